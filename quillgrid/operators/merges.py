"""Merged cells of table bodies: inferred from blank cells, written out as spans, and taken back.

A body is rows of a unit: row (from 0 without gaps) and cells, an array of text; columns is one array of names for each unit. Each
blank cell below a text belongs to one run; what columns hold and what a row says come from joins and aggregates, and where the
runs of a unit end and what merges hide are told unit by unit within tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dashes that stand for a blank cell.
DASHES = ("", "—", "–", "-", "−", "‒")
# Fixed patterns: names of columns that hold labels, names that are never broken at, and labels of sums.
LABEL_NAMES = r"^(?:sl\.?\s*no\.?|s\.?\s*no\.?|sno|item|name|indicator|state|district|disease|particulars|description|category|sector|occupation|education|sex)$|name of|local body|disease|district"
SEX_NAMES = ("sex", "gender")
SUM_LABELS = r"^(?:all|total|overall|aggregate|grand\s*total)$|^(?:all|total)\s*[(:]"
# The share of numbers that a label column has at most, and of blank cells that a sparse one has at least.
NUMBERS, BLANKS, DISTINCT = 0.35, 0.12, 0.75


def shown(cell: Column) -> Column:
    """A cell's trimmed text; null where it is blank or a dash."""
    text = F.trim(cell)
    return F.when(text.isin(*DASHES), F.lit(None)).otherwise(text)


def is_plain_figure(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[,%*]", "")).rlike(r"^-?[0-9]+(?:\.[0-9]+)?$")


def is_sum(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(SUM_LABELS), F.lit(False))


def column_roles(body: DataFrame, unit: str) -> DataFrame:
    """unit, label, sparse, dense and open: for each column whether it holds labels, labels with gaps, labels that mostly differ, figures with gaps; last_row."""
    each = body.select(unit, "row", "names", F.posexplode("said").alias("col", "v"))
    per_value = each.groupBy(unit, "col", F.get("names", F.col("col")).alias("name"), F.lower("v").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("last"))
    found = per_value.groupBy(unit, "col", F.lower(F.coalesce("name", F.lit(""))).alias("name")).agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("low").isNull(), F.col("n"))), F.lit(0)).alias("blank"),
        F.coalesce(F.sum(F.when(is_plain_figure(F.col("low")), F.col("n"))), F.lit(0)).alias("figures"),
        F.count("low").alias("distinct"),
        F.max("last").alias("last"),
    )
    said = F.col("rows") - F.col("blank")
    label = F.col("name").rlike(LABEL_NAMES) | ((said >= 1) & (F.col("figures") <= NUMBERS * said))
    gaps = (F.col("blank") >= 1) & (F.col("blank") >= BLANKS * F.col("rows")) & (said > 0)
    told = label & ~F.col("name").isin(*SEX_NAMES)
    dense = told & ~gaps & (said >= 2) & (F.col("distinct") >= F.greatest(F.lit(3), F.ceil(DISTINCT * said)))
    roles = F.array_sort(F.collect_list(F.struct("col", label.alias("label"), (told & gaps).alias("sparse"), dense.alias("dense"), (~label & gaps).alias("open"))))
    return found.groupBy(unit).agg(roles.alias("r"), F.max("last").alias("last_row")).select(unit, *(F.col(f"r.{k}").alias(k) for k in ("label", "sparse", "dense", "open")), "last_row")


def run_from(fits: list[bool], at: int) -> int:
    """How many entries are true in a row from a place on."""
    end = at
    while end < len(fits) and fits[end]:
        end += 1
    return max(0, end - at)


def runs_of(body: list[dict], label: list[bool], sparse: list[bool], dense: list[bool], opened: list[bool]) -> Iterator[tuple[int, int, int, int]]:
    """row, col, row_span and col_span of the merged cells of one unit; body: its rows in order, each with row, low (texts, none where blank), sums (which of them sum up), first_label, foot and section."""
    lows, figure = [r["low"] for r in body], [not x for x in label]
    telling = [(c, sparse[c]) for c in range(len(label)) if sparse[c] or dense[c]]

    def breaks(i: int, start: int, col: int) -> bool:
        if body[i]["foot"] or (body[i]["first_label"] is not None and body[i]["first_label"] < col):
            return True
        now, was = lows[i], lows[start]
        return any(c != col and now[c] is not None and now[c] != was[c] and (gaps or body[i]["sums"][c] or body[start]["sums"][c]) for c, gaps in telling)

    def beside(i: int, col: int, fits: list[bool]) -> int:
        return run_from([v is None and x for v, x in zip(lows[i], fits)], col)

    for col in (c for c in range(len(label)) if label[c] or opened[c]):
        begun = [i for i, low in enumerate(lows) if low[col] is not None]
        for start, end in zip(begun, [*begun[1:], len(body)]):
            stop = next((i for i in range(start + 1, end) if breaks(i, start, col)), end) if label[col] else end
            wide = 1
            if label[col]:
                if not body[start]["first_label"] < col:
                    wide += min(beside(i, col + 1, label) for i in range(start, stop))
                if stop - start == 1 and body[start]["section"]:
                    wide += beside(start, col + wide, figure)
            if stop - start > 1 or wide > 1:
                yield body[start]["row"], col, stop - start, wide


def inferred(rows: DataFrame, columns: DataFrame, unit: str) -> DataFrame:
    """unit, row, col, row_span and col_span of each merged cell that blank cells suggest.

    A label runs down over blank cells until one to its left begins something, a sibling label changes (any value of a column
    with gaps; to or from a sum in one whose labels mostly differ), or the last row sums up; then right over label columns
    that are blank beside all of it. A label in a row without figures runs on over them. A figure with gaps below runs down
    to the next one. columns: unit and names. Units without label columns, rows or columns have none.
    """
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.size("names"))), F.lit(1), F.size("names"))
    body = rows.join(columns.where(F.size("names") > 0), unit).select(unit, "row", "names", F.transform(F.coalesce(padded, F.array_repeat(F.lit(None).cast("string"), F.size("names"))), shown).alias("said"))
    roles = column_roles(body, unit).where(F.exists("label", lambda x: x))
    whole = body.join(roles, unit)
    labelled = F.zip_with("said", "label", lambda v, is_label: v.isNotNull() & is_label)
    whole = whole.withColumn("first_label", F.nullif(F.array_position(labelled, True), F.lit(0)) - 1)
    sums = F.exists(F.zip_with("said", "label", lambda v, is_label: is_label & is_sum(v)), lambda x: x)
    no_figures = F.exists("label", lambda x: ~x) & F.forall(F.zip_with("said", "label", lambda v, is_label: is_label | v.isNull()), lambda x: x)
    wordy = F.exists(F.zip_with("said", "label", lambda v, is_label: is_label & v.isNotNull() & ~F.coalesce(is_plain_figure(v), F.lit(False))), lambda x: x)
    whole = whole.withColumns({"foot": sums & (F.col("row") == F.col("last_row")), "section": no_figures & wordy})
    low, sum_of = F.transform("said", lambda v: F.lower(v)), F.transform("said", is_sum)
    each = F.struct("row", low.alias("low"), sum_of.alias("sums"), F.col("first_label").cast("int").alias("first_label"), "foot", "section")
    kinds = ("label", "sparse", "dense", "open")
    bodies = whole.groupBy(unit).agg(F.array_sort(F.collect_list(each)).alias("body"), *(F.first(c).alias(c) for c in kinds))
    like = rows.select(unit, "row", *(F.lit(0).alias(c) for c in ("col", "row_span", "col_span"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *m) for i, told in enumerate(zip(*(batch.column(c).to_pylist() for c in ("body", *kinds)))) for m in runs_of(*told)]
            units, *rest = zip(*found) if found else [()] * 5
            types = (batch.schema.field("body").type.value_type.field("row").type, pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(unit).take(pa.array(units, pa.int64())), *(pa.array(x, t) for x, t in zip(rest, types))], [unit, "row", "col", "row_span", "col_span"])

    return bodies.mapInArrow(run, like)


def laid_over(n_rows: int, n_cols: int, merges: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, col, row_span and col_span of what is visible of a grid under merges (the same four) in their order, of which one that begins in a cell of an accepted one doesn't count."""
    claimed, hidden = np.zeros((n_rows, n_cols), bool), np.zeros((n_rows, n_cols), bool)
    high, wide = np.ones((n_rows, n_cols), np.int32), np.ones((n_rows, n_cols), np.int32)
    for row, col, h, w in merges:
        if not claimed[row, col]:
            first = hidden[row, col]
            claimed[row : row + h, col : col + w] = hidden[row : row + h, col : col + w] = True
            hidden[row, col], high[row, col], wide[row, col] = first, h, w
    rows, cols = np.nonzero(~hidden)
    return rows, cols, high[rows, cols], wide[rows, cols]


#: Visible cells that are given back at once.
CELLS = 1 << 18


def cell_spans(merges: DataFrame, sizes: DataFrame, unit: str) -> DataFrame:
    """unit, row, col, row_span and col_span of each visible cell; cells that a merge covers have no row.

    merges: unit, ord, row, col, row_span and col_span (below one count as one); sizes: unit (each once), n_rows and n_cols. Of
    merges that overlap the one with the lower ord comes first: a merge that begins in a covered cell doesn't count. Merges that
    begin outside are left out, and cells outside are none. A unit's merges meet its size once, and its grid is laid out in a task.
    """
    merges = merges.where("row >= 0 and col >= 0")
    names = ("row", "col", "row_span", "col_span")
    each = F.struct("ord", *(F.greatest(F.lit(1), F.coalesce(F.col(c).cast("int"), F.lit(1))).alias(c) if c.endswith("span") else F.col(c).cast("int").alias(c) for c in names))
    all_of = merges.groupBy(unit).agg(F.array_sort(F.collect_list(each)).alias("merges"))
    fields = (F.col(f"merges.{c}").alias(c) for c in names)
    grids = sizes.where("n_rows > 0 and n_cols > 0").select(unit, F.col("n_rows").cast("int").alias("n_rows"), F.col("n_cols").cast("int").alias("n_cols")).join(all_of, unit, "left").select(unit, "n_rows", "n_cols", *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, found, cells = [], [], 0
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("row")), 0).to_numpy(zero_copy_only=False)).tolist()
            flat = list(zip(*(batch.column(c).flatten().to_pylist() for c in names)))
            for i, (n_rows, n_cols) in enumerate(zip(batch.column("n_rows").to_pylist(), batch.column("n_cols").to_pylist())):
                inside = [m for m in flat[ends[i - 1] if i else 0 : ends[i]] if m[0] < n_rows and m[1] < n_cols]
                found.append(laid_over(n_rows, n_cols, inside))
                units.append(np.full(len(found[-1][0]), i))
                cells += len(units[-1])
                if cells >= CELLS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(unit).take(pa.array(np.concatenate(units))), *(pa.array(np.concatenate(x).astype(np.int32)) for x in zip(*found))], [unit, *names])
                    units, found, cells = [], [], 0

    return grids.mapInArrow(run, grids.select(unit, *(F.lit(0).alias(c) for c in names)).schema)


def merges_of(spans: DataFrame) -> DataFrame:
    """The merged cells among spans, as cell_spans() gives them."""
    return spans.where("row_span > 1 or col_span > 1")


def unmerged(merges: DataFrame, cells: DataFrame, unit: str) -> DataFrame:
    """merges without those that cover the first cell of a merge over a cell of cells (unit, row and col)."""
    def over(a: str, row: str, col: str) -> Column:
        return F.col(row).between(F.col(f"{a}.row"), F.col(f"{a}.row") + F.col(f"{a}.row_span") - 1) & F.col(col).between(F.col(f"{a}.col"), F.col(f"{a}.col") + F.col(f"{a}.col_span") - 1)

    asked = cells.select(unit, F.col("row").alias("at_row"), F.col("col").alias("at_col"))
    first = merges.alias("m").join(asked.alias("c"), unit).where(over("m", "at_row", "at_col")).select(unit, F.col("m.row").alias("first_row"), F.col("m.col").alias("first_col")).distinct()
    gone = merges.alias("m").join(first.alias("f"), unit).where(over("m", "first_row", "first_col")).select(unit, F.col("m.row").alias("row"), F.col("m.col").alias("col"), F.col("m.row_span").alias("row_span"), F.col("m.col_span").alias("col_span"))
    return merges.join(gone.distinct(), [unit, "row", "col", "row_span", "col_span"], "left_anti")
