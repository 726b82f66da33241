"""Rows that a reader has stacked into one, taken apart again: labels by their wraps, sexes by pairs, figures line by line.

A grid is rows of a unit: row (from 0) and cells, an array of text with line breaks. What a row becomes depends on the row, the next
one and the unit's column of sexes, so it takes windows over neighbours and expressions over single rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions import cells as C
from quillgrid.functions import stacks as S
from quillgrid.session import dealt


def with_sex_column(rows: DataFrame, unit: str) -> DataFrame:
    """rows with sex_col: the first column headed sex or gender in their unit's first six rows, else the one with most stacked sexes."""
    along = W.partitionBy(unit)

    def stacked(c: Column, i: Column) -> Column:
        return S.let({"n": F.size(S.sexes(c))}, lambda x: F.when(x["n"] >= 2, F.struct((-x["n"]).alias("n"), F.col("row"), i.alias("col"))))

    named = F.transform("cells", lambda c, i: F.when((F.col("row") < 6) & F.lower(C.canonical(c)).isin("sex", "gender"), F.struct(F.col("row"), i.alias("col"))))
    told = rows.withColumns({"_head": F.array_min(named), "_most": F.array_min(F.transform("cells", stacked))})
    return told.withColumn("sex_col", F.coalesce(F.min("_head").over(along)["col"], F.min("_most").over(along)["col"])).drop("_head", "_most")


def most_lines(cells: Column, after: Column) -> Column:
    """The most lines of figures of any cell behind a column."""
    rest = F.slice(cells, after + 2, F.size(cells))
    return F.coalesce(F.array_max(F.transform(rest, lambda c: F.size(S.measures(c)))), F.lit(0))


def with_continuations(rows: DataFrame, unit: str) -> DataFrame:
    """rows with the figures of a row that only goes on joined to the row with its labels and sexes before it.

    rows: unit, row, cells and sex_col. A row goes on if its columns up to the sexes are blank (of sexes it may have one) and its
    lines and those before come within two of the sexes.
    """
    along = W.partitionBy(unit).orderBy("row")
    n = F.when(F.col("sex_col").isNotNull(), F.size(S.sexes(F.get("cells", F.col("sex_col"))))).otherwise(0)
    known = rows.withColumns({"_n": n, "_lines": F.when(F.col("sex_col").isNotNull(), most_lines(F.col("cells"), F.col("sex_col"))).otherwise(0)})
    blank = F.forall(F.slice("cells", F.lit(1), F.coalesce("sex_col", F.lit(0))), lambda c: C.canonical(c) == "")
    known = known.withColumn("_bare", blank & (F.col("_n") < 2) & (F.col("_lines") >= 2) & F.col("sex_col").isNotNull())
    after, more = F.lead("_lines").over(along), F.lead("_bare").over(along)
    total = F.col("_lines") + after
    takes = (F.col("_n") >= 2) & (F.col("_lines") < F.col("_n")) & F.coalesce(more, F.lit(False)) & (total >= F.greatest(F.lit(2), F.col("_n") - 2)) & (total <= F.col("_n") + 2)
    known = known.withColumns({"_takes": takes, "_next": F.lead("cells").over(along)})
    known = known.withColumn("_gone", F.coalesce(F.lag("_takes").over(along), F.lit(False))).where("not _gone")
    joined = F.transform("cells", lambda c, i: F.when(i > F.col("sex_col"), F.nullif(F.array_join(F.concat(S.lines(c), S.lines(F.get("_next", i))), "\n"), F.lit(""))).otherwise(c))
    return known.select(unit, "row", F.when(F.col("_takes"), joined).otherwise(F.col("cells")).alias("cells"), "sex_col")


def rows_held(cells: Column, sex_col: Column) -> Column:
    """How many rows a row holds: the middle line count of its stacks of figures, or its sexes; 1 for a plain row."""
    def stack(c: Column) -> Column:
        def of(x: Column) -> Column:
            numbers = F.size(F.filter(x["parts"], lambda p: S.is_number(F.substring_index(p, "\n", 1))))
            return F.when((F.size(x["parts"]) >= 2) & (numbers >= F.greatest(F.lit(2), F.floor(0.6 * F.size(x["parts"])))), F.size(x["parts"]))

        return S.let({"parts": S.measures(c)}, of)

    counts = F.array_sort(F.filter(F.transform(cells, lambda c, i: F.when(sex_col.isNull() | (i != sex_col), stack(c))), lambda n: n.isNotNull()))
    figures = S.let({"counts": counts}, lambda x: F.coalesce(F.get(x["counts"], F.floor(F.size(x["counts"]) / 2).cast("int")), F.lit(0)))
    told = F.when(sex_col.isNotNull(), F.size(S.sexes(F.get(cells, sex_col)))).otherwise(0)

    def several(c: Column) -> Column:
        flat = C.canonical(c)
        return (F.size(S.measures(c)) >= 2) | F.contains(flat, F.lit(" ")) | flat.rlike("^[0-9]{2,}$")

    others = F.exists(F.transform(cells, lambda c, i: (i != sex_col) & several(c)), lambda x: x)
    return S.let({"figures": figures, "told": told}, lambda x: F.when(x["figures"] >= 2, F.greatest(x["figures"], x["told"])).when((x["told"] >= 2) & F.coalesce(others, F.lit(False)), x["told"]).otherwise(1))


def is_label_stack(cell: Column, n: Column) -> Column:
    """Whether a cell of a grid without sexes holds stacked labels rather than figures."""
    def of(x: Column) -> Column:
        size, numbers, flat = F.size(x["parts"]), F.size(F.filter(x["parts"], S.is_number)), x["flat"]
        few = (numbers < F.greatest(F.lit(2), F.floor(0.5 * size))) & ((size > n) | (numbers <= F.greatest(F.lit(1), F.floor(0.25 * size))))
        return F.when(size < 2, (flat != "") & ~S.is_number(flat) & F.contains(flat, F.lit(" "))).otherwise(few)

    return S.let({"parts": S.lines(cell), "flat": C.canonical(cell)}, of)


def labels(cell: Column, n: Column, told: Column) -> Column:
    """A cell before the sexes on n rows: on M rows where sexes pair up, else by wraps."""
    def of(x: Column) -> Column:
        parts, digits, men = x["parts"], x["digits"], x["men"]
        m, every = F.size(men), F.forall(told, lambda s: s.isNotNull())
        paired = every & (m > 0) & (n == 2 * m) & F.forall(men, lambda i: i % 2 == 0)
        places = F.sequence(F.lit(0), n - 1)
        on_men = F.transform(places, lambda i: F.when(F.array_contains(men, i), F.get(parts, (F.array_position(men, i) - 1).cast("int"))))
        each_digit = F.transform(places, lambda i: F.when(i % 2 == 0, F.substring(digits, (i / 2 + 1).cast("int"), F.lit(1))))
        one_each = (F.size(parts) == 1) & digits.rlike("^[0-9]+$") & (F.length(digits) == m)
        by_place = F.when((m > 0) & (F.size(parts) == m) & (F.size(parts) != n), on_men).otherwise(S.padded(parts, n))
        unpaired = F.when((m > 0) & (F.size(parts) <= m), on_men).otherwise(S.labels_on_rows(parts, n))
        return F.when(paired & one_each, each_digit).when(paired, S.labels_on_pairs(parts, m)).when(every, by_place).otherwise(unpaired)

    men = F.filter(F.transform(told, lambda s, i: F.when(s == "M", i)), lambda i: i.isNotNull())
    return S.let({"parts": S.lines(cell), "digits": F.replace(C.canonical(cell), F.lit(" "), F.lit("")), "men": men}, of)


def expanded(rows: DataFrame, unit: str) -> DataFrame:
    """unit, row and cells of each row once stacked rows are apart; rows are numbered anew from 0.

    Units of fewer than three columns stay as they are, and so do rows that hold one row only. Null arrays are blank rows.
    """
    # One dealing by unit serves all windows below; a null unit is none.
    held = dealt(rows.where(F.col(unit).isNotNull()).select(unit, "row", F.coalesce(F.col("cells"), S.none()).alias("cells")), unit)
    whole = held.withColumn("w", F.max(F.size("cells")).over(W.partitionBy(unit))).withColumn("cells", S.padded(F.col("cells"), F.col("w")))
    whole = with_sex_column(whole, unit).withColumn("sex_col", F.when(F.col("w") >= 3, F.col("sex_col"))).drop("w")
    merged = with_continuations(whole, unit)
    n = F.when(F.size("cells") >= 3, rows_held(F.col("cells"), F.col("sex_col"))).otherwise(1)
    counted = merged.withColumn("n", n.cast("int")).withColumn("told", F.when(F.col("n") > 1, F.when(F.col("sex_col").isNotNull(), S.sexes_on_rows(F.get("cells", F.col("sex_col")), F.col("n"))).otherwise(S.padded(S.none(), F.col("n")))))
    rows_n, sex = F.col("n"), F.col("sex_col")
    columns = F.transform(
        "cells",
        lambda c, i: F.when(i == sex, F.col("told"))
        .when(i < sex, labels(c, rows_n, F.col("told")))
        .when(sex.isNull() & is_label_stack(c, rows_n), S.labels_on_rows(S.lines(c), rows_n))
        .otherwise(S.figures_on_rows(c, rows_n)),
    )
    # Rows that hold one row only take the same way, so that what comes before is computed once.
    each = F.when(rows_n > 1, columns).otherwise(F.transform("cells", lambda c: F.array(c)))
    spread = counted.select(unit, "row", "sex_col", rows_n, each.alias("columns")).select(unit, "row", "sex_col", "columns", F.explode(F.sequence(F.lit(0), F.greatest(rows_n, F.lit(1)) - 1)).alias("part"))
    spread = spread.select(unit, "row", "part", "sex_col", F.transform("columns", lambda c: F.get(c, F.col("part"))).alias("cells"))
    numbered = spread.withColumn("row", F.row_number().over(W.partitionBy(unit).orderBy("row", "part")) - 1)
    return labels_set_back(numbered, unit).select(unit, "row", "cells")


def labels_set_back(rows: DataFrame, unit: str) -> DataFrame:
    """rows with labels that slipped onto an F row moved to the M row after it, where that has none or only their end.

    rows: unit, row, cells and sex_col. The row before, if any, is an M row; a line that goes on with a label stays.
    """
    along = W.partitionBy(unit).orderBy("row")
    sex = F.upper(C.canonical(F.get("cells", F.col("sex_col"))))
    known = rows.withColumn("_sex", F.when(F.col("sex_col") >= 1, sex))
    slips = (F.col("_sex") == "F") & (F.lead("_sex").over(along) == "M") & ((F.row_number().over(along) == 1) | (F.lag("_sex").over(along) == "M"))
    known = known.withColumns({"_slips": F.coalesce(slips, F.lit(False)), "_after": F.lead("cells").over(along), "_before": F.lag("cells").over(along)})
    known = known.withColumn("_gets", F.coalesce(F.lag("_slips").over(along), F.lit(False)))

    def moves(label: Column, after: Column) -> Column:
        own, next_ = C.canonical(label), C.canonical(after)
        return (own != "") & ~S.continues(own, F.lit("")) & ((next_ == "") | S.continues(next_, F.lit("")))

    def mended(c: Column, i: Column) -> Column:
        gone = F.col("_slips") & (i < F.col("sex_col")) & moves(c, F.get("_after", i))
        got = F.col("_gets") & (i < F.col("sex_col")) & moves(F.get("_before", i), c)
        return F.when(gone, F.lit(None).cast("string")).when(got, F.trim(F.concat_ws(" ", C.canonical(F.get("_before", i)), F.nullif(C.canonical(c), F.lit(""))))).otherwise(c)

    return known.withColumn("cells", F.transform("cells", mended))
