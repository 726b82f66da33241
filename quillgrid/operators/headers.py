"""Header rows of printed grids, of any depth, and the column paths that they spell.

A grid is rows of one unit: row (from 0 without gaps, blank rows counted) and cells, an array of text. Which
rows head the columns is told by facts of each row and of the first header row, so it takes windows over the
ten rows at a unit's top; nothing below them is sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions import cells as C
from quillgrid.session import unsent

# Rows that are looked at, and header levels that are taken at most.
TOP_ROWS, MOST_LEVELS = 10, 8
# Words of which one is in a spanning header whose codes are known although their row is lost.
CODED_GROUPS = ("birth order", "order", "education", "sex", "gender", "religion", "marital", "literacy", "qualification", "occupation")


def how_many(cells: Column, test) -> Column:
    return F.size(F.filter(cells, test))


def column_kinds(cells: Column) -> Column:
    """For each cell of a top header row: span if blank, group if it spans others, stub if it heads its own column.

    A cell spans others where a blank one follows it, or an equal one stands beside it.
    """
    def kind(cell: Column, i: Column) -> Column:
        after, before = F.get(cells, i + 1), F.when(i > 0, F.get(cells, i - 1))
        beside = (after == "") | (F.upper(after) == F.upper(cell)) | (F.upper(before) == F.upper(cell))
        return F.when(cell == "", "span").when(F.coalesce(beside, F.lit(False)), "group").otherwise("stub")

    return F.transform(cells, kind)


def is_full_banner(cells: Column) -> Column:
    """Whether one text stands for a whole row of two cells or more: alone, or repeated and long or a table's number."""
    said = F.filter(cells, lambda c: c != "")
    n, width, label = F.size(said), F.size(cells), F.get(said, F.lit(0))
    one_text = F.size(F.array_distinct(F.transform(said, F.upper))) == 1
    most = n >= F.greatest(F.lit(2), F.floor(0.6 * width))
    repeated = (most & (label.rlike(C.TABLE_NUMBER) | (F.length(label) >= 28))) | (label.rlike(C.TABLE_NUMBER) & (n >= 0.5 * width))
    return (width >= 2) & one_text & ((n == 1) | repeated)


def is_index_strip(cells: Column) -> Column:
    """Whether a row only numbers the columns: (1) (2) (3), or 1 2 3 over most of the width."""
    said = F.filter(cells, lambda c: c != "")
    bracketed = how_many(said, lambda c: c.rlike(r"^\([0-9]+\)$"))
    counting = F.forall(F.transform(said, lambda c, i: c.rlike("^[0-9]{1,2}$") & (c.try_cast("int") == i + 1)), lambda ok: ok)
    return (bracketed > 0.5 * F.size(said)) | ((F.size(said) >= F.greatest(F.lit(3), F.floor(0.6 * F.size(cells)))) & F.coalesce(counting, F.lit(False)))


def row_facts(cells: Column) -> dict[str, Column]:
    """Counts of a row's cells by what they hold, and what the row is by itself."""
    said = F.filter(cells, lambda c: c != "")
    n = F.size(said)
    numbers, counts = how_many(said, lambda c: C.size_of(c).isNotNull()), how_many(said, C.is_count)
    short, codes = how_many(said, lambda c: F.length(c) <= C.CODE_LENGTH), how_many(said, C.is_code)
    repeated_number = (F.size(F.array_distinct(said)) == 1) & C.size_of(F.get(said, F.lit(0))).isNotNull()
    return {
        "n": n,
        "counts": counts,
        "long": n - short,
        "medium": how_many(said, lambda c: F.length(c) <= 40),
        "labels": (n > 0) & (numbers <= 0.35 * n) & (counts == 0),
        "figures": (counts >= 2) & (numbers >= F.greatest(F.lit(2), F.floor(0.5 * n))),
        "coded": (n >= 2) & (short >= 0.75 * n) & (counts < 2) & ~repeated_number & ~((n > short) & (counts > 0)) & (codes >= F.greatest(F.lit(2), F.floor(0.55 * n))),
        "banner": is_full_banner(cells),
        "strip": (n > 0) & is_index_strip(cells),
    }


def under_root(cells: Column, root: Column) -> dict[str, Column]:
    """How a row stands to the first header row: cells of its own in stub columns, blank ones there, codes below groups."""
    met = F.zip_with(F.zip_with(cells, root["cells"], lambda c, p: F.struct(c.alias("c"), p.alias("p"))), root["kinds"], lambda x, k: F.struct(x["c"].alias("c"), x["p"].alias("p"), k.alias("k")))
    return {
        "own": how_many(met, lambda x: (x["k"] == "stub") & (x["c"] != "") & (F.upper(x["c"]) != F.upper(x["p"]))),
        "open": how_many(met, lambda x: (x["k"] == "stub") & (x["c"] == "")),
        "below": how_many(met, lambda x: (x["k"] == "group") & C.is_code(x["c"])),
    }


def top_rows(rows: DataFrame, unit: str, row: str, cells: str) -> DataFrame:
    """unit, row, cells (canonical, as many as the unit's widest row has) and role of a unit's first rows.

    role: header, skipped (banners and column numbers above the body) or body. header_count is how many
    leading rows the header takes, skipped ones among them. A unit without labels on top has its first row that isn't
    blank as header. Null cells are blank ones; a null array is a blank row.
    """
    held = F.coalesce(F.col(cells), F.array().cast("array<string>"))
    width = rows.groupBy(unit).agg(F.greatest(F.max(F.size(held)), F.lit(1)).alias("_width"))
    top = rows.where(F.col(row) < TOP_ROWS).select(unit, F.col(row).alias("row"), held.alias("_held")).join(unsent(width), unit)
    top = top.select(unit, "row", F.transform(F.slice(F.concat("_held", F.array_repeat(F.lit(None).cast("string"), F.col("_width"))), F.lit(1), F.col("_width")), C.canonical).alias("cells"))
    top = top.withColumns(row_facts(F.col("cells"))).withColumn("kinds", column_kinds(F.col("cells")))
    in_unit = W.partitionBy(unit).orderBy("row")
    whole = in_unit.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    body = ~F.col("banner") & (F.col("figures") | (F.col("counts") >= 2))
    seen = F.coalesce(F.max(body).over(in_unit.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    top = top.withColumn("skipped", ~seen & (F.col("banner") | (~body & F.col("strip"))))
    root = F.first(F.when(~F.col("skipped"), F.struct("row", "cells", "kinds")), ignorenulls=True).over(whole)
    top = top.withColumn("root", root)
    top = top.withColumns(under_root(F.col("cells"), F.col("root")))
    figures = F.col("figures") | ((F.col("own") > 0) & ((F.col("counts") > 0) | (F.col("long") > 0))) | (F.col("own") >= 2)
    sparse = F.col("labels") & (F.col("n") <= 0.85 * F.size("cells")) & (F.col("own") == 0)
    codes = F.col("coded") & (F.col("own") == 0) & ((F.col("open") > 0) | (F.col("below") > 0))
    level = (F.col("n") > 0) & (F.col("counts") < 2) & (F.col("own") == 0) & (F.col("medium") >= F.greatest(F.lit(1), F.floor(0.7 * F.col("n"))))
    fits = F.when(F.col("row") == F.col("root.row"), F.col("labels")).otherwise((F.col("n") > 0) & ~figures & (sparse | codes | level))
    live = ~F.col("skipped")
    nth = F.sum(live.cast("int")).over(in_unit)
    top = top.withColumn("_ends", live & ~(F.coalesce(fits, F.lit(False)) & (nth <= MOST_LEVELS)))
    top = top.withColumn("_head", live & ~F.max("_ends").over(in_unit.rowsBetween(W.unboundedPreceding, 0)))
    count = F.coalesce(F.max(F.when(F.col("_head"), F.col("row"))).over(whole), F.min(F.when(live & (F.col("n") > 0), F.col("row"))).over(whole), F.lit(0)) + 1
    role = F.when(F.col("skipped") & (F.col("row") < count), "skipped").when(F.col("row") < count, "header").when(F.col("skipped"), "skipped").otherwise("body")
    return top.select(unit, "row", "cells", "kinds", "banner", role.alias("role"), count.cast("int").alias("header_count"))


def filled_header(cells: DataFrame, unit: str) -> DataFrame:
    """cells with each header label filled down its column first, then right along its row.

    cells: unit, row, col and label (canonical texts). A label spans the blank rows below it, then the blank columns beside it.
    """
    down = F.last(F.nullif("label", F.lit("")), ignorenulls=True).over(W.partitionBy(unit, "col").orderBy("row").rowsBetween(W.unboundedPreceding, 0))
    right = F.last("_down", ignorenulls=True).over(W.partitionBy(unit, "row").orderBy("col").rowsBetween(W.unboundedPreceding, 0))
    return cells.withColumn("_down", down).withColumn("label", right).drop("_down")


def column_paths(top: DataFrame, unit: str) -> DataFrame:
    """unit, col, header_path (from the top label to the column's own), header_group, name and display of each column.

    top: what top_rows() gives. Repeated labels along a path count once, a table's number isn't part of it, and a stub column
    keeps its own label only. A column without labels is Col_1, Col_2 and so on by its place. display joins the path;
    unique_name tells repeated displays of a unit apart by (2), (3) and so on. header_count is the unit's.
    """
    head = top.where("role = 'header'")
    whole = W.partitionBy(unit)
    head = head.withColumn("_only_banners", F.min("banner").over(whole)).where(~F.col("banner") | F.col("_only_banners"))
    # The kinds of the first header row go along with its cells, so that nothing is computed twice.
    head = head.withColumn("_kinds", F.first("kinds").over(whole.orderBy("row").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    cells = head.select(unit, "row", "header_count", F.posexplode(F.zip_with("cells", "_kinds", lambda c, k: F.struct(c.alias("label"), k.alias("kind")))).alias("col", "x"))
    cells = filled_header(cells.select(unit, "row", "header_count", "col", "x.label", "x.kind"), unit)
    label = F.array_sort(F.collect_list(F.struct("row", "label")))
    paths = cells.groupBy(unit, "col").agg(F.transform(label, lambda x: x["label"]).alias("path"), F.first("kind").alias("kind"), F.max("header_count").alias("header_count"))
    said = F.filter("path", lambda x: x.isNotNull() & ~x.rlike(C.TABLE_NUMBER))
    paths = paths.select(unit, "col", "kind", "header_count", said.alias("path"))
    once = F.filter("path", lambda x, i: (i == 0) | (F.upper(x) != F.upper(F.get("path", i - 1))))
    joined = paths.select(unit, "col", "kind", "header_count", F.when(F.size("path") > 0, once).otherwise(F.array(F.concat(F.lit("Col_"), (F.col("col") + 1).cast("string")))).alias("path"))
    top_label, own = F.get("path", F.lit(0)), F.element_at("path", -1)
    alone = (F.col("kind") == "stub") & (F.upper(top_label) != F.upper(own))
    joined = joined.withColumn("path", F.when(alone, F.slice("path", 1, 1)).otherwise(F.col("path")))
    path = with_lost_codes(joined, unit)
    name = path.select(unit, "col", F.col("path").alias("header_path"), F.when(F.size("path") > 1, F.element_at("path", -2)).alias("header_group"), F.element_at("path", -1).alias("name"), F.array_join("path", " / ").alias("display"), "header_count")
    nth = F.row_number().over(W.partitionBy(unit, "display").orderBy("col"))
    return name.withColumn("unique_name", F.when(nth > 1, F.concat("display", F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise(F.col("display")))


def with_lost_codes(paths: DataFrame, unit: str) -> DataFrame:
    """paths with the codes 1 to 8, >8, All, 10 and so on below a group that only repeats its label over its columns.

    paths: unit, col, kind, path and header_count. Only groups named for what such codes divide get them, in two columns or more.
    """
    along = W.partitionBy(unit).orderBy("col")
    run = F.sum((F.col("kind") != "span").cast("int")).over(along)
    of_run = W.partitionBy(unit, "_run")
    label = F.get("path", F.lit(0))
    named = F.lower(label).rlike(r"\b(?:" + "|".join(w.replace(" ", r"\s*") for w in CODED_GROUPS) + r")\b") & (F.length(label) <= 48) & ((F.length(label) >= 8) | F.contains(label, F.lit(" ")))
    at = F.row_number().over(of_run.orderBy("col"))
    code = F.when(at <= 8, at.cast("string")).when(at == 9, ">8").when(at == 10, "All").otherwise((at - 1).cast("string"))
    same = (F.min(F.upper(label)).over(of_run) == F.max(F.upper(label)).over(of_run)) & (F.max(F.size("path")).over(of_run) == 1)
    lost = same & (F.count(F.lit(1)).over(of_run) >= 2) & (F.max((F.col("kind") == "group").cast("int")).over(of_run) == 1) & named
    return paths.withColumn("_run", run).select(unit, "col", "header_count", F.when(lost, F.array(label, code)).otherwise(F.col("path")).alias("path"))


def headers_resolved(rows: DataFrame, unit: str, row: str, cells: str) -> DataFrame:
    """column_paths() of each unit of rows, with header_count. A unit of blank rows only has columns by place."""
    return column_paths(top_rows(rows, unit, row, cells), unit)
