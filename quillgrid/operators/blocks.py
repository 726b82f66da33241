"""Sheets into blocks, one for each table, by the strongest evidence that a sheet gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions.labels import is_columnar_header
from quillgrid.operators.grid import blocks_by_gap

# Fixed patterns: a table's number by itself, and behind the word for table; and how long either may be.
SHORT_CODE, NAMED_CODE = r"(?i)^(?:TABLE\s*[:.\-–—]?\s*)?[A-Z]{1,3}\s*[-–—]?\s*\d+(?:\.\d+)?\s*$", r"(?i)^TABLE\s*[:.\-–—]\s*[A-Z0-9]"
SHORT, NAMED, PROSE = 40, 48, 48


def said(cells: Column) -> Column:
    return F.filter(F.transform(F.coalesce(cells, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: F.coalesce(c, F.lit("")) != "")


def only_label(cells: Column) -> Column:
    """The one text that a row says, once or over and over; null for any other row."""
    texts = said(cells)
    return F.when(F.size(F.array_distinct(F.transform(texts, F.upper))) == 1, F.get(texts, F.lit(0)))


def is_marker(cells: Column) -> Column:
    """Whether a row only says a table's number, and so begins a block."""
    label = only_label(cells)
    return F.coalesce(((F.length(label) <= SHORT) & label.rlike(SHORT_CODE)) | ((F.length(label) <= NAMED) & label.rlike(NAMED_CODE)), F.lit(False))


def is_note(cells: Column) -> Column:
    """Whether a row is prose of one or two cells, as below a table."""
    texts = said(cells)
    return F.size(texts).between(1, 2) & (F.length(F.array_join(texts, " ")) > PROSE) & ~is_columnar_header(texts) & ~is_marker(cells)


def chosen_blocks(rows: DataFrame, unit: str) -> DataFrame:
    """The rows of each sheet's blocks, with block, its number from 0, and chosen_by.

    rows: unit, row (from 0 without gaps) and cells. Rows that only say a table's number begin blocks, which end before blank rows and
    notes at their ends and have a second row at least ("marker"). Without such blocks, runs between two blank rows or more are
    blocks if two of them have a label on top and a header in the five rows behind it ("gap"). Else the sheet is one
    block from its first row that isn't blank to its last ("whole"). Blank sheets have none.
    """
    known = rows.select(unit, "row", "cells", (F.size(said(F.col("cells"))) == 0).alias("blank"), is_marker(F.col("cells")).alias("marker"), is_note(F.col("cells")).alias("note"), only_label(F.col("cells")).isNotNull().alias("labelled"), is_columnar_header(said(F.col("cells"))).alias("columnar"))
    along = W.partitionBy(unit).orderBy("row")

    numbered = known.withColumn("run", F.sum(F.col("marker").cast("int")).over(along)).where("run > 0")
    of_run = W.partitionBy(unit, "run")
    ends = F.max(F.when(~F.col("blank") & ~F.col("note"), F.col("row"))).over(of_run)
    marked = numbered.withColumns({"first": F.min("row").over(of_run), "last": ends}).where("last > first and row <= last")
    marked = marked.select(unit, "row", "cells", (F.dense_rank().over(W.partitionBy(unit).orderBy("run")) - 1).alias("block"), F.lit("marker").alias("chosen_by"))

    rest = known.join(marked.select(unit).distinct(), unit, "left_anti")
    gaps = blocks_by_gap(rest, unit, "row", "blank")
    place = F.sum((~F.col("blank")).cast("int")).over(W.partitionBy(unit, "block").orderBy("row"))
    strong = gaps.withColumn("nth", place).where("not blank").groupBy(unit, "block").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("nth") == 1) & (F.col("labelled") | F.col("marker"))).alias("titled"), F.max(F.col("nth").between(2, 6) & F.col("columnar")).alias("headed")
    )
    parted = strong.groupBy(unit).agg(F.count(F.lit(1)).alias("blocks"), F.count_if((F.col("n") >= 3) & F.col("titled") & F.col("headed")).alias("strong")).where("blocks > 1 and strong >= 2").select(unit)
    by_gap = gaps.join(parted, unit, "left_semi").select(unit, "row", "cells", F.col("block").cast("int").alias("block"), F.lit("gap").alias("chosen_by"))

    whole = rest.join(parted, unit, "left_anti")
    filled = whole.where("not blank").groupBy(unit).agg(F.min("row").alias("first"), F.max("row").alias("last"))
    one = whole.join(filled, unit).where("row between first and last").select(unit, "row", "cells", F.lit(0).alias("block"), F.lit("whole").alias("chosen_by"))
    return marked.unionByName(by_gap).unionByName(one)
