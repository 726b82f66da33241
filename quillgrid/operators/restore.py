"""Rows that a rebuilt table lost against the candidate it was rebuilt from, aligned and put back.

Both sides are rows of a unit: row (from 0) and cells, an array of text. Rows meet by the text of their first cell or by all of it,
the first row that has it on either side, so no rows of a unit are paired with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions.text import is_numeric, is_placeholder


def cell_key(cell: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " ")))


def said_cells(cells: Column) -> Column:
    return F.filter(cells, lambda c: ~is_placeholder(c))


def is_index_row(cells: Column) -> Column:
    """Whether a row only numbers the columns: more than half of its texts as (1), or 1 2 3 and so on for three or more."""
    said = said_cells(cells)
    bracketed = F.size(F.filter(said, lambda c: F.trim(c).rlike(r"^\([0-9]+\)$")))
    counting = F.forall(F.transform(said, lambda c, i: F.trim(c).rlike("^[0-9]{1,2}$") & (F.trim(c).try_cast("int") == i + 1)), lambda ok: F.coalesce(ok, F.lit(False)))
    return (F.size(said) >= 2) & ((bracketed > 0.5 * F.size(said)) | ((F.size(said) >= 3) & counting))


def has_measures(cells: Column) -> Column:
    """Whether a row has two numbers or more that are half of its texts."""
    said = said_cells(cells)
    return F.size(F.filter(said, is_numeric)) >= F.greatest(F.lit(2), F.floor(0.5 * F.size(said)))


def aligned(rebuilt: DataFrame, candidate: DataFrame, unit: str) -> DataFrame:
    """unit, row and candidate_row (null without one) of each rebuilt row.

    Where both have equally many rows they align by place. Else the first candidate row with the same first cell
    is a row's, if 60 % of the rows have one; otherwise rows align by place as far as they go. Blank first cells have none.
    """
    there = candidate.groupBy(unit).agg(F.count(F.lit(1)).alias("n_there"))
    here = rebuilt.groupBy(unit).agg(F.count(F.lit(1)).alias("n_here"))
    first = candidate.select(unit, cell_key(F.get("cells", F.lit(0))).alias("key"), "row").where("key <> ''").groupBy(unit, "key").agg(F.min("row").alias("by_key"))
    found = rebuilt.select(unit, "row", cell_key(F.get("cells", F.lit(0))).alias("key")).join(first, [unit, "key"], "left").join(here, unit).join(there, unit, "left")
    n_there = F.coalesce("n_there", F.lit(0))
    matched = F.count("by_key").over(W.partitionBy(unit))
    by_key = (matched >= F.greatest(F.lit(1), F.floor(0.6 * F.col("n_here")))) & (n_there != F.col("n_here"))
    by_place = F.when(F.col("row") < n_there, F.col("row"))
    return found.select(unit, "row", F.when(by_key, F.col("by_key")).otherwise(by_place).alias("candidate_row"))


def restored(rebuilt: DataFrame, candidate: DataFrame, unit: str) -> DataFrame:
    """unit, row, cells and source (kept or restored) of each rebuilt table with the rows it lost.

    A candidate row comes back if no rebuilt row is it and it holds measures, or numbers the columns above all others. Rows
    then stand in the candidate's order, and rebuilt rows that it doesn't have come last. Nothing changes where the
    candidate is more than one column wider or narrower, has no more rows, or nothing comes back. Cells are padded or cut
    to the rebuilt table's width, its widest row.
    """
    sides = [rows.select(unit, "row", "cells", F.lit(side).alias("theirs")) for rows, side in ((rebuilt, False), (candidate, True))]
    in_unit = W.partitionBy(unit)
    mine, theirs = ~F.col("theirs"), F.col("theirs")

    def of_side(side: Column, value: Column) -> Column:
        return F.when(side, value)

    # One dealing by unit serves all windows below, which look at single rows and what their unit says of them.
    size = F.size("cells")
    rows = sides[0].unionByName(sides[1]).withColumns({
        "width": F.max(of_side(mine, size)).over(in_unit), "wide": F.max(of_side(theirs, size)).over(in_unit),
        "n": F.count(of_side(mine, F.lit(1))).over(in_unit), "n_there": F.count(of_side(theirs, F.lit(1))).over(in_unit),
    })
    fit = F.col(unit).isNotNull() & (F.abs(F.col("wide") - F.col("width")) <= 1) & (F.col("n_there") > F.col("n"))
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False))).where("fit or not theirs")
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.col("width"))), F.lit(1), F.col("width"))
    rows = rows.withColumn("padded", F.when(F.col("fit"), padded)).drop("wide", "n", "n_there", "width")
    whole = F.array_join(F.transform(said_cells(F.col("padded")), cell_key), "\u0001")
    rows = rows.withColumns({"index_row": F.when(F.col("fit"), is_index_row(F.col("padded"))), "key": F.when(F.col("fit"), cell_key(F.get("padded", F.lit(0)))), "whole": F.when(F.col("fit"), whole)})

    def paired(rows: DataFrame, by: str, asks: Column, pair: str) -> DataFrame:
        """rows with pair: for the first row on either side with one text, the other one."""
        alike = W.partitionBy(unit, by)
        asks = asks & (F.col(by) != "")
        here, there = F.min(of_side(asks & mine, F.col("row"))).over(alike), F.min(of_side(asks & theirs, F.col("row"))).over(alike)
        return rows.withColumns({"_here": here, "_there": there}).withColumn(pair, F.when(asks & mine & (F.col("row") == F.col("_here")), F.col("_there")).when(asks & theirs & (F.col("row") == F.col("_there")), F.col("_here"))).drop("_here", "_there")

    rows = paired(rows, "key", F.col("fit") & ~F.col("index_row"), "by_key").drop("key")
    rows = paired(rows, "whole", F.col("fit") & F.col("by_key").isNull(), "by_whole").drop("whole")
    rows = rows.withColumn("other", F.coalesce("by_key", "by_whole")).drop("by_key", "by_whole")
    first_row = F.min(of_side(theirs & ~F.col("index_row"), F.col("row"))).over(in_unit)
    leading = F.col("index_row") & (F.col("first_row").isNull() | (F.col("row") < F.col("first_row")))
    back = theirs & F.col("other").isNull() & (leading | (has_measures(F.col("padded")) & ~F.col("index_row")))
    rows = rows.withColumn("first_row", first_row).withColumn("back", F.coalesce(back, F.lit(False))).where(mine | F.col("back"))
    rows = rows.withColumn("changed", F.max("back").over(in_unit))
    behind = (mine & F.col("other").isNull()).cast("int")
    at = F.when(F.col("back"), F.col("row")).otherwise(F.coalesce("other", F.col("row")))
    place = F.row_number().over(in_unit.orderBy(behind, at)) - 1
    shown = F.transform("padded", lambda c: F.when(~is_placeholder(c), c))
    cells = F.when(F.col("back"), shown).when(F.col("changed"), F.col("padded")).otherwise(F.col("cells"))
    return rows.withColumn("place", place).select(unit, F.when(F.col("changed"), F.col("place")).otherwise(F.col("row")).alias("row"), cells.alias("cells"), F.when(F.col("back"), "restored").otherwise("kept").alias("source"))
