"""Grids into tables: blocks, headers, stacked and wrapped rows, halves side by side, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions.labels import is_banner


def blocks_by_gap(rows: DataFrame, unit: str, order: str, blank: str) -> DataFrame:
    """The rows of each block of a unit, with block, its number from 0.

    Two blank rows or more in a row part blocks; a single one belongs to the block around it. Blank rows
    at a block's edges are left out, and so are blocks of one row.
    """
    in_unit = W.partitionBy(unit).orderBy(order)
    filled = F.when(~F.col(blank), F.col("_at"))
    at = rows.withColumn("_at", F.row_number().over(in_unit))
    at = at.withColumn("_last", F.max(filled).over(in_unit.rowsBetween(W.unboundedPreceding, -1)))
    starts = (~F.col(blank) & (F.col("_last").isNull() | (F.col("_at") - F.col("_last") > 2))).cast("int")
    at = at.withColumn("_run", F.sum(starts).over(in_unit.rowsBetween(W.unboundedPreceding, 0)))
    of_run = W.partitionBy(unit, "_run")
    inside = at.withColumns({"_from": F.min(filled).over(of_run), "_to": F.max(filled).over(of_run)}).where("_to > _from and _at between _from and _to")
    return inside.withColumn("block", F.dense_rank().over(W.partitionBy(unit).orderBy("_run")) - 1).drop("_at", "_last", "_run", "_from", "_to")


def strip_banners(rows: DataFrame, unit: str, order: str, cells: str) -> DataFrame:
    """rows without those at the start of a unit that only repeat one label; cells is an array of text."""
    so_far = F.min(F.coalesce(is_banner(F.col(cells)), F.lit(False))).over(W.partitionBy(unit).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_banner", so_far).where("not _banner").drop("_banner")


def fill_forward(rows: DataFrame, unit: str, order: str, column: str) -> DataFrame:
    """rows with a merged label repeated over the blank cells that follow it."""
    value = F.when(F.trim(column) != "", F.col(column))
    return rows.withColumn(column, F.last(value, ignorenulls=True).over(W.partitionBy(unit).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def expand_stacked(rows: DataFrame, column: str) -> DataFrame:
    """A row for each line of a cell, with part, its number from 0."""
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.posexplode(F.split(column, "\n")).alias("part", column))


def fold_wrapped(lines: DataFrame, unit: str, order: str, text: str) -> DataFrame:
    """Lines joined with those that go on with them: one that begins in lower case continues the line before."""
    in_unit = W.partitionBy(unit).orderBy(order)
    begins = (~F.coalesce(F.col(text).rlike("^[a-z]"), F.lit(False)) | (F.row_number().over(in_unit) == 1)).cast("int")
    numbered = lines.withColumn("_begins", begins).withColumn("label_no", F.sum("_begins").over(in_unit.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return numbered.groupBy(unit, "label_no").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias(text), F.count(F.lit(1)).alias("n_lines"))


def stack_halves(rows: DataFrame, key: str, left: list[str], right: list[str]) -> DataFrame:
    """A table printed in two halves side by side as one: a row's left half, then its right one."""
    halves = [F.struct(F.lit(i).alias("half"), *(F.col(c).cast("string").alias(f"c{j}") for j, c in enumerate(side))) for i, side in enumerate((left, right))]
    return rows.select(key, F.inline(F.array(*halves)))


def overlapping_boxes(boxes: DataFrame, unit: str, key: str, least: float) -> DataFrame:
    """Pairs of boxes of one unit (a before b) and their intersection over union, from a least value."""
    a = boxes.select(unit, F.col(key).alias("a"), *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    b = boxes.select(unit, F.col(key).alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    wide = F.greatest(F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0"), F.lit(0))
    high = F.greatest(F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"), F.lit(0))
    both = wide * high
    areas = (F.col("a_x1") - F.col("a_x0")) * (F.col("a_y1") - F.col("a_y0")) + (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0"))
    share = F.round(both / (areas - both), 4)
    met = a.join(b, (a[unit] == b[unit]) & (F.col("a") < F.col("b"))).drop(b[unit])
    return met.select(unit, "a", "b", share.alias("iou")).where(F.col("iou") >= least)


def nearest_above(items: DataFrame, marks: DataFrame, unit: str) -> DataFrame:
    """item and mark: for each item the last mark at or above it in its unit.

    items: unit, item, y; marks: unit, mark, y. One sort of both together, no range join.
    """
    both = marks.select(unit, F.lit(None).cast("long").alias("item"), "y", F.struct("y", "mark").alias("m"), F.lit(0).alias("kind")).unionByName(
        items.select(unit, F.col("item").cast("long").alias("item"), "y", F.lit(None).cast(f"struct<y:{marks.schema['y'].dataType.simpleString()},mark:{marks.schema['mark'].dataType.simpleString()}>").alias("m"), F.lit(1).alias("kind"))
    )
    seen = F.last("m", ignorenulls=True).over(W.partitionBy(unit).orderBy("y", "kind", F.col("m.mark")).rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("_seen", seen).where("kind = 1").select(unit, "item", F.col("_seen.mark").alias("mark"))


def best_candidate(candidates: DataFrame, owner: str, key: str, score: str) -> DataFrame:
    """The candidate of the greatest score of each owner; of equal ones that of the least key."""
    order = F.struct(F.col(score), -F.col(key))
    return candidates.groupBy(owner).agg(F.max_by(key, order).alias(key), F.max(score).alias(score))
