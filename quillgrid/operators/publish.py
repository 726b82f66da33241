"""Writing the catalogue: upserts, soft deletes, appended ids, steps, overlays, ids, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert_latest(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key: of the greatest version, a change before a current row at equal versions."""
    both = current.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)))
    order = W.partitionBy(key).orderBy(F.desc_nulls_last(version), F.desc("_change"))
    return both.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_change")


def soft_delete_missing(current: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """current with deleted: whether its key isn't among those to keep. Null keys never match."""
    found = keep.where(F.col(key).isNotNull()).select(F.col(key).alias("_kept")).distinct()
    return current.join(found, current[key] == found["_kept"], "left").withColumn("deleted", F.col("_kept").isNull()).drop("_kept")


def appended(old: Column, new: Column) -> Column:
    """The elements of old, then those of new; repeats and nulls stay, as ids are only ever added."""
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(old, empty), F.coalesce(new, empty))


def monotone_step(current: Column, proposed: Column) -> Column:
    """A step that never goes back; what is proposed counts as 1 at least and 6 at most."""
    return F.greatest(F.coalesce(current, F.lit(0)), F.least(F.greatest(F.coalesce(proposed, F.lit(1)), F.lit(1)), F.lit(6)))


def overlay(base: DataFrame, edits: DataFrame, key: str, columns: list[str], tombstones: DataFrame) -> DataFrame:
    """base with edited columns where an edit has a value, without the keys that tombstones hold."""
    changed = edits.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    rows = base.join(tombstones.select(key).distinct(), key, "left_anti")
    rows = rows.join(changed, rows[key] == changed["_key"], "left")
    return rows.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def review_ids(tables: DataFrame, source: str, page: str, order: str, prefix: str, statistics: str = "", separator: str = "-") -> DataFrame:
    """tables with review_id: prefix, statistics, source, P and the page (0 where it is no number), and T and the table's number where a page has several.

    Empty parts are left out.
    """
    on_page = W.partitionBy(source, page)
    number = F.row_number().over(on_page.orderBy(order))
    many = F.count(F.lit(1)).over(on_page) > 1
    page_part = F.concat(F.lit("P"), F.coalesce(F.expr(f"try_cast(`{page}` as bigint)"), F.lit(0)).cast("string"))
    parts = [F.lit(prefix), F.lit(statistics), F.col(source).cast("string"), page_part, F.when(many, F.concat(F.lit("T"), number.cast("string")))]
    return tables.withColumn("review_id", F.concat_ws(separator, *(F.when(x != "", x) for x in parts)))


def live(staged: DataFrame, stamp: str, now: str, days: int = 7) -> DataFrame:
    """Staged rows that haven't expired at a given time."""
    return staged.where(F.col(stamp) >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(days=F.lit(days)))


def batch_status(jobs: DataFrame, batch: str, status: str) -> DataFrame:
    """status and percent of each batch from those of its jobs."""
    counts = jobs.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(status) == "done").alias("done"),
        F.count_if(F.col(status) == "error").alias("failed"),
        F.count_if(F.col(status).isin("queued", "running")).alias("open"),
    )
    said = F.when(F.col("open") > 0, "running").when((F.col("done") > 0) & (F.col("failed") > 0), "completed_with_errors").when(F.col("done") > 0, "done").otherwise("failed")
    percent = F.when(F.col("open") > 0, F.bround(100 * (F.col("done") + F.col("failed")) / F.col("n"))).otherwise(100).cast("int")
    return counts.select(batch, said.alias("batch_state"), percent.alias("percent"), "n")
