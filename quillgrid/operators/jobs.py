"""Publishing and jobs: datasets pushed with their rows, approved tables kept, groupings saved, files of a batch merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Headers of serial columns, in the order in which they count.
SERIAL_KEYS = ("sl_no", "Sl. No.", "S.No.", "Sr.No.", "S.No", "SL NO", "Sl No")
UUID = r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"


def readable(value: Column) -> Column:
    """A trimmed id; null where it is blank or a UUID."""
    bare = F.trim(value.cast("string"))
    return F.when((bare != "") & ~bare.rlike(UUID), bare)


def dataset_id(explicit: Column, row_id: Column, table_id: Column, made: Column) -> Column:
    """The id under which a table is published: an explicit one, else the table's where the row's is a UUID, else the row's, the table's, a made one."""
    uuid = F.coalesce(F.trim(row_id.cast("string")).rlike(UUID), F.lit(False))
    return F.coalesce(readable(explicit), F.when(uuid, readable(table_id)), readable(row_id), readable(table_id), made)


def named_cells(columns: Column, cells: Column) -> Column:
    """A row's cells by the names of their columns: missing cells are null, cells beyond the columns go, of equal names the last counts."""
    names = F.transform(columns, lambda c, i: F.coalesce(F.nullif(c, F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))
    pairs = F.zip_with(names, F.slice(F.concat(cells, F.array_repeat(F.lit(None).cast("string"), F.size(names))), F.lit(1), F.size(names)), lambda n, v: F.struct(n.alias("key"), v.alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def serial(columns: Column, cells: Column, row_index: Column) -> Column:
    """A row's serial number as text: of the first known header, else its first cell if that is digits, else its place from 1."""
    values = named_cells(columns, cells)
    has = [F.when(F.map_contains_key(values, k), F.coalesce(values[k], F.lit("None"))) for k in SERIAL_KEYS]
    first = F.get(cells, F.lit(0))
    return F.coalesce(*has, F.when(F.trim(first).rlike("^[0-9]+$"), first), (row_index + 1).cast("string"))


def pushed(current: DataFrame, incoming: DataFrame, key: str, owner: str) -> DataFrame:
    """current with incoming rows in the place of those with their key; an incoming row without an owner keeps the old one's.

    Both have the same columns and each key once.
    """
    old = current.select(F.col(key).alias("_key"), F.col(owner).alias("_owner"))
    new = incoming.join(old, incoming[key] == old["_key"], "left").withColumn(owner, F.coalesce(owner, "_owner")).drop("_key", "_owner")
    return current.join(incoming.select(key), key, "left_anti").unionByName(new)


def replaced_rows(current: DataFrame, tables: DataFrame) -> DataFrame:
    """dataset_id, row_index, sl_no and row_data of all datasets, in which those of tables have their new rows only.

    current: these columns; tables: dataset_id, columns (names) and rows (an array of arrays of text), once each. A table
    without rows leaves its dataset without any.
    """
    each = tables.select("dataset_id", "columns", F.posexplode("rows").alias("row_index", "cells"))
    new = each.select("dataset_id", F.col("row_index").cast("int").alias("row_index"), serial(F.col("columns"), F.col("cells"), F.col("row_index")).alias("sl_no"), named_cells(F.col("columns"), F.col("cells")).alias("row_data"))
    return current.join(tables.select("dataset_id"), "dataset_id", "left_anti").select("dataset_id", "row_index", "sl_no", "row_data").unionByName(new)


def approved(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The tables of jobs once a job's approved ones are kept: job_id, table_id, the payload columns, deleted_at and updated_at.

    current: all of these; incoming: all but deleted_at and updated_at, of the jobs that approve, with the last of equal tables by ord.
    Incoming tables replace those with their id and are alive again; other live tables of such a job are deleted as of
    now; tables of other jobs, and those deleted before, stay as they are. Blank table ids are left out, but their job counts.
    """
    keys = ["job_id", "table_id"]
    payload = [c for c in incoming.columns if c not in (*keys, "ord")]
    given = incoming.where(F.coalesce("table_id", F.lit("")) != "")
    given = given.groupBy(*keys).agg(F.max_by(F.struct(*payload), "ord").alias("p")).select(*keys, "p.*", F.lit(None).cast("timestamp").alias("deleted_at"), now.alias("updated_at"))
    jobs = incoming.select("job_id").distinct().withColumn("_approves", F.lit(True))
    rest = current.join(given.select(*keys), keys, "left_anti").join(jobs, "job_id", "left")
    goes = F.col("_approves").isNotNull() & F.col("deleted_at").isNull()
    rest = rest.withColumn("updated_at", F.when(goes, now).otherwise(F.col("updated_at"))).withColumn("deleted_at", F.when(goes, now).otherwise(F.col("deleted_at")))
    return rest.select(*keys, *payload, "deleted_at", "updated_at").unionByName(given)


def active(tables: DataFrame) -> DataFrame:
    """The tables that aren't deleted, with place, their number in their job: by page (none last), then id."""
    place = F.row_number().over(W.partitionBy("job_id").orderBy(F.col("page").asc_nulls_last(), "table_id")) - 1
    return tables.where("deleted_at is null").withColumn("place", place)


def saved_groups(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """job_id, sort_order, name and table_ids of all jobs' groups, in which the jobs of incoming have their new groups only.

    incoming: job_id, sort_order, name and table_ids. A blank name is "Group" and the place from 1.
    """
    place = F.row_number().over(W.partitionBy("job_id").orderBy("sort_order"))
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("Group "), place.cast("string")))
    new = incoming.select("job_id", (place - 1).alias("sort_order"), name.alias("name"), "table_ids")
    return current.join(incoming.select("job_id").distinct(), "job_id", "left_anti").select(*new.columns).unionByName(new)


def loaded_groups(groups: DataFrame, tables: DataFrame) -> DataFrame:
    """job_id, sort_order, name and table_ids of each group, of its live tables in order, and a group without name and order of those in none.

    groups: as saved_groups() gives them; tables: as active() gives them. A job without tables outside has no such group.
    """
    member = groups.select("job_id", "sort_order", "name", F.posexplode("table_ids").alias("at", "table_id"))
    held = member.join(tables.select("job_id", "table_id"), ["job_id", "table_id"])
    ids = held.groupBy("job_id", "sort_order", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "table_id"))), lambda x: x["table_id"]).alias("table_ids"))
    named = groups.select("job_id", "sort_order", "name").join(ids, ["job_id", "sort_order", "name"], "left").withColumn("table_ids", F.coalesce("table_ids", F.array().cast("array<string>")))
    outside = tables.join(held.select("job_id", "table_id").distinct(), ["job_id", "table_id"], "left_anti")
    rest = outside.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "table_id"))), lambda x: x["table_id"]).alias("table_ids"))
    return named.unionByName(rest.select("job_id", F.lit(None).cast("int").alias("sort_order"), F.lit(None).cast("string").alias("name"), "table_ids"))


def batch_merged(tables: DataFrame, files: DataFrame) -> DataFrame:
    """tables with page_key (the file and the page), and source_file, source_filename, source_file_id and source_type of their file.

    tables: batch, file_index, page and their own columns; files: batch, file_index, filename, file_id and type. A source_type that
    a table has itself stays.
    """
    own = F.nullif("source_type", F.lit("")) if "source_type" in tables.columns else F.lit(None).cast("string")
    marked = tables.withColumn("_own", own).drop("source_type", "source_file", "source_filename", "source_file_id").join(files, ["batch", "file_index"])
    key = F.concat(F.lit("__f"), F.col("file_index").cast("string"), F.lit("__"), F.col("page").cast("string"))
    return marked.withColumns({"page_key": key, "source_type": F.coalesce("_own", "type"), "source_file": F.col("filename"), "source_filename": F.col("filename"), "source_file_id": F.col("file_id")}).drop("_own", "type", "filename", "file_id")
