"""Catalogue stores into tables: one table for each dataset, its columns as its rows' keys come up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: rows of one dataset that are taken at most.
ROW_LIMIT = 50_000


def readable(rows: DataFrame, payload: str) -> DataFrame:
    """The rows whose payload is a JSON object, with keys in their order and values as text (null for null)."""
    keys = F.json_object_keys(F.col(payload))
    return rows.withColumn("keys", F.when(F.get_json_object(payload, "$").isNotNull(), keys)).where("keys is not null").withColumn("values", F.from_json(payload, "map<string,string>"))


def dataset_columns(rows: DataFrame, dataset: str, order: list[str], payload: str) -> DataFrame:
    """dataset and columns: the keys of a dataset's rows, in the order in which they come up first."""
    read = readable(rows.select(dataset, *order, payload), payload)
    each = read.select(dataset, F.struct(*order).alias("at"), F.posexplode("keys").alias("place", "key"))
    first = each.groupBy(dataset, "key").agg(F.min(F.struct("at", "place")).alias("first"))
    return first.groupBy(dataset).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "key"))), lambda x: x["key"]).alias("columns"))


def expanded_rows(rows: DataFrame, dataset: str, order: list[str], payload: str, limit: int = ROW_LIMIT) -> DataFrame:
    """dataset, row (from 0), and cells: the values of a dataset's first rows in the order of its columns.

    rows come by order, nulls last; beyond limit they are left out, and so are those whose payload is no JSON object, which
    count against limit. A missing key and a JSON null are null. Values are text: objects and arrays stay JSON.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    nth = F.row_number().over(W.partitionBy(dataset).orderBy(*by))
    some = rows.withColumn("_nth", nth).where(F.col("_nth") <= limit).select(dataset, "_nth", payload)
    columns = dataset_columns(some, dataset, ["_nth"], payload)
    read = readable(some, payload).join(columns, dataset)
    place = F.row_number().over(W.partitionBy(dataset).orderBy("_nth")) - 1
    return read.select(dataset, place.alias("row"), F.transform("columns", lambda k: F.col("values")[k]).alias("cells"))


def expanded_tables(datasets: DataFrame, rows: DataFrame, dataset: str, order: list[str], payload: str, notes: dict[str, str], limit: int = ROW_LIMIT) -> DataFrame:
    """dataset, table_id, title, columns, n_rows (stored), notes and error of each dataset.

    datasets: dataset, table_id, title and the columns that notes names, as label: column. Blank ids and titles fall back to
    the dataset, and the title to the id. Notes are those that aren't blank, as "label: value". A dataset of which no row can be read
    stays, with the column _error and the reason; one without rows has no columns and no error.
    """
    stored = rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_rows"))
    by = [F.col(c).asc_nulls_last() for c in order]
    some = rows.withColumn("_nth", F.row_number().over(W.partitionBy(dataset).orderBy(*by))).where(F.col("_nth") <= limit)
    columns = dataset_columns(some, dataset, ["_nth"], payload)
    found = datasets.join(stored, dataset, "left").join(columns, dataset, "left")
    own = F.col(dataset).cast("string")
    table_id = F.coalesce(F.nullif(F.trim("table_id"), F.lit("")), own)
    broken = F.col("columns").isNull() & (F.col("n_rows") > 0)
    said = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for label, c in notes.items()]
    told = F.filter(F.array(*said), lambda n: n.isNotNull())
    return found.select(
        dataset,
        table_id.alias("table_id"),
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), table_id).alias("title"),
        F.when(broken, F.array(F.lit("_error"))).otherwise(F.coalesce("columns", F.array().cast("array<string>"))).alias("columns"),
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
        told.alias("notes"),
        F.when(broken, "no row is a JSON object").alias("error"),
    )
