"""Publishing and job queries over orders, customers and parts, beside the SQL they are compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import jobs
from quillgrid.session import table

NOW = "2024-02-01 00:00:00"
UUID = "0f8fad5b-d9cb-469f-a165-70867728950e"


def dataset_ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    explicit = F.when(key % 5 == 0, F.concat(F.lit(" DS-"), key)).when(key % 5 == 1, UUID)
    row_id = F.when(key % 3 == 0, UUID.upper()).when(key % 3 == 1, F.concat(F.lit("row "), key)).otherwise(" ")
    table_id = F.when(key % 4 != 0, F.concat(F.lit("T"), key)).otherwise(UUID)
    return table(spark, sf, "part").select("p_partkey", jobs.dataset_id(explicit, row_id, table_id, F.concat(F.lit("made-"), key)).alias("dataset_id"))


def datasets_pushed(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("owner"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("o")).where("o % 2 = 0")
    return jobs.pushed(customer, new.select((F.col("k") + F.when(F.col("o") % 4 == 0, 0).otherwise(1_000_000)).alias("k"), F.concat(F.lit("order "), "o").alias("title"), F.when(F.col("o") % 3 == 0, "new").alias("owner")), "k", "owner")


def rows_replaced(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    old = part.select(F.col("p_size").alias("dataset_id"), F.col("p_partkey").cast("int").alias("row_index"), F.lit("old").alias("sl_no"), F.create_map(F.lit("name"), "p_name").alias("row_data"))
    key = F.col("p_partkey").cast("string")
    head = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("Name"), F.lit("S.No."))).when(F.col("p_size") % 4 == 2, F.array(F.lit(""), F.lit("Name"), F.lit("Name"), F.lit("more"))).otherwise(F.array(F.lit("a")))
    cells = F.when(F.col("p_partkey") % 3 == 0, F.array("p_name", key)).otherwise(F.array(key, "p_name", "p_brand"))
    new = part.where("p_size % 3 = 0").groupBy(F.col("p_size").alias("dataset_id"), head.alias("columns")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("c")))), lambda x: x["c"]).alias("rows"))
    found = jobs.replaced_rows(old, new)
    return found.select("dataset_id", "row_index", "sl_no", F.array_join(F.array_sort(F.transform(F.map_entries("row_data"), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("~"))))), "|").alias("row_data"))


def job_tables(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    now = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("job_id"), F.concat(F.lit("t"), (key % 9).cast("string")).alias("table_id"), F.when(key % 4 != 0, key % 5).alias("page"), F.col("o_orderpriority").alias("title"),
        F.when(key % 6 == 0, F.to_timestamp(F.lit("2024-01-05"))).alias("deleted_at"), F.to_timestamp(F.lit("2024-01-01")).alias("updated_at"), key.alias("ord"),
    )
    current = now.groupBy("job_id", "table_id").agg(F.min_by(F.struct("page", "title", "deleted_at", "updated_at"), "ord").alias("x")).select("job_id", "table_id", "x.*")
    given = table(spark, sf, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("job_id"), F.when(key % 7 != 0, F.concat(F.lit("t"), (key % 11).cast("string"))).alias("table_id"), (key % 3).alias("page"), F.lit("new").alias("title"), key.alias("ord"))
    return jobs.approved(current, given, F.to_timestamp(F.lit(NOW)))


def tables_approved(spark: SparkSession, sf: str) -> DataFrame:
    found = job_tables(spark, sf)
    return found.select("job_id", "table_id", "page", "title", F.date_format("deleted_at", "yyyy-MM-dd").alias("deleted_on"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


def job_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of each job's tables by page, of which those of every third job are saved anew, two pages together."""
    tables = jobs.active(job_tables(spark, sf))
    old = tables.where("page is not null").groupBy("job_id", F.col("page").cast("int").alias("sort_order")).agg(F.array_sort(F.collect_list("table_id")).alias("table_ids")).withColumn("name", F.concat(F.lit("page "), "sort_order"))
    new = tables.where("page is not null and job_id % 3 = 0").groupBy("job_id", F.floor(F.col("page") / 2).cast("int").alias("sort_order")).agg(F.reverse(F.array_sort(F.collect_list("table_id"))).alias("table_ids"))
    new = new.withColumn("table_ids", F.concat("table_ids", F.array(F.lit("gone")))).withColumn("name", F.when(F.col("sort_order") % 2 == 0, F.lit(" ")).otherwise("odd"))
    return jobs.saved_groups(old, new)


def groups_loaded(spark: SparkSession, sf: str) -> DataFrame:
    found = jobs.loaded_groups(job_groups(spark, sf), jobs.active(job_tables(spark, sf)))
    return found.select("job_id", "sort_order", "name", F.array_join("table_ids", ",").alias("table_ids"))


def batch_files(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    tables = lines.select(F.col("l_orderkey").alias("batch"), (F.col("l_linenumber") % 3).alias("file_index"), F.col("l_linenumber").alias("page"), "l_partkey", F.when(F.col("l_partkey") % 4 == 0, "csv").when(F.col("l_partkey") % 4 == 1, "").alias("source_type"))
    files = lines.select(F.col("l_orderkey").alias("batch"), (F.col("l_linenumber") % 3).alias("file_index")).distinct().withColumns({"filename": F.concat(F.lit("f"), "file_index", F.lit(".pdf")), "file_id": F.concat_ws("-", "batch", "file_index"), "type": F.lit("pdf")})
    return jobs.batch_merged(tables, files).select("batch", "page_key", "l_partkey", "source_type", "source_file", "source_file_id")


GIVEN = """c0 AS (SELECT o_custkey AS job_id, 't' || (o_orderkey % 9) AS table_id, min(o_orderkey) AS k FROM orders GROUP BY 1, 2),
    c AS (SELECT job_id, table_id, CASE WHEN k % 4 <> 0 THEN k % 5 END AS page, o_orderpriority AS title, k % 6 = 0 AS dead FROM c0 JOIN orders ON o_orderkey = k),
    n0 AS (SELECT o_custkey AS job_id, CASE WHEN o_orderkey % 7 <> 0 THEN 't' || (o_orderkey % 11) END AS table_id, o_orderkey AS k FROM orders WHERE o_custkey % 2 = 0),
    n AS (SELECT job_id, table_id, max(k) % 3 AS page FROM n0 WHERE table_id IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT job_id, table_id, page, title, CASE WHEN dead THEN '2024-01-05' WHEN job_id IN (SELECT job_id FROM n0) THEN '2024-02-01' END AS deleted_on,
                 CASE WHEN NOT dead AND job_id IN (SELECT job_id FROM n0) THEN '2024-02-01' ELSE '2024-01-01' END AS updated_on FROM c WHERE (job_id, table_id) NOT IN (SELECT job_id, table_id FROM n)
          UNION ALL SELECT job_id, table_id, page, 'new', NULL, '2024-02-01' FROM n),
    a AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY page NULLS LAST, table_id) AS place FROM t WHERE deleted_on IS NULL)"""

SQL: dict[str, str] = {
    "dataset_ids": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'DS-' || p_partkey WHEN p_partkey % 3 = 1 THEN 'row ' || p_partkey WHEN p_partkey % 4 <> 0 THEN 'T' || p_partkey ELSE 'made-' || p_partkey END AS dataset_id FROM part""",
    "datasets_pushed": """WITH o AS (SELECT o_custkey AS c, min(o_orderkey) AS o FROM orders GROUP BY 1), n AS (SELECT CASE WHEN o % 4 = 0 THEN c ELSE c + 1000000 END AS k, 'order ' || o AS title, CASE WHEN o % 3 = 0 THEN 'new' END AS owner FROM o WHERE o % 2 = 0)
        SELECT coalesce(n.k, c_custkey) AS k, coalesce(n.title, c_name) AS title, coalesce(n.owner, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END) AS owner FROM customer FULL JOIN n ON n.k = c_custkey""",
    "rows_replaced": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS i, p_partkey % 3 = 0 AS two, p_partkey::VARCHAR AS key FROM part)
        SELECT p_size AS dataset_id, CASE WHEN p_size % 3 = 0 THEN i ELSE p_partkey END::INT AS row_index,
            CASE WHEN p_size % 3 <> 0 THEN 'old' WHEN p_size % 4 = 0 THEN CASE WHEN two THEN key ELSE p_name END WHEN NOT two THEN key ELSE (i + 1)::VARCHAR END AS sl_no,
            CASE WHEN p_size % 3 <> 0 THEN 'name=' || p_name WHEN p_size % 4 = 0 THEN 'Name=' || (CASE WHEN two THEN p_name ELSE key END) || '|S.No.=' || (CASE WHEN two THEN key ELSE p_name END)
                 WHEN p_size % 4 = 2 THEN 'Name=' || (CASE WHEN two THEN '~' ELSE p_brand END) || '|column_1=' || (CASE WHEN two THEN p_name ELSE key END) || '|more=~' ELSE 'a=' || (CASE WHEN two THEN p_name ELSE key END) END AS row_data FROM p""",
    "tables_approved": f"""WITH {GIVEN} SELECT job_id, table_id, page, title, deleted_on, updated_on FROM t""",
    "groups_loaded": f"""WITH {GIVEN},
        old AS (SELECT job_id, page::INT AS so, 'page ' || page AS name, table_id FROM a WHERE page IS NOT NULL AND job_id NOT IN (SELECT job_id FROM a WHERE page IS NOT NULL AND job_id % 3 = 0)),
        new AS (SELECT job_id, (dense_rank() OVER (PARTITION BY job_id ORDER BY page // 2) - 1)::INT AS so, page // 2 AS h, table_id FROM a WHERE page IS NOT NULL AND job_id % 3 = 0),
        g AS (SELECT job_id, so AS sort_order, name, string_agg(table_id, ',' ORDER BY table_id) AS table_ids FROM old GROUP BY 1, 2, 3
              UNION ALL SELECT job_id, so, CASE WHEN h % 2 = 0 THEN 'Group ' || (so + 1) ELSE 'odd' END, string_agg(table_id, ',' ORDER BY table_id DESC) FROM new GROUP BY job_id, so, h)
        SELECT * FROM g UNION ALL SELECT job_id, NULL, NULL, string_agg(table_id, ',' ORDER BY place) FROM a WHERE page IS NULL GROUP BY job_id""",
    "batch_files": """SELECT DISTINCT l_orderkey AS batch, '__f' || (l_linenumber % 3) || '__' || l_linenumber AS page_key, l_partkey, CASE WHEN l_partkey % 4 = 0 THEN 'csv' ELSE 'pdf' END AS source_type,
        'f' || (l_linenumber % 3) || '.pdf' AS source_file, l_orderkey || '-' || (l_linenumber % 3) AS source_file_id FROM lineitem""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dataset_ids": dataset_ids,
    "datasets_pushed": datasets_pushed,
    "rows_replaced": rows_replaced,
    "tables_approved": tables_approved,
    "groups_loaded": groups_loaded,
    "batch_files": batch_files,
}
