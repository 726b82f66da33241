"""Facts of tables and titles, pages of searches and filtered nearest vectors, beside the SQL they are compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import catalogue, columns, facts, matching
from quillgrid.session import table


def part_cells(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    named = part.select(
        F.concat(F.lit("size "), F.col("p_size")).alias("t"), "p_partkey", F.col("p_partkey").cast("string").alias("Serial"), F.col("p_brand").alias("Brand"), F.col("p_name").alias("Item"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, (F.col("p_partkey") % 7).cast("string")).otherwise(" ").alias("Age group"),
        F.when(F.col("p_partkey") % 5 == 0, F.upper("p_type")).otherwise((F.col("p_partkey") % 4).cast("string")).alias("Mixed"), (F.col("p_partkey") % 9).cast("string").alias("State"),
    )
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value")) for c in named.columns[2:]))
    return named.select(F.col("t").alias("table_name"), F.inline(each))


def categorical_facts(spark: SparkSession, sf: str) -> DataFrame:
    found = facts.row_dimensions(part_cells(spark, sf))
    return found.select("table_name", "column_name", F.array_join("category_values", "|").alias("category_values"))


def mixed_type_columns(spark: SparkSession, sf: str) -> DataFrame:
    cells = part_cells(spark, sf).withColumn("row_key", F.lit(0))
    return columns.profile(cells).where("mixed").select("table_name", "column_name", "n_rows", "fill_ratio")


def title_facts(spark: SparkSession, sf: str) -> DataFrame:
    year = F.year("o_orderdate")
    key = F.col("o_orderkey")
    title = F.concat_ws(" ", F.concat(F.lit("Table b-"), key % 30, F.when(key % 4 == 0, ".5").otherwise("")), F.when(key % 3 == 0, "Urban, rural").when(key % 3 == 1, "statewide City"), F.concat(year, F.when(key % 2 == 0, F.concat(F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))).otherwise("")), F.when(key % 5 == 0, "(Number in lakh)").when(key % 5 == 1, "( Provisional ) (per 1000)"), F.lit("d-2 1875"))
    found = table(spark, sf, "orders").select("o_orderkey", title.alias("t"))
    return found.select("o_orderkey", *(F.array_join(c, "|").alias(n) for n, c in facts.text_facts(F.col("t")).items()))


def search_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a customer search within a nation, with how many there are in all."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("summary"), F.col("c_nationkey").cast("string").alias("release"))
    return catalogue.search_page(customers, " UILD ", ["title", "summary"], [F.col("id")], offset=5, limit=7, release="3")


def cosine_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").withColumns({"kind": F.when(F.col("vec_id") % 3 == 0, "table").otherwise("column"), "owner": F.when(F.col("vec_id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("org"), F.col("vec_id") % 2))})
    found = matching.nearest_visible(vectors.where("vec_id % 20 = 0"), vectors, 4, {"kind": "column"}, "owner", "org1")
    return found.select("query_id", "vec_id", F.round("distance", 4).alias("distance"), "rank")


NUM = facts.NUMBER.replace("(?:", "(")
SQL: dict[str, str] = {
    "categorical_facts": f"""WITH c AS (SELECT 'size ' || p_size AS t, unnest([struct_pack(c := 'Serial', v := p_partkey::VARCHAR), struct_pack(c := 'Brand', v := p_brand), struct_pack(c := 'Item', v := p_name),
              struct_pack(c := 'Age group', v := CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN (p_partkey % 7)::VARCHAR ELSE '' END), struct_pack(c := 'Mixed', v := CASE WHEN p_partkey % 5 = 0 THEN upper(p_type) ELSE (p_partkey % 4)::VARCHAR END),
              struct_pack(c := 'State', v := (p_partkey % 9)::VARCHAR)]) AS x FROM part),
        d AS (SELECT t, x.c AS c, x.v AS v, regexp_matches(x.v, '{NUM}') AS num FROM c WHERE x.v <> ''),
        f AS (SELECT t, c, count(*) AS n, count(DISTINCT v) AS d, count(*) FILTER (num) AS nums FROM d GROUP BY 1, 2),
        k AS (SELECT t, c FROM f WHERE c <> 'Serial' AND nums < n AND (c IN ('Age group', 'State') OR (d > 1 AND d < n AND nums <= 0.6 * n AND (d <= 15 OR (d <= 50 AND d <= 0.5 * n)))))
        SELECT t AS table_name, c AS column_name, string_agg(v, '|' ORDER BY lower(v), v) AS category_values FROM (SELECT DISTINCT t, c, v FROM d JOIN k USING (t, c) WHERE NOT num) GROUP BY 1, 2""",
    "mixed_type_columns": """WITH c AS (SELECT 'size ' || p_size AS t, unnest([struct_pack(c := 'Age group', v := CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN (p_partkey % 7)::VARCHAR END), struct_pack(c := 'Mixed', v := CASE WHEN p_partkey % 5 = 0 THEN upper(p_type) ELSE (p_partkey % 4)::VARCHAR END)]) AS x FROM part),
        f AS (SELECT t, x.c AS c, count(*) AS n, count(x.v) AS there, count(*) FILTER (regexp_matches(x.v, '^[0-9]+$')) AS nums, max(len(x.v)) AS longest FROM c GROUP BY 1, 2)
        SELECT t AS table_name, c AS column_name, n AS n_rows, round(there / n, 3) AS fill_ratio FROM f WHERE there >= 3 AND longest > 4 AND nums / there > 0.2 AND nums / there < 0.8""",
    "title_facts": """WITH a AS (SELECT o_orderkey, o_orderkey AS k, year(o_orderdate) AS y FROM orders)
        SELECT o_orderkey, y::VARCHAR AS years, CASE WHEN k % 2 = 0 THEN y || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') ELSE '' END AS year_ranges,
               CASE k % 5 WHEN 0 THEN 'Number in lakh' WHEN 1 THEN 'per 1000' ELSE '' END AS units, array_to_string(list_sort(list_distinct(['B-' || (k % 30) || CASE WHEN k % 4 = 0 THEN '.5' ELSE '' END, 'D-2'])), '|') AS codes,
               CASE k % 3 WHEN 0 THEN 'RURAL|URBAN' WHEN 1 THEN 'CITY' ELSE '' END AS places FROM a""",
    "search_pages": """SELECT c_custkey AS id, c_name AS title, c_mktsegment AS summary, c_nationkey::VARCHAR AS release, count(*) OVER () AS total FROM customer WHERE c_nationkey = 3 AND (contains(lower(c_name), 'uild') OR contains(lower(c_mktsegment), 'uild')) ORDER BY c_custkey LIMIT 7 OFFSET 5""",
    "cosine_topk_filtered": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), t AS (SELECT * FROM v WHERE vec_id % 3 <> 0 AND (vec_id % 4 = 0 OR vec_id % 2 = 1)),
        p AS (SELECT q.vec_id AS query_id, t.vec_id AS vec_id, round(1 - list_cosine_similarity(q.e, t.e), 6) AS d FROM v q, t WHERE q.vec_id % 20 = 0 AND q.vec_id <> t.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p)
        SELECT query_id, vec_id, round(d, 4) AS distance, rank::INT AS rank FROM r WHERE rank <= 4""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "categorical_facts": categorical_facts,
    "mixed_type_columns": mixed_type_columns,
    "title_facts": title_facts,
    "search_pages": search_pages,
    "cosine_topk_filtered": cosine_topk_filtered,
}
