"""Blocks of sheets printed from orders, and tables re-homed by corrected titles, beside the SQL they are compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.operators import blocks, rehome
from quillgrid.session import table


def sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as a sheet: with numbers of tables for some, with gaps and titles for others, plain for the rest."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    key, unit = F.col("o_orderkey"), F.col("o_custkey")
    blank = F.array(F.lit(" "), F.lit(None).cast("string"))
    note = F.array(F.concat(F.lit("Note: figures are provisional and may change, see number "), key))
    code = F.array(F.concat(F.lit("Table: D-"), key % 50), F.lit(""))
    title = F.array(F.concat(F.lit("Births "), key), F.lit(None).cast("string"))
    data = F.array(key.cast("string"), "o_orderstatus", "o_orderpriority")
    marked = F.when(key % 5 == 0, code).when(key % 5 == 1, note).when(key % 5 == 2, blank).otherwise(data)
    gapped = F.when(key % 6 < 2, blank).when(key % 6 == 2, title).otherwise(data)
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    # In sheets with gaps every order prints its own few rows.
    lines = orders.select(unit.alias("unit"), nth.alias("nth"), key.alias("k"), F.when(unit % 3 == 0, F.array(marked)).when(unit % 3 == 1, F.when(key % 4 == 0, F.array(blank, blank, title, data, data)).otherwise(F.array(gapped))).otherwise(F.array(F.when(key % 3 == 0, blank).otherwise(data))).alias("rows"))
    each = lines.select("unit", "nth", "k", F.posexplode("rows").alias("i", "cells"))
    return each.select("unit", (F.row_number().over(W.partitionBy("unit").orderBy("nth", "i")) - 1).alias("row"), "cells")


def sheet_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.chosen_blocks(sheets(spark, sf), "unit").select("unit", "row", "block", "chosen_by")


def grouped_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts of a brand in groups by name, and corrections of some of their titles."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    title = F.concat_ws(" ", "p_name", F.when(key % 4 == 0, "(urban)"))
    group = F.when(key % 9 != 0, F.dense_rank().over(W.partitionBy("p_brand").orderBy("p_name")) - 1)
    members = part.select(F.col("p_brand").alias("scope"), group.alias("group_no"), key.alias("place"), key.cast("string").alias("table_id"), title.alias("title"))
    new = F.when(key % 5 == 0, F.concat("p_name", F.lit("  (rural)"))).when(key % 7 == 0, F.concat(F.lit("new "), "p_type")).when(key % 11 == 0, "small ring")
    return members, part.select(F.col("p_brand").alias("scope"), key.cast("string").alias("table_id"), new.alias("title")).where("title is not null")


def rehome_changed_titles(spark: SparkSession, sf: str) -> DataFrame:
    return rehome.rehomed(*grouped_parts(spark, sf)).select("scope", "group_no", "place", "table_id", "title", "group_name")


SHEETS = """o AS (SELECT o_custkey AS unit, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders),
    l AS (SELECT unit, nth, k, unnest(CASE WHEN unit % 3 = 0 THEN [CASE k % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'note' WHEN 2 THEN 'blank' ELSE 'data' END]
              WHEN unit % 3 = 1 THEN CASE WHEN k % 4 = 0 THEN ['blank', 'blank', 'title', 'data', 'data'] ELSE [CASE WHEN k % 6 < 2 THEN 'blank' WHEN k % 6 = 2 THEN 'title' ELSE 'data' END] END
              ELSE [CASE WHEN k % 3 = 0 THEN 'blank' ELSE 'data' END] END) AS what, generate_subscripts(CASE WHEN unit % 3 = 1 AND k % 4 = 0 THEN [1, 2, 3, 4, 5] ELSE [1] END, 1) AS i FROM o),
    r AS (SELECT unit, what, row_number() OVER (PARTITION BY unit ORDER BY nth, i) - 1 AS "row" FROM l)"""

SQL: dict[str, str] = {
    "sheet_blocks": f"""WITH {SHEETS},
        m AS (SELECT *, sum((what = 'code')::INT) OVER (PARTITION BY unit ORDER BY "row") AS run FROM r),
        e AS (SELECT unit, run, min("row") AS a, max("row") FILTER (what IN ('code', 'data', 'title')) AS b FROM m WHERE run > 0 GROUP BY 1, 2),
        k AS (SELECT unit, a, b, row_number() OVER (PARTITION BY unit ORDER BY a) - 1 AS block FROM e WHERE b > a),
        rest AS (SELECT * FROM r WHERE unit NOT IN (SELECT unit FROM k)),
        f AS (SELECT *, lag("row") OVER (PARTITION BY unit ORDER BY "row") AS prv FROM rest WHERE what <> 'blank'),
        g AS (SELECT *, sum((prv IS NULL OR "row" - prv > 2)::INT) OVER (PARTITION BY unit ORDER BY "row") AS run FROM f),
        h AS (SELECT unit, run, min("row") AS a, max("row") AS b, count(*) AS n, arg_min(what, "row") IN ('title', 'code', 'note') AS titled FROM g GROUP BY 1, 2),
        headed AS (SELECT unit, run FROM (SELECT *, row_number() OVER (PARTITION BY unit, run ORDER BY "row") AS q FROM g) WHERE q BETWEEN 2 AND 6 AND what = 'data' GROUP BY 1, 2),
        gb AS (SELECT h.*, row_number() OVER (PARTITION BY h.unit ORDER BY a) - 1 AS block, n >= 3 AND titled AND (h.unit, h.run) IN (SELECT unit, run FROM headed) AS strong FROM h WHERE b > a),
        pt AS (SELECT unit FROM gb GROUP BY unit HAVING count(*) > 1 AND count(*) FILTER (strong) >= 2),
        w AS (SELECT unit, min("row") AS a, max("row") AS b FROM rest WHERE what <> 'blank' AND unit NOT IN (SELECT unit FROM pt) GROUP BY 1),
        z AS (SELECT unit, a, b, block, 'marker' AS chosen_by FROM k UNION ALL SELECT unit, a, b, block, 'gap' FROM gb WHERE unit IN (SELECT unit FROM pt) UNION ALL SELECT unit, a, b, 0, 'whole' FROM w)
        SELECT z.unit AS unit, "row"::INT AS "row", block::INT AS block, chosen_by FROM z JOIN r ON r.unit = z.unit AND r."row" BETWEEN a AND b""",
    "rehome_changed_titles": """WITH m AS (SELECT p_brand AS scope, CASE WHEN p_partkey % 9 <> 0 THEN dense_rank() OVER (PARTITION BY p_brand ORDER BY p_name) - 1 END AS g, p_partkey AS k, p_name || CASE WHEN p_partkey % 4 = 0 THEN ' (urban)' ELSE '' END AS t,
                CASE WHEN p_partkey % 5 = 0 THEN p_name || '  (rural)' WHEN p_partkey % 7 = 0 THEN 'new ' || p_type WHEN p_partkey % 11 = 0 THEN 'small ring' END AS n, p_name FROM part),
        f AS (SELECT scope, g, k, coalesce(n, t) AS title, upper(trim(regexp_replace(coalesce(n, t), '\\s*\\([^()]*\\)$', ''))) AS key, n IS NOT NULL AND upper(trim(regexp_replace(n, '\\s*\\([^()]*\\)$', ''))) <> upper(p_name) AS moves FROM m),
        nm AS (SELECT scope, g, arg_min(key, k) AS key FROM f WHERE g IS NOT NULL GROUP BY 1, 2),
        home AS (SELECT scope, key, min(g) AS home FROM (SELECT scope, g, arg_min(key, k) AS key FROM f WHERE g IS NOT NULL AND NOT moves GROUP BY 1, 2) GROUP BY 1, 2),
        pu AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY g NULLS LAST, k) AS turn FROM f WHERE moves),
        top AS (SELECT scope, max(g) AS top FROM m GROUP BY 1),
        fr AS (SELECT pu.scope AS scope, pu.key AS key, row_number() OVER (PARTITION BY pu.scope ORDER BY min(turn)) AS nth FROM pu LEFT JOIN home USING (scope, key) WHERE home IS NULL GROUP BY 1, 2),
        al AS (SELECT scope, g, k, title, key, 0 AS late, k AS pos FROM f WHERE NOT moves
               UNION ALL SELECT pu.scope, coalesce(home, top + nth), k, title, pu.key, 1, turn FROM pu LEFT JOIN home ON home.scope = pu.scope AND home.key = pu.key LEFT JOIN fr ON fr.scope = pu.scope AND fr.key = pu.key JOIN top ON top.scope = pu.scope),
        nu AS (SELECT *, row_number() OVER (PARTITION BY scope, g ORDER BY late, pos) - 1 AS place, first_value(key) OVER (PARTITION BY scope, g ORDER BY late, pos) AS fk FROM al),
        fi AS (SELECT nu.scope AS scope, nu.g AS group_no, place, k, title, CASE WHEN nu.g IS NOT NULL THEN lower(coalesce(nm.key, fk)) END AS low FROM nu LEFT JOIN nm ON nm.scope = nu.scope AND nm.g = nu.g)
        SELECT scope, group_no::INT AS group_no, place::INT AS place, k::VARCHAR AS table_id, title, array_to_string(list_transform(string_split(low, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS group_name FROM fi""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"sheet_blocks": sheet_blocks, "rehome_changed_titles": rehome_changed_titles}
