"""Matching of tables made from part to workbooks made from it, beside a recursive SQL text that takes the tables one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgrid.operators import inventory
from quillgrid.session import table

#: Both texts are read by either engine.
TABLES = """SELECT p_type AS scope, p_partkey AS ord,
    CASE p_partkey % 6 WHEN 0 THEN concat('cb-t', p_partkey, '_2021_V1') WHEN 1 THEN concat('CB T', p_partkey - 1, '_2020_v2') WHEN 3 THEN concat('w_', lower(p_brand)) ELSE '' END AS id,
    CASE p_partkey % 6 WHEN 2 THEN concat('Table B-', p_partkey, ' (old)') WHEN 3 THEN concat('C.', p_partkey % 20) WHEN 5 THEN concat('B', p_partkey - 3) END AS table_id,
    concat(p_name, CASE WHEN p_size % 2 = 0 THEN ' (urban)' ELSE ' births' END) AS title, CASE WHEN p_partkey % 12 = 3 THEN 'sheet (ii)' ELSE 'sheet' END AS sheet,
    CASE WHEN p_partkey % 7 = 0 THEN concat('file ', p_partkey % 40) ELSE concat('own ', p_partkey) END AS source_file FROM part"""
ITEMS = """SELECT p_type AS scope, p_partkey AS ord, p_brand AS workbook,
    CASE WHEN p_partkey % 6 < 2 THEN concat('CB_T', p_partkey - p_partkey % 6, '_2021_V', p_partkey % 6 + 1) ELSE concat('ZZ_', p_partkey) END AS unique_dataset_id,
    CASE p_partkey % 6 WHEN 2 THEN concat('b-', p_partkey) WHEN 3 THEN concat('c-', p_partkey % 20, ' (Provisional)') WHEN 4 THEN concat('C', p_partkey % 20, '2') ELSE '' END AS table_id,
    concat(p_name, ' of ', p_brand) AS short_description FROM part"""


def frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    table(spark, sf, "part").createOrReplaceTempView("quillgrid_part")
    return spark.sql(TABLES.replace("FROM part", "FROM quillgrid_part")), spark.sql(ITEMS.replace("FROM part", "FROM quillgrid_part"))


def inventory_match(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.matched(*frames(spark, sf))


def inventory_left(spark: SparkSession, sf: str) -> DataFrame:
    tables, items = frames(spark, sf)
    return inventory.unmatched_items(items, inventory.matched(tables, items)).select("scope", "ord", "unique_dataset_id")


STEM = "regexp_replace(regexp_replace(upper({0}), '_[0-9]{{4}}_[A-Z0-9]+$', ''), '[^A-Z0-9]', '', 'g')"
WHOLE = "regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g')"
FOUND = f"""t AS (SELECT *, nullif({WHOLE.format("id")}, '') AS whole, nullif({STEM.format("id")}, '') AS stem, lower(concat_ws(' ', coalesce(table_id, ''), coalesce(title, ''), coalesce(sheet, ''), coalesce(id, ''))) AS said,
                 nullif(regexp_replace(regexp_replace(replace(upper(coalesce(table_id, '')), 'TABLE', ''), '\\([^)]*\\)', '', 'g'), '[^A-Z0-9&]', '', 'g') || CASE WHEN sheet = 'sheet (ii)' THEN '2' ELSE '' END, '') AS code,
                 row_number() OVER (PARTITION BY scope ORDER BY ord) AS nth FROM ({TABLES}) x),
    i AS (SELECT *, nullif({WHOLE.format("unique_dataset_id")}, '') AS whole, nullif({STEM.format("unique_dataset_id")}, '') AS stem, list_distinct(regexp_extract_all(lower(short_description), '[a-z]+')) AS words_any, regexp_extract_all(lower(short_description), '[a-z]+') AS words,
                 nullif(regexp_replace(regexp_replace(replace(upper(table_id), 'TABLE', ''), '\\([^)0-9][^)]*\\)', '', 'g'), '[^A-Z0-9&]', '', 'g'), '') AS code FROM ({ITEMS}) x),
    e AS (SELECT scope, whole, max(ord) AS exact FROM i GROUP BY 1, 2), s AS (SELECT scope, stem, list(ord) AS stems FROM i GROUP BY 1, 2),
    c AS (SELECT scope, code, list(struct_pack(o := ord, d := short_description, w := words) ORDER BY ord) AS coded FROM i GROUP BY 1, 2),
    q AS (SELECT t.scope AS scope, ord, nth, said, exact, coalesce(stems, []) AS stems, coalesce(coded, []) AS coded FROM t LEFT JOIN e ON e.scope = t.scope AND e.whole = t.whole
          LEFT JOIN s ON s.scope = t.scope AND s.stem = t.stem LEFT JOIN c ON c.scope = t.scope AND c.code = t.code),
    f AS (SELECT DISTINCT scope, 0::BIGINT AS nth, NULL::BIGINT AS ord, []::BIGINT[] AS used, NULL::BIGINT AS item, NULL::VARCHAR AS confidence FROM t
          UNION ALL
          SELECT scope, nth, ord, CASE WHEN item IS NULL THEN used ELSE list_append(used, item) END, item, confidence FROM (
            SELECT *, CASE confidence WHEN 'exact' THEN exact WHEN 'stem' THEN stems[1] WHEN 'code' THEN coded[1].o WHEN 'code+keyword' THEN told[1].o END AS item FROM (
              SELECT *, CASE WHEN exact IS NOT NULL AND NOT list_contains(used, exact) THEN 'exact' WHEN len(stems) = 1 THEN 'stem' WHEN len(coded) = 1 THEN 'code'
                             WHEN len(told) = 1 THEN 'code+keyword' WHEN len(coded) > 1 THEN 'ambiguous' ELSE 'none' END AS confidence FROM (
                SELECT *, list_filter(coded, lambda k: coalesce(contains(said, list_filter(k.w, lambda x: len(x) > 3 AND NOT list_contains(flatten(list_transform(list_filter(coded, lambda b: b.d <> k.d), lambda b: b.w)), x))[1]), false)) AS told FROM (
                  SELECT q.scope AS scope, q.nth AS nth, q.ord AS ord, q.said AS said, q.exact AS exact, f.used AS used, list_filter(q.stems, lambda o: NOT list_contains(f.used, o)) AS stems,
                         list_filter(q.coded, lambda k: NOT list_contains(f.used, k.o)) AS coded FROM f JOIN q ON q.scope = f.scope AND q.nth = f.nth + 1))))),
    g AS (SELECT f.scope AS scope, f.ord AS ord, f.item AS item, f.confidence AS confidence, i.workbook AS workbook, t.source_file AS file,
                 upper(trim(regexp_replace(t.title, '\\s*\\([^()]*\\)\\s*$', ''))) AS base
          FROM f JOIN t ON t.scope = f.scope AND t.ord = f.ord LEFT JOIN i ON i.scope = f.scope AND i.ord = f.item),
    bf AS (SELECT scope, file, min(workbook) AS b FROM g WHERE workbook IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT workbook) = 1),
    bt AS (SELECT scope, base, min(workbook) AS b FROM g WHERE workbook IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT workbook) = 1)"""

SQL: dict[str, str] = {
    "inventory_match": f"""WITH RECURSIVE {FOUND} SELECT g.scope AS scope, ord, item, coalesce(workbook, bf.b, bt.b) AS workbook,
            CASE WHEN workbook IS NULL AND coalesce(bf.b, bt.b) IS NOT NULL THEN 'grouped' ELSE confidence END AS confidence
        FROM g LEFT JOIN bf ON bf.scope = g.scope AND bf.file = g.file LEFT JOIN bt ON bt.scope = g.scope AND bt.base = g.base""",
    "inventory_left": f"""WITH RECURSIVE {FOUND} SELECT scope, ord, unique_dataset_id FROM i WHERE (scope, ord) NOT IN (SELECT scope, item FROM f WHERE item IS NOT NULL)""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"inventory_match": inventory_match, "inventory_left": inventory_left}
