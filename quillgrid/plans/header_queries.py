"""Header queries over grids printed from the rows of part, beside the SQL they are compared to.

Every part prints one grid: its key picks a layout, and the layout's marks are filled from its columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import cells as C
from quillgrid.operators import headers
from quillgrid.session import table

# Layouts of one to four header rows; | parts cells, and an empty cell is blank. {n} {b} {t} {s} {k} {y} are filled in.
LAYOUTS = (
    ("{n}|{b}|Budget|Year", "S1|{k}|2{k}|2020", "S2|1{k}|21{k}|2021"),
    ("State|{b}|{b}|RURAL|RURAL", "State|Male|Female|Male|Female", "01|1{s}|20|{k}|40", "02|11|21|31|41"),
    ("TABLE: B-{s}||||", "Sl. No.|State|{n}||", "||{y}|20{s}|Total", "(1)|(2)|(3)|(4)|(5)", "1|Assam|{k}|34.5|990"),
    ("Sl. No.|State|{t}|||", "||URBAN||RURAL|", "||Male|Female|Male|Female", "1|2|3|4|5|6", "1|{n}|{k}|{k}|110|120"),
    ("Mother|BIRTH ORDER {b}||", "A|12|{k}|600", "B|13|{k}|601"),
    ("Area|{n}|||", "|Workers|||", "|Main||Marginal|", "|Male|Female|Male|> {s}", "{t}|{k}|{k}|{k}|{k}"),
    ("{k}|300|450", "13|301|451"),
    ("||", "| nan |", "{n}|{b}|  {t}   {s} ", "x|{k}|12.5"),
    ("Statement {s}|Statement {s}|Statement {s}|Statement {s}", "Name|EDUCATION LEVEL|||", "{n}|{k}|{k}|{k}|9", "|(10.6)|(13.6)||"),
    ("{n}|{n}|{b}", "0|0|0", "a|b|{k}"),
)
MARKS = {"{n}": "p_name", "{b}": "p_brand", "{t}": "p_type", "{s}": "cast(p_size as varchar)", "{k}": "cast(p_partkey + 100 as varchar)", "{y}": "cast(1990 + p_size % 20 as varchar)"}


def printed_grids(spark: SparkSession, sf: str) -> DataFrame:
    """unit, row and cells: the grid of each part."""
    lines = [(i, r, line) for i, layout in enumerate(LAYOUTS) for r, line in enumerate(layout)]
    layouts = spark.createDataFrame(lines, "layout int, row int, line string")
    part = table(spark, sf, "part").withColumn("layout", (F.col("p_partkey") % len(LAYOUTS)).cast("int"))
    text = F.col("line")
    for mark, value in MARKS.items():
        text = F.replace(text, F.lit(mark), F.expr(value.replace("varchar", "string")))
    return part.join(F.broadcast(layouts), "layout").select(F.col("p_partkey").alias("unit"), "row", F.split(text, r"\|", -1).alias("cells"))


def header_rows(spark: SparkSession, sf: str) -> DataFrame:
    top = headers.top_rows(printed_grids(spark, sf), "unit", "row", "cells")
    return top.select("unit", "row", F.array_join("kinds", ",").alias("kinds"), "role", "header_count")


def headers_resolved(spark: SparkSession, sf: str) -> DataFrame:
    found = headers.headers_resolved(printed_grids(spark, sf), "unit", "row", "cells")
    return found.select("unit", "col", F.array_join("header_path", ">").alias("path"), "header_group", "name", "unique_name", "header_count")


def _grids_sql() -> str:
    listed = ", ".join(f"({i}, {r}, '{line}')" for i, layout in enumerate(LAYOUTS) for r, line in enumerate(layout))
    text = "line"
    for mark, value in MARKS.items():
        text = f"replace({text}, '{mark}', {value})"
    return f"SELECT p_partkey AS unit, \"row\", string_split({text}, '|') AS cells FROM part, (VALUES {listed}) l(layout, \"row\", line) WHERE p_partkey % {len(LAYOUTS)} = layout"


NUMBER = r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"
#: The grids' cells one by one, what each holds, and each row's role.
TOP_SQL = f"""
    g AS (SELECT unit, "row", cells FROM ({_grids_sql()}) x WHERE "row" < 10),
    width AS (SELECT unit, max(len(cells)) AS w FROM g GROUP BY unit),
    long AS (SELECT unit, "row", i - 1 AS col, CASE WHEN lower(t) IN ('nan', 'none', '<na>') THEN '' ELSE t END AS s, w
             FROM (SELECT unit, "row", w, i, trim(regexp_replace(coalesce(cells[i], ''), '\\s+', ' ', 'g')) AS t
                   FROM (SELECT unit, "row", cells, w, unnest(range(1, w + 1)) AS i FROM g JOIN width USING (unit)))),
    b AS (SELECT *, CASE WHEN regexp_matches(p, '^\\(.+\\)$') THEN trim(p[2:-2]) ELSE p END AS bare
          FROM (SELECT *, trim(regexp_replace(s, '[,%*]', '', 'g')) AS p FROM long)),
    c AS (SELECT *, CASE WHEN regexp_matches(bare, '{NUMBER}') THEN abs(try_cast(bare AS DOUBLE)) END AS num,
                 coalesce(regexp_matches(s, '^[0-9,]+$') AND try_cast(replace(s, ',', '') AS INT) BETWEEN 1800 AND 2100 AND len(replace(s, ',', '')) = 4, false) AS yr FROM b),
    d AS (SELECT *, coalesce(NOT yr AND (num >= 100 OR (regexp_matches(bare, '^[0-9]+\\.[0-9]+$') AND num >= 1)), false) AS cnt FROM c),
    e AS (SELECT *, s <> '' AND len(s) <= 24 AND (yr OR (NOT cnt AND (regexp_matches(replace(s, ' ', ''), '^([<>]=?[0-9]+\\+?|[0-9]+\\+)$') OR coalesce(num > 0, true)))) AS code,
                 CASE WHEN s = '' THEN 'span' WHEN coalesce(nxt = '', false) OR coalesce(upper(nxt) = upper(s), false) OR coalesce(upper(prv) = upper(s), false) THEN 'group' ELSE 'stub' END AS kind
          FROM (SELECT *, lead(s) OVER (PARTITION BY unit, "row" ORDER BY col) AS nxt, lag(s) OVER (PARTITION BY unit, "row" ORDER BY col) AS prv FROM d)),
    f AS (SELECT unit, "row", w, list(s ORDER BY col) AS cells, list(kind ORDER BY col) AS kinds, count(*) FILTER (s <> '') AS n,
                 count(*) FILTER (s <> '' AND num IS NOT NULL) AS nums, count(*) FILTER (cnt) AS cnts, count(*) FILTER (s <> '' AND len(s) <= 24) AS short,
                 count(*) FILTER (s <> '' AND len(s) <= 40) AS medium, count(*) FILTER (code) AS codes, count(DISTINCT upper(s)) FILTER (s <> '') AS kinds_of, count(DISTINCT s) FILTER (s <> '') AS texts,
                 first(s ORDER BY col) FILTER (s <> '') AS label, first(num ORDER BY col) FILTER (s <> '') AS first_num,
                 count(*) FILTER (regexp_matches(s, '^\\([0-9]+\\)$')) AS bracketed, list(s ORDER BY col) FILTER (s <> '') AS said FROM e GROUP BY unit, "row", w),
    h AS (SELECT *, w >= 2 AND n > 0 AND kinds_of = 1 AND (n = 1 OR (n >= greatest(2, floor(0.6 * w)) AND (tab OR len(label) >= 28)) OR (tab AND n >= 0.5 * w)) AS banner,
                 n > 0 AND (bracketed > 0.5 * n OR (n >= greatest(3, floor(0.6 * w)) AND array_to_string(said, ',') = array_to_string(range(1, n + 1), ','))) AS strip,
                 cnts >= 2 AND nums >= greatest(2, floor(0.5 * n)) AS figures
          FROM (SELECT *, coalesce(regexp_matches(label, '{C.TABLE_NUMBER}'), false) AS tab FROM f)),
    i AS (SELECT *, NOT coalesce(max(NOT banner AND (figures OR cnts >= 2)) OVER (PARTITION BY unit ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
                    AND (banner OR (NOT (figures OR cnts >= 2) AND strip)) AS skipped FROM h),
    r AS (SELECT unit, min("row") AS root FROM i WHERE NOT skipped GROUP BY unit),
    u AS (SELECT x.unit AS unit, x."row" AS "row", count(*) FILTER (p.kind = 'stub' AND x.s <> '' AND upper(x.s) <> upper(p.s)) AS own,
                 count(*) FILTER (p.kind = 'stub' AND x.s = '') AS open, count(*) FILTER (p.kind = 'group' AND x.code) AS below
          FROM e x JOIN r ON r.unit = x.unit JOIN e p ON p.unit = x.unit AND p."row" = r.root AND p.col = x.col GROUP BY 1, 2),
    j AS (SELECT i.*, r.root, CASE WHEN skipped THEN NULL WHEN i."row" = r.root THEN n > 0 AND nums <= 0.35 * n AND cnts = 0
                 ELSE n > 0 AND NOT (figures OR (own > 0 AND (cnts > 0 OR n > short)) OR own >= 2) AND own = 0
                      AND ((nums <= 0.35 * n AND cnts = 0 AND n <= 0.85 * w)
                           OR (n >= 2 AND short >= 0.75 * n AND cnts < 2 AND NOT (texts = 1 AND first_num IS NOT NULL) AND NOT (n > short AND cnts > 0) AND codes >= greatest(2, floor(0.55 * n)) AND (open > 0 OR below > 0))
                           OR (cnts < 2 AND medium >= greatest(1, floor(0.7 * n)))) END AS fits,
                 sum((NOT skipped)::INT) OVER (PARTITION BY i.unit ORDER BY i."row") AS nth
          FROM i LEFT JOIN r ON r.unit = i.unit LEFT JOIN u ON u.unit = i.unit AND u."row" = i."row"),
    stop AS (SELECT unit, min("row") AS ends FROM j WHERE NOT skipped AND NOT (fits AND nth <= 8) GROUP BY unit),
    cnt AS (SELECT j.unit AS unit, (1 + coalesce(max("row") FILTER (NOT skipped AND "row" < coalesce(ends, 99)), min("row") FILTER (NOT skipped AND n > 0), 0))::INT AS header_count
            FROM j LEFT JOIN stop ON stop.unit = j.unit GROUP BY j.unit),
    top AS (SELECT j.*, header_count, CASE WHEN skipped THEN 'skipped' WHEN "row" < header_count THEN 'header' ELSE 'body' END AS role FROM j JOIN cnt ON cnt.unit = j.unit)"""

SQL: dict[str, str] = {
    "header_rows": f"""WITH {TOP_SQL} SELECT unit, "row", array_to_string(kinds, ',') AS kinds, role, header_count FROM top""",
    "headers_resolved": f"""WITH {TOP_SQL},
        head AS (SELECT * FROM top t WHERE role = 'header' AND (NOT banner OR NOT EXISTS (SELECT 1 FROM top o WHERE o.unit = t.unit AND o.role = 'header' AND NOT o.banner))),
        k AS (SELECT unit, unnest(kinds) AS kind, generate_subscripts(kinds, 1) - 1 AS col FROM head WHERE ("row", unit) IN (SELECT (min("row"), unit) FROM head GROUP BY unit)),
        cell AS (SELECT unit, "row", unnest(cells) AS s, generate_subscripts(cells, 1) - 1 AS col FROM head),
        down AS (SELECT unit, "row", col, last_value(nullif(s, '') IGNORE NULLS) OVER (PARTITION BY unit, col ORDER BY "row") AS s FROM cell),
        filled AS (SELECT unit, "row", col, last_value(s IGNORE NULLS) OVER (PARTITION BY unit, "row" ORDER BY col) AS s FROM down),
        kept AS (SELECT unit, "row", col, s, lag(s) OVER (PARTITION BY unit, col ORDER BY "row") AS prv FROM filled WHERE s IS NOT NULL AND NOT regexp_matches(s, '{C.TABLE_NUMBER}')),
        p AS (SELECT unit, col, list(s ORDER BY "row") AS path FROM kept WHERE prv IS NULL OR upper(prv) <> upper(s) GROUP BY unit, col),
        q AS (SELECT k.unit AS unit, k.col AS col, kind, coalesce(path, ['Col_' || (k.col + 1)]) AS path FROM k LEFT JOIN p ON p.unit = k.unit AND p.col = k.col),
        s1 AS (SELECT unit, col, kind, CASE WHEN kind = 'stub' AND upper(path[1]) <> upper(path[-1]) THEN path[1:1] ELSE path END AS path,
                      sum((kind <> 'span')::INT) OVER (PARTITION BY unit ORDER BY col) AS run FROM q),
        s2 AS (SELECT *, row_number() OVER (PARTITION BY unit, run ORDER BY col) AS pos, count(*) OVER x AS n, min(upper(path[1])) OVER x = max(upper(path[1])) OVER x AS same,
                      max(len(path)) OVER x AS deep, bool_or(kind = 'group') OVER x AS grouped FROM s1 WINDOW x AS (PARTITION BY unit, run)),
        s3 AS (SELECT unit, col, CASE WHEN n >= 2 AND same AND deep = 1 AND grouped AND len(path[1]) <= 48 AND (len(path[1]) >= 8 OR contains(path[1], ' '))
                      AND regexp_matches(lower(path[1]), '\\b(birth\\s*order|order|education|sex|gender|religion|marital|literacy|qualification|occupation)\\b')
                      THEN [path[1], CASE WHEN pos <= 8 THEN pos::VARCHAR WHEN pos = 9 THEN '>8' WHEN pos = 10 THEN 'All' ELSE (pos - 1)::VARCHAR END] ELSE path END AS path FROM s2),
        s4 AS (SELECT *, array_to_string(path, ' / ') AS display, row_number() OVER (PARTITION BY unit, array_to_string(path, ' / ') ORDER BY col) AS nth FROM s3)
        SELECT unit, col, array_to_string(path, '>') AS path, CASE WHEN len(path) > 1 THEN path[-2] END AS header_group, path[-1] AS name,
               CASE WHEN nth > 1 THEN display || ' (' || nth || ')' ELSE display END AS unique_name, header_count
        FROM s4 JOIN cnt USING (unit)""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"header_rows": header_rows, "headers_resolved": headers_resolved}
