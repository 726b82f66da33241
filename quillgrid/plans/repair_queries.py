"""Repairs of grids and of model replies made from part, beside the SQL they are compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import replies
from quillgrid.operators import repairs, stacked, tables
from quillgrid.session import dealt, table, unsent

#: Texts that both engines read.
GLUED = """SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN concat(p_name, '|', p_size, ' ', p_partkey, '|||9') WHEN 1 THEN concat(p_name, '||', p_size, ' 2 3||') WHEN 2 THEN concat('||', p_size, ' (4.5) ', p_partkey, '|x|7')
    WHEN 3 THEN concat('||1 2 3 ', p_size, '|', CASE WHEN p_size % 2 = 0 THEN '|8' ELSE '|' END) WHEN 4 THEN concat('1 ', p_size, '||3 4||5 6 7') WHEN 5 THEN concat(p_size, '  ', p_partkey, '%||a 1||') ELSE concat('5 6|x|', p_size, ' 1,000||') END AS line FROM part"""
LAYOUT = """SELECT p_size AS unit, p_partkey AS row, CASE p_size % 4
    WHEN 0 THEN concat(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END, '|', CASE WHEN p_partkey % 2 = 1 THEN p_name WHEN p_partkey % 100 = p_size THEN 'ing' WHEN p_partkey % 90 = p_size THEN 'Of all' ELSE '' END, '|', p_partkey, '||', p_partkey + 1)
    WHEN 1 THEN concat(p_name, '|', p_partkey, '|', p_size, '|', CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE 7 END, '|')
    WHEN 2 THEN concat(p_name, '||', p_size, '|', p_partkey, '|')
    ELSE concat('A', p_size, '|', p_brand, '|', CASE WHEN p_partkey % 150 = p_size THEN 'Of ' ELSE '' END, '||', CASE WHEN p_partkey % 70 = p_size THEN substring(p_brand, 1, 5) ELSE '' END) END AS line FROM part"""
HEADS = ("Cause>|Cause>|Male>|Male (2)>|All>", "Name>|Births>|Births>Male|Births>Female|Births>Total", "Name>|Deaths>|Deaths>Male|Deaths>Female|Rest>", "No>|Brand>|Brand>|Brand>|Brand>")
REPLY = """SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN concat('Sure: ```json', chr(10), '{"title": "', p_name, ' {x} \\\\"q\\\\"", "n": {"a": [1, 2, ], }, } and {"b": 1}', chr(10), '```')
    WHEN 1 THEN concat('{"title": "', p_name, '"') WHEN 2 THEN concat('no object, ', p_name) WHEN 3 THEN concat('{“title”: “', p_name, '”, "k": ', p_size, ' , }}') WHEN 4 THEN concat('} {"title": "}', p_brand, '{", "k": {"t": "', p_name, '"}}  x')
    WHEN 5 THEN concat('{"title": "open ', p_name, '}') WHEN 6 THEN concat('```', chr(10), '{"k":', p_size, ',"title":null}', chr(10), '``` ') ELSE concat('{', p_name, ' {"title": "', p_type, '"}, ]') END AS reply FROM part"""


def read(spark: SparkSession, sf: str, text: str) -> DataFrame:
    table(spark, sf, "part").createOrReplaceTempView("quillgrid_part")
    rows = spark.sql(text.replace("FROM part", "FROM quillgrid_part").replace("chr(10)", "char(10)"))
    return dealt(rows, "k" if "k" in rows.columns else "row")


def glued_spread(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.transform(F.split("line", r"\|", -1), lambda c: F.nullif(c, F.lit("")))
    found = read(spark, sf, GLUED).select("k", repairs.spread_numbers(cells).alias("cells"))
    return found.select("k", F.array_join("cells", "|", "").alias("cells"))


def extracted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf, LAYOUT).select("unit", "row", F.split("line", r"\|", -1).alias("cells"))
    heads = [(i, c, *h.split(">")) for i, line in enumerate(HEADS) for c, h in enumerate(line.split("|"))]
    heads = spark.createDataFrame(heads, "layout int, col int, up string, own string")
    path = F.when(F.col("own") != "", F.array("up", "own")).otherwise(F.array(F.regexp_replace("up", r" \([0-9]\)$", "")))
    name = F.when(F.col("own") != "", F.col("own")).otherwise(F.col("up"))
    return rows, rows.select("unit").distinct().join(heads, F.col("unit") % 4 == F.col("layout")).select("unit", "col", name.alias("name"), path.alias("path"))


def shown(rows: DataFrame, names: DataFrame) -> DataFrame:
    line = names.groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "name"))), lambda x: x["name"]), "|").alias("names"))
    return rows.join(unsent(line), "unit").select("unit", "row", "names", F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), "|").alias("cells"))


def phantom_columns(spark: SparkSession, sf: str) -> DataFrame:
    return shown(*repairs.coalesced(*extracted(spark, sf), "unit"))


def parent_columns(spark: SparkSession, sf: str) -> DataFrame:
    return shown(*repairs.without_parents(*extracted(spark, sf), "unit"))


def json_extracted(spark: SparkSession, sf: str) -> DataFrame:
    found = read(spark, sf, REPLY)
    return found.select("k", replies.first_object(F.col("reply")).alias("object"), replies.mended(F.col("reply")).alias("mended"), replies.fields(F.col("reply"), ("title",))["title"].alias("title"))


NUM = r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"
NUMERIC = f"regexp_matches(CASE WHEN regexp_matches(x, '^\\(.+\\)$') THEN replace(x, '%', '')[2:-2] ELSE regexp_replace(x, '[,%*]', '', 'g') END, '{NUM}')"
HEAD_ROWS = ", ".join(f"({i}, {c}, '{h.split('>')[0]}', '{h.split('>')[1]}')" for i, line in enumerate(HEADS) for c, h in enumerate(line.split("|")))
GRID = f"""r AS (SELECT unit, "row", string_split(line, '|') AS cells FROM ({LAYOUT.replace("AS row,", 'AS "row",')}) x),
    h AS (SELECT DISTINCT unit, col, up, own, CASE WHEN own <> '' THEN own ELSE up END AS name, CASE WHEN own <> '' THEN lower(up) ELSE '' END AS grp, lower(regexp_replace(up, ' \\([0-9]\\)$', '')) || '/' || lower(own) AS key
          FROM (SELECT DISTINCT unit FROM r) u, (VALUES {HEAD_ROWS}) v(layout, col, up, own) WHERE unit % 4 = layout),
    c AS (SELECT unit, "row", unnest(cells) AS t, generate_subscripts(cells, 1) - 1 AS col FROM r),
    l AS (SELECT unit, "row", col, trim(t) AS t FROM c)"""
JOIN_TEXT = "CASE WHEN a = '' THEN b WHEN b = '' OR contains(a, b) THEN a WHEN contains(b, a) THEN b WHEN regexp_matches(a, '[\\p{L}\\p{N}]$') AND regexp_matches(b, '^[\\p{L}\\p{N}]') AND (regexp_matches(b, '^\\p{Ll}') OR (len(b) <= 6 AND NOT contains(b, ' ') AND NOT regexp_matches(b, '^[0-9]'))) THEN a || b ELSE a || ' ' || b END"

SQL: dict[str, str] = {
    "glued_spread": f"""WITH RECURSIVE g AS (SELECT k, string_split(line, '|') AS cells FROM ({GLUED}) x),
        f AS (SELECT k, cells, 1::BIGINT AS j FROM g
              UNION ALL
              SELECT k, CASE WHEN s IS NULL THEN cells ELSE list_transform(cells, lambda y, i: CASE WHEN i BETWEEN s AND s + n - 1 THEN parts[i - s + 1] ELSE y END) END, CASE WHEN s IS NULL THEN j + 1 ELSE s + n END FROM (
                SELECT *, CASE WHEN n < 2 OR len(list_filter(parts, lambda x: NOT {NUMERIC})) > 0 THEN NULL WHEN n <= aft + 1 THEN j WHEN n <= bef + 1 THEN j - n + 1 WHEN n <= bef + aft + 1 THEN j + aft - n + 1 END AS s FROM (
                  SELECT *, len(parts) AS n, coalesce(list_position(list_transform(cells[j + 1:], lambda y: y <> ''), true), len(cells) - j + 1) - 1 AS aft,
                         coalesce(list_position(list_transform(list_reverse(cells[1:j - 1]), lambda y: y <> ''), true), j) - 1 AS bef FROM (
                    SELECT *, string_split(trim(regexp_replace(cells[j], '\\s+', ' ', 'g')), ' ') AS parts FROM f WHERE j <= len(cells)))))
        SELECT k, array_to_string(cells, '|') AS cells FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY j DESC) AS z FROM f) WHERE z = 1""",
    "phantom_columns": f"""WITH RECURSIVE {GRID},
        a AS (SELECT *, sum(CASE WHEN prv = key THEN 0 ELSE 1 END) OVER (PARTITION BY unit ORDER BY col) AS run FROM (SELECT *, lag(key) OVER (PARTITION BY unit ORDER BY col) AS prv FROM h)),
        d AS (SELECT unit, run FROM (SELECT l.unit AS unit, run, "row" FROM l JOIN a ON a.unit = l.unit AND a.col = l.col WHERE t <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT t) >= 2) GROUP BY 1, 2 HAVING count(*) >= 2),
        w AS (SELECT a.*, (a.unit, a.run) IN (SELECT unit, run FROM d) OR count(*) OVER (PARTITION BY unit, run) = 1 AS alone FROM a),
        p AS (SELECT *, dense_rank() OVER (PARTITION BY unit ORDER BY run, CASE WHEN alone THEN col ELSE -1 END) AS nw FROM w),
        q AS (SELECT l.unit AS unit, "row", nw, t, row_number() OVER (PARTITION BY l.unit, "row", nw ORDER BY l.col) AS i FROM l JOIN p ON p.unit = l.unit AND p.col = l.col),
        z AS (SELECT unit, "row", nw, i, t FROM q WHERE i = 1
              UNION ALL SELECT unit, "row", nw, i, {JOIN_TEXT} FROM (SELECT z.unit AS unit, z."row" AS "row", z.nw AS nw, q.i AS i, z.t AS a, q.t AS b FROM z JOIN q ON q.unit = z.unit AND q."row" = z."row" AND q.nw = z.nw AND q.i = z.i + 1)),
        e AS (SELECT unit, "row", nw, arg_max(t, i) AS t FROM z GROUP BY 1, 2, 3),
        n AS (SELECT unit, string_agg(name, '|' ORDER BY nw) AS names FROM (SELECT unit, nw, arg_min(CASE WHEN alone THEN name ELSE regexp_replace(name, ' \\([0-9]\\)$', '') END, col) AS name FROM p GROUP BY 1, 2) GROUP BY unit)
        SELECT e.unit AS unit, "row", names, string_agg(t, '|' ORDER BY nw) AS cells FROM e JOIN n ON n.unit = e.unit GROUP BY 1, 2, 3""",
    "parent_columns": f"""WITH {GRID},
        k AS (SELECT unit, col, count(*) FILTER (t <> '') AS n FROM l GROUP BY 1, 2),
        fam AS (SELECT p.unit AS unit, p.col AS head, max(o.col) AS last FROM h p JOIN h o ON o.unit = p.unit AND o.col > p.col AND o.grp = lower(p.name)
                WHERE p.grp = '' AND NOT EXISTS (SELECT 1 FROM h m WHERE m.unit = p.unit AND m.col > p.col AND m.col < o.col AND m.grp <> lower(p.name)) GROUP BY 1, 2 HAVING count(*) >= 2),
        sh AS (SELECT fam.* FROM fam JOIN k a ON a.unit = fam.unit AND a.col = head JOIN k b ON b.unit = fam.unit AND b.col = last WHERE a.n >= 2 AND b.n = 0),
        m AS (SELECT l.unit AS unit, "row", CASE WHEN sh.head IS NOT NULL THEN l.col + 1 ELSE l.col END AS col, t FROM l LEFT JOIN sh ON sh.unit = l.unit AND l.col BETWEEN head AND last WHERE t <> ''),
        kp AS (SELECT h.*, row_number() OVER (PARTITION BY h.unit ORDER BY col) AS nw FROM h WHERE (unit, col) IN (SELECT unit, col FROM m) OR (unit, lower(regexp_replace(name, ' \\([0-9]\\)$', ''))) NOT IN (SELECT unit, grp FROM h WHERE grp <> '')),
        n AS (SELECT unit, string_agg(name, '|' ORDER BY nw) AS names FROM kp GROUP BY unit)
        SELECT r.unit AS unit, r."row" AS "row", any_value(names) AS names, string_agg(coalesce(m.t, ''), '|' ORDER BY nw) AS cells
        FROM r JOIN n ON n.unit = r.unit JOIN kp ON kp.unit = r.unit LEFT JOIN m ON m.unit = r.unit AND m."row" = r."row" AND m.col = kp.col GROUP BY 1, 2""",
    "json_extracted": f"""WITH r AS (SELECT k, replace(reply, '\\\\', '\\') AS reply FROM ({REPLY}) x),
        b AS (SELECT k, reply, translate(regexp_replace(regexp_replace(trim(regexp_replace(reply, '```[a-zA-Z]*\\n?', '', 'g')), '`+$', ''), '^\\s+|\\s+$', '', 'g'), '“”‘’', '""''''') AS bare FROM r),
        e AS (SELECT k, reply AS t, 0 AS w FROM b UNION ALL SELECT k, bare, 1 FROM b),
        p AS (SELECT k, w, t[instr(t, '{{'):] AS t, unnest(range(1, len(t) + 1)) AS j FROM e WHERE contains(t, '{{')),
        c AS (SELECT k, w, t[1:j] AS pre, regexp_replace(t[1:j], '"([^"\\\\]|\\\\.)*"', '', 'gs') AS left_ FROM p WHERE t[j] = '}}' AND j <= len(t)),
        o AS (SELECT k, w, arg_min(pre, len(pre)) AS obj FROM c WHERE NOT contains(left_, '"') AND len(left_) - len(replace(left_, '{{', '')) = len(left_) - len(replace(left_, '}}', '')) GROUP BY 1, 2),
        d AS (SELECT b.k AS k, o0.obj AS object, regexp_replace(coalesce(o1.obj, bare), ',\\s*([}}\\]])', '\\1', 'g') AS mended FROM b LEFT JOIN o o0 ON o0.k = b.k AND o0.w = 0 LEFT JOIN o o1 ON o1.k = b.k AND o1.w = 1)
        SELECT k, object, mended, CASE WHEN json_valid(mended) THEN json_extract_string(mended, '$.title') END AS title FROM d""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"glued_spread": glued_spread, "phantom_columns": phantom_columns, "parent_columns": parent_columns, "json_extracted": json_extracted}


def stacked_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Grids of parts whose readers have stacked rows: with sexes, without, and with figures left to the next row."""
    n = F.lit("\n")
    part = table(spark, sf, "part")
    key, name = F.col("p_partkey"), F.initcap("p_name")
    title = F.concat(name, F.lit(" (A"), key % 90, F.lit(")"))
    wrapped = F.concat(F.lit("Other "), F.col("p_name"), F.lit(" and"), n, F.lit("its kind (B"), key % 90, F.lit(")"))
    figures = [F.concat_ws("\n", *((key % (7 + i + j)).cast("string") for i in range(4))) for j in range(3)]
    head = F.array(*map(F.lit, ("No.", "Name", "Sex", "Young", "Old")))
    sexed = F.array(F.concat(key, n, key + 1), F.concat(title, n, wrapped), F.lit("M\nF\nM\nF"), figures[0], figures[1])
    short = F.array(F.concat(key, n, key + 1), F.concat(title, n, F.upper("p_name")), F.lit("M\nF\n0M\nF"), (key % 5).cast("string"), (key % 6).cast("string"))
    rest = F.array(F.lit(""), F.lit(None).cast("string"), F.lit(""), F.concat_ws("\n", *((key % k).cast("string") for k in (3, 4, 5))), F.concat_ws("\n", *((key % k).cast("string") for k in (6, 7, 8))))
    bare = F.array(F.lit("Region"), F.lit("Cause"), F.lit("A"), F.lit("B"), F.lit("C"))
    plain = F.array(F.col("p_brand"), F.concat(title, n, wrapped, n, F.lit("Total")), figures[2], figures[0], F.lit("x"))
    grids = F.when(key % 3 == 0, F.array(head, sexed)).when(key % 3 == 1, F.array(head, short, rest)).otherwise(F.array(bare, plain))
    return part.select(key.alias("unit"), F.posexplode(grids).alias("row", "cells"))


def stacked_apart(spark: SparkSession, sf: str) -> DataFrame:
    found = stacked.expanded(stacked_grids(spark, sf), "unit")
    return found.select("unit", "row", F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), "|").alias("cells"))


QUERIES["stacked_apart"] = stacked_apart


def share_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each size's parts as rows of a table in which some rows hold shares only."""
    key = F.col("p_partkey")
    share = F.concat(F.lit("("), key, F.lit(".5)"))
    sparse = F.array(F.lit(""), F.when(key % 2 == 0, share), F.when(key % 3 == 0, share).when(key % 7 == 0, "-"), F.when(key % 11 == 0, share))
    plain = F.array("p_name", key.cast("string"), F.when(key % 13 == 0, "x").otherwise(F.col("p_size").cast("string")), F.when(key % 4 == 0, key.cast("string")))
    rows = table(spark, sf, "part").select(F.col("p_size").alias("unit"), key.alias("row"), F.when(key % 3 == 1, plain).otherwise(sparse).alias("cells"))
    return rows, rows.select("unit").distinct().select("unit", F.posexplode(F.array(*map(F.lit, ("Name", "A", "B", "C")))).alias("col", "name"))


def shares_folded(spark: SparkSession, sf: str) -> DataFrame:
    found = tables.shares_folded(*share_rows(spark, sf), "unit")
    return found.select("unit", "row", F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), "|").alias("cells"))


def tables_built(spark: SparkSession, sf: str) -> DataFrame:
    rows, columns = tables.built(stacked_grids(spark, sf), "unit")
    names = columns.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "name"))), lambda x: x["name"]).alias("names"))
    return rows.join(unsent(names), "unit").select("unit", "row", F.array_join("names", "|").alias("names"), F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), "|").alias("cells"))


QUERIES |= {"shares_folded": shares_folded, "tables_built": tables_built}
#: Two of three rows are sparse, so a share meets at most one figure and a row at most two rows of shares.
SQL["shares_folded"] = """WITH r AS (SELECT p_size AS unit, p_partkey AS k, p_partkey % 3 = 1 AS plain, '(' || p_partkey || '.5)' AS sh, p_name, p_size FROM part),
    c AS (SELECT unit, k, plain, CASE WHEN plain THEN p_name ELSE '' END AS c0, CASE WHEN plain THEN k::VARCHAR WHEN k % 2 = 0 THEN sh ELSE '' END AS c1,
                 CASE WHEN plain THEN CASE WHEN k % 13 = 0 THEN 'x' ELSE p_size::VARCHAR END WHEN k % 3 = 0 THEN sh WHEN k % 7 = 0 THEN '-' ELSE '' END AS c2, CASE WHEN plain THEN CASE WHEN k % 4 = 0 THEN k::VARCHAR ELSE '' END WHEN k % 11 = 0 THEN sh ELSE '' END AS c3 FROM r),
    f AS (SELECT *, NOT plain AND (c1 <> '')::INT + (c2 NOT IN ('', '-'))::INT + (c3 <> '')::INT = 1 AS sparse FROM c),
    b AS (SELECT *, max(k) FILTER (NOT sparse) OVER (PARTITION BY unit ORDER BY k) AS base FROM f),
    j AS (SELECT b.*, coalesce(b.sparse AND p.plain, false) AS joins FROM b LEFT JOIN b p ON p.unit = b.unit AND p.k = b.base),
    o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY k) - 1 AS row_no FROM j WHERE NOT joins),
    s AS (SELECT unit, base, string_agg(nullif(c1, ''), ' ' ORDER BY k) AS s1, string_agg(CASE WHEN c2 NOT IN ('', '-') THEN c2 END, ' ' ORDER BY k) AS s2, string_agg(nullif(c3, ''), ' ' ORDER BY k) AS s3 FROM j WHERE joins GROUP BY 1, 2)
    SELECT o.unit AS unit, row_no::INT AS "row", c0 || '|' || trim(c1 || coalesce(' ' || s1, '')) || '|' || trim(c2 || coalesce(' ' || s2, '')) || '|' || trim(c3 || coalesce(' ' || s3, '')) AS cells
    FROM o LEFT JOIN s ON s.unit = o.unit AND s.base = o.k"""
