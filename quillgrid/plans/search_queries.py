"""Merged cells, rough search, singleton merges and catalogue expansion, beside the SQL each is compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.operators import fuzzy, merges, singletons
from quillgrid.session import table
from quillgrid.sources import expand

#: Texts that both engines read; {} is a prefix of the tables' names.
NAMES = ("Sl. No.", "Name of item", "Sex", "Total", "Share")
BODIES = """SELECT l_orderkey // 4 AS unit, (row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY l_orderkey, l_linenumber) - 1)::INT AS "row",
    [CASE WHEN l_linenumber = 1 OR q % 7 = 0 THEN (l_orderkey % 4)::VARCHAR ELSE '' END,
     CASE WHEN p % 5 = 0 THEN 'Total' WHEN p % 3 = 0 THEN 'part ' || (p % 7) ELSE '-' END,
     CASE q % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'ALL' WHEN 2 THEN ' Female' ELSE '—' END,
     CASE WHEN p % 4 = 0 OR q % 6 = 5 THEN ' ' ELSE p::VARCHAR END,
     CASE WHEN q % 2 = 1 THEN NULL ELSE '12.5%' END] AS cells
    FROM (SELECT l_orderkey, l_linenumber, min(l_quantity)::INT AS q, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)"""


def bodies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"), F.min("l_partkey").alias("p"))
    unit = F.floor(F.col("l_orderkey") / 4)
    q, p = F.col("q"), F.col("p")
    cells = F.array(
        F.when((F.col("l_linenumber") == 1) | (q % 7 == 0), (F.col("l_orderkey") % 4).cast("string")).otherwise(""),
        F.when(p % 5 == 0, "Total").when(p % 3 == 0, F.concat(F.lit("part "), (p % 7).cast("string"))).otherwise("-"),
        F.when(q % 4 == 0, "Male").when(q % 4 == 1, "ALL").when(q % 4 == 2, " Female").otherwise("—"),
        F.when((p % 4 == 0) | (q % 6 == 5), " ").otherwise(p.cast("string")),
        F.when(q % 2 == 0, "12.5%"),
    )
    nth = F.row_number().over(W.partitionBy(unit).orderBy("l_orderkey", "l_linenumber")) - 1
    rows = lines.select(unit.alias("unit"), nth.alias("row"), cells.alias("cells"))
    return rows, rows.select("unit").distinct().withColumn("names", F.array(*map(F.lit, NAMES)))


def merges_inferred(spark: SparkSession, sf: str) -> DataFrame:
    return merges.inferred(*bodies(spark, sf), "unit")


def merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    """What is visible of the first cells of each page once the merges of all rows are laid over it, those of later rows first."""
    rows, names = bodies(spark, sf)
    found = merges.inferred(rows, names, "unit").withColumn("ord", -(F.col("row") * 10 + F.col("col"))).withColumn("row_span", F.col("row_span") + F.col("row") % 2)
    sizes = rows.groupBy("unit").agg((F.max("row") + 1).alias("n_rows")).withColumn("n_cols", F.lit(len(NAMES)))
    return merges.cell_spans(found, sizes, "unit")


def printed_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Tables titled from part, and queries from its names and brands as users mistype them."""
    part = table(spark, sf, "part")
    tables = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lit("by"), "p_type").alias("title"), F.col("p_size").alias("page"), F.concat(F.lit("T-"), F.col("p_partkey") % 97, F.lit("("), F.col("p_size"), F.lit(")")).alias("table_id"), F.concat("p_brand", F.lit(".xlsx")).alias("source_file"))
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    kinds = [
        F.concat(F.lit("n:"), F.expr("overlay(p_name placing '' from 2 for 1)")),
        F.concat(F.lit("t:"), F.lower(F.expr("overlay(p_type placing 'x' from 3 for 2)")), F.lit(" "), F.left(last, F.lit(2))),
        F.concat(F.lit("s:"), last, F.lit("ing "), first),
        F.concat(F.lit("p:"), F.lit("Page "), F.col("p_size") % 9),
        F.concat(F.lit("b:"), F.regexp_replace("p_brand", "#", " n"), F.lit("!")),
        F.concat(F.lit("l:"), F.lower("p_type"), last, F.lit("s")),
    ]
    queries = part.select(F.explode(F.array(*kinds)).alias("x")).distinct().select(F.col("x").alias("query_id"), F.expr("substring(x, 3)").alias("query"))
    return tables, queries


def fuzzy_search(spark: SparkSession, sf: str) -> DataFrame:
    """How many tables each query fits, and the first and last of them."""
    found = fuzzy.search(*printed_tables(spark, sf), ["title", "table_id", "source_file"])
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_found"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def singleton_frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    title = F.when(key % 11 == 0, " ").otherwise(F.concat_ws(" ", "p_name", F.lit("of"), "p_type", F.when(key % 3 == 0, F.lit("(urban)"))))
    singles = part.where("p_partkey % 13 <> 0").select("p_brand", key.cast("string").alias("id"), title.alias("title")).withColumnRenamed("p_brand", "scope")
    near = F.array(*((key + F.col("p_size") * k).cast("string") for k in (0, 25, 50)), key.cast("string"), F.lit(None).cast("string"))
    # The tables of a brand with one kind, as a model would propose them: the one before, itself, and those behind.
    kin = W.partitionBy("p_brand", "p_type").orderBy(key)
    beside = F.array_compact(F.array(F.lag(key).over(kin), key, *(F.lead(key, i).over(kin) for i in (1, 2, 3))))
    picked = F.transform(F.slice(beside, F.lit(1), (2 + key % 3).cast("int")), lambda x: x.cast("string"))
    confidence = F.when(key % 7 == 0, "medium").when(key % 2 == 0, " High ").otherwise("high")
    return part.select(F.col("p_brand").alias("scope"), key.alias("ord"), confidence.alias("confidence"), F.concat(picked, near).alias("ids")), singles


def singleton_merges(spark: SparkSession, sf: str) -> DataFrame:
    return singletons.accepted_merges(*singleton_frames(spark, sf)).select("scope", "ord", F.array_join("ids", ",").alias("ids"))


PAYLOAD = """CASE WHEN o_custkey % 50 = 0 THEN 'broken ' || o_orderkey WHEN o_orderkey % 11 = 0 THEN '[1]' WHEN o_orderkey % 3 = 0 THEN '{"id": ' || o_orderkey || ', "state": "' || o_orderstatus || '", "more": {"p": [' || (o_orderkey % 5) || ']}}'
    WHEN o_orderkey % 3 = 1 THEN '{"state": null, "k' || (o_orderkey % 4) || '": "a \\\\"q\\\\" b", "id": ' || o_orderkey || '}' ELSE '{"priority": "' || o_orderpriority || '", "id": true}' END"""


def stored_rows(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.expr(PAYLOAD.replace("o_orderkey ||", "cast(o_orderkey as string) ||"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("dataset"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderkey") % 13).alias("row_index"), F.col("o_orderkey").alias("id"), payload.alias("payload"))


def catalogue_expand(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    datasets = table(spark, sf, "customer").select(key.alias("dataset"), F.when(key % 2 == 0, F.concat(F.lit(" T"), key)).otherwise("").alias("table_id"), F.when(key % 3 == 0, F.col("c_name")).alias("title"), F.col("c_mktsegment").alias("segment"), F.when(key % 4 == 0, F.col("c_nationkey")).alias("nation"))
    found = expand.expanded_tables(datasets, stored_rows(spark, sf), "dataset", ["row_index", "id"], "payload", {"Category": "segment", "Geography": "nation"}, limit=6)
    return found.select("dataset", "table_id", "title", F.array_join("columns", "|").alias("columns"), "n_rows", F.array_join("notes", "|").alias("notes"), "error")


def catalogue_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = expand.expanded_rows(stored_rows(spark, sf), "dataset", ["row_index", "id"], "payload", limit=6)
    return found.select("dataset", "row", F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit("~"))), "|").alias("cells"))


EMPTY = "('', '—', '–', '-', '−', '‒')"
MERGED = f"""b AS ({BODIES}),
    l AS (SELECT unit, "row", i - 1 AS col, CASE WHEN trim(cells[i]) IN {EMPTY} THEN NULL ELSE trim(cells[i]) END AS v FROM (SELECT *, unnest(range(1, 6)) AS i FROM b)),
    s AS (SELECT unit, col, count(*) AS n, count(*) FILTER (v IS NULL) AS blank, count(DISTINCT lower(v)) AS d FROM l GROUP BY 1, 2),
    c AS (SELECT unit, col, col < 3 AS label, col < 2 AND blank >= 1 AND blank >= 0.12 * n AND blank < n AS sparse, col >= 3 AND blank >= 1 AND blank >= 0.12 * n AND blank < n AS open,
                 col < 2 AND NOT (blank >= 1 AND blank >= 0.12 * n AND blank < n) AND n - blank >= 2 AND d >= greatest(3, ceil(0.75 * (n - blank))) AS dense FROM s),
    z AS (SELECT unit, max("row") AS last FROM b GROUP BY 1),
    x AS (SELECT l.*, label, sparse, dense, open, label AND v IS NOT NULL AND regexp_matches(lower(v), '^(all|total|overall|aggregate|grand\\s*total)$|^(all|total)\\s*[(:]') AS summed FROM l JOIN c USING (unit, col)),
    f AS (SELECT unit, "row", min(col) FILTER (label AND v IS NOT NULL) AS lead, bool_or(summed) AS summed, bool_and(label OR v IS NULL) AS bare,
                 bool_or(label AND v IS NOT NULL AND NOT regexp_matches(trim(regexp_replace(v, '[,%*]', '', 'g')), '^-?[0-9]+(\\.[0-9]+)?$')) AS wordy FROM x GROUP BY 1, 2),
    st AS (SELECT * FROM x WHERE v IS NOT NULL),
    nx AS (SELECT a.unit AS unit, a.col AS col, a."row" AS "row", min(o."row") AS nxt FROM st a LEFT JOIN st o ON o.unit = a.unit AND o.col = a.col AND o."row" > a."row" GROUP BY 1, 2, 3),
    -- A run ends at the first later row in which something begins beside it.
    br AS (SELECT a.unit AS unit, a.col AS col, a."row" AS "row", min(f."row") AS stop FROM st a JOIN f ON f.unit = a.unit AND f."row" > a."row" JOIN z ON z.unit = a.unit
           WHERE a.label AND (f.lead < a.col OR (f.summed AND f."row" = z.last) OR EXISTS (
               SELECT 1 FROM x n JOIN x t ON t.unit = n.unit AND t.col = n.col WHERE n.unit = a.unit AND n."row" = f."row" AND t."row" = a."row" AND n.col <> a.col AND n.v IS NOT NULL
               AND (t.v IS NULL OR lower(t.v) <> lower(n.v)) AND (n.sparse OR (n.dense AND (n.summed OR t.summed))))) GROUP BY 1, 2, 3),
    sp AS (SELECT a.unit AS unit, a.col AS col, a."row" AS "row", least(coalesce(nxt, last + 1), coalesce(stop, last + 1)) - a."row" AS h FROM st a JOIN nx ON nx.unit = a.unit AND nx.col = a.col AND nx."row" = a."row" JOIN z ON z.unit = a.unit
           LEFT JOIN br ON br.unit = a.unit AND br.col = a.col AND br."row" = a."row" WHERE a.label),
    wd AS (SELECT sp.*, f.bare AND f.wordy AND h = 1 AS section, coalesce((SELECT min(o.col) FROM x o WHERE o.unit = sp.unit AND o.col > sp.col AND o."row" BETWEEN sp."row" AND sp."row" + h - 1 AND (o.v IS NOT NULL OR NOT o.label)), 5) AS blk, f.lead < sp.col AS led
           FROM sp JOIN f ON f.unit = sp.unit AND f."row" = sp."row"),
    w2 AS (SELECT *, CASE WHEN led THEN 1 ELSE blk - col END AS w FROM wd),
    w3 AS (SELECT *, CASE WHEN section THEN coalesce((SELECT min(o.col) FROM x o WHERE o.unit = w2.unit AND o."row" = w2."row" AND o.col >= w2.col + w AND (o.label OR o.v IS NOT NULL)), 5) - (col + w) ELSE 0 END AS more FROM w2),
    m AS (SELECT unit, "row", col, h::INT AS row_span, (w + more)::INT AS col_span FROM w3
          UNION ALL SELECT st.unit, st."row", st.col, (coalesce(nxt, last + 1) - st."row")::INT, 1 FROM st JOIN nx ON nx.unit = st.unit AND nx.col = st.col AND nx."row" = st."row" JOIN z ON z.unit = st.unit WHERE st.open)"""
TABLES = """t AS (SELECT p_partkey AS id, p_name || ' by ' || p_type AS title, p_size AS page, 'T-' || (p_partkey % 97) || '(' || p_size || ')' AS table_id, p_brand || '.xlsx' AS source_file FROM part),
    q AS (SELECT DISTINCT k AS query_id, k[3:] AS query FROM (SELECT unnest(['n:' || p_name[1] || p_name[3:], 't:' || lower(p_type[1:2] || 'x' || p_type[5:]) || ' ' || split_part(p_name, ' ', -1)[1:2],
             's:' || split_part(p_name, ' ', -1) || 'ing ' || split_part(p_name, ' ', 1), 'p:Page ' || (p_size % 9), 'b:' || replace(p_brand, '#', ' n') || '!', 'l:' || lower(p_type) || split_part(p_name, ' ', -1) || 's']) AS k FROM part))"""

SQL: dict[str, str] = {
    "merges_inferred": f"""WITH {MERGED} SELECT * FROM m WHERE row_span > 1 OR col_span > 1""",
    "merge_spans": f"""WITH RECURSIVE {MERGED},
        e AS (SELECT unit, "row", col, row_span + "row" % 2 AS row_span, col_span, row_number() OVER (PARTITION BY unit ORDER BY -("row" * 10 + col)) AS nth FROM m WHERE row_span > 1 OR col_span > 1),
        k AS (SELECT DISTINCT unit, 0::BIGINT AS nth, []::STRUCT(r INT, c INT, h INT, w INT)[] AS kept FROM b
              UNION ALL SELECT k.unit, e.nth, CASE WHEN len(list_filter(kept, lambda y: e."row" BETWEEN y.r AND y.r + y.h - 1 AND e.col BETWEEN y.c AND y.c + y.w - 1)) > 0 THEN kept
                     ELSE list_append(kept, struct_pack(r := e."row"::INT, c := e.col::INT, h := e.row_span::INT, w := e.col_span::INT)) END FROM k JOIN e ON e.unit = k.unit AND e.nth = k.nth + 1),
        a AS (SELECT unit, unnest(kept) AS y FROM k WHERE (unit, nth) IN (SELECT unit, max(nth) FROM k GROUP BY unit))
        SELECT l.unit AS unit, l."row" AS "row", l.col::INT AS col, coalesce(a.y.h, 1)::INT AS row_span, coalesce(a.y.w, 1)::INT AS col_span FROM l LEFT JOIN a ON a.unit = l.unit AND a.y.r = l."row" AND a.y.c = l.col
        WHERE NOT EXISTS (SELECT 1 FROM a o WHERE o.unit = l.unit AND l."row" BETWEEN o.y.r AND o.y.r + o.y.h - 1 AND l.col BETWEEN o.y.c AND o.y.c + o.y.w - 1 AND (o.y.r, o.y.c) <> (l."row", l.col))""",
    "fuzzy_search": f"""WITH {TABLES},
        n AS (SELECT query_id, nullif(regexp_extract(trim(query), '^([pP]([aA][gG][eE])?\\.?\\s*)?([0-9]+)$', 3), '') AS num, list_distinct(string_split(trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')), ' ')) AS ws FROM q),
        tok AS (SELECT query_id, len(ws) AS n, unnest(ws) AS a FROM n WHERE num IS NULL),
        held AS (SELECT DISTINCT id, unnest(string_split(trim(regexp_replace(lower(title || ' ' || table_id || ' ' || source_file || ' page ' || page), '[^a-z0-9]+', ' ', 'g')), ' ')) AS w FROM t),
        pair AS (SELECT a, w FROM (SELECT DISTINCT a FROM tok) x, (SELECT DISTINCT w FROM held) y
                 WHERE contains(w, a) OR (NOT regexp_matches(a, '^[0-9]+$') AND ((len(a) >= 3 AND len(w) >= 3 AND (contains(a, w) OR regexp_matches(w, array_to_string(string_split(a, ''), '.*'))))
                   OR (NOT regexp_matches(w, '^[0-9]+$') AND len(a) <= 32 AND len(w) <= 32 AND levenshtein(a, w) <= CASE WHEN len(a) <= 4 THEN 1 WHEN len(a) <= 8 THEN 2 ELSE 3 END)))),
        hit AS (SELECT query_id, id FROM tok JOIN pair USING (a) JOIN held USING (w) GROUP BY query_id, id, n HAVING count(DISTINCT a) = n
                UNION ALL SELECT query_id, id FROM n JOIN t ON t.page::VARCHAR = n.num)
        SELECT query_id, count(*) AS n_found, min(id) AS first_id, max(id) AS last_id FROM hit GROUP BY query_id""",
    "singleton_merges": """WITH RECURSIVE sing AS (SELECT p_brand AS scope, p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name || ' of ' || p_type || CASE WHEN p_partkey % 3 = 0 THEN ' (urban)' ELSE '' END END AS title FROM part WHERE p_partkey % 13 <> 0),
        tk AS (SELECT scope, id, trim(title) = '' AS blank, list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(title, '\\s*\\([^()]*\\)\\s*$', '')), '[a-z0-9]+'),
                   lambda w: len(w) >= 3 AND NOT list_contains(['a','an','the','of','and','or','by','for','in','on','to','with','as','at','from','per','no','sl','nos','table','statement','urban','rural','all','total','male','female','others','other'], w) AND NOT regexp_matches(w, '^[0-9]+$'))) AS t FROM sing),
        kin AS (SELECT p_brand AS scope, p_type, list(p_partkey ORDER BY p_partkey) AS kin FROM part GROUP BY 1, 2),
        pr AS (SELECT p_brand AS scope, p_partkey AS ord, list_concat(list_transform(kin[greatest(list_position(kin, p_partkey) - 1, 1):greatest(list_position(kin, p_partkey) - 1, 1) + 1 + p_partkey % 3], lambda y: y::VARCHAR),
                  [p_partkey::VARCHAR, (p_partkey + p_size * 25)::VARCHAR, (p_partkey + p_size * 50)::VARCHAR]) AS ids FROM part JOIN kin ON kin.scope = p_brand AND kin.p_type = part.p_type WHERE p_partkey % 7 <> 0),
        ex AS (SELECT scope, ord, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM pr),
        mem AS (SELECT ex.scope AS scope, ord, ex.id AS id, min(pos) AS pos, any_value(blank) AS blank, any_value(t) AS t FROM ex JOIN tk ON tk.scope = ex.scope AND tk.id = ex.id GROUP BY 1, 2, 3),
        p AS (SELECT scope, ord, list(struct_pack(id := id, blank := blank, t := t) ORDER BY pos) AS ms, row_number() OVER (PARTITION BY scope ORDER BY ord) AS nth FROM mem GROUP BY scope, ord),
        f AS (SELECT DISTINCT scope, 0::BIGINT AS nth, NULL::BIGINT AS ord, []::VARCHAR[] AS used, NULL::VARCHAR[] AS ids FROM sing
              UNION ALL
              SELECT scope, nth, ord, CASE WHEN good THEN list_concat(used, list_transform(fr, lambda y: y.id)) ELSE used END, CASE WHEN good THEN list_transform(fr, lambda y: y.id) END FROM (
                SELECT *, len(fr) >= 2 AND len(list_filter(fr, lambda y: NOT y.blank)) >= 2 AND len(list_filter(fr, lambda a: NOT a.blank AND len(list_filter(fr, lambda b: NOT b.blank AND b.id <> a.id
                    AND NOT (len(list_intersect(a.t, b.t)) >= 2 OR (len(list_intersect(a.t, b.t)) >= 1 AND len(list_intersect(a.t, b.t)) >= 0.7 * least(len(a.t), len(b.t)))))) > 0)) = 0 AS good FROM (
                  SELECT f.scope AS scope, p.nth AS nth, p.ord AS ord, used, list_filter(ms, lambda y: NOT list_contains(used, y.id)) AS fr FROM f JOIN p ON p.scope = f.scope AND p.nth = f.nth + 1)))
        SELECT scope, ord, array_to_string(ids, ',') AS ids FROM f WHERE ids IS NOT NULL""",
}
EXPANDED = f"""r AS (SELECT o_custkey AS dataset, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 13 END NULLS LAST, o_orderkey) AS nth, {PAYLOAD.replace(chr(92) * 2, chr(92))} AS payload FROM orders),
    g AS (SELECT dataset, nth, payload FROM r WHERE nth <= 6 AND json_valid(payload) AND payload[1] = '{{'),
    ks AS (SELECT dataset, nth, payload, unnest(json_keys(payload)) AS key, generate_subscripts(json_keys(payload), 1) AS place FROM g),
    fs AS (SELECT dataset, key, min(nth * 100 + place) AS at0 FROM ks GROUP BY 1, 2),
    cs AS (SELECT dataset, list(key ORDER BY at0) AS columns FROM fs GROUP BY 1)"""
SQL |= {
    "catalogue_expand": f"""WITH {EXPANDED}, st AS (SELECT o_custkey AS dataset, count(*) AS n FROM orders GROUP BY 1)
        SELECT c_custkey AS dataset, CASE WHEN c_custkey % 2 = 0 THEN 'T' || c_custkey ELSE c_custkey::VARCHAR END AS table_id, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN 'T' || c_custkey ELSE c_custkey::VARCHAR END AS title,
               CASE WHEN columns IS NULL AND n > 0 THEN '_error' ELSE coalesce(array_to_string(columns, '|'), '') END AS columns, coalesce(n, 0) AS n_rows,
               'Category: ' || c_mktsegment || CASE WHEN c_custkey % 4 = 0 THEN '|Geography: ' || c_nationkey ELSE '' END AS notes, CASE WHEN columns IS NULL AND n > 0 THEN 'no row is a JSON object' END AS error
        FROM customer LEFT JOIN st ON st.dataset = c_custkey LEFT JOIN cs ON cs.dataset = c_custkey""",
    "catalogue_rows": f"""WITH {EXPANDED}
        SELECT g.dataset AS dataset, (row_number() OVER (PARTITION BY g.dataset ORDER BY nth) - 1)::INT AS "row",
               array_to_string(list_transform(columns, lambda k: coalesce(json_extract_string(payload, '$.' || k), '~')), '|') AS cells FROM g JOIN cs ON cs.dataset = g.dataset""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "merges_inferred": merges_inferred,
    "merge_spans": merge_spans,
    "fuzzy_search": fuzzy_search,
    "singleton_merges": singleton_merges,
    "catalogue_expand": catalogue_expand,
    "catalogue_rows": catalogue_rows,
}
