"""DuckDB SQL for each catalogue query, written on its own from the query's meaning."""

from __future__ import annotations

CELLS = """cells AS (
    SELECT 'orders' AS table_name, o_orderkey AS row_key, unnest(['o_orderstatus', 'o_orderpriority', 'o_totalprice', 'o_custkey']) AS column_name,
           unnest([o_orderstatus, o_orderpriority, o_totalprice::VARCHAR, o_custkey::VARCHAR]) AS value FROM orders
    UNION ALL SELECT 'part', p_partkey, unnest(['p_brand', 'p_type', 'p_name', 'p_size']), unnest([p_brand, p_type, p_name, p_size::VARCHAR]) FROM part
    UNION ALL SELECT 'customer', c_custkey, unnest(['c_mktsegment', 'c_name', 'c_acctbal']), unnest([c_mktsegment, c_name, c_acctbal::VARCHAR]) FROM customer)"""
BLANKED = """blanked AS (
    SELECT 'customer' AS table_name, c_custkey AS row_key, unnest(['balance', 'blend', 'rare']) AS column_name,
           unnest([CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal::VARCHAR END,
                   CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR ELSE c_mktsegment END,
                   CASE WHEN c_custkey % 10 = 0 THEN c_name ELSE ' - ' END]) AS value FROM customer)"""
THERE = "(value IS NOT NULL AND lower(trim(value)) NOT IN ('', '-', '--', '—', '–', 'na', 'n.a.', 'n/a', 'nil', '..', '...'))"
NUMERIC = f"({THERE} AND try_cast(regexp_replace(trim(value), '[,*%()]', '', 'g') AS DOUBLE) IS NOT NULL)"


def profile_sql(cells: str) -> str:
    return f"""SELECT table_name, column_name, n_rows, round(n_values / n_rows, 3) AS fill_ratio,
           coalesce(n_values >= 3 AND longest > 4 AND n_numbers / n_values > 0.2 AND n_numbers / n_values < 0.8, false) AS mixed
        FROM (SELECT table_name, column_name, count(*) AS n_rows, count(*) FILTER ({THERE}) AS n_values,
                     count(*) FILTER ({NUMERIC}) AS n_numbers, max(length(value)) FILTER ({THERE}) AS longest
              FROM {cells} GROUP BY 1, 2)"""


TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda t: length(t) >= 3 AND t NOT IN ('a', 'an', 'the', 'of', 'and', 'or', 'by', 'for', 'in', 'on', 'to', 'with', 'as', 'at', 'from', 'per', 'no', 'sl', 'nos', 'table', 'statement', 'urban', 'rural', 'all', 'total', 'male', 'female', 'others', 'other') AND NOT regexp_full_match(t, '[0-9]+'))"
BASE_TITLE = r"""CASE WHEN trim(regexp_replace(regexp_replace(title, '\s*\([^()]*\)\s*$', ''), '\s+', ' ', 'g')) = '' THEN upper(trim(title))
    ELSE upper(trim(regexp_replace(regexp_replace(title, '\s*\([^()]*\)\s*$', ''), '\s+', ' ', 'g'))) END"""
SLUG = r"lower(regexp_replace({0}, '[\s_\-./]', '', 'g'))"
COSINE = """dist AS (SELECT a.vec_id AS q, b.vec_id AS v, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS d
    FROM {0} a, {1} b WHERE a.vec_id <> b.vec_id)"""
NEIGHBOURS = """near AS (SELECT e.vec_id, CASE WHEN f.vec_id IS NULL THEN e.embedding::DOUBLE[]
    ELSE list_transform(f.embedding::DOUBLE[], lambda x, i: x + 0.01 * (e.vec_id % 4) * ((i - 1) % 3 - 1)) END AS embedding
    FROM embeddings e LEFT JOIN embeddings f ON f.vec_id = e.vec_id - e.vec_id % 4 AND e.vec_id % 4 IN (1, 2))"""
DOC_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS part FROM documents)"
STEM = SLUG.format(r"regexp_replace(upper(trim({0})), '(\([0-9]+\)|[A-Z])$', '')")

SQL: dict[str, str] = {
    "dataset_list_counts": """
        SELECT c_custkey AS dataset_id, c_name AS title, n_name AS release_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS row_count
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "rows_equals_page": """
        SELECT o_orderkey AS row_key, o_custkey::VARCHAR AS o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
        ORDER BY o_orderkey LIMIT 100 OFFSET 20""",
    "rows_contains_page": """
        SELECT p_partkey AS row_key, p_name, p_brand FROM part WHERE p_brand ILIKE '%RAND#1%' ORDER BY p_partkey LIMIT 200""",
    "rows_total": "SELECT count(*) AS total FROM orders WHERE o_orderpriority ILIKE '%urgent%'",
    "json_row_flatten": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "dataset_search": """
        SELECT lang, count(*) AS n_found, min(doc_id) AS first_id FROM documents
        WHERE contains(lower(text), 'that') OR contains(lower(source), 'that') GROUP BY lang""",
    "dataset_cards": """
        SELECT p_partkey, CASE WHEN p_type = p_brand THEN p_type ELSE p_type || ',' || p_brand END AS tags, lower(p_name || ' ' || p_brand) AS keywords FROM part""",
    "release_rollup": """
        SELECT r_name, count(*) AS n_tables, sum(n)::BIGINT AS row_count FROM region JOIN nation ON n_regionkey = r_regionkey
        JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY r_name""",
    "dashboard_status": """
        WITH g AS (SELECT source, count(quality) AS filled, count(*) AS entries, count(DISTINCT lang) AS dimensions
                   FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
        SELECT source, filled, entries, dimensions, round(filled / entries, 4) AS fill,
               CASE WHEN filled / entries >= 0.9 THEN 100 ELSE round_even(75 + 20 * (filled / entries), 0) END::INT AS percent,
               CASE WHEN filled / entries >= 0.9 THEN 'Published' ELSE 'Awaiting' END AS status FROM g""",
    "dashboard_union": """
        SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS title FROM supplier
        UNION ALL SELECT 'customer', c_custkey, c_name FROM customer WHERE c_acctbal < 0""",
    "code_definition_enrich": """
        SELECT o_orderkey, o_orderpriority,
               CASE lower(o_orderpriority) WHEN '1-urgent' THEN 'U' WHEN '2-high' THEN 'H' WHEN '5-low' THEN 'L' END AS "Code",
               CASE lower(o_orderpriority) WHEN '1-urgent' THEN 'At once' WHEN '2-high' THEN 'Soon' END AS "Definition" FROM orders""",
    "column_stats": f"""
        WITH {CELLS}, t AS (SELECT *, value IS NOT NULL AND trim(value) <> '' AS there, try_cast(replace(value, ',', '') AS DOUBLE) AS number FROM cells),
        g AS (SELECT table_name, column_name, count(*) AS n_rows, count(*) FILTER (there) AS n_values, count(DISTINCT value) FILTER (there) AS n_distinct,
                     count(number) FILTER (there) = count(*) FILTER (there) AND count(*) FILTER (there) > 0 AS numeric,
                     min(number) AS lo, max(number) AS hi, avg(number) AS mean FROM t GROUP BY 1, 2)
        SELECT table_name, column_name, CASE WHEN numeric THEN 'number' ELSE 'text' END AS column_type, n_rows, n_values, n_distinct,
               CASE WHEN numeric THEN round(lo, 4) END AS min_value, CASE WHEN numeric THEN round(hi, 4) END AS max_value,
               CASE WHEN numeric THEN round(mean, 4) END AS mean_value FROM g""",
    "discover_dimensions": rf"""
        WITH {CELLS}, v AS (SELECT table_name, column_name, lower(trim(value)) AS low, count(*) AS n, min(trim(value)) AS spelling,
                                   regexp_full_match(replace(lower(trim(min(value))), ',', ''), '[-+]?[0-9]+([.,][0-9]+)?') AS plain
                            FROM cells WHERE trim(value) <> '' GROUP BY 1, 2, 3),
        g AS (SELECT table_name, column_name, sum(n) AS n_values, count(*) FILTER (NOT plain) AS n_distinct, avg(length(spelling)) FILTER (NOT plain) AS len FROM v GROUP BY 1, 2)
        SELECT table_name, column_name AS dimension, n_distinct FROM g
        WHERE n_distinct BETWEEN 2 AND 80 AND NOT coalesce(n_distinct >= 8 AND n_distinct / n_values >= 0.85 AND len >= 24, false)""",
    "facet_counts": """
        WITH c AS (SELECT p_partkey, unnest(['p_brand', 'p_type']) AS column_name, unnest([p_brand, p_type]) AS facet_value FROM part)
        SELECT column_name, facet_value, count(DISTINCT p_partkey) AS n_owners FROM c WHERE trim(facet_value) <> '' GROUP BY 1, 2""",
    "dim_value_jaccard": f"""
        WITH s AS (SELECT DISTINCT 'size ' || p_size AS k, lower(p_brand) AS v FROM part), n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
        p AS (SELECT a.k AS a, b.k AS b, count(*) AS both_ FROM s a JOIN s b ON a.v = b.v AND a.k < b.k GROUP BY 1, 2)
        SELECT a, b, round(both_ / (x.n + y.n - both_), 4) AS jaccard, round(both_ / least(x.n, y.n), 4) AS contained,
               both_ / (x.n + y.n - both_) >= 0.85 OR both_ / least(x.n, y.n) >= 0.9 AS near
        FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b""",
    "code_list_union": """
        WITH e AS (SELECT p_type AS dimension, p_partkey AS ord, p_brand AS value, CASE WHEN p_partkey % 3 <> 0 THEN 'c' || p_size END AS code,
                          CASE WHEN p_partkey % 2 = 0 THEN p_name END AS definition FROM part)
        SELECT dimension, arg_min(value, ord) AS value, arg_min(code, ord) FILTER (code IS NOT NULL) AS code,
               arg_min(definition, ord) FILTER (definition IS NOT NULL) AS definition FROM e GROUP BY dimension, lower(value)""",
    "equivalent_columns": """
        WITH c AS (SELECT unnest(['lineitem.l_returnflag', 'lineitem.flag_copy', 'lineitem.l_linestatus']) AS name, lower(unnest([l_returnflag, l_returnflag, l_linestatus])) AS v FROM lineitem),
        s AS (SELECT name, string_agg(DISTINCT v, ',' ORDER BY v) AS vs, count(DISTINCT v) AS n FROM c GROUP BY name)
        SELECT string_agg(name, ',' ORDER BY name) AS members, count(*) AS n_columns, any_value(n) AS n_values FROM s GROUP BY vs HAVING count(*) > 1""",
    "fill_ratio": "SELECT lang, round(count(quality) / count(*), 4) AS fill FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "regex_years_units": "SELECT o_orderkey, year(o_orderdate) || ',2001' AS years, 'Number' AS unit FROM orders",
    "profile_columns": f"WITH {BLANKED} {profile_sql('blanked')}",
    "route_tables": f"""
        WITH {BLANKED}, {CELLS}, everything AS (SELECT * FROM blanked UNION ALL SELECT * FROM cells), p AS ({profile_sql('everything')}),
        g AS (SELECT table_name, max(n_rows) AS n_rows, round(avg(fill_ratio), 3) AS fill, bool_or(mixed) AS mixed FROM p WHERE fill_ratio > 0 GROUP BY 1)
        SELECT table_name, n_rows, fill, CASE WHEN n_rows < 2 THEN 'too few rows' WHEN fill < 0.5 THEN 'sparse' WHEN mixed THEN 'mixed types' ELSE '' END AS reason,
               CASE WHEN n_rows < 2 OR fill < 0.5 OR mixed THEN 'review' ELSE 'accept' END AS routed FROM g""",
    "alignment_issues": f"""
        WITH {BLANKED}, {CELLS}, everything AS (SELECT * FROM blanked UNION ALL SELECT * FROM cells),
        g AS (SELECT table_name, column_name, count(*) AS n, avg((NOT {THERE})::INT) AS blank, avg({NUMERIC}::INT) FILTER ({THERE}) AS num FROM everything
              WHERE column_name IN ('balance', 'blend', 'rare', 'o_orderpriority', 'o_totalprice') GROUP BY 1, 2)
        SELECT * FROM (SELECT table_name, column_name, 'measure' AS kind, CASE WHEN n >= 5 AND blank >= 0.7 THEN 'empty_measure' WHEN n >= 5 AND num < 0.5 THEN 'non_numeric_measure' END AS issue FROM g)
        WHERE issue IS NOT NULL""",
    "column_uniquify": """
        SELECT p_partkey, p_brand, p_name, CASE WHEN r > 1 THEN p_name || '_' || r ELSE p_name END AS unique_name
        FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r FROM part)""",
    "base_title_groups": f"""
        WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' (urban)' WHEN 1 THEN '  (rural)' ELSE '' END AS title FROM part)
        SELECT {BASE_TITLE} AS group_name, count(*) AS n_members, min(p_partkey) AS first_member FROM t GROUP BY 1""",
    "tiered_match": f"""
        WITH t AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'T-' || p_partkey WHEN 1 THEN 't ' || p_partkey || 'A' ELSE 'Z' || p_partkey END AS table_id FROM part),
        i AS (SELECT 'T' || p_partkey AS item_id FROM part),
        exact AS (SELECT table_id, item_id, 'exact' AS confidence FROM t JOIN i ON {SLUG.format('table_id')} = {SLUG.format('item_id')}),
        l AS (SELECT table_id, {STEM.format('table_id')} AS s FROM t WHERE table_id NOT IN (SELECT table_id FROM exact)),
        f AS (SELECT {STEM.format('item_id')} AS s, min(item_id) AS item_id, count(*) AS n FROM i WHERE item_id NOT IN (SELECT item_id FROM exact) GROUP BY 1),
        m AS (SELECT table_id, item_id, n, row_number() OVER (PARTITION BY l.s ORDER BY table_id) AS r FROM l LEFT JOIN f ON f.s = l.s)
        SELECT * FROM exact UNION ALL
        SELECT table_id, CASE WHEN n = 1 AND r = 1 THEN item_id END, CASE WHEN n = 1 AND r = 1 THEN 'stem' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END FROM m""",
    "leftover_inventory": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "codes_prefer_own": """
        SELECT n_nationkey AS dataset, c AS "column", CASE WHEN n_nationkey % 3 = 0 AND c = 'area' THEN 'N' ELSE 'R' END AS code,
               CASE WHEN n_nationkey % 3 = 0 AND c = 'area' THEN n_name ELSE r_name END AS value
        FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES ('area'), ('place')) AS v(c)""",
    "release_tables": """
        WITH d AS (SELECT *, CASE WHEN c_custkey % 3 = 1 THEN 'DS-' || c_custkey WHEN c_custkey % 2 = 0 THEN 'T-' || c_custkey ELSE c_custkey::VARCHAR END AS id FROM customer)
        SELECT c_nationkey AS release, id, CASE WHEN c_custkey % 5 <> 0 THEN c_name ELSE id END AS title,
               CASE WHEN c_custkey % 2 = 0 THEN 'T-' || c_custkey ELSE id END AS table_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS row_count FROM d""",
    "release_facet_filter": """
        SELECT p_name, min(p_brand) AS brand FROM part GROUP BY p_name
        HAVING bool_or(p_type = 'PROMO') AND contains(lower(p_name || ' ' || min(p_brand)), 'ring')""",
    "keyword_chips": """
        SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || '|' || p_brand ELSE replace(p_name, ' ', '|') || '|' || p_brand END AS chips FROM part""",
    "dataset_id_summary": """
        WITH n AS (SELECT n_nationkey % 9 AS part, min(n_nationkey) FILTER (n_nationkey % 4 <> 0) AS lo, count(*) FILTER (n_nationkey % 4 <> 0) AS n FROM nation GROUP BY 1)
        SELECT part, CASE WHEN n = 0 THEN '' ELSE lpad(lo::VARCHAR, 3, '0') || CASE WHEN n > 1 THEN ' +' || (n - 1) || ' more' ELSE '' END END AS summary FROM n""",
    "occupation_keys": r"""
        SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type || ' / ' || p_name || ' / (' || p_brand || ')'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS label_key,
               CASE p_partkey % 3 WHEN 0 THEN p_size < 10000 WHEN 1 THEN p_partkey < 10000 ELSE false END AS coded FROM part""",
    "id_keys": """
        SELECT p_partkey, 'B' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '2021V1' ELSE 'PROVISIONALTABLE3' END AS id_key,
               'B' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'PROVISIONALTABLE3' END AS id_stem,
               'B' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '2021V1' ELSE '3' END AS inventory_code FROM part""",
    "title_pair_compatible": f"""
        WITH t AS (SELECT title, {TOKENS.format('title')} AS ts FROM (SELECT DISTINCT p_name || ' by ' || p_type || ' total' AS title FROM part)),
        p AS (SELECT a.title AS first, b.title AS second, len(list_intersect(a.ts, b.ts)) AS shared, least(len(a.ts), len(b.ts)) AS small FROM t a JOIN t b ON a.title < b.title)
        SELECT first, second, shared FROM p WHERE shared >= 2 OR (shared >= 1 AND shared >= 0.7 * small)""",
    "cosine_topk": f"""
        WITH {COSINE.format('(SELECT * FROM embeddings WHERE vec_id % 20 = 0)', 'embeddings')},
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, v) AS rank FROM dist)
        SELECT q AS query_id, v AS vec_id, round(d, 4) AS distance, rank FROM r WHERE rank <= 5""",
    "knn_edges": f"""
        WITH {NEIGHBOURS}, {COSINE.format('near', 'near')}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, v) AS rank FROM dist)
        SELECT DISTINCT least(q, v) AS a, greatest(q, v) AS b FROM r WHERE rank <= 8 AND d <= 0.42""",
    "clusters": f"""
        WITH RECURSIVE {NEIGHBOURS}, {COSINE.format('near', 'near')}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, v) AS rank FROM dist),
        e AS (SELECT DISTINCT q AS a, v AS b FROM r WHERE rank <= 2 AND d <= 0.25 UNION SELECT DISTINCT v, q FROM r WHERE rank <= 2 AND d <= 0.25),
        reach AS (SELECT vec_id AS id, vec_id AS other FROM near UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other)
        SELECT id, min(other) AS component FROM reach GROUP BY id""",
    "hash_embedding": """
        WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
        p AS (SELECT item_id, ('0x' || substr(sha256(token), 8 * i + 1, 8))::BIGINT % 1536 AS bucket FROM t, range(8) AS r(i)),
        s AS (SELECT item_id, bucket, count(*) AS n FROM p GROUP BY 1, 2), norm AS (SELECT item_id, sqrt(sum(n * n)) AS len FROM s GROUP BY 1)
        SELECT item_id AS key, bucket, round(n / len, 6) AS weight FROM s JOIN norm USING (item_id)""",
    "hierarchy_nodes": """
        SELECT 'division' AS level, r_regionkey::VARCHAR AS code, r_name AS title, NULL::VARCHAR AS parent FROM region
        UNION ALL SELECT 'group', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR FROM nation""",
    "token_cosine": f"""
        WITH t AS (SELECT p_name, {TOKENS.format('p_name')} AS ts FROM (SELECT DISTINCT p_name FROM part)),
        u AS (SELECT p_name, unnest(list_append(ts, list_min(ts))) AS token FROM t), f AS (SELECT p_name, token, count(*) AS tf FROM u GROUP BY ALL),
        n AS (SELECT p_name, sqrt(sum(tf * tf)) AS norm FROM f GROUP BY 1)
        SELECT a.p_name AS left_key, b.p_name AS right_key, round(sum(a.tf * b.tf) / (any_value(na.norm) * any_value(nb.norm)), 6) AS cosine
        FROM f a JOIN f b USING (token) JOIN n na ON na.p_name = a.p_name JOIN n nb ON nb.p_name = b.p_name WHERE a.p_name < b.p_name GROUP BY 1, 2""",
    "shortlist_quota": """
        WITH s AS (SELECT p_brand, p_type, p_partkey, round(p_retailprice, 2) AS score FROM part),
        r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY score DESC, p_partkey) AS il, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS ov FROM s),
        k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM r
              WHERE il <= CASE p_type WHEN 'STANDARD' THEN 2 WHEN 'PROMO' THEN 1 ELSE 0 END OR ov <= 8)
        SELECT p_brand, p_partkey, rank FROM k WHERE rank <= 4""",
    "upsert_latest": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
    "soft_delete_not_in": """
        SELECT c_custkey, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS deleted FROM customer""",
    "append_ids": """
        SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN 'a,' || p_brand || ',' ELSE '' END || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ',b' ELSE '' END || ',' || p_type AS ids FROM part""",
    "monotone_step": """
        SELECT p_partkey, greatest(coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_size % 7 END, 0), greatest(1, least(6, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 9 END, 1))))::BIGINT AS step FROM part""",
    "review_overlay": """
        SELECT d.doc_id, d.lang, CASE WHEN l.quality = 0 THEN 'poor' ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id)
        WHERE l.toxic IS NULL OR l.toxic <> 1""",
    "review_ids": """
        WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber % 3 AS page FROM lineitem),
        n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, page) AS c, row_number() OVER (PARTITION BY l_orderkey, page ORDER BY l_linenumber) AS r FROM l)
        SELECT l_orderkey, l_linenumber, 'TB-PRC-' || l_orderkey || '-P' || page || CASE WHEN c > 1 THEN '-T' || r ELSE '' END AS review_id FROM n""",
    "ttl_purge": "SELECT event_type, count(*) AS n_live FROM events WHERE ts >= TIMESTAMP '2024-01-23 00:00:00' GROUP BY event_type",
    "batch_status": """
        WITH s AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN CASE WHEN o_custkey % 3 = 0 THEN 'done' ELSE 'error' END ELSE 'running' END AS st FROM orders),
        g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (st = 'done') AS d, count(*) FILTER (st = 'error') AS e, count(*) FILTER (st = 'running') AS r FROM s GROUP BY 1)
        SELECT o_custkey, CASE WHEN r > 0 THEN 'running' WHEN d > 0 AND e > 0 THEN 'completed_with_errors' WHEN d > 0 THEN 'done' ELSE 'failed' END AS batch_state,
               CASE WHEN r > 0 THEN round_even(100 * (d + e) / n, 0) ELSE 100 END::INT AS percent, n FROM g""",
    "stacked_rows_expand": f"WITH {DOC_LINES} SELECT doc_id, part::INT AS part, md5(line) AS line_md5 FROM lines",
    "blocks_by_gap": f"""
        WITH {DOC_LINES}, there AS (SELECT doc_id, part, part - lag(part) OVER (PARTITION BY doc_id ORDER BY part) AS step FROM lines WHERE length(line) >= 40),
        runs AS (SELECT doc_id, part, count(*) FILTER (step IS NULL OR step > 2) OVER (PARTITION BY doc_id ORDER BY part) AS run FROM there),
        spans AS (SELECT doc_id, run, max(part) - min(part) + 1 AS n_rows FROM runs GROUP BY 1, 2 HAVING max(part) > min(part))
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS block, n_rows FROM spans""",
    "header_fill": """
        SELECT p_size, p_partkey, last_value(CASE WHEN p_partkey % 3 = 0 THEN p_brand END IGNORE NULLS) OVER (PARTITION BY p_size ORDER BY p_partkey) AS label FROM part""",
    "wrap_fold": f"""
        WITH {DOC_LINES}, s AS (SELECT *, (part = 0 OR NOT regexp_matches(line, '^[a-z]'))::INT AS st FROM lines),
        b AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY part) AS label_no FROM s)
        SELECT doc_id, label_no::BIGINT AS label_no, count(*) AS n_lines, md5(string_agg(line, ' ' ORDER BY part)) AS label_md5 FROM b GROUP BY 1, 2""",
    "side_by_side_stack": """
        SELECT p_partkey, 0 AS half, p_brand AS c0, p_size::VARCHAR AS c1 FROM part UNION ALL SELECT p_partkey, 1, p_type, p_partkey::VARCHAR FROM part""",
    "bbox_iou_pairs": """
        WITH b AS (SELECT l_orderkey, l_linenumber AS box, (l_linenumber * 7) % 20 AS x, trunc(min(l_quantity))::INT % 15 AS y FROM lineitem GROUP BY 1, 2),
        p AS (SELECT a.l_orderkey, a.box AS a, b.box AS b, greatest(12 - abs(a.x - b.x), 0) * greatest(9 - abs(a.y - b.y), 0) AS i FROM b a JOIN b b ON a.l_orderkey = b.l_orderkey AND a.box < b.box)
        SELECT l_orderkey, a, b, round(i / (216 - i), 4) AS iou FROM p WHERE round(i / (216 - i), 4) >= 0.3""",
    "nearest_above": """
        WITH m AS (SELECT user_id, event_id AS mark, ts FROM events WHERE event_id % 7 = 0), i AS (SELECT user_id, event_id AS item, ts FROM events WHERE event_id % 7 <> 0)
        SELECT user_id, item, (SELECT arg_max(mark, (ts, mark)) FROM m WHERE m.user_id = i.user_id AND m.ts <= i.ts) AS mark FROM i""",
    "candidate_best": """
        SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""",
    "event_windows": """
        SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""",
    "gated_query": "SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY s_nationkey",
    "garbled_documents": "SELECT doc_id FROM documents WHERE doc_id % 7 = 0",
}
