"""Caption and title queries over texts of part, orders and documents, beside the SQL they are compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import captions
from quillgrid.session import dealt, table

#: Titles that both engines read; wide ones take their text from the part's name over and over.
TITLES = """SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN concat(p_name, ' — ', p_type, ', ', p_brand, ', year') WHEN 1 THEN concat('  ', p_name, '   by ', p_type, ' – Sl. No.') WHEN 2 THEN concat(p_name, ', ', p_type, ' / ', p_brand)
    WHEN 3 THEN concat(repeat(concat(p_name, ' '), 30), '— ', p_brand) WHEN 4 THEN concat('Table: ', p_size) WHEN 5 THEN regexp_replace(upper(p_name), '([A-Z])', '{0}{0}') WHEN 6 THEN repeat(concat(p_type, p_brand, ','), 20)
    WHEN 7 THEN concat(p_name, ' and ', lower(p_type), ' of ', p_brand) ELSE concat(p_type, ' —', p_name, ' for all ', p_type, ' parts of the year') END AS title,
    CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN '' ELSE 'Year' END AS c1, p_brand AS c2, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'no' END AS c3 FROM part"""


def titled(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "part").createOrReplaceTempView("quillgrid_part")
    return dealt(spark.sql(TITLES.format("$1").replace("FROM part", "FROM quillgrid_part")), "k")


def titles_normal(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array("c1", "c2", "c3")
    title = F.col("title")
    return titled(spark, sf).select("k", captions.normal_title(title, names).alias("normal_title"), captions.reads_as_headers(title, names).alias("headers"), captions.is_column_list(title).alias("listed"))


def titles_undoubled(spark: SparkSession, sf: str) -> DataFrame:
    """The first words of documents, of which every third is printed with doubled letters and every sixth with some."""
    start = F.array_join(F.slice(F.split("text", r"\s+"), 1, 6), " ")
    key = F.col("doc_id")
    doubled = F.when(key % 3 == 0, F.regexp_replace(start, r"(\p{L})", "$1$1")).when(key % 6 == 1, F.regexp_replace(start, r"([eaoi])", "$1$1")).otherwise(start)
    return table(spark, sf, "documents").select("doc_id", captions.undoubled(doubled).alias("title"), captions.is_garbled(F.when(key % 5 == 0, F.concat(start, F.lit("Ã©"))).otherwise(start)).alias("garbled"))


def id_title_issues(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    own = F.when(key % 4 == 0, F.concat(F.lit("table "), key)).when(key % 4 == 1, F.concat(F.lit("D-"), key)).when(key % 4 == 2, " ")
    title = F.when(key % 3 == 0, F.concat(F.lit("TABLE: "), key)).when(key % 3 == 1, F.concat(F.lit("Tables of "), F.col("o_orderpriority")))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(captions.id_title_issues(own, title), "|").alias("issues"))


HEADED = "({0} <> '' AND ((regexp_matches(upper({0}), '\\bTABLE[\\s:\\-]') AND len({0}) < 40) OR regexp_matches(upper({0}), '\\bSL\\.?\\s*NO\\.?\\b') OR (len(names) >= 2 AND len(list_filter(names, lambda c: contains(upper({0}), c))) >= 2)))"
PARTS = "list_filter(list_transform(regexp_split_to_array({0}, '[,;/|]'), lambda p: trim(p)), lambda p: p <> '')"
IS_LIST = f"(len({PARTS}) >= 2 AND len(list_filter({PARTS}, lambda p: len(p) <= 40 AND len(string_split(p, ' ')) <= 5)) >= greatest(2, len({PARTS}) - 1) AND len({{0}}) <= 160)"
SINGLE = """SELECT k, string_agg(c, '' ORDER BY i) AS t FROM (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY i) AS q FROM (
    SELECT *, sum(CASE WHEN letter AND lower(c) = prv THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM (
      SELECT k, i, c, regexp_matches(c, '\\p{L}') AS letter, lag(lower(c)) OVER (PARTITION BY k ORDER BY i) AS prv FROM (SELECT k, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM d)))) WHERE NOT letter OR q % 2 = 1 GROUP BY k"""
#: Which texts of d (k, t) are doubled: by runs over their letters alone.
DOUBLED = """SELECT k FROM (SELECT k, run, count(*) AS n FROM (SELECT *, sum(CASE WHEN c = prv THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM (
    SELECT k, i, c, lag(c) OVER (PARTITION BY k ORDER BY i) AS prv FROM (SELECT k, unnest(string_split(l, '')) AS c, generate_subscripts(string_split(l, ''), 1) AS i FROM (SELECT k, lower(regexp_replace(t, '[^\\p{L}]', '', 'g')) AS l FROM d) WHERE len(l) >= 6))) GROUP BY 1, 2) GROUP BY k HAVING sum(n - n % 2) >= 0.8 * sum(n)"""

SQL: dict[str, str] = {
    "titles_undoubled": f"""WITH s AS (SELECT doc_id AS k, array_to_string(regexp_split_to_array(text, '\\s+')[1:6], ' ') AS s FROM documents),
        d AS (SELECT k, CASE WHEN k % 3 = 0 THEN regexp_replace(s, '(\\p{{L}})', '\\1\\1', 'g') WHEN k % 6 = 1 THEN regexp_replace(s, '([eaoi])', '\\1\\1', 'g') ELSE s END AS t FROM s),
        dbl AS ({DOUBLED}), one AS ({SINGLE})
        SELECT d.k AS doc_id, CASE WHEN d.k IN (SELECT k FROM dbl) THEN one.t ELSE d.t END AS title, d.k % 5 = 0 AS garbled FROM d LEFT JOIN one ON one.k = d.k""",
    "titles_normal": f"""WITH a AS (SELECT k, title AS raw, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t, list_transform(list_filter([c1, c2, c3], lambda c: len(trim(c)) >= 3), lambda c: upper(c)) AS names FROM ({TITLES.format(chr(92) + "1").replace("'([A-Z])', '" + chr(92) + "1" + chr(92) + "1')", "'([A-Z])', '" + chr(92) + "1" + chr(92) + "1', 'g')")}) x),
        d AS (SELECT k, t FROM a), dbl AS ({DOUBLED}), one AS ({SINGLE}),
        b AS (SELECT a.k AS k, a.t AS plain, names, CASE WHEN a.k IN (SELECT k FROM dbl) THEN one.t ELSE a.t END AS t FROM a LEFT JOIN one ON one.k = a.k),
        c AS (SELECT *, CASE WHEN contains(t, ' — ') THEN ' — ' WHEN contains(t, ' – ') THEN ' – ' WHEN contains(t, ' —') THEN ' —' WHEN contains(t, ' –') THEN ' –' END AS dash FROM b),
        e AS (SELECT *, trim(t[:instr(t, dash) - 1]) AS l, trim(t[instr(t, dash) + len(dash):]) AS r FROM c),
        f AS (SELECT *, CASE WHEN dash IS NOT NULL AND l <> '' AND ({HEADED.format("r")} OR {IS_LIST.format("r")} OR (len(t) > 220 AND len(l) >= 12)) THEN l ELSE t END AS u FROM e),
        g AS (SELECT *, CASE WHEN contains(u[:220], ' ') THEN regexp_replace(u[:220], '\\s\\S*$', '') ELSE u[:220] END AS w FROM f)
        SELECT k, CASE WHEN {HEADED.format("u")} OR {IS_LIST.format("u")} THEN '' WHEN len(u) > 220 THEN CASE WHEN len(w) >= 20 THEN regexp_replace(w, '[ ,;:—–-]+$', '') ELSE rtrim(u[:220]) END ELSE u END AS normal_title,
               {HEADED.format("plain")} AS headers, {IS_LIST.format("plain")} AS listed FROM g""",
    "id_title_issues": """WITH a AS (SELECT o_orderkey, coalesce(trim(CASE o_orderkey % 4 WHEN 0 THEN 'table ' || o_orderkey WHEN 1 THEN 'D-' || o_orderkey WHEN 2 THEN ' ' END), '') AS i,
              coalesce(CASE o_orderkey % 3 WHEN 0 THEN 'TABLE: ' || o_orderkey WHEN 1 THEN 'Tables of ' || o_orderpriority END, '') AS t FROM orders),
        b AS (SELECT *, regexp_matches(upper(i), '\\bTABLE[\\s:-]') AS im, regexp_matches(upper(t), '\\bTABLE[\\s:-]') AS tm FROM a)
        SELECT o_orderkey, concat_ws('|', CASE WHEN i = '' AND t = '' THEN 'id and title missing' WHEN i = '' THEN 'id missing' WHEN t = '' THEN 'title missing' END,
               CASE WHEN i <> '' AND t <> '' AND tm AND NOT im THEN 'id and title swapped' END, CASE WHEN i <> '' AND NOT im AND NOT tm THEN 'id without table' END) AS issues FROM b""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"titles_normal": titles_normal, "titles_undoubled": titles_undoubled, "id_title_issues": id_title_issues}
