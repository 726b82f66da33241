"""Queries over names, labels and codes of printed tables, each beside the SQL it is compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import labels as L
from quillgrid.operators import columns, grid, matching
from quillgrid.session import table

NAMES = ["Sl. No.", "Col_3", "Unnamed: 4", "2023-24", "(7)", "Page No", "Remarks", "page", "Title", "Age group", "State", "content_type", "row#", "15.0", " "]
LABELS = ["Others / Not stated", "All workers", "Total inspectors", "N.A.", "Not known to us", "Teachers, nurses and Glass workers etc", "Residual", "total persons", "classified", "Bus drivers or cooks", ""]
CODES = ["Table B-12 (Provisional)", "d-4(2)", "TABLE: R&D-1", ""]
SHEETS = ["B (iv)", "one (12)", "plain", "odd (xx) "]
TITLES = ["Sl. No. women's age-group", "sl no", "births  (by o'clock)", "  ", "No. of schools,"]
GOALS = ["Indicators of SDG 3 and SDG 5", "Table 4.2 States/UTs", "sdg 19", "Table 4.2", "SDG 7 Index", ""]


def chosen(values: list[str], key: str = "p_partkey") -> Column:
    """One of the values for each row, in turn."""
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def chosen_sql(values: list[str]) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[p_partkey % {len(values)} + 1]"


def junk_columns(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, chosen(NAMES)).otherwise(F.concat_ws("_", "p_type", "p_name"))
    return table(spark, sf, "part").select("p_partkey", L.is_junk_name(name).alias("junk"), L.is_serial_name(name).alias("serial"))


def page_like_values(spark: SparkSession, sf: str) -> DataFrame:
    value = chosen(["p. 12", "iv - xii", "12345", "P7", "mix", "Iowa"])
    return table(spark, sf, "part").select("p_partkey", L.is_page_like(value).alias("page_like"))


def contents_tables(spark: SparkSession, sf: str) -> DataFrame:
    title = chosen(["List of  Tables", "Price Index", "contents"])
    names = F.concat(F.array(chosen(["S. No.", "SNo", "Age"])), F.array(chosen(["Subject", "Page 1", "Rate", "Total"])), F.slice(F.array(F.lit("Page"), F.col("p_name"), F.col("p_type"), F.col("p_brand")), 1, F.col("p_size") % 5))
    return table(spark, sf, "part").select("p_partkey", L.is_contents_table(F.when(F.col("p_size") % 7 != 0, "Births").otherwise(title), names).alias("contents"))


def code_entries(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    entry = L.code_entry(F.when(key % 4 != 0, F.upper("p_brand")), F.when(key % 3 != 0, F.col("p_brand")).otherwise(""), F.when(key % 5 == 0, F.col("p_name")).when(key % 5 == 1, ""), F.when(key % 7 == 0, F.col("p_type")))
    return table(spark, sf, "part").select("p_partkey", entry.alias("e")).select("p_partkey", "e.*")


def curated_codes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    guessed = part.select(F.col("p_type").alias("dimension"), F.col("p_brand").alias("value"), F.lit("guess").alias("origin")).distinct()
    curated = part.where("p_type < 'M'").select(F.col("p_type").alias("dimension"), F.col("p_name").alias("value"), F.lit("real").alias("origin")).distinct()
    return columns.curated_over_guessed(guessed, curated, "dimension")


def aggregate_labels(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("p_size") % 2 == 0, chosen(LABELS)).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", L.is_aggregate_label(label).alias("aggregate"))


def label_tokens(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat_ws(" ", chosen(LABELS), "p_name")
    return table(spark, sf, "part").select("p_partkey", F.array_join(L.content_tokens(label), ",").alias("tokens"), F.array_join(L.phrases(label), "|").alias("phrases"))


def match_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "part").select("p_brand", "p_partkey", (F.col("p_partkey") % 101 / 100).alias("score"))
    best = scored.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("score", "p_partkey")).alias("p_partkey"))
    found = matching.alternatives(scored, "p_brand", "score", "p_partkey", best)
    return found.withColumns({"by_words": L.match_confidence(F.col("score"), False), "by_vectors": L.match_confidence(F.col("score"), True)})


def printed_codes(spark: SparkSession, sf: str) -> DataFrame:
    code = L.printed_code(F.concat(chosen(CODES), F.col("p_size").cast("string")), F.get(F.array(*map(F.lit, SHEETS)), (F.col("p_size") % 4).cast("int")))
    return table(spark, sf, "part").select("p_partkey", code.alias("printed_code"))


def telling_words(spark: SparkSession, sf: str) -> DataFrame:
    word = L.telling_word(F.concat_ws(" ", "p_type", "p_name"), F.array(chosen(["the widget of brass", "Small ECONOMY", ""])))
    return table(spark, sf, "part").select("p_partkey", word.alias("word"))


def group_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", L.group_name(F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise(chosen(TITLES))).alias("group_name"))


def table_goals(spark: SparkSession, sf: str) -> DataFrame:
    goal = L.goal_number(chosen(GOALS), F.array("p_name", F.when(F.col("p_size") % 4 == 0, "SDG 12 index").otherwise("")), F.when(F.col("p_size") % 3 == 0, "SDG 2"), F.lit("for SDG16"))
    return table(spark, sf, "part").select("p_partkey", goal.alias("goal"))


def banners_stripped(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    cells = F.when(key % 3 == 0, F.array(F.lit("D-12"), F.lit(" "), F.lit(" D-12"))).otherwise(F.array("p_name", F.lit(None), "p_brand", "p_type"))
    rows = table(spark, sf, "part").select("p_size", "p_partkey", cells.alias("cells"))
    return grid.strip_banners(rows, "p_size", "p_partkey", "cells").select("p_partkey", L.is_columnar_header(F.col("cells")).alias("columnar"))


LISTED = "a an and the of or etc other not elsewhere classified nec worker workers related support".split()
STOPS = "(" + ", ".join(f"'{w}'" for w in LISTED) + ")"
KEY = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
WORDS = "trim(regexp_replace(lower({0}), '[\\s_\\-./]+', ' ', 'g'))"
SERIAL = "(replace(w, ' ', '') IN ('slno', 'sno', 'srno', 'serialno', 'serialnumber', 'rowno', 'index') OR regexp_matches(w, 'sl no|serial|sr no|row no|#'))"

SQL: dict[str, str] = {
    "junk_columns": f"""
        WITH a AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN {chosen_sql(NAMES)} ELSE p_type || '_' || p_name END AS name FROM part), b AS (SELECT *, {WORDS.format('name')} AS w FROM a)
        SELECT p_partkey, {SERIAL} AS serial, {SERIAL} OR name IN ('Col_3', 'Unnamed: 4', '2023-24', '(7)', '15.0', ' ') OR w IN ('page', 'title')
            OR regexp_matches(w, 'content|page no|remark|note|chapter|description|particulars') AS junk FROM b""",
    "page_like_values": "SELECT p_partkey, p_partkey % 6 IN (0, 1, 3, 4) AS page_like FROM part",
    "contents_tables": """
        WITH a AS (SELECT p_partkey, p_size, p_partkey % 3 < 2 AS serial, p_partkey % 4 = 0 AS subject, p_partkey % 4 = 1 OR p_size % 5 >= 1 AS page, 2 + p_size % 5 AS n FROM part)
        SELECT p_partkey, (p_size % 7 = 0 AND p_partkey % 3 <> 1) OR (serial AND (subject OR page) AND n <= 5) OR (subject AND page AND n <= 4) AS contents FROM a""",
    "code_entries": """
        WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN upper(p_brand) END AS code, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE '' END AS value,
            CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 7 = 0 THEN p_type WHEN p_partkey % 5 = 1 THEN '' END AS definition FROM part)
        SELECT p_partkey, CASE WHEN code IS NULL OR value = '' OR coalesce(definition, '') = '' THEN '' ELSE code END AS code,
            CASE WHEN value = '' AND code IS NOT NULL THEN code ELSE value END AS value, definition FROM a""",
    "curated_codes": """
        SELECT DISTINCT p_type AS dimension, p_name AS value, 'real' AS origin FROM part WHERE p_type < 'M'
        UNION ALL (SELECT DISTINCT p_type, p_brand, 'guess' FROM part WHERE p_type >= 'M')""",
    "aggregate_labels": "SELECT p_partkey, p_size % 2 = 0 AND p_partkey % 11 IN (0, 1, 3, 6, 7) AS aggregate FROM part",
    "label_tokens": f"""
        WITH a AS (SELECT p_partkey, {chosen_sql(LABELS)} || ' ' || p_name AS label FROM part),
        t AS (SELECT p_partkey, label, list_filter(string_split({KEY.format('label')}, ' '), lambda w: w NOT IN {STOPS} AND w <> '') AS ws FROM a)
        SELECT p_partkey, array_to_string(list_transform(ws, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' AND w[:-2] NOT IN {STOPS} THEN w || ',' || w[:-2] ELSE w END), ',') AS tokens,
            array_to_string(list_filter(list_transform(string_split_regex(label, '[,/;]|\\s+(and|or)\\s+'), lambda p: trim(regexp_replace(p, '\\betc\\b', '', 'g'))), lambda p: p <> ''), '|') AS phrases FROM t""",
    "match_alternatives": """
        WITH s AS (SELECT p_brand, p_partkey, (p_partkey % 101) / 100 AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 101 DESC, p_partkey DESC) AS best FROM part),
        r AS (SELECT p_brand, p_partkey, score, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM s WHERE best > 1)
        SELECT *, CASE WHEN score >= 0.55 THEN 'high' WHEN score >= 0.38 THEN 'medium' ELSE 'low' END AS by_words,
            CASE WHEN score >= 0.52 THEN 'high' WHEN score >= 0.38 THEN 'medium' ELSE 'low' END AS by_vectors FROM r WHERE rank <= 4""",
    "printed_codes": "SELECT p_partkey, (['B12', 'D4', 'R&D1', ''])[p_partkey % 4 + 1] || p_size || (['4', '12', '', ''])[p_size % 4 + 1] AS printed_code FROM part",
    "telling_words": """
        SELECT p_partkey, list_filter(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z]+'),
            lambda w: length(w) > 3 AND NOT list_contains(string_split((['the widget of brass', 'small economy', ''])[p_partkey % 3 + 1], ' '), w))[1] AS word FROM part""",
    "group_names": """
        SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')
            ELSE (['Women''S Age-Group', 'Sl No', 'Births (By O''Clock)', 'Untitled group', 'Of Schools'])[p_partkey % 5 + 1] END AS group_name FROM part""",
    "table_goals": """
        SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN NULL WHEN 4 THEN 7
            ELSE CASE WHEN p_size % 4 = 0 THEN 12 WHEN p_size % 3 = 0 THEN 2 ELSE 16 END END AS goal FROM part""",
    "banners_stripped": """
        WITH f AS (SELECT p_size AS s, min(p_partkey) AS k FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1)
        SELECT p_partkey, p_partkey % 3 <> 0 AS columnar FROM part JOIN f ON s = p_size AND p_partkey >= k""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: found for name, found in list(globals().items()) if name in SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
