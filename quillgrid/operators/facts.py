"""Facts about tables: which columns are row dimensions and what they hold, and what titles say of periods, units, codes and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What names of serial columns and of row dimensions hold, or are.
SERIAL_HINTS = ("sl no", "sl.no", "s.no", "serial", "sr no", "sr.no", "index", "#")
DIMENSION_NAMES = ("age", "religion", "category", "sex", "gender")
DIMENSION_HINTS = ("age", "religion", "category", "cause", "place", "area", "district", "state", "sex", "gender")
# Words for kinds of places, and distinct values that a category has at most: of half its rows, or of any.
PLACES = ("URBAN", "RURAL", "DISTRICT", "STATE", "NATIONAL", "ZONE", "REGION", "BLOCK", "WARD", "VILLAGE", "TALUKA", "MANDAL", "CIRCLE", "DIVISION", "COUNTRY", "CITY", "TOWN", "PANCHAYAT", "COUNTY", "DEPARTMENT")
MOST_VALUES, FEW_VALUES, MOST_SHARE, MOST_NUMBERS = 50, 15, 0.5, 0.6
# Fixed patterns: years, ranges of years, codes of tables, and bracketed remarks that name a unit.
YEAR, YEARS = r"\b((?:19|20)\d{2})\b", r"\b((?:19|20)\d{2}\s*[-/–]\s*(?:(?:19|20)\d{2}|\d{2}))\b"
CODE, UNIT = r"\b([A-Za-z]{1,3}-\d+(?:\.\d+)?)\b", r"(?i)\(([^)]*(?:RS\.?|₹|%|PERCENT|LAKH|CRORE|SQ\.?\s?KM|PER\s+\d+|COUNT|NUMBER|KG|MT|KM)[^)]*)\)"
NUMBER = r"^[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"


def is_figure(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).rlike(NUMBER)


def holds_any(name: Column, hints: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for hint in hints:
        found = found | F.contains(name, F.lit(hint))
    return found


def row_dimensions(cells: DataFrame) -> DataFrame:
    """table_name, column_name and category_values (the texts that are no numbers, without regard to case in order) of each row dimension.

    cells: table_name, column_name and value. Serial columns are none. A column named as a dimension is one if it has a text that
    is no number; any other if its values repeat, at most 60 % of its cells are numbers, and it has 15 distinct values at most,
    or 50 that are at most half its cells. Blank cells don't count.
    """
    each = cells.select("table_name", "column_name", F.trim("value").alias("v")).where("v <> ''").groupBy("table_name", "column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    each = each.withColumn("number", is_figure(F.col("v")))
    found = each.groupBy("table_name", "column_name").agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum(F.when(F.col("number"), F.col("n"))), F.lit(0)).alias("numbers"))
    name = F.lower(F.trim("column_name"))
    named = name.isin(*DIMENSION_NAMES) | holds_any(name, DIMENSION_HINTS)
    repeats = (F.col("distinct") > 1) & (F.col("distinct") < F.col("cells")) & (F.col("numbers") <= MOST_NUMBERS * F.col("cells"))
    few = (F.col("distinct") <= FEW_VALUES) | ((F.col("distinct") <= MOST_VALUES) & (F.col("distinct") <= MOST_SHARE * F.col("cells")))
    kept = found.where(~holds_any(name, SERIAL_HINTS) & (F.col("numbers") < F.col("cells")) & (named | (repeats & few))).select("table_name", "column_name")
    texts = each.where("not number").join(kept, ["table_name", "column_name"])
    values = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("v").alias("low"), "v"))), lambda x: x["v"])
    return texts.groupBy("table_name", "column_name").agg(values.alias("category_values"))


def found_in(text: Column, pattern: str) -> Column:
    """What a pattern's first group finds in a text, once each and in order; none for null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1)))


def text_facts(text: Column) -> dict[str, Column]:
    """years, year_ranges, units, codes (in capitals) and places of a title or note, as sorted arrays."""
    words = F.split(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9_]+")
    return {
        "years": found_in(text, YEAR),
        "year_ranges": found_in(text, YEARS),
        "units": F.array_sort(F.array_distinct(F.transform(found_in(text, UNIT), lambda x: F.trim(x)))),
        "codes": F.array_sort(F.array_distinct(F.transform(found_in(text, CODE), F.upper))),
        "places": F.array_sort(F.array_intersect(F.array(*map(F.lit, PLACES)), words)),
    }
