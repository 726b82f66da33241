"""Occupation matching over labels and a hierarchy made from part; matching blocks are beyond SQL, so a test measures all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import occupations
from quillgrid.session import table


def part_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Types as divisions, first words of names as subdivisions, brands as groups, names of a type as families."""
    part = table(spark, sf, "part").select("p_type", "p_name", "p_brand").distinct()
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    kind = F.substring("p_type", 1, 2)
    return part.select(
        kind.alias("division_code"),
        F.initcap(F.lower("p_type")).alias("division_title"),
        F.concat_ws(".", kind, F.substring(first, 1, 2)).alias("subdivision_code"),
        F.concat_ws(" ", F.initcap(first), F.lit("goods and related")).alias("subdivision_title"),
        F.concat_ws(".", kind, F.substring(first, 1, 2), F.regexp_extract("p_brand", "([0-9]+)", 1)).alias("group_code"),
        F.concat_ws(" ", first, "p_brand").alias("group_title"),
        F.concat_ws(".", kind, F.translate("p_name", " ", "_")).alias("family_code"),
        F.concat_ws(" ", last, F.lit("makers of"), first, F.lit("kind")).alias("family_title"),
    )


def part_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of parts as a survey would print them: several kinds, slashes, plurals and cut words."""
    key = F.col("p_partkey")
    last = F.substring_index("p_name", " ", -1)
    label = F.when(key % 3 == 0, F.concat_ws(" / ", F.upper("p_name"), F.concat(last, F.lit("s, etc")))).when(key % 3 == 1, F.concat_ws(" and ", F.lower("p_type"), F.concat(F.lit("maker of "), F.expr("left(p_name, length(p_name) - 1)")))).otherwise(F.concat_ws(" ", "p_brand", last, F.lit("workers")))
    return table(spark, sf, "part").select(label.alias("label")).distinct()


def occupation_match(spark: SparkSession, sf: str) -> DataFrame:
    return occupations.matched(part_labels(spark, sf), part_hierarchy(spark, sf))


SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"occupation_match": occupation_match}
