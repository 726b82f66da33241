"""Columns in long form: profiles, statistics, facets, categorical dimensions, alignment issues, and their sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions.labels import is_junk_name, is_page_like
from quillgrid.functions.text import is_numeric, is_placeholder, is_plain_number, slug


def long_form(table: DataFrame, name: str, key: str, columns: list[str]) -> DataFrame:
    """table_name, row_key, column_name and value (text) of each cell: one pass over the table, no union."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))
    return table.select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), F.inline(cells))


def column_stats(cells: DataFrame) -> DataFrame:
    """Type, counts, extremes and mean of each column; numbers where every value that is there reads as one."""
    number = F.regexp_replace("value", ",", "").try_cast("double")
    there = F.col("value").isNotNull() & (F.trim("value") != "")
    found = cells.groupBy("table_name", "column_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(there).alias("n_values"),
        F.count_if(there & number.isNotNull()).alias("n_numbers"),
        F.countDistinct(F.when(there, F.col("value"))).alias("n_distinct"),
        F.min(F.when(there, number)).alias("lo"),
        F.max(F.when(there, number)).alias("hi"),
        F.avg(F.when(there, number)).alias("mean"),
    )
    numeric = (F.col("n_values") > 0) & (F.col("n_numbers") == F.col("n_values"))
    return found.select(
        "table_name",
        "column_name",
        F.when(numeric, "number").otherwise("text").alias("column_type"),
        "n_rows",
        "n_values",
        "n_distinct",
        F.when(numeric, F.round("lo", 4)).alias("min_value"),
        F.when(numeric, F.round("hi", 4)).alias("max_value"),
        F.when(numeric, F.round("mean", 4)).alias("mean_value"),
    )


def facet_counts(rows: DataFrame, owner: str, dimension: str, value: str) -> DataFrame:
    """How many distinct owners have each value of each dimension; blanks don't count."""
    there = rows.where(F.col(value).isNotNull() & (F.trim(F.col(value)) != ""))
    return there.groupBy(dimension, value).agg(F.countDistinct(owner).alias("n_owners"))


def discover_dimensions(cells: DataFrame, least: int = 2, most: int = 80) -> DataFrame:
    """Columns that look like categories: from 2 to 80 texts without regard to case, not free text, pages or serials, by values and names."""
    bare = F.trim("value")
    texts = cells.where(F.col("value").isNotNull() & (bare != "") & ~is_junk_name(F.col("column_name"))).select("table_name", "column_name", bare.alias("v"))
    per_value = texts.groupBy("table_name", "column_name", F.lower("v").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("spelling"))
    counted = per_value.withColumn("plain", is_plain_number(F.col("low")))
    found = counted.groupBy("table_name", "column_name").agg(
        F.sum("n").alias("n_values"), F.count_if(~F.col("plain")).alias("n_distinct"), F.avg(F.when(~F.col("plain"), F.length("spelling"))).alias("mean_length"),
        F.count_if(~F.col("plain") & is_page_like(F.col("spelling"))).alias("n_pages"),
    )
    free = (F.col("n_distinct") >= 8) & (F.col("n_distinct") / F.col("n_values") >= 0.85) & (F.col("mean_length") >= 24)
    pages = F.col("n_pages") >= F.greatest(F.lit(2), F.floor(0.8 * F.col("n_distinct")))
    return found.where(F.col("n_distinct").between(least, most) & ~pages & ~F.coalesce(free, F.lit(False))).select("table_name", F.regexp_replace("column_name", r"\s+", "_").alias("dimension"), "n_distinct")


def near_sets(values: DataFrame, key: str, least_jaccard: float = 0.85, least_contained: float = 0.9) -> DataFrame:
    """Pairs of keys whose value sets nearly agree, or whose names do.

    values: key and value, one row for each. Pairs come from shared values, so sets without any in
    common never meet; names are compared by their own equality.
    """
    sets = values.select(F.col(key).alias("k"), F.lower(F.trim("value")).alias("v")).distinct()
    sizes = sets.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    a, b = sets.select(F.col("k").alias("a"), "v"), sets.select(F.col("k").alias("b"), "v")
    shared = a.join(b, "v").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    names = sizes.select("k", slug(F.col("k")).alias("s"))
    alike = names.select(F.col("k").alias("a"), "s").join(names.select(F.col("k").alias("b"), "s"), "s").where("a < b").select("a", "b", F.lit(0).cast("long").alias("both"))
    pairs = shared.unionByName(alike).groupBy("a", "b").agg(F.max("both").alias("both"))
    pairs = pairs.join(sizes.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    jaccard = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    contained = F.col("both") / F.least("na", "nb")
    near = (jaccard >= least_jaccard) | (contained >= least_contained) | (slug(F.col("a")) == slug(F.col("b")))
    return pairs.select("a", "b", F.round(jaccard, 4).alias("jaccard"), F.round(contained, 4).alias("contained"), near.alias("near"))


def curated_over_guessed(guessed: DataFrame, curated: DataFrame, dimension: str) -> DataFrame:
    """The curated entries, and the guessed ones of dimensions that aren't curated; both have the same columns."""
    return curated.unionByName(guessed.join(curated.select(dimension).distinct(), dimension, "left_anti"))


def code_list_union(entries: DataFrame) -> DataFrame:
    """One entry for each dimension and value: the first code and definition that aren't blank, by ord."""
    by_ord = W.partitionBy("dimension", F.lower(F.trim("value"))).orderBy("ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def first(c: str) -> Column:
        return F.first(F.when(F.trim(c) != "", F.col(c)), ignorenulls=True).over(by_ord).alias(c)

    picked = entries.select("dimension", "ord", F.first("value").over(by_ord).alias("value"), first("code"), first("definition"), F.min("ord").over(by_ord).alias("_first"))
    return picked.where("ord = _first").select("dimension", "value", "code", "definition")


def equivalent_columns(cells: DataFrame) -> DataFrame:
    """Groups of columns with the same set of values, without regard to case.

    Columns are told apart by how many values they have and the sum of the values' hashes; only the sets of columns that
    agree in both are gathered and compared.
    """
    each = cells.where(F.trim("value") != "").select(F.concat_ws(".", "table_name", "column_name").alias("name"), F.lower(F.trim("value")).alias("v")).distinct()
    prints = each.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("h"))
    alike = prints.join(prints.groupBy("n", "h").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), ["n", "h"]).select("name")
    sets = each.join(alike, "name", "left_semi").groupBy("name").agg(F.array_sort(F.collect_set("v")).alias("values"))
    found = sets.groupBy("values").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("members"), F.count(F.lit(1)).alias("n_columns"))
    return found.where("n_columns > 1").select("members", "n_columns", F.size("values").cast("long").alias("n_values"))


def profile(cells: DataFrame) -> DataFrame:
    """Fill ratio and the mixed-type flag of each column of each table, and where the table is routed."""
    there = ~is_placeholder(F.col("value"))
    found = cells.groupBy("table_name", "column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(there).alias("n_values"), F.count_if(there & is_numeric(F.col("value"))).alias("n_numbers"), F.max(F.when(there, F.length("value"))).alias("longest")
    )
    share = F.col("n_numbers") / F.col("n_values")
    mixed = (F.col("n_values") >= 3) & (F.col("longest") > 4) & (share > 0.2) & (share < 0.8)
    return found.select("table_name", "column_name", "n_rows", F.round(F.col("n_values") / F.col("n_rows"), 3).alias("fill_ratio"), F.coalesce(mixed, F.lit(False)).alias("mixed"))


def route(profiled: DataFrame, least_fill: float = 0.5, least_rows: int = 2) -> DataFrame:
    """accept or review for each table, with the first reason that holds."""
    used = profiled.where("fill_ratio > 0")
    found = used.groupBy("table_name").agg(F.max("n_rows").alias("n_rows"), F.round(F.avg("fill_ratio"), 3).alias("fill"), F.max("mixed").alias("mixed"))
    reason = F.when(F.col("n_rows") < least_rows, "too few rows").when(F.col("fill") < least_fill, "sparse").when(F.col("mixed"), "mixed types").otherwise("")
    return found.select("table_name", "n_rows", "fill", reason.alias("reason"), F.when(reason == "", "accept").otherwise("review").alias("routed"))


def alignment_issues(cells: DataFrame, kinds: DataFrame) -> DataFrame:
    """Columns whose values don't fit their kind (table_name, column_name, kind): measure, geo or serial."""
    value = F.col("value")
    blank = is_placeholder(value)
    direction = F.lower(F.trim(value)).isin("north", "south", "east", "west", "male", "female", "total")
    # Cells are counted within each task first, whatever the kinds; only counts meet them.
    facts = cells.groupBy("table_name", "column_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(blank.cast("int")).alias("blank"),
        F.avg(F.when(~blank, is_numeric(value).cast("int"))).alias("numeric"),
        F.avg(F.coalesce(direction, F.lit(False)).cast("int")).alias("direction"),
        F.avg(F.coalesce(value.rlike(r"^[0-9]+\s*,\s*\S"), F.lit(False)).cast("int")).alias("listed"),
    )
    times = kinds.groupBy("table_name", "column_name", "kind").agg(F.count(F.lit(1)).alias("times"))
    found = facts.join(times, ["table_name", "column_name"]).withColumn("n", F.col("n") * F.col("times"))
    issue = (
        F.when((F.col("kind") == "measure") & (F.col("n") >= 5) & (F.col("blank") >= 0.7), "empty_measure")
        .when((F.col("kind") == "measure") & (F.col("n") >= 5) & (F.col("numeric") < 0.5), "non_numeric_measure")
        .when(F.col("kind").isin("measure", "geo") & (F.col("direction") >= 0.4), F.concat(F.lit("direction_in_"), F.col("kind")))
        .when((F.col("kind") == "serial") & (F.col("listed") >= 0.3), "list_in_serial")
    )
    return found.select("table_name", "column_name", "kind", issue.alias("issue")).where("issue is not null")


def uniquify(columns: DataFrame, owner: str, order: str, name: str) -> DataFrame:
    """columns with unique_name: the second and later of a name get _2, _3 and so on, in order."""
    number = F.row_number().over(W.partitionBy(owner, name).orderBy(order))
    return columns.withColumn("unique_name", F.when(number > 1, F.concat(name, F.lit("_"), number.cast("string"))).otherwise(F.col(name)))
