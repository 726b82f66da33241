"""Reading the catalogue: lists, cards, search, filtered row pages, releases, readiness, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions.text import like_needle

MAX_PAGE = 500


def with_counts(owners: DataFrame, owner_key: str, rows: DataFrame, row_key: str, name: str = "row_count") -> DataFrame:
    """owners with how many rows each has, 0 where none. Rows are counted before they are joined."""
    counts = rows.groupBy(F.col(row_key).alias("_owner")).agg(F.count(F.lit(1)).alias(name))
    return owners.join(counts, owners[owner_key] == counts["_owner"], "left").drop("_owner").fillna(0, [name])


def as_row_store(table: DataFrame, key: str) -> DataFrame:
    """dataset rows as the schemaless store holds them: key and a map of column to text."""
    pairs = [x for c in table.columns for x in (F.lit(c), F.col(c).cast("string"))]
    return table.select(F.col(key).alias("row_key"), F.create_map(*pairs).alias("row_data"))


def filter_rows(store: DataFrame, allowed: list[str], column: str = "", equals: str | None = None, contains: str | None = None) -> DataFrame:
    """Rows whose column equals, or holds without regard to case, a text; equals outweighs.

    A value that is missing never matches; a column outside the allowed ones is an error.
    """
    if not column:
        if equals is not None or contains is not None:
            raise ValueError("a filter needs a column")
        return store
    if column not in allowed:
        raise ValueError(f"no such column: {column}")
    value = F.col("row_data")[column]
    if equals is not None:
        return store.where(value == equals)
    if contains is not None:
        return store.where(value.ilike(like_needle(contains)))
    return store


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of rows in a total order; Catalyst keeps only offset + limit rows of each partition."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), MAX_PAGE))


def cards(datasets: DataFrame, tag_columns: list[str], keyword_columns: list[str]) -> DataFrame:
    """datasets with tags (distinct non-blank values, first 16, comma-joined) and keywords (lower case, spaces between)."""
    present = F.filter(F.array(*(F.trim(F.coalesce(F.col(c), F.lit(""))) for c in tag_columns)), lambda x: x != "")
    words = F.filter(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in keyword_columns)), lambda x: F.trim(x) != "")
    return datasets.withColumns({"tags": F.array_join(F.slice(F.array_distinct(present), 1, 16), ","), "keywords": F.lower(F.array_join(words, " "))})


def search(items: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Items in which some column holds the needle, without regard to case; a blank needle matches all."""
    wanted = needle.strip().lower()
    if not wanted:
        return items
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted)), F.lit(False))
    return items.where(hit)


def search_page(items: DataFrame, needle: str, columns: list[str], order: list[Column], offset: int = 0, limit: int = 50, release: str | None = None) -> DataFrame:
    """One page of search() within a release (column release; None or blank for any), each row with total, how many there are in all."""
    within = items.where(F.col("release") == release.strip()) if release and release.strip() else items
    found = search(within, needle, columns)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return page(found, order, offset, limit).join(F.broadcast(total), how="cross")


def release_rollup(releases: DataFrame, key: str, datasets: DataFrame, owner: str, count: str) -> DataFrame:
    """releases with n_tables and row_count over their datasets; those without a dataset are left out."""
    sums = datasets.groupBy(F.col(owner).alias("_release")).agg(F.count(F.lit(1)).alias("n_tables"), F.sum(count).alias("row_count"))
    return releases.join(sums, releases[key] == sums["_release"]).drop("_release")


def readiness(filled: Column, entries: Column, dimensions: Column) -> dict[str, Column]:
    """fill, percent and status of a release: published when nine tenths of its definitions are there."""
    fill = F.when(entries > 0, filled / entries).otherwise(F.lit(0.0))
    done = (dimensions > 0) & (fill >= 0.9)
    percent = F.when(done, 100).when(dimensions > 0, F.bround(75 + 20 * fill)).otherwise(75).cast("int")
    return {"fill": F.round(fill, 4), "percent": percent, "status": F.when(done, "Published").otherwise("Awaiting")}


def enrich_codes(rows: DataFrame, value: str, code_list: DataFrame) -> DataFrame:
    """rows with the Code and Definition of a value, matched trimmed and without case; the first entry of a value counts.

    code_list: ord, code, value, definition.
    """
    first = W.partitionBy("_key").orderBy("ord")
    keyed = code_list.withColumn("_key", F.lower(F.trim("value"))).withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
    keyed = keyed.select("_key", F.col("code").alias("Code"), F.col("definition").alias("Definition"))
    return rows.join(keyed, F.lower(F.trim(rows[value])) == keyed["_key"], "left").drop("_key")


def prefer_own_codes(own: DataFrame, of_release: DataFrame, members: DataFrame) -> DataFrame:
    """dataset, column, code and value: a dataset's own code list of a column, or else its release's.

    own: dataset, column, code, value; of_release: release, column, code, value; members: dataset, release.
    """
    has_own = own.select("dataset", "column").distinct()
    lent = members.join(of_release, "release").join(has_own, ["dataset", "column"], "left_anti")
    return own.select("dataset", "column", "code", "value").unionByName(lent.select("dataset", "column", "code", "value"))


UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def readable_id(*candidates: Column) -> Column:
    """The first candidate that is neither blank nor a UUID; the last one, trimmed, where all are."""
    trimmed = [F.trim(c.cast("string")) for c in candidates]
    return F.coalesce(*(F.when((c != "") & ~c.rlike(UUID), c) for c in trimmed), trimmed[-1])


def tables_of_releases(datasets: DataFrame, rows: DataFrame) -> DataFrame:
    """Each dataset with its release, readable id, title, table id and row_count; titles and table ids fall back on the id.

    datasets: dataset_id, unique_dataset_id, table_id, title, release; rows: dataset_id.
    """
    shown = readable_id(F.col("unique_dataset_id"), F.col("table_id"), F.col("dataset_id"))
    found = with_counts(datasets.withColumn("id", shown), "dataset_id", rows, "dataset_id")
    filled = {c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(F.col("id")) for c in ("title", "table_id")}
    return found.select("release", "id", filled["title"].alias("title"), filled["table_id"].alias("table_id"), "row_count")


def facet_filter(releases: DataFrame, facets: str, facet: str, columns: list[str], needle: str) -> DataFrame:
    """Releases that carry a facet ("all": any) and in whose columns, joined by blanks, the needle occurs without regard to case."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    wanted = needle.strip().lower()
    held = F.lit(True) if facet == "all" else F.coalesce(F.array_contains(facets, facet), F.lit(False))
    return releases.where(held & (F.contains(text, F.lit(wanted)) if wanted else F.lit(True)))


def keyword_chips(tags: Column, keywords: Column) -> Column:
    """The distinct tags that say something, or else the distinct words of two characters or more of the keywords."""
    said = F.array_distinct(F.filter(tags, lambda t: t.isNotNull() & (F.trim(t) != "") & (F.trim(t) != "—")))
    words = F.array_distinct(F.filter(F.split(F.coalesce(keywords, F.lit("")), r"\s+"), lambda w: F.length(w) > 1))
    return F.when(F.size(said) > 0, said).otherwise(words)


def id_summary(ids: Column) -> Column:
    """The first id that isn't blank, and how many more there are; empty without one."""
    there = F.filter(ids, lambda x: x.isNotNull() & (F.trim(x) != ""))
    first = F.trim(F.get(there, F.lit(0)))
    return F.when(F.size(there) == 0, "").when(F.size(there) == 1, first).otherwise(F.concat(first, F.lit(" +"), (F.size(there) - 1).cast("string"), F.lit(" more")))
