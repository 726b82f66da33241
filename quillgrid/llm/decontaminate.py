"""Benchmark decontamination over a positional inverted index.

Every window of an item is reached through its rarest term. The terms' corpus counts are taken first,
over all documents; then only the postings of those rarest terms are stored, each with the words around
it. Aligning a posting with the item at the term's place and walking both ways while the words agree
gives the longest common run through that place; windows inside the run are exact phrase matches. The
same stored context answers proximity: how many of a window's words lie close to the posting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import cut, let, words_by_class

#: Benchmark text is searched in blocks of this size. What a block broadcasts is under ten times that.
BLOCK_BYTES = 4 << 20


def item_anchors(items: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """item_id, n (words in the item), size (words in a window), at, term and near (the words around at).

    One row for each place of an item that is the rarest of some window: least corpus count, then
    least term, then first place. Windows with a term that no document has are left out.
    """
    placed = items.select("item_key", F.posexplode("words").alias("at", "term")).join(counts, "term", "left")
    ranked = placed.groupBy("item_key").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("n_found", F.lit(0)).alias("n_found"), "term"))).alias("ranks")
    )
    n = F.size("ranks")
    size = F.least(n, F.lit(width))
    rarest = F.transform(
        F.sequence(F.lit(0), n - size),
        lambda i: F.array_min(F.transform(F.slice("ranks", i + 1, size), lambda r: F.struct(r["n_found"], r["term"], r["at"]))),
    )
    return (
        ranked.select("item_key", size.alias("size"), F.explode(F.array_distinct(rarest)).alias("a"))
        .where("a.n_found > 0")
        .select("item_key", "size", F.col("a.at").alias("at"), F.col("a.term").alias("term"))
        .join(items.select("item_key", "words"), "item_key")
        .select("item_key", "size", "term", around(F.col("words"), F.col("at"), width - 1).alias("near"))
    )


def around(words: Column, at: Column, reach: int) -> Column:
    """The words before at (nearest first) and after it, at most so many each."""
    start = F.greatest(at - reach, F.lit(0))
    return F.struct(
        F.when(at > 0, F.reverse(F.slice(words, start + 1, at - start))).otherwise(F.array().cast("array<string>")).alias("left"),
        F.slice(words, at + 2, reach).alias("right"),
    )


def agreeing(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(same, lambda s: F.when(F.array_contains(s, False), F.array_position(s, False).cast("int") - 1).otherwise(F.size(s)))


def phrase_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, content (a hash of the text) and, for documents with a match, intervals and items.

    intervals: array of (from, to) word places inside some occurrence of a window, to inclusive.
    items: the ids of the items whose windows occur; near_items: those, and the items of which at
    least eight tenths of the distinct words around a rarest term lie around it in the document too.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("content"), words_by_class(F.col("text")).alias("words"))
    items = benchmark.select("item_id", words_by_class(F.col("text")).alias("words")).where("size(words) > 0")
    # Items of equal text are searched once.
    items = items.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    items = items.withColumn("item_key", F.sha2(F.concat_ws(" ", "words"), 256))
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    parts = [block_hits(rows, items.where(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == b), width) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("doc_id", "content").agg(
        F.collect_set("interval").alias("intervals"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("exact_ids")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("near_items"),
    )


def block_hits(rows: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """The matches of one block of items, which is small enough for every executor to hold."""
    terms = items.select(F.explode("words").alias("term")).distinct()
    counts = rows.select(F.explode("words").alias("term")).join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_found"))
    anchors = cut(item_anchors(items, cut(counts), width))
    rare = anchors.select("term").distinct()
    index = (
        rows.select("doc_id", "content", "words", F.posexplode("words").alias("at", "term"))
        .join(F.broadcast(rare), "term")
        .select("term", "doc_id", "content", "at", around(F.col("words"), F.col("at"), width - 1).alias("context"))
    )
    item_words = F.array_distinct(F.concat("near.left", "near.right"))
    shared = F.size(F.array_intersect(item_words, F.concat("context.left", "context.right")))
    met = index.join(F.broadcast(anchors), "term").select(
        "doc_id",
        "content",
        "at",
        "item_key",
        "size",
        agreeing(F.col("context.left"), F.col("near.left")).alias("before"),
        agreeing(F.col("context.right"), F.col("near.right")).alias("after"),
        (10 * (shared + 1) >= 8 * (F.size(item_words) + 1)).alias("close"),
    )
    exact = F.expr("before + after + 1 >= size")
    interval = F.struct((F.col("at") - F.col("before")).alias("from"), (F.col("at") + F.col("after")).alias("to"))
    return (
        met.where(exact | F.col("close"))
        .join(F.broadcast(items.select("item_key", "item_ids")), "item_key")
        .select("doc_id", "content", F.when(exact, interval).alias("interval"), F.when(exact, F.col("item_ids")).alias("exact_ids"), "item_ids")
    )


def covered(intervals: Column) -> Column:
    """How many places lie in at least one of the intervals."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("int").alias("end"))

    def add(state: Column, x: Column) -> Column:
        first = F.greatest(x["from"], state["end"] + 1)
        return F.struct((state["n"] + F.greatest(x["to"] - first + 1, F.lit(0))).cast("long").alias("n"), F.greatest(x["to"], state["end"]).cast("int").alias("end"))

    return F.aggregate(F.array_sort(intervals), start, add)["n"]


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, content, n_words, n_hit (words inside an occurrence of an item's window) and items of every row.

    A null text has no words and no hits. An item of fewer words than width, but not none, is one
    window; an item without words matches nothing; a null item_id takes part in the hits but has
    no id to list. Rows of one doc_id are judged by their own texts; rows that are equal get equal
    results. An empty benchmark leaves every document clean, an empty table gives an empty table.
    """
    hits = phrase_hits(docs, benchmark, width)
    base = docs.select("doc_id", F.xxhash64("text").alias("content"), F.size(words_by_class(F.col("text"))).cast("long").alias("n_words"))
    same = base["doc_id"].eqNullSafe(hits["doc_id"]) & (base["content"] == hits["content"])
    none = F.array().cast("array<string>")
    return base.join(hits, same, "left").select(
        base["doc_id"],
        base["content"],
        "n_words",
        F.coalesce(covered(F.col("intervals")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs."""
    hits = phrase_hits(docs, benchmark, width).where("size(items) > 0 or size(intervals) > 0").select(F.col("doc_id").alias("_hit_id"), F.col("content").alias("_hit_content"))
    same = docs["doc_id"].eqNullSafe(hits["_hit_id"]) & (F.xxhash64(docs["text"]) == hits["_hit_content"])
    return docs.join(hits, same, "left_anti")
