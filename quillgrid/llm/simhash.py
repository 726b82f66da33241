"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all values within half the radius of itself. Two fingerprints lie
within the radius of each other exactly when some emitted value is common to both, so one shuffle on
those values meets every linked pair. As the fingerprints that meet in one value are all linked
through it, each is linked to the least of them only, which keeps the edges in proportion to the
emitted rows however large a group of copies is. Exact copies have one fingerprint and never meet.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import as_bytes, cut, free_name

SEED = 42
#: Documents that stay, up to this many (some 30 bytes each), are named to every executor; beyond it texts are shuffled.
BROADCAST_ROWS = 1_000_000
#: Shingles whose bits are counted at once, which bounds the memory that a very long text takes.
PIECE = 1 << 15
BIT_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes | None, width: int) -> int:
    """64 majority bits of the XXH64 of a text's word shingles; zero without a word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    hashes = map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), shingles)
    set_bits, total = np.zeros(64, np.int64), 0
    while len(piece := np.fromiter(itertools.islice(hashes, PIECE), np.uint64)):
        bits = np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int32)
        total += len(piece)
    return int(BIT_WEIGHTS[2 * set_bits > total].sum(dtype=np.uint64).astype(np.int64))


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, content (a hash of the text) and fp (the fingerprint as a signed 64-bit number) of every row.

    A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width) for t in as_bytes(batch.column("text"))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(found)], ["doc_id", "content", "fp"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("content"))
    return rows.mapInArrow(run, rows.select("doc_id", "content", F.lit(0).cast("long").alias("fp")).schema)


def ball(radius: int) -> list[int]:
    """Masks of at most so many bits, as signed numbers."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in itertools.combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked_pairs(prints: DataFrame, radius: int = 2) -> DataFrame:
    """u > v: links among the distinct values of column fp that connect all that lie within an even radius."""
    if radius % 2:
        raise ValueError("the radius is even: both sides emit half of it")
    masks = F.array(*(F.lit(m).cast("long") for m in ball(radius // 2)))
    met = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    # At most 65 distinct fingerprints lie within one bit of a value, so a group is small whatever the input.
    groups = met.groupBy("variant").agg(F.min("fp").alias("v"), F.max("fp").alias("w"), F.count(F.lit(1)).alias("n"))
    alone = groups.where("n = 2").select(F.col("w").alias("u"), "v")
    many = groups.where("n > 2").select("variant", "v")
    rest = met.join(many, "variant").where("fp <> v").select(F.col("fp").alias("u"), "v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    return alone.unionByName(rest).where(near).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """fp and root (the least value reachable) for every value in edges u > v.

    Large-star and small-star steps take turns until the edges form stars. Each step shuffles the
    edges only, aggregates before it shuffles, and cuts its lineage in the shared folder.
    """
    now = cut(edges)
    was = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == was:
            break
        was = seen
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, content, fp, component_id (the least doc_id reachable over links) and root of every row of docs.

    Texts without a word share the fingerprint zero and are linked like any other; a null text
    counts as empty. Rows of one doc_id are fingerprinted one by one. A null doc_id keeps its row;
    it gives its component no id, so component_id is null where no member has one. Columns other
    than doc_id and text are not read. An empty table gives an empty table. root is a fingerprint that
    names the component.
    """
    rows = cut(with_fingerprints(docs, width))
    # Copies meet here by partial aggregates; only distinct fingerprints go further.
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(linked_pairs(prints.select("fp"), radius))
    of_print = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = of_print.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = of_print.join(of_root, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", "content", "fp", "component_id", "root")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, width: int = 5, radius: int = 2) -> DataFrame:
    """The rows of docs that stay when one document of each group of near duplicates does, with their columns.

    The one of least doc_id stays (null last); of rows that share it, the one of least content hash,
    and of rows that share that as well one. Null texts count as empty ones and are alike. Columns pass through,
    whatever their names; an empty table gives an empty table.
    """
    return winners_of(docs, near_duplicates(docs, width, radius))


def winners_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The one row of docs that stays for each root in found (doc_id, content and root of every row of docs)."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content")
    winners = found.groupBy("root").agg(F.min(place).alias("w")).select(F.col("w.doc_id").alias("doc_id"), F.col("w.content").alias("content"))
    sizes = found.groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n"))
    same = winners["doc_id"].eqNullSafe(sizes["doc_id"]) & (winners["content"] == sizes["content"])
    won_id, won_content = free_name(docs, "won_id"), free_name(docs, "won_content")
    winners = cut(winners.join(sizes, same).select(winners["doc_id"].alias(won_id), winners["content"].alias(won_content), F.col("n").alias("won_n")))
    won = docs["doc_id"].eqNullSafe(F.col(won_id)) & (F.xxhash64(docs["text"]) == F.col(won_content))
    once = cut(winners.where("won_n = 1").drop("won_n"))
    stay = docs.join(F.broadcast(once) if once.count() <= BROADCAST_ROWS else once, won, "left_semi")
    repeated = winners.where("won_n > 1").drop("won_n")
    if repeated.isEmpty():
        return stay
    return stay.unionByName(docs.join(repeated, won, "left_semi").dropDuplicates(["doc_id", "text"]))
