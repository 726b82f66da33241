"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents are cut into blocks of equal numbers of documents. A source's target at a slot is
its exact share of the slots so far: weights over the sum of the weights of those that still have blocks,
so the targets of the others rise at the moment at which a source's target has reached its blocks. Among
the blocks whose release has come, the one of earliest deadline gets the slot. With m sources, block j
(from 0) is released when the target reaches j + e and due when it reaches j + 1 - e, e = 1 / (2m - 2);
then no source is ever a whole block off its target (Tijdeman, The chairman assignment problem, 1980).

The schedule is made slot by slot and written in ranges of RANGE slots. What the driver holds is a few
numbers for each source and one range, none of which grows with the number of documents; its time grows
with the number of blocks.
"""

from __future__ import annotations

import heapq
import itertools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.llm.common import cut, free_name, shared_folder

#: Slots in a period of whole_weights, which the mix itself doesn't use.
PERIOD = 2048
#: Slots that are written at once.
RANGE = 1 << 17
#: A schedule of up to this many slots is sent to every executor; beyond it rows are shuffled.
BROADCAST_SLOTS = 1_000_000
NO_SOURCE = "\x00none"


def whole_weights(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of each source in a period: at least one, by largest remainder, period in all."""
    total = math.fsum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (-(exact[s] - math.floor(exact[s])), s))
    while sum(slots.values()) < period:
        for s in order[: period - sum(slots.values())]:
            slots[s] += 1
    while (over := sum(slots.values()) - period) > 0:
        for s in sorted((s for s in slots if slots[s] > 1), key=lambda s: (exact[s] - slots[s], s))[:over]:
            slots[s] -= 1
    return slots


def pfair(slots: dict[str, int]) -> list[str]:
    """The source of each slot of one period, by earliest deadline first among released blocks.

    Ties of deadline go to the block whose window overlaps the next one's, then to the one whose
    run of such windows ends later, then by name: the tie-breaks under which no deadline is missed.
    """
    period = sum(slots.values())

    def release(n: int, j: int) -> int:
        return (j - 1) * period // n

    def deadline(n: int, j: int) -> int:
        return -(-j * period // n)

    def overlaps(n: int, j: int) -> int:
        return deadline(n, j) - release(n, j + 1)

    def group_deadline(n: int, j: int) -> int:
        if 2 * n < period or n == period:  # windows of three slots or more don't force their successors
            return 0
        while overlaps(n, j) and deadline(n, j + 1) - release(n, j + 1) == 2:
            j += 1
        return deadline(n, j)

    done = dict.fromkeys(slots, 0)
    out = []
    for t in range(period):
        ready = [s for s, n in slots.items() if done[s] < n and release(n, done[s] + 1) <= t]
        best = min(ready, key=lambda s: (deadline(slots[s], done[s] + 1), -overlaps(slots[s], done[s] + 1), -group_deadline(slots[s], done[s] + 1), s))
        done[best] += 1
        out.append(best)
    return out


def turns(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """(source, block) of each slot in turn, less than one block off every source's exact target.

    Level v is common to all sources: the target of one is its weight times v, and its blocks at most.
    """
    if not blocks:
        return
    names = sorted(blocks)
    edge = 1 / (2 * max(2, len(names)) - 2)
    waiting = [(edge / weights[s], k) for k, s in enumerate(names)]
    heapq.heapify(waiting)
    ready: list[tuple[float, int]] = []
    done = [0] * len(names)
    # The level at which each target ends, the slots gone by then, and the weight at work before.
    ends = sorted((blocks[s] / weights[s], weights[s], blocks[s]) for s in names)
    left = [0.0, *itertools.accumulate(w for _, w, _ in reversed(ends))]
    ended = at = 0
    for slot in range(1, sum(blocks.values()) + 1):
        while True:
            v = (slot - ended) / left[len(ends) - at]
            if at == len(ends) - 1 or v <= ends[at][0]:
                break
            ended += ends[at][2]
            at += 1
        while waiting and (waiting[0][0] <= v or not ready):
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, ((done[k] + 1 - edge) / weights[names[k]], k))
        k = heapq.heappop(ready)[1]
        yield names[k], done[k]
        done[k] += 1
        if done[k] < blocks[names[k]]:
            heapq.heappush(waiting, ((done[k] + edge) / weights[names[k]], k))


def numbered(rows: DataFrame, counts: dict[str, int], per_piece: int) -> DataFrame:
    """rows with m_number, from 0 in each m_source, in an order that spreads a source over many tasks.

    A row falls into one of its source's pieces by the hash that orders the source. Rows of a piece are
    numbered among themselves; the counts of the pieces, far fewer, give each piece its start. They are
    summed in two levels, so that no task holds all the pieces of a large source.
    """
    spark = rows.sparkSession
    pieces = spark.createDataFrame([(s, -(-n // per_piece), math.isqrt(-(-n // per_piece)) + 1) for s, n in counts.items()], "m_source string, m_pieces long, m_wide long")
    rows = rows.join(F.broadcast(pieces), "m_source").withColumn("m_piece", F.pmod(F.xxhash64("m_order", "m_content"), F.col("m_pieces")))
    rows = rows.withColumn("m_part", F.floor(F.col("m_piece") / F.col("m_wide")).cast("long")).drop("m_pieces", "m_wide")
    sizes = rows.groupBy("m_source", "m_part", "m_piece").agg(F.count(F.lit(1)).alias("m_rows"))
    before = (W.unboundedPreceding, -1)
    parts = sizes.groupBy("m_source", "m_part").agg(F.sum("m_rows").alias("m_rows"))
    in_source = F.sum("m_rows").over(W.partitionBy("m_source").orderBy("m_part").rowsBetween(*before))
    in_part = F.sum("m_rows").over(W.partitionBy("m_source", "m_part").orderBy("m_piece").rowsBetween(*before))
    parts = parts.select("m_source", "m_part", F.coalesce(in_source, F.lit(0)).alias("m_a"))
    starts = sizes.select("m_source", "m_part", "m_piece", F.coalesce(in_part, F.lit(0)).alias("m_b")).join(parts, ["m_source", "m_part"])
    starts = cut(starts.select("m_source", "m_piece", (F.col("m_a") + F.col("m_b")).alias("m_start")))
    own = F.row_number().over(W.partitionBy("m_source", "m_piece").orderBy("m_order", "m_content")) - 1
    rows = rows.drop("m_part").withColumn("m_own", own).join(starts, ["m_source", "m_piece"])
    return rows.withColumn("m_number", (F.col("m_start") + F.col("m_own")).cast("long")).drop("m_piece", "m_own", "m_start", "m_order", "m_content")


@dataclass
class Plan:
    """The (source, block) of each slot, made anew by each iteration."""

    parts: list[tuple[dict[str, int], dict[str, float]]]

    def __iter__(self) -> Iterator[tuple[str, int]]:
        for blocks, weights in self.parts:
            yield from turns(blocks, weights)


def plan(counts: dict[str, int], weights: dict[str, float] | None, power: float, block_docs: int) -> Plan:
    """The sources that have a weight, then the others by equal weights."""
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    given = {s: n**power if weights is None else weights.get(s, 0.0) for s, n in counts.items()}
    wanted = {s: b for s, b in blocks.items() if given[s] > 0}
    others = {s: b for s, b in blocks.items() if given[s] <= 0}
    return Plan([(part, {s: given[s] if given[s] > 0 else 1.0 for s in part}) for part in (wanted, others)])


def slot_table(spark: SparkSession, made: Plan, counts: dict[str, int], block_docs: int) -> DataFrame:
    """m_source, m_block, m_slot and m_first (the documents before the block) of each slot, written range by range."""
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    schema = "m_source string, m_block long, m_slot long, m_first long"
    spark.createDataFrame([], schema).write.parquet(path)
    slots, first, slot = iter(made), 0, 0
    while chunk := list(itertools.islice(slots, RANGE)):
        firsts = []
        for s, b in chunk:
            firsts.append(first)
            first += min(block_docs, counts[s] - b * block_docs)
        columns = [pa.array([s for s, _ in chunk], pa.string()), pa.array([b for _, b in chunk], pa.int64()), pa.array(range(slot, slot + len(chunk)), pa.int64()), pa.array(firsts, pa.int64())]
        spark.createDataFrame(pa.Table.from_arrays(columns, ["m_source", "m_block", "m_slot", "m_first"])).write.mode("append").parquet(path)
        slot += len(chunk)
    table = spark.read.schema(schema).parquet(path)
    return F.broadcast(table) if slot <= BROADCAST_SLOTS else table


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, block_docs: int = 16, per_piece: int = 1024) -> DataFrame:
    """docs with mix_source, mix_block (from 0 in its source), mix_slot and mix_position (from 0) for every row.

    weights: the target of each source; without them, a source's number of documents to the given
    power, which lifts small sources. A null source is a source of its own. A source's documents come
    in the order of a hash of doc_id. All rows stay; a source that the weights don't name, or give
    nothing, follows after the others. Repeated rows have places of their own, null texts and ids
    count like any others, an empty table gives an empty table. Columns of docs pass through; those
    that clash with an added one give way to it.
    """
    docs = docs.drop(*ADDED)
    hidden = {c: free_name(docs, f"kept_{i}") for i, c in enumerate(docs.columns) if c.lower().startswith("m_")}
    names, docs = docs.columns, docs.withColumnsRenamed(hidden)
    rows = docs.withColumns(
        {
            "m_source": F.coalesce(docs["source"], F.lit(NO_SOURCE)),
            "m_order": F.xxhash64(F.lit("order"), docs["doc_id"]),
            "m_content": F.xxhash64(docs["doc_id"], docs["text"]),
        }
    )
    counted = rows.groupBy("m_source").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r.m_source: r.n for r in sorted(counted)}
    table = slot_table(docs.sparkSession, plan(counts, weights, power, block_docs), counts, block_docs)
    rows = numbered(rows, counts, per_piece).withColumn("m_block", F.floor(F.col("m_number") / block_docs).cast("long"))
    rows = rows.join(table, ["m_source", "m_block"])
    back = {v: k for k, v in hidden.items()}
    return rows.select(
        *(F.col(f"`{hidden.get(c, c)}`").alias(back.get(c, c)) for c in names),
        F.when(F.col("m_source") != NO_SOURCE, F.col("m_source")).alias("mix_source"),
        F.col("m_block").alias("mix_block"),
        F.col("m_slot").alias("mix_slot"),
        (F.col("m_first") + F.pmod(F.col("m_number"), F.lit(block_docs))).cast("long").alias("mix_position"),
    )


ADDED = ("mix_source", "mix_block", "mix_slot", "mix_position")


def slot_of(made: Plan, source: str, block: int) -> int:
    for slot, x in enumerate(made):
        if x == (source, block):
            return slot
    raise KeyError((source, block))
