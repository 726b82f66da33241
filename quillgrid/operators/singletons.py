"""Proposed merges of single tables, kept where their titles agree pair by pair and no table is used twice."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions.text import base_title, title_tokens
from quillgrid.session import dealt, unsent

# Shared words that make two titles agree, and the share of the shorter one that does.
SHARED, CONTAINED = 2, 0.7


def agree(a: list[str], b: list[str]) -> bool:
    """Whether two lists of title tokens agree; never where one is empty."""
    both = len(set(a) & set(b))
    return both >= SHARED or (both >= 1 and both >= CONTAINED * min(len(a), len(b)))


def all_agree(titles: list[list[str]]) -> bool:
    """Whether two titles or more are all in agreement with each other."""
    return len(titles) >= 2 and all(agree(a, b) for a, b in combinations(titles, 2))


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """scope, ord and ids of the proposals that are accepted; they come scope by scope, in order, with their members.

    An id that has been used is held until the last proposal that has it (last) has passed.
    """
    now, used = None, set()
    for batch in batches:
        rows, found = [], []
        for i, (scope, members) in enumerate(zip(batch.column("scope").to_pylist(), batch.column("members").to_pylist())):
            if scope != now:
                now, used = scope, set()
            free = [m for m in members if m["id"] not in used]
            if all_agree([m["tokens"] for m in free if not m["blank"]]):
                rows.append(i)
                found.append([m["id"] for m in free])
                used.update(m["id"] for m in free)
            used.difference_update(m["id"] for m in members if m["last"])
        kept = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column("scope"), kept.column("ord"), pa.array(found, pa.list_(pa.string()))], ["scope", "ord", "ids"])


def accepted_merges(proposals: DataFrame, singles: DataFrame) -> DataFrame:
    """scope, ord and ids of the proposals that are accepted.

    proposals: scope, ord (a long), confidence and ids (an array of text); singles: scope, id and title. Proposals come in by
    ord; only those of high confidence count. Of a proposal's tables those that are no single, repeated, or used by an
    accepted one before don't. At least two must be left, and of those with a title at least two, all of which agree: two
    shared words, or 70 % of the shorter title. One task goes through a scope's proposals in order, as each may depend on all before;
    it holds only ids that later proposals have too.
    """
    sure = proposals.where(F.lower(F.trim("confidence")) == "high").select("scope", F.col("ord").cast("long").alias("ord"), F.posexplode("ids").alias("at", "id"))
    tokens = title_tokens(base_title(F.coalesce("title", F.lit(""))))
    single = singles.select("scope", "id", (F.trim(F.coalesce("title", F.lit(""))) == "").alias("blank"), tokens.alias("tokens"), "title")
    each = sure.select("scope", "ord", "at", F.trim("id").alias("id")).join(unsent(single), ["scope", "id"])
    each = each.groupBy("scope", "ord", "id", "title", "blank", "tokens").agg(F.min("at").alias("at"))
    last = F.col("ord") == F.max("ord").over(W.partitionBy("scope", "id"))
    member = F.struct("at", "id", "blank", "tokens", last.alias("last"))
    held = each.select("scope", "ord", member.alias("member")).groupBy("scope", "ord").agg(F.array_sort(F.collect_list("member")).alias("members"))
    ordered = dealt(held, "scope").sortWithinPartitions("scope", "ord")
    return ordered.mapInArrow(settled, ordered.select("scope", "ord", F.lit(None).cast("array<string>").alias("ids")).schema)
