"""Tables matched to the rows of metadata workbooks, one after another, each row once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.labels import printed_code
from quillgrid.functions.text import base_title, id_key, id_stem, inventory_code
from quillgrid.operators.matching import checkpointed, components
from quillgrid.session import dealt


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), 1))


def keyed(tables: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the keys by which they meet: whole, stem and code; blank ones are null."""

    def some(key: Column) -> Column:
        return F.nullif(key, F.lit(""))

    said = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("table_id", "title", "sheet", "id"))))
    left = tables.select("scope", "ord", some(id_key(F.col("id"))).alias("whole"), some(id_stem(F.col("id"))).alias("stem"), some(printed_code(F.col("table_id"), F.col("sheet"))).alias("code"), said.alias("said"))
    right = inventory.select("scope", "ord", some(id_key(F.col("unique_dataset_id"))).alias("whole"), some(id_stem(F.col("unique_dataset_id"))).alias("stem"), some(inventory_code(F.col("table_id"))).alias("code"), F.coalesce("short_description", F.lit("")).alias("told"), words_of(F.col("short_description")).alias("words"))
    return left, right


class Free:
    """The free items of one part: by whole id, stem and code, and under a code by what they tell."""

    def __init__(self) -> None:
        self.last: dict[str, int] = {}
        self.used: set[int] = set()
        self.by_stem: dict[str, set[int]] = {}
        self.by_code: dict[str, set[int]] = {}
        self.keys: dict[int, tuple] = {}
        self.told: dict[str, dict[str, tuple[list[str], set[int]]]] = {}
        self.tellers: dict[str, dict[str, set[str]]] = {}

    def add(self, ord_: int, whole: str | None, stem: str | None, code: str | None, told: str, words: list[str]) -> None:
        if whole is not None:
            self.last[whole] = max(ord_, self.last.get(whole, ord_))
        self.keys[ord_] = (stem, code, told)
        if stem is not None:
            self.by_stem.setdefault(stem, set()).add(ord_)
        if code is not None:
            self.by_code.setdefault(code, set()).add(ord_)
            texts = self.told.setdefault(code, {})
            if told not in texts:
                texts[told] = (words, set())
                for w in words:
                    self.tellers.setdefault(code, {}).setdefault(w, set()).add(told)
            texts[told][1].add(ord_)

    def take(self, ord_: int) -> None:
        self.used.add(ord_)
        stem, code, told = self.keys.pop(ord_)
        if stem is not None:
            self.by_stem[stem].discard(ord_)
        if code is not None:
            self.by_code[code].discard(ord_)
            words, those = self.told[code][told]
            those.discard(ord_)
            if not those:
                del self.told[code][told]
                for w in words:
                    self.tellers[code][w].discard(told)

    def told_by(self, code: str, said: str) -> set[int]:
        """The free items of a code whose first long word that no other text has stands in said; two of them at most are looked for."""
        found: set[int] = set()
        tellers = self.tellers[code]
        # A word of its own has one teller, and only words that stand in said count: whichever are fewer are gone through.
        parts = len(said) * (len(said) - 3) // 2
        near = {said[i:j] for i in range(len(said)) for j in range(i + 4, len(said) + 1)} & tellers.keys() if parts < len(tellers) else [w for w in tellers if w in said]
        for w in near:
            if len(w) > 3 and len(tellers[w]) == 1:
                (told,) = tellers[w]
                words, those = self.told[code][told]
                if w == next(x for x in words if len(x) > 3 and len(tellers[x]) == 1):
                    found |= those
                    if len(found) > 1:
                        break
        return found

    def settle(self, whole: str | None, stem: str | None, code: str | None, said: str) -> tuple[int | None, str]:
        """What a table gets, by the first way that finds it, and how."""
        exact = self.last.get(whole) if whole is not None else None
        if exact is not None and exact not in self.used:
            return exact, "exact"
        stems, coded = self.by_stem.get(stem, ()), self.by_code.get(code, ())
        if len(stems) == 1:
            return next(iter(stems)), "stem"
        if len(coded) == 1:
            return next(iter(coded)), "code"
        if len(coded) > 1:
            told = self.told_by(code, said)
            return (next(iter(told)), "code+keyword") if len(told) == 1 else (None, "ambiguous")
        return None, "none"


def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each table gets: scope, ord, item (null without one) and confidence.

    The rows come part by part, its items first, then its tables in order. A table gets the row with its whole id, the last of
    equal ones; else the only free one of its stem; else the only free one of its code; else, of several, the only one with a
    word of its own that the table's texts say. Only the items of one part are held at a time.
    """
    names = ["part", "is_table", "ord", "whole", "stem", "code", "text", "words"]
    now, free = None, Free()
    for batch in batches:
        out: list[tuple] = []
        for part, is_table, ord_, whole, stem, code, text, words in zip(*(batch.column(n).to_pylist() for n in names)):
            if part != now:
                now, free = part, Free()
            if not is_table:
                free.add(ord_, whole, stem, code, text, words)
                continue
            item, confidence = free.settle(whole, stem, code, text)
            if item is not None:
                free.take(item)
            out.append((ord_, item, confidence))
        columns = list(zip(*out)) or [(), (), ()]
        scopes = batch.filter(batch.column("is_table")).column("scope")
        yield pa.RecordBatch.from_arrays([scopes, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))], ["scope", "ord", "item", "confidence"])


def matched(tables: DataFrame, inventory: DataFrame) -> DataFrame:
    """scope, ord, item, workbook and confidence of every table.

    tables: scope, ord (a long, the order in which tables come), id, table_id, title, sheet and source_file; inventory: scope, ord,
    workbook, unique_dataset_id, table_id and short_description. Scopes are matched apart. Tables and rows that share a key,
    or are linked through such, are settled together and in order, so a row goes to one table only. Tables left over join a
    workbook ("grouped", without a row) if only one has tables of their source file, else if only one has tables of their base
    title. Blank ids, stems and codes match nothing; without a workbook the confidence is ambiguous or none.
    """
    left, right = keyed(tables, inventory)
    marks = [F.concat(F.lit(f"{k[0]}:"), F.col(k)) for k in ("whole", "stem", "code")]
    ends = left.select("scope", F.lit("t").alias("side"), "ord", F.explode(F.array(*marks)).alias("mark")).unionByName(right.select("scope", F.lit("i").alias("side"), "ord", F.explode(F.array(*marks)).alias("mark")))
    ends = ends.where("mark is not null").select("scope", "mark", F.struct("scope", "side", "ord").alias("id"))
    # A key links only if a table and a row have it: tables alone with one take nothing from each other.
    firsts = ends.groupBy("scope", "mark").agg(F.min("id").alias("first"), F.max("id.side").alias("last")).where("first.side = 'i' and last = 't'")
    edges = ends.join(firsts, ["scope", "mark"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    edges = checkpointed(edges)
    nodes = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    part = components(nodes, edges).select(F.col("id.scope").alias("scope"), F.col("id.side").alias("side"), F.col("id.ord").alias("ord"), F.col("component.ord").alias("part"))

    def of_part(rows: DataFrame, side: str, text: str, words: Column) -> DataFrame:
        mine = part.where(F.col("side") == side).drop("side")
        return rows.join(mine, ["scope", "ord"], "inner" if side == "i" else "left").select(
            F.to_json(F.struct("scope", F.coalesce(F.concat(F.lit("i"), "part"), F.concat(F.lit("t"), F.col("ord"))).alias("p"))).alias("part"),
            F.lit(side == "t").alias("is_table"), "scope", F.col("ord").cast("long").alias("ord"), "whole", "stem", "code", F.col(text).alias("text"), words.alias("words"),
        )

    # A table without a part has nothing to take and is a part of its own.
    together = of_part(right, "i", "told", F.col("words")).unionByName(of_part(left, "t", "said", F.lit(None).cast("array<string>")))
    ordered = dealt(together, "part").sortWithinPartitions("part", "is_table", "ord")
    found = ordered.mapInArrow(assigned, ordered.select("scope", "ord", F.lit(None).cast("long").alias("item"), F.lit(None).cast("string").alias("confidence")).schema)
    found = found.join(inventory.select("scope", F.col("ord").cast("long").alias("item"), "workbook"), ["scope", "item"], "left")
    whole = tables.select("scope", F.col("ord").cast("long").alias("ord"), F.coalesce("source_file", F.lit("")).alias("file"), F.coalesce(base_title(F.col("title")), F.lit("")).alias("base"))
    placed = found.join(whole, ["scope", "ord"])

    def only(by: str) -> DataFrame:
        known = placed.where("workbook is not null").groupBy("scope", by).agg(F.min("workbook").alias(f"by_{by}"), F.max("workbook").alias("_last"))
        return known.where(f"by_{by} = _last").drop("_last")

    joined = placed.join(only("file"), ["scope", "file"], "left").join(only("base"), ["scope", "base"], "left")
    home = F.coalesce("workbook", "by_file", "by_base")
    confidence = F.when(F.col("workbook").isNull() & home.isNotNull(), "grouped").otherwise(F.col("confidence"))
    return joined.select("scope", "ord", "item", home.alias("workbook"), confidence.alias("confidence"))


def unmatched_items(inventory: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of inventory that no table of found, as matched() gives it, has taken."""
    taken = found.where("item is not null").select("scope", F.col("item").alias("ord"))
    return inventory.join(taken, ["scope", "ord"], "left_anti")
