"""Occupation labels matched to the nodes of an occupation hierarchy, by an alias or by likeness of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions import labels as L
from quillgrid.functions.similarity import Side, Titles
from quillgrid.functions.text import is_hierarchy_code, occupation_key

LEVELS = ("division", "subdivision", "group", "family")
#: Nodes that are sent to every task at once (some 300 bytes each); longer hierarchies go in further blocks.
BLOCK_NODES = 20_000
# Length of a shortlist, ranks among which a parent is looked for, its share of the best score, alternatives.
SHORTLIST, PARENT_RANKS, PARENT_SHARE, ALTERNATIVES = 16, (2, 8), 0.97, 4


def hierarchy(codes: DataFrame) -> DataFrame:
    """One node for each level and code: level_no, level, code, title, search_text, and code and title of the levels above.

    codes: division_code, division_title and so on down to family, one row for each occupation. search_text joins the titles
    from the division to the node. Of rows that spell a node differently the first in the order of all columns counts.
    """
    kinds = []
    for k, level in enumerate(LEVELS):
        above = [F.col(f"{LEVELS[j]}_{what}").cast("string") if j <= k else F.lit(None).cast("string") for j in range(len(LEVELS)) for what in ("code", "title")]
        names = [f"{up}_{what}" for up in LEVELS for what in ("code", "title")]
        titles = [F.nullif(F.col(f"{up}_title"), F.lit("")) for up in LEVELS[: k + 1]]
        kinds.append(F.struct(F.lit(k).alias("level_no"), F.lit(level).alias("level"), F.col(f"{level}_code").cast("string").alias("code"), F.coalesce(F.col(f"{level}_title"), F.lit("")).alias("title"), F.concat_ws(" ", *titles).alias("search_text"), *(c.alias(n) for c, n in zip(above, names))))
    nodes = codes.select(F.inline(F.array(*kinds))).where(F.coalesce("code", F.lit("")) != "")
    rest = [c for c in nodes.columns if c not in ("level_no", "level", "code")]
    return nodes.groupBy("level_no", "level", "code").agg(F.min(F.struct(*rest)).alias("x")).select("level_no", "level", "code", "x.*")


def shortlists(labels: DataFrame, nodes: DataFrame, most: int = SHORTLIST) -> DataFrame:
    """label, rank, score, level_no and code of the best nodes of each label, and how many pairs were met and measured.

    labels: label, once each. Equal scores rank by level from the top, then by code. Nodes go to the tasks in blocks of
    bounded size, and labels stay where they are; met and measured count pairs of phrase and node over a block.
    """
    ordered = nodes.select("level_no", "code", occupation_key(F.col("title")).alias("title"), occupation_key(F.col("search_text")).alias("around"), L.content_tokens(F.col("title")).alias("own_tokens"), L.content_tokens(F.col("search_text")).alias("around_tokens"))
    n = ordered.count()
    blocks = max(1, -(-n // BLOCK_NODES))
    spoken = F.array_distinct(F.concat(L.phrases(F.col("label")), F.array("label")))
    asked = labels.select("label", F.transform(spoken, lambda p: F.struct(occupation_key(p).alias("text"), L.content_tokens(p).alias("tokens"))).alias("phrases"))
    found = None
    for b in range(blocks):
        own = ordered.where(F.pmod(F.xxhash64("level_no", "code"), F.lit(blocks)) == b).orderBy("level_no", "code").collect()
        part = asked.mapInArrow(ranked_by(own, most), "label string, score double, level_no int, code string, met long, measured long")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "level_no", "code"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def ranked_by(nodes: list, most: int):
    """A function over batches of labels that ranks these nodes for each."""
    places = [(r["level_no"], r["code"]) for r in nodes]
    texts = [(r["title"], r["own_tokens"], r["around"], r["around_tokens"]) for r in nodes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        titles = Titles(Side([t[0] for t in texts], [t[1] for t in texts]), Side([t[2] for t in texts], [t[3] for t in texts]))
        for batch in batches:
            rows = []
            for label, phrases in zip(batch.column("label").to_pylist(), batch.column("phrases").to_pylist()):
                titles.met = titles.measured = 0
                best = titles.best([(p["text"], p["tokens"]) for p in phrases], most)
                rows += [(label, score, *places[i], titles.met, titles.measured) for score, i in best]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["label", "score", "level_no", "code", "met", "measured"])

    return run


def matched(labels: DataFrame, codes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """label, level, code, title, score, confidence, auto_fill, source and alternatives of each label that is an occupation.

    labels: label, repeated or not; null and blank ones, sums and residual labels have no row, nor have labels that no node
    is like. aliases (label, level, code, title; labels by their words) decide first where their code is one of the
    hierarchy's form. A family or group gives way to its parent (subdivision, or division of a group) that is among the
    next seven with 97 % of its score. A group is told by its subdivision. alternatives are up to four other nodes as
    level:code:score.
    """
    asked = labels.select(F.trim("label").alias("label")).where((F.col("label") != "") & ~L.is_aggregate_label(F.col("label"))).distinct()
    nodes = hierarchy(codes)
    known = None
    if aliases is not None:
        usable = aliases.where(is_hierarchy_code(F.col("code"))).groupBy(occupation_key(F.col("label")).alias("key")).agg(F.min(F.struct("level", F.trim("code").alias("code"), "title")).alias("a"))
        known = asked.join(usable, occupation_key(F.col("label")) == F.col("key"))
        asked = asked.join(known.select("label"), "label", "left_anti")
        level = F.when(F.col("a.level") == "group", "subdivision").otherwise(F.coalesce("a.level", F.lit("division")))
        known = known.select("label", level.alias("level"), F.col("a.code").alias("code"), F.col("a.title").alias("title"), F.lit(1.0).alias("score"), F.lit("alias").alias("source"), F.lit("").alias("alternatives"))
    best = shortlists(asked, nodes).join(F.broadcast(nodes) if nodes.count() <= BLOCK_NODES else nodes, ["level_no", "code"])
    of_label = W.partitionBy("label")
    first = F.max(F.when(F.col("rank") == 1, F.struct("level_no", "score", "division_code", "subdivision_code"))).over(of_label)
    up = F.when(F.col("first.level_no") == 3, 1).when(F.col("first.level_no") == 2, 0)
    wanted = F.when(up == 1, F.col("first.subdivision_code")).when(up == 0, F.col("first.division_code"))
    parent = F.col("rank").between(*PARENT_RANKS) & (F.col("level_no") == up) & (F.col("code") == wanted) & (F.col("score") >= PARENT_SHARE * F.col("first.score"))
    best = best.withColumn("first", first).withColumn("parent", parent)
    chosen = F.coalesce(F.min(F.when(F.col("parent"), F.col("rank"))).over(of_label), F.lit(1))
    best = best.withColumn("chosen", F.col("rank") == chosen)
    told = F.when(F.col("level_no") == 3, "family").when(F.col("level_no") == 0, "division").otherwise("subdivision")
    deep = F.col("level_no") == 3
    code = F.when(deep, F.col("family_code")).when(F.col("level_no") == 0, F.col("division_code")).otherwise(F.coalesce(F.nullif("subdivision_code", F.lit("")), "group_code"))
    title = F.when(deep, F.col("family_title")).when(F.col("level_no") == 0, F.col("division_title")).otherwise(F.coalesce(F.nullif("subdivision_title", F.lit("")), "group_title"))
    best = best.withColumns({"told": told, "told_code": code, "told_title": title})
    picked = F.max(F.when(F.col("chosen"), F.struct("told", "told_code", "told_title", "score"))).over(of_label)
    best = best.withColumn("picked", picked)
    short_level = F.when(F.col("level") == "group", "subdivision").otherwise(F.col("level"))
    other = F.when(F.col("code") != F.col("picked.told_code"), F.struct("rank", F.concat_ws(":", short_level, "code", F.format_number("score", 3)).alias("text")))
    rows = best.groupBy("label", "picked").agg(F.slice(F.array_sort(F.collect_list(other)), 1, ALTERNATIVES).alias("others"))
    found = rows.select("label", F.col("picked.told").alias("level"), F.col("picked.told_code").alias("code"), F.col("picked.told_title").alias("title"), F.col("picked.score").alias("score"), F.lit("likeness").alias("source"), F.array_join(F.transform("others", lambda x: x["text"]), ",").alias("alternatives"))
    if known is not None:
        found = found.unionByName(known)
    confidence = L.match_confidence(F.col("score"), by_vectors=False)
    return found.select("label", "level", "code", "title", F.round("score", 3).alias("score"), confidence.alias("confidence"), (confidence == "high").alias("auto_fill"), "source", "alternatives")
