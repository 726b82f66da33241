"""Boxes on pages: pairs that overlap, found through tiles, and candidates for one table of which one stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions.stacks import let
from quillgrid.operators.matching import checkpointed, components

SIDES = ("x0", "y0", "x1", "y1")
# Shares of the union and of the smaller box from which two boxes show one table; methods, the surest first.
SAME_UNION, SAME_SMALLER = 0.55, 0.65
METHODS = ("lines_strict", "lines", "text")
#: Units of up to this many boxes are met box by box; tiles and components are for larger ones.
FEW = 64


def shares(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    """The intersection of two boxes as a share of their union and of the smaller one; 0 without any, null with a missing side."""
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    both = F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))
    area = [F.greatest(x["x1"] - x["x0"], F.lit(0)) * F.greatest(x["y1"] - x["y0"], F.lit(0)) for x in (a, b)]
    some = both > 0
    return F.when(some, both / (area[0] + area[1] - both)).otherwise(0.0), F.when(some, both / F.least(*area)).otherwise(0.0)


def crowded(boxes: DataFrame, unit: str) -> DataFrame:
    """The units of more than FEW boxes, computed now."""
    return checkpointed(boxes.groupBy(unit).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select(unit))


def overlapping(boxes: DataFrame, unit: str, key: str) -> DataFrame:
    """unit, a, b (a before b), iou and of_smaller for each pair of boxes of one unit that share an area.

    boxes: unit, key, x0, y0, x1 and y1. Units of few boxes are gathered and paired as they are, larger ones through
    tiles. Boxes without area share none.
    """
    many = crowded(boxes, unit)
    sized = boxes.join(many, unit, "left_anti").select(unit, F.col(key).alias("key"), *(F.col(c).cast("double").alias(c) for c in SIDES)).where("x1 > x0 and y1 > y0")
    gathered = sized.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.collect_list(F.struct("key", *SIDES)).alias("all"))
    met = gathered.select(unit, "all", F.explode("all").alias("p")).select(unit, "p", F.explode("all").alias("q")).where("p.key < q.key")
    p, q = ({c: F.col(f"{name}.{c}") for c in SIDES} for name in "pq")
    met = met.where((F.least(p["x1"], q["x1"]) > F.greatest(p["x0"], q["x0"])) & (F.least(p["y1"], q["y1"]) > F.greatest(p["y0"], q["y0"])))
    iou, of_smaller = shares(p, q)
    found = met.select(unit, F.col("p.key").alias("a"), F.col("q.key").alias("b"), iou.alias("iou"), of_smaller.alias("of_smaller")).where("iou > 0")
    return found if many.isEmpty() else found.unionByName(tiled(boxes.join(many, unit, "left_semi"), unit, key))


def tiled(boxes: DataFrame, unit: str, key: str) -> DataFrame:
    """overlapping(), through tiles for all units.

    Tiles have powers of two as sides; a box stands in the at most four tiles of the
    size next above its own, and, to meet larger boxes, in those of each larger size that any box has. The pair counts in the
    tile that holds the upper left corner of what it shares, so it comes up once. Boxes without area share none.
    """
    sized = boxes.select(unit, F.col(key).alias("key"), *(F.col(c).cast("double").alias(c) for c in SIDES)).where("x1 > x0 and y1 > y0")
    sized = sized.withColumn("size", F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).cast("int"))
    levels = sorted(r["size"] for r in sized.select("size").distinct().collect())  # at most some two thousand, whatever the data
    if not levels:
        levels = [0]

    def in_tiles(level: Column) -> Column:
        side = F.pow(F.lit(2.0), level)
        xs = F.sequence(F.floor(F.col("x0") / side), F.floor(F.col("x1") / side))
        ys = F.sequence(F.floor(F.col("y0") / side), F.floor(F.col("y1") / side))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(level.alias("level"), x.alias("tx"), y.alias("ty")))))

    large = sized.select(unit, F.inline(in_tiles(F.col("size"))), F.struct("key", *SIDES).alias("p"))
    above = F.filter(F.array(*map(F.lit, levels)), lambda level: level >= F.col("size"))
    small = sized.select(unit, F.explode(above).alias("_level"), "key", "size", *SIDES).select(unit, F.inline(in_tiles(F.col("_level"))), F.struct("key", *SIDES).alias("q"), "size")
    met = large.join(small, [unit, "level", "tx", "ty"])
    # Boxes of one size meet in both roles.
    met = met.where((F.col("size") < F.col("level")) | (F.col("p.key") < F.col("q.key")))
    side = F.pow(F.lit(2.0), F.col("level"))
    corner = (F.floor(F.greatest("p.x0", "q.x0") / side) == F.col("tx")) & (F.floor(F.greatest("p.y0", "q.y0") / side) == F.col("ty"))
    p, q = ({c: F.col(f"{name}.{c}") for c in SIDES} for name in "pq")
    iou, of_smaller = shares(p, q)
    return met.where(corner).select(unit, F.least("p.key", "q.key").alias("a"), F.greatest("p.key", "q.key").alias("b"), iou.alias("iou"), of_smaller.alias("of_smaller")).where("iou > 0")


def deduped(candidates: DataFrame, unit: str, key: str) -> DataFrame:
    """The candidates that stay, with place, their number in their unit from 0, from the top down.

    candidates: unit, key, method, x0, y0, x1, y1, n_rows and n_cols. They come in by method, upper edge and key. One that shows
    the table of a kept one goes, unless it is much richer than the richest such one: then it takes the place of all of
    them. Text never replaces ruled tables. Only candidates linked by overlaps decide about each other, so in
    units of more than FEW each such set is folded by itself. Without a box a candidate stays; an unknown method comes last.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, METHODS)), F.col("method")), F.lit(0)).cast("int") - 1, F.lit(9))
    empty = (F.coalesce("n_rows", F.lit(0)) <= 0) | (F.coalesce("n_cols", F.lit(0)) <= 0)
    score = F.when(empty, F.struct(F.lit(0).cast("long").alias("wide"), F.lit(0).cast("long").alias("cells"), F.lit(0).alias("bonus"))).otherwise(
        F.struct(F.col("n_cols").cast("long").alias("wide"), (F.col("n_rows").cast("long") * F.col("n_cols")).alias("cells"), F.greatest(3 - rank, F.lit(0)).alias("bonus"))
    )
    held = candidates.select(unit, F.col(key).alias("key"), rank.alias("rank"), F.coalesce("y0", F.lit(0)).cast("double").alias("top"), (F.coalesce("method", F.lit("")) == "text").alias("loose"), F.coalesce(F.startswith("method", F.lit("lines")), F.lit(False)).alias("ruled"), score.alias("score"), *(F.col(c).cast("double").alias(c) for c in SIDES))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "top", "key", "loose", "ruled", "score", *SIDES)))
    many = crowded(candidates, unit)
    kept = held.join(many, unit, "left_anti").groupBy(unit).agg(ordered.alias("all")).select(unit, F.explode(survivors(F.col("all"))).alias("k"))
    if not many.isEmpty():
        parts = linked_parts(held.join(many, unit, "left_semi"), candidates.join(many, unit, "left_semi"), unit, key)
        kept = kept.unionByName(parts.groupBy(unit, "part").agg(ordered.alias("all")).select(unit, F.explode(survivors(F.col("all"))).alias("k")))
    place = F.row_number().over(W.partitionBy(unit).orderBy("k.top", "k.rank", "k.key")) - 1
    staying = kept.select(unit, F.col("k.key").alias(key), place.alias("place"))
    return candidates.join(staying, [unit, key])


def linked_parts(held: DataFrame, candidates: DataFrame, unit: str, key: str) -> DataFrame:
    """held with part: the set of candidates of its unit that each is linked to by overlaps."""
    pairs = tiled(candidates, unit, key).where(f"iou >= {SAME_UNION} or of_smaller >= {SAME_SMALLER}")
    edges = pairs.select(F.struct(F.col(unit).alias("u"), F.col("a").alias("k")).alias("a"), F.struct(F.col(unit).alias("u"), F.col("b").alias("k")).alias("b"))
    linked = components(held.select(F.struct(F.col(unit).alias("u"), F.col("key").alias("k")).alias("id")), edges)
    linked = linked.select(F.col("id.u").alias(unit), F.col("id.k").alias("key"), F.col("component.k").alias("part"))
    return held.join(linked, [unit, "key"])


def survivors(ordered: Column) -> Column:
    """What is left of an ordered array of candidates as each meets those kept so far."""

    def same(a: Column, b: Column) -> Column:
        iou, smaller = shares({c: a[c] for c in SIDES}, {c: b[c] for c in SIDES})
        return F.coalesce((iou >= SAME_UNION) | (smaller >= SAME_SMALLER), F.lit(False))

    def richer(a: Column, b: Column) -> Column:
        wide, cells, had_wide, had = a["wide"], a["cells"], b["wide"], b["cells"]
        return ((wide >= had_wide + 3) & (cells > had)) | ((wide > had_wide) & (cells >= F.greatest(2 * had, had + 20))) | ((wide == had_wide) & (cells >= 2 * had + 10))

    def step(kept: Column, c: Column) -> Column:
        def of(x: Column) -> Column:
            rivals = F.filter(x["met"], lambda k: k["same"])
            best = F.array_max(F.transform(rivals, lambda k: k["k"]["score"]))
            covered = c["loose"] & F.exists(rivals, lambda k: k["k"]["ruled"])
            rest = F.transform(F.filter(x["met"], lambda k: ~k["same"]), lambda k: k["k"])
            takes = (F.size(rivals) == 0) | (~covered & richer(c["score"], best))
            return F.when(takes, F.concat(rest, F.array(c))).otherwise(kept)

        return let({"met": F.transform(kept, lambda k: F.named_struct(F.lit("k"), k, F.lit("same"), same(c, k)))}, of)

    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)
