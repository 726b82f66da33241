"""Tables against an inventory and against each other: tiers, titles, vectors, clusters."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions.text import base_title, slug, title_tokens


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed now, in the folder that spark.checkpoint.dir names, or a temporary one where it is unset."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillgrid-"))
    return df.checkpoint()


def base_title_groups(items: DataFrame, key: str, title: str) -> DataFrame:
    """group_name, n_members and the first key of each group of items with one base title."""
    return items.groupBy(base_title(F.col(title)).alias("group_name")).agg(F.count(F.lit(1)).alias("n_members"), F.min(key).alias("first_member"))


def tiered_match(tables: DataFrame, inventory: DataFrame) -> DataFrame:
    """table_id, item_id and confidence by two of the tiers of inventory.matched(): exact where ids agree, else stem where a stem has one free item.

    tables: table_id; inventory: item_id, each once. A stem is an id without its last letter or bracketed number.
    An item is used once: of tables that read like it the first takes it, and it is no longer free.
    """
    def stem(c: str) -> Column:
        return slug(F.regexp_replace(F.upper(F.trim(F.col(c))), r"(?:\([0-9]+\)|[A-Z])$", ""))

    takers = tables.groupBy(slug(F.col("table_id")).alias("s")).agg(F.min("table_id").alias("table_id"))
    offers = inventory.groupBy(slug(F.col("item_id")).alias("s")).agg(F.max("item_id").alias("item_id"))
    exact = takers.join(offers, "s").select("table_id", "item_id", F.lit("exact").alias("confidence"))
    left = tables.join(exact, "table_id", "left_anti").select("table_id", stem("table_id").alias("s"))
    free = inventory.join(exact, "item_id", "left_anti").select("item_id", stem("item_id").alias("s"))
    one = free.groupBy("s").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy("s").orderBy("table_id"))
    stems = left.join(one, "s", "left").withColumn("turn", first)
    found = (F.col("n") == 1) & (F.col("turn") == 1)
    kind = F.when(found, "stem").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return exact.unionByName(stems.select("table_id", F.when(found, F.col("item_id")).alias("item_id"), kind.alias("confidence")))


def leftover(inventory: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    return inventory.join(matched.where(F.col(key).isNotNull()), key, "left_anti")


def compatible_titles(items: DataFrame, key: str, title: str) -> DataFrame:
    """Pairs of items (first, second) whose titles share two tokens, or most of the shorter one.

    Distinct titles are paired, through their tokens, never item by item; first and second are titles.
    """
    titles = items.select(F.col(title).alias("t")).distinct()
    tokens = titles.select("t", F.explode(title_tokens(base_title(F.col("t")))).alias("token"))
    sizes = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    met = tokens.select(F.col("t").alias("first"), "token").join(tokens.select(F.col("t").alias("second"), "token"), "token").where("first < second")
    pairs = met.groupBy("first", "second").agg(F.count(F.lit(1)).alias("shared"))
    pairs = pairs.join(sizes.select(F.col("t").alias("first"), F.col("n").alias("na")), "first").join(sizes.select(F.col("t").alias("second"), F.col("n").alias("nb")), "second")
    return pairs.where((F.col("shared") >= 2) | (F.col("shared") >= 0.7 * F.least("na", "nb"))).select("first", "second", "shared")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector is missing, of another length, or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), 1 - dot(a, b) / norms).otherwise(1.0)


def unit(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096, most: float | None = None) -> DataFrame:
    """query_id, vec_id, distance (to six places) and rank of the k nearest vectors of each query, within a distance where most gives one; ties by vec_id.

    queries and vectors: vec_id and embedding. Both are packed into blocks of about so many rows (fewer of long vectors), each written
    once. A task takes a few blocks of queries and reads its share of the vectors' blocks one after the other, keeping the k best so far;
    no vector is copied for the blocks that it meets, and only the k best of each share are shuffled to be ranked. A vector isn't near
    itself; null vectors have no row, and vectors of another length or of length zero are at distance one.
    """
    asked, parts = packed(queries, block)
    there, parts = (asked, parts) if vectors is queries else packed(vectors, block)
    shares = max(1, -(-parts // SHARE))
    left, right = asked.toDF("block", "query_id", "q"), there.select("vec_id", "v").coalesce(shares)
    met = left.crossJoin(right.hint("shuffle_replicate_nl"))
    schema = queries.select(F.col("vec_id").alias("query_id")).schema.add(vectors.schema["vec_id"]).add("distance", "double")
    found = met.mapInArrow(best_of_blocks(k, most), schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def packed(vectors: DataFrame, block: int) -> tuple[DataFrame, int]:
    """block (a number), vec_id and v: blocks of vectors of length one and their ids, in the order of ids, computed now, and in how many partitions; null vectors are in none."""
    rows = vectors.where("embedding is not null").select("vec_id", F.col("embedding").alias("v"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("longest")).first()
    most = max(1, min(block, BLOCK_VALUES // max(1, sizes["longest"] or 0)))
    parts = max(1, -(-sizes["n"] // most), min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes["n"] // STRIP)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            pieces = -(-batch.num_rows // (most + most // 8))
            for i in range(pieces):
                low, high = (j * batch.num_rows // pieces for j in (i, i + 1))
                piece = batch.slice(low, high - low)
                # In the order of ties, so that places tell which of equal ones comes first.
                piece = piece.take(pc.sort_indices(piece, sort_keys=[("vec_id", "ascending")], null_placement="at_start"))
                lists = (pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(c)) for c in ("vec_id", "v"))
                yield pa.RecordBatch.from_arrays([pa.array([number]), *lists], ["block", "vec_id", "v"])
                number += 1

    rows = rows.repartition(parts).select("vec_id", unit(F.col("v")).alias("v"))
    return checkpointed(rows.mapInArrow(run, rows.select(F.lit(0).cast("long").alias("block"), F.array("vec_id").alias("vec_id"), F.array("v").alias("v")).schema)), parts


def nearest_visible(queries: DataFrame, vectors: DataFrame, k: int, equal: dict[str, str | None], owner: str, own: str | None) -> DataFrame:
    """nearest() among the vectors whose columns equal the given values (None for any) and that have no owner or the given one (None for any)."""
    for column, value in equal.items():
        if value is not None:
            vectors = vectors.where(F.col(column) == value)
    if own is not None:
        vectors = vectors.where(F.col(owner).isNull() | (F.col(owner) == own))
    return nearest(queries, vectors, k)


#: Rows of a block of queries that are compared at a time, which bounds the matrices of a task.
STRIP = 256
#: Components in a block of vectors (2 MB), and blocks of vectors that a task reads.
BLOCK_VALUES, SHARE = 1 << 18, 64
#: Distances to six places may be equal where they differ by less.
ROUNDED = 2e-6


def matrices(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length above 0 of some lists: their places, and a matrix of their values (missing ones are no numbers)."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    found = {}
    for n in map(int, np.unique(lengths)):
        at = np.flatnonzero(lengths == n)
        if n:
            found[n] = at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
    return found


class Best:
    """The k nearest vectors so far of each query of a block: its place, their ids and distances."""

    def __init__(self, ids: pa.Array, lists: pa.Array, k: int, most: float | None):
        self.ids, self.sides, self.k, self.most = ids, matrices(lists), k, most
        self.limit = np.full(len(ids), np.inf if most is None else most + ROUNDED)
        self.kept: pa.Table | None = None
        self.new: list[pa.Table] = []

    def meet(self, ids: pa.Array, lists: pa.Array) -> None:
        """Compares all queries with one block of vectors."""
        others, own = matrices(lists), self.own_places(ids)
        alike = next((n for n in self.sides if len(self.sides[n][0]) == len(self.ids) and n in others and len(others[n][0]) == len(ids)), None)
        rough = None if alike is None else others[alike][1].astype(np.float32)
        for at in range(0, len(self.ids), STRIP):
            rows = slice(at, min(at + STRIP, len(self.ids)))
            out = [(i - at, own[i]) for i in range(rows.start, rows.stop) if i in own]
            if alike is None:
                near = closest(self.distances(rows, others, len(ids), out), self.k, self.most, self.limit[rows])
            else:
                near = self.near_by_rough_ones(rows, alike, others[alike][1], rough, out)
            if len(near[0]):
                self.new.append(pa.table([pa.array(near[0] + at), ids.take(pa.array(near[1])), pa.array(near[2])], ["row", "vec_id", "distance"]))
        if sum(map(len, self.new)) > len(self.ids):
            self.settle()

    def distances(self, rows: slice, others: dict[int, tuple[np.ndarray, np.ndarray]], width: int, out: list[tuple[int, list[int]]]) -> np.ndarray:
        """The distances of some queries from vectors of any lengths; infinite from those left out."""
        far = np.ones((rows.stop - rows.start, width))
        for n, (places, q) in self.sides.items():
            if n in others:
                low, high = np.searchsorted(places, (rows.start, rows.stop))
                met, v = others[n]
                far[np.ix_(places[low:high] - rows.start, met)] = 1 - q[low:high] @ v.T
        for i, places in out:
            far[i, places] = np.inf
        return far

    def near_by_rough_ones(self, rows: slice, n: int, v: np.ndarray, rough: np.ndarray, out: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As closest() of the distances from vectors of the queries' own length n: cosines in single precision tell which may be near, and only those are computed in double."""
        q, slack = self.sides[n][1][rows], np.float32(ROUNDED + n * 2.0**-22)
        cosines = q.astype(np.float32) @ rough.T
        for i, places in out:
            cosines[i, places] = -np.inf
        least = (1 - self.limit[rows]).astype(np.float32) - slack
        near = cosines >= least[:, None]
        r, c = np.nonzero(near)
        crowded = np.flatnonzero(np.bincount(r, minlength=len(q)) > 4 * self.k)
        if len(crowded):
            near[crowded] &= cosines[crowded] >= -np.partition(-cosines[crowded], self.k - 1, axis=1)[:, self.k - 1, None] - 2 * slack
            r, c = np.nonzero(near)
        return least_of_rows(r, c, 1 - np.einsum("ij,ij->i", q[r], v[c]), len(q), self.k, self.most, out)

    def own_places(self, ids: pa.Array) -> dict[int, list[int]]:
        """For each query whose id is among ids, where."""
        if not pc.any(pc.is_in(ids, value_set=self.ids)).as_py():
            return {}
        there: dict = {}
        for j, key in enumerate(ids.to_pylist()):
            there.setdefault(key, []).append(j)
        return {i: there[key] for i, key in enumerate(self.ids.to_pylist()) if key in there}

    def settle(self) -> None:
        """The k best of those kept and the new ones are kept; what is farther than the last of k need not be looked at again."""
        found = pa.concat_tables([*([self.kept] if self.kept is not None else []), *self.new])
        found = found.take(pc.sort_indices(found, sort_keys=[("row", "ascending"), ("distance", "ascending"), ("vec_id", "ascending")], null_placement="at_start"))
        rows = found.column("row").to_numpy()
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == self.k - 1
        self.limit[rows[last]] = np.minimum(self.limit[rows[last]], found.column("distance").to_numpy()[last] + ROUNDED)
        self.kept, self.new = found.filter(pa.array(place < self.k)).combine_chunks(), []

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.new:
            self.settle()
        if self.kept is not None:
            yield from self.kept.set_column(0, "query_id", pc.take(self.ids, self.kept.column("row"))).to_batches()


def best_of_blocks(k: int, most: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over pairs of a block of queries (block, query_id, q) and one of vectors (vec_id, v), block by block of queries, that gives the k nearest of all these vectors for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None
        for batch in batches:
            for i, number in enumerate(batch.column("block").to_pylist()):
                if best is None or number != block:
                    if best is not None:
                        yield from best.result()
                    block, best = number, Best(batch.column("query_id")[i].values, batch.column("q")[i].values, k, most)
                best.meet(batch.column("vec_id")[i].values, batch.column("v")[i].values)
        if best is not None:
            yield from best.result()

    return run


def closest(far: np.ndarray, k: int, most: float | None = None, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value (to six places) of the k least finite entries of each row of a matrix, up to most and to the row's limit; of equal ones the first columns."""
    limit = np.full(len(far), np.inf if most is None else most + ROUNDED) if limit is None else limit.copy()
    near = far <= limit[:, None]
    crowded = np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * k)
    if len(crowded):
        limit[crowded] = np.minimum(limit[crowded], np.partition(far[crowded], k - 1, axis=1)[:, k - 1] + ROUNDED)
        near[crowded] = far[crowded] <= limit[crowded, None]
    rows, columns = np.nonzero(near)
    return least_of_rows(rows, columns, far[rows, columns], len(far), k, most, [])


def least_of_rows(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int, k: int, most: float | None, out: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries in the order of rows, the k least finite ones (to six places) of each row up to most, of equal ones the first columns; those left out by row are none."""
    values = np.round(values, 6)
    for i, places in out:
        low, high = np.searchsorted(rows, (i, i + 1))
        values[low:high][np.isin(columns[low:high], places)] = np.inf
    fit = np.isfinite(values) & (True if most is None else values <= most)
    rows, columns, values = rows[fit], columns[fit], values[fit]
    ranked = np.lexsort((columns, values, rows))
    rows, columns, values = rows[ranked], columns[ranked], values[ranked]
    kept = np.arange(len(rows)) - np.searchsorted(rows, np.arange(height))[rows] < k
    return rows[kept], columns[kept], values[kept]


def knn_edges(vectors: DataFrame, k: int = 8, most: float = 0.42) -> DataFrame:
    """a < b: vectors of which one is among the other's k nearest, within a distance."""
    near = nearest(vectors, vectors, k, most=most)
    return near.select(F.least("query_id", "vec_id").alias("a"), F.greatest("query_id", "vec_id").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """id and component (the least id reachable) of every node: labels spread and double back until they rest.

    nodes: id; edges: a, b. Edges whose ends agree drop out as labels meet, and lineage is cut each round.
    """
    labels = checkpointed(nodes.select("id", F.col("id").alias("component")))
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    for _ in range(most_rounds):
        offered = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("offer"))
        moved = labels.join(offered, labels["id"] == offered["a"], "left").select("id", F.least("component", F.coalesce("offer", "component")).alias("c"), F.col("component").alias("old"))
        jump = moved.select(F.col("id").alias("up"), F.col("c").alias("above"))
        now = checkpointed(moved.join(jump, moved["c"] == jump["up"], "left").select("id", F.least("c", F.coalesce("above", "c")).alias("component"), "old"))
        changed = not now.where("component <> old").isEmpty()
        labels = now.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError("the components did not settle")


def hash_embedding(items: DataFrame, key: str, text: str, width: int = 1536) -> DataFrame:
    """key, bucket and weight of each non-zero place of a text's hashed bag of words, of length one.

    Each token adds one at eight places: the eight 32-bit parts of its SHA-256, modulo the width.
    """
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9]+)"), 1)
    tokens = F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit("empty")))
    each = items.select(F.col(key).alias("key"), F.explode(tokens).alias("token")).groupBy("key", "token").agg(F.count(F.lit(1)).alias("n"))
    digest = F.sha2("token", 256)
    places = F.array(*(F.pmod(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long"), F.lit(width)) for i in range(8)))
    summed = each.select("key", F.explode(places).alias("bucket"), "n").groupBy("key", "bucket").agg(F.sum("n").alias("n"))
    norm = summed.groupBy("key").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return summed.join(norm, "key").select("key", "bucket", F.round(F.col("n") / F.col("norm"), 6).alias("weight"))


def token_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_key, right_key and the cosine of how often their tokens occur, for pairs that share one.

    left and right: key and tokens (an array in which tokens may repeat).
    """

    def spread(side: DataFrame, name: str) -> DataFrame:
        counted = side.select(F.col("key").alias(name), F.explode("tokens").alias("token")).groupBy(name, "token").agg(F.count(F.lit(1)).alias(f"{name}_tf"))
        return counted.withColumn(f"{name}_norm", F.sum(F.pow(f"{name}_tf", F.lit(2))).over(W.partitionBy(name)))

    shared = spread(left, "left_key").join(spread(right, "right_key"), "token").groupBy("left_key", "right_key", "left_key_norm", "right_key_norm").agg(F.sum(F.col("left_key_tf") * F.col("right_key_tf")).alias("dot"))
    return shared.select("left_key", "right_key", F.round(F.col("dot") / F.sqrt(F.col("left_key_norm") * F.col("right_key_norm")), 6).alias("cosine"))


def shortlist(scored: DataFrame, owner: str, level: str, score: str, key: str, quotas: dict[str, int], best: int) -> DataFrame:
    """For each owner, the best of each level up to its quota and the best overall, distinct, best first."""
    in_level = F.row_number().over(W.partitionBy(owner, level).orderBy(F.desc(score), key))
    overall = F.row_number().over(W.partitionBy(owner).orderBy(F.desc(score), key))
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(level) == name, n).otherwise(quota)
    ranked = scored.withColumns({"_in_level": in_level, "_overall": overall}).where((F.col("_in_level") <= quota) | (F.col("_overall") <= 2 * best))
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy(owner).orderBy(F.desc(score), key))).where(F.col("rank") <= best).drop("_in_level", "_overall")


def alternatives(scored: DataFrame, owner: str, score: str, key: str, chosen: DataFrame, most: int = 4) -> DataFrame:
    """For each owner, the best candidates but the chosen ones (owner, key), with rank; ties by key."""
    rank = F.row_number().over(W.partitionBy(owner).orderBy(F.desc(score), key))
    return scored.join(chosen.select(owner, key).distinct(), [owner, key], "left_anti").withColumn("rank", rank).where(F.col("rank") <= most)


def hierarchy_nodes(leaves: DataFrame, levels: list[tuple[str, str, str]]) -> DataFrame:
    """level, code, title and parent of each node of a hierarchy given by its leaves; (level, code column, title column) from the top."""
    nodes = []
    for i, (name, code, title) in enumerate(levels):
        parent = F.col(levels[i - 1][1]).cast("string") if i else F.lit(None).cast("string")
        nodes.append(F.struct(F.lit(name).alias("level"), F.col(code).cast("string").alias("code"), F.col(title).alias("title"), parent.alias("parent")))
    return leaves.select(F.inline(F.array(*nodes))).where("code is not null").groupBy("level", "code").agg(F.min("title").alias("title"), F.min("parent").alias("parent"))
