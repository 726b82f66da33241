"""Vector code compression: product-quantiser codes whose codebooks are refined by filtering Lloyd rounds.

Components become whole numbers, so that every sum and distance is exact and no result depends on how
rows are dealt. Each task cuts its vectors into parts and builds a kd-tree for each part position over a
block of rows, each node with its bounding box, count and component sums. Codebook entries go down the
tree from the root: at a node the entry nearest to the middle of the box stands against every other one,
and an entry that is farther from even the most favourable corner of the box can't win anywhere inside
and goes. Where one entry is left, the whole subtree is its: in a Lloyd round its cached count and
sums are added, in the last pass its rows get their code. Only leaves with several entries left compare
single parts. What leaves a task in a round is a row of sums for each part and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import cut

#: Rows over which one set of trees is built; bounds the memory of a task.
BLOCK_ROWS = 16_384
LEAF_ROWS = 16
#: A component of at most so much keeps every distance, summed over a vector, within 64 bits.
LARGEST = 1 << 26
#: Labels, of some 20 bytes each, that are sent to all executors; beyond it the join on them is a shuffle.
BROADCAST_LABELS = 1_000_000


@dataclass
class Level:
    """The nodes of one depth of a tree: node i holds rows order[start[i]:end[i]]."""

    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return self.end - self.start


def kd_tree(points: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """The order of rows and the levels of a balanced tree; each level halves every node on its widest side.

    The children of node i of a level are nodes 2i and 2i + 1 of the next.
    """
    n, wide = points.shape
    order = np.arange(n)
    edges = np.array([0, n])
    levels = []
    while True:
        start, end = edges[:-1], edges[1:]
        held = points[order]
        low, high = np.minimum.reduceat(held, start), np.maximum.reduceat(held, start)
        levels.append(Level(start, end, low, high, np.add.reduceat(held, start)))
        if (end - start).max() <= LEAF_ROWS:
            return order, levels
        side = np.argmax(high - low, axis=1)
        node = np.repeat(np.arange(len(start)), end - start)
        order = order[np.lexsort((held[np.arange(n), side[node]], node))]
        edges = np.sort(np.concatenate([edges, (start + end) // 2]))


def nearest_entry(points: np.ndarray, entries: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """For each point the index of the nearest entry among those open to it; the lower one of equals."""
    # The square of the point itself is the same for all entries, so it is left out.
    far = (entries * entries).sum(axis=1) - points @ (2 * entries.T)
    return np.where(open_, far, np.iinfo(np.int64).max).argmin(axis=1)


def surviving(low: np.ndarray, high: np.ndarray, entries: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Which of the open entries can be the nearest one of some point in each box."""
    # Doubled numbers keep the middle of a box whole.
    best = nearest_entry(low + high, 2 * entries, open_)
    ahead = np.zeros(open_.shape, np.int64)
    for d in range(entries.shape[1]):
        other, own = entries[None, :, d], entries[best, d][:, None]
        toward = other - own
        corner = np.where(toward > 0, high[:, d, None], low[:, d, None])
        ahead += toward * (other + own - 2 * corner)
    beaten = (ahead > 0) | ((ahead == 0) & (np.arange(len(entries))[None, :] > best[:, None]))
    return open_ & ~beaten


def filtered(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entry of each point, and the sums and counts of the points of each entry."""
    codes = np.zeros(len(points), np.int64)
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    order, levels = kd_tree(points)
    nodes, open_ = np.array([0]), np.ones((1, len(entries)), bool)
    for depth, level in enumerate(levels):
        open_ = surviving(level.low[nodes], level.high[nodes], entries, open_)
        single = open_.sum(axis=1) == 1
        winner, whole = open_[single].argmax(axis=1), nodes[single]
        np.add.at(sums, winner, level.total[whole])
        np.add.at(counts, winner, level.count[whole])
        codes[order[spread(level.start[whole], level.end[whole])]] = np.repeat(winner, level.count[whole])
        nodes, open_ = nodes[~single], open_[~single]
        if not len(nodes):
            break
        if depth == len(levels) - 1:
            rows = order[spread(level.start[nodes], level.end[nodes])]
            found = nearest_entry(points[rows], entries, np.repeat(open_, level.count[nodes], axis=0))
            codes[rows] = found
            np.add.at(sums, found, points[rows])
            counts += np.bincount(found, minlength=len(entries))
        else:
            nodes, open_ = np.stack([2 * nodes, 2 * nodes + 1], axis=1).reshape(-1), np.repeat(open_, 2, axis=0)
    return codes, sums, counts


def spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges [start, end), one after another."""
    size = end - start
    return np.repeat(end - np.cumsum(size), size) + np.arange(size.sum())


def whole_parts(column: pa.Array | pa.ChunkedArray, parts: int, scale: int) -> np.ndarray:
    """The vectors of a list column, all of one length, as whole numbers: rows x parts x components of a part."""
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64)
    cut_up = np.floor(scale * flat)
    if len(cut_up) and np.abs(cut_up).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / scale:g}, so that distances would leave 64 bits")
    return cut_up.astype(np.int64).reshape(len(column), parts, len(cut_up) // max(len(column) * parts, 1))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches in tables of BLOCK_ROWS or fewer."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            piece = batch.slice(at, BLOCK_ROWS)
            if n + piece.num_rows > BLOCK_ROWS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(piece)
            n += piece.num_rows
    if n:
        yield pa.Table.from_batches(held)


def usable(vectors: DataFrame, vector: str, parts: int) -> DataFrame:
    """The rows whose vector can be coded: no null, no component null or not finite, and the length of most such rows.

    Of lengths, only those that the number of parts divides count, ties go to the smaller one.
    """
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vectors.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    lengths = sound.groupBy(F.size(vector).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    most = lengths.orderBy(F.desc("rows"), "n").first()
    return sound.where(F.size(vector) == (most["n"] if most else 0))


def first_books(rows: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> np.ndarray:
    """parts x entries x components: the parts of the rows of least key (null last; equal keys by vector)."""
    first = rows.select(key, vector).orderBy(F.col(key).isNull(), key, vector).limit(entries).toArrow()
    return whole_parts(first.column(vector), parts, scale).transpose(1, 0, 2)


def refined(rows: DataFrame, vector: str, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one Lloyd round over all rows; an entry of no part stays as it is."""
    parts, entries, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for block in blocks(batches):
            points = whole_parts(block.column(vector), parts, scale)
            for p in range(parts):
                _, s, c = filtered(np.ascontiguousarray(points[:, p]), books[p])
                sums[p] += s
                counts[p] += c
        part, entry = np.nonzero(counts)
        totals = pa.FixedSizeListArray.from_arrays(pa.array(sums[part, entry].reshape(-1)), wide).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), totals, pa.array(counts[part, entry])], ["part", "entry", "sums", "n"])

    found = rows.select(vector).mapInArrow(run, "part long, entry long, sums array<long>, n long")
    # Whole numbers of 38 digits: no corpus is too large for the sums.
    means = [exact_floor(F.sum(F.col("sums")[i].cast("decimal(38,0)")), F.sum("n")).alias(f"m{i}") for i in range(wide)]
    after = books.copy()
    for r in found.groupBy("part", "entry").agg(*means).toLocalIterator():
        after[r["part"], r["entry"]] = [r[f"m{i}"] for i in range(wide)]
    return after


def exact_floor(total: Column, n: Column) -> Column:
    """floor(total / n) without the rounding of a division: by the remainder, which is never negative."""
    n = n.cast("decimal(38,0)")
    return ((total - F.pmod(total, n)) / n).cast("long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, in decimal and comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def trained(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray:
    """The codebooks of a table: parts x entries x components, fewer entries where the table has fewer rows.

    They start as the parts of the rows of least key, and each round is one pass over all rows. What comes
    to the driver is bounded by the codebooks' size.
    """
    rows = usable(vectors, vector, parts)
    books = first_books(rows, key, vector, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        books = refined(rows, vector, books, scale)
    return books


def encoded(vectors: DataFrame, books: np.ndarray, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The usable rows of a table with all columns, and code (an entry for each part, two hex digits each) and error.

    error is the squared distance of the whole numbers to their entries, summed over the parts. Existing
    columns named code and error are replaced. Entries beyond 256 have no two hex digits and are refused.
    """
    parts, entries, _ = books.shape
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    rows = usable(vectors, vector, parts)
    rows = rows.drop(*(c for c in rows.columns if c.lower() in ("code", "error")))
    schema = rows.withColumns({"code": F.lit("").cast("string"), "error": F.lit(0).cast("long")}).schema
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            points = whole_parts(block.column(vector), parts, scale)
            codes = np.stack([filtered(np.ascontiguousarray(points[:, p]), books[p])[0] for p in range(parts)], axis=1)
            gap = points - books[np.arange(parts)[None, :], codes]
            error = (gap * gap).sum(axis=(1, 2))
            text = ["".join(row) for row in digits[codes].tolist()]
            yield from block.append_column("code", pa.array(text, pa.string())).append_column("error", pa.array(error)).to_batches()

    return rows.mapInArrow(run, schema)


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """key, label, code, error and label_error of each usable row, and codebooks_sha256.

    label_error is the error summed over the rows of one label, null labels together. Rows whose vector is
    null, holds a component that is null or not finite, or hasn't the length of most rows (or one that the
    parts don't divide) are left out. Rows that repeat a key are coded one by one; of equal distances the
    lower entry wins; a null key is coded and comes last among the first entries. A table with fewer usable
    rows than entries starts with as many entries as rows, and an empty one gives no rows. Components beyond
    2^26 after scaling raise an error, as their distances don't fit 64 bits. Other columns aren't read.
    """
    books = trained(vectors, key, vector, parts, entries, rounds, scale)
    found = encoded(vectors.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).alias("_vector")), books, "_vector", scale)
    # Codes are a fraction of the vectors' size, and both the labels' sums and the result read them.
    found = cut(found.drop("_vector"))
    totals = cut(found.groupBy(F.col("_label").alias("_same")).agg(F.sum("error").alias("label_error")))
    sums = F.broadcast(totals) if totals.count() <= BROADCAST_LABELS else totals
    joined = found.join(sums, F.col("_label").eqNullSafe(F.col("_same")))
    return joined.select(F.col("_key").alias(key), F.col("_label").alias(label), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
