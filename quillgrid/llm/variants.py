"""Spelling variants: words one edit apart, found in dictionaries sorted forward and reversed.

One inserted, deleted or replaced code point leaves the first or the last half of the shorter word
intact. So each word stands in two sorted dictionaries, one ordered by its first half and one by its last
half read backward, and all its near words stand in its block of equal halves in one of them. A block
with more words than a scan should compare is divided: within the part that is not known to be equal
the same holds again, so its words stand in the smaller blocks of equal first or last halves of that
part. Halves end at one code point, where a block is bounded by the alphabet. A pair is reported by one
block only: the one that taking the first half whenever it is equal leads to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import ascii_lower, cut

#: Words of a block that are compared with each other; larger blocks are divided. Changes no result.
BLOCK_WORDS = 64
#: Keys of blocks (some 40 bytes each) or links of words that are sent to all executors; beyond it those joins are shuffles.
BROADCAST_ROWS = 200_000
#: Code points that a scan holds as numbers at once.
SCAN_CELLS = 1 << 22
NON_LETTER_RUN = r"[^a-zÀ-ÿ]+"


def observed_words(docs: DataFrame, noise: int = 199, shortest: int = 6) -> DataFrame:
    """word: one row for each run of letters of each text, lower-case in A-Z, with a code point deleted from some.

    A run loses one where noise divides the unsigned CRC-32 of "<doc_id>:<run>": the one at that number modulo its
    length. Results shorter than shortest are left out. A null text has no runs; a null doc_id reads as nothing.
    """
    runs = docs.select("doc_id", F.explode(F.split(ascii_lower(F.col("text")), NON_LETTER_RUN)).alias("run")).where(F.length("run") >= shortest)
    hashed = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)


def vocabulary(docs: DataFrame, noise: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """word and n of each observed word of so many occurrences; counted in each task before anything is shuffled."""
    return observed_words(docs, noise, shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def halves(entries: DataFrame) -> DataFrame:
    """The entries of the blocks that those of entries are divided into.

    An entry is a word in the frame of the length m of the shorter word of a pair: its first a and last b code
    points are known to be equal in its block, and path tells by which halves (P first, S last) it came there.
    """
    half = ((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    first = F.struct(F.concat("path", F.lit("P")).alias("path"), (F.col("a") + half).alias("a"), F.col("b").alias("b"))
    last = F.struct(F.concat("path", F.lit("S")).alias("path"), F.col("a").alias("a"), (F.col("b") + half).alias("b"))
    divided = entries.select("word", "n", "m", F.inline(F.array(first, last)))
    return divided.withColumn("block", block_key())


def block_key() -> Column:
    """What is equal in a block, as it is read in its dictionary: forward, or backward from the end."""
    start = F.left("word", F.col("a"))
    end = F.left(F.reverse("word"), F.col("b"))
    return F.when(F.col("path").startswith("P"), F.concat_ws(" ", start, end)).otherwise(F.concat_ws(" ", end, start))


def in_blocks(words: DataFrame, shortest: int) -> DataFrame:
    """word, n, m, path and block: entries such that each pair of near words meets in a block of bounded size."""
    length = F.length("word")
    frames = F.filter(F.array(length, length - 1), lambda m: m >= shortest)
    now = halves(words.select("word", "n", F.explode(frames).alias("m"), F.lit("").alias("path"), F.lit(0).alias("a"), F.lit(0).alias("b")))
    done = None
    block = ["m", "path", "block"]
    while True:
        sizes = now.groupBy(*block).agg(F.count(F.lit(1)).alias("size"), F.max(F.length("word") == F.col("m")).alias("any_short"))
        wide = cut(sizes.where((F.col("size") > BLOCK_WORDS) & (F.col("m") > 1)).drop("size"))
        n_wide = wide.count()
        named = F.broadcast(wide) if n_wide <= BROADCAST_ROWS else wide
        last = F.col("m") - F.col("a") - F.col("b") < 2
        small = now.where(last).unionByName(now.where(~last).join(named, block, "left_anti")) if n_wide else now
        small = small.select("word", "n", *block)
        done = small if done is None else done.unionByName(small)
        if not n_wide:
            return done
        # A block without a word of the frame's own length pairs nothing in this frame.
        large = now.where(~last).join(named.where("any_short"), block, "left_semi")
        now = cut(halves(large))


def common_lengths(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many leading cells of the rows of two matrices are equal."""
    differ = left != right
    return np.where(differ.any(axis=1), differ.argmax(axis=1), left.shape[1])


def as_cells(words: list[str], width: int) -> np.ndarray:
    """The code points of words, one row each, with zeros behind."""
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)


def near_in(words: np.ndarray, m: np.ndarray, path: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of near words among rows dealt in blocks that begin at start; i is of its frame's length."""
    width = int(m.max()) + 1
    length = np.fromiter(map(len, words), np.int64, len(words))
    forward, backward = as_cells(list(words), width), as_cells([w[::-1] for w in words], width)
    end = np.append(start[1:], len(words))
    of_block = np.repeat(np.arange(len(start)), end - start)
    short = np.flatnonzero(length == m)
    size = (end - start)[of_block[short]]
    some = max(1, SCAN_CELLS // width)
    found_i, found_j = [], []
    edge = np.cumsum(size)
    at = 0
    while at < len(short):
        upto = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + some)))
        picked, n = short[at:upto], size[at:upto]
        i = np.repeat(picked, n)
        j = np.repeat(start[of_block[picked]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        # Words of equal length meet once, by their order in the block; none meets itself.
        keep = (length[j] > length[i]) | (i < j)
        i, j = i[keep], j[keep]
        lead, tail = common_lengths(forward[i], forward[j]), common_lengths(backward[i], backward[j])
        near = lead + tail >= length[j] - 1
        i, j, lead = i[near], j[near], lead[near]
        own = np.zeros(len(i), bool)
        for p in np.unique(path[i]):
            on = path[i] == p
            own[on] = leads_to(p, m[i][on], lead[on])
        found_i.append(i[own])
        found_j.append(j[own])
        at = upto
    return np.concatenate(found_i or [short[:0]]), np.concatenate(found_j or [short[:0]])


def leads_to(path: str, m: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Whether pairs with so many equal leading code points come to a path when they take each equal first half."""
    a, b, right = np.zeros_like(m), np.zeros_like(m), np.ones(len(m), bool)
    for step in path:
        half = (m - a - b) // 2
        first = lead >= a + half
        right &= first == (step == "P")
        a, b = a + half * (step == "P"), b + half * (step == "S")
    return right


def near_pairs(words: DataFrame, shortest: int = 6) -> DataFrame:
    """word, near and near_n: every ordered pair of distinct words exactly one edit apart. words: word (once each) and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_blocks(batches):
            word, n, m, path = (part.column(c).to_numpy(zero_copy_only=False) for c in ("word", "n", "m", "path"))
            i, j = near_in(word, m, path, block_starts(part))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([word[i], word[j]]), pa.string()), pa.array(np.concatenate([word[j], word[i]]), pa.string()), pa.array(np.concatenate([n[j], n[i]]))], ["word", "near", "near_n"])

    entries = in_blocks(words, shortest)
    key = ["m", "path", "block"]
    return entries.repartitionByRange(*key).sortWithinPartitions(*key, "word").mapInArrow(run, "word string, near string, near_n long")


def block_starts(part: pa.Table) -> np.ndarray:
    """Where rows begin that differ from the row before in the block they belong to."""
    change = np.zeros(part.num_rows, bool)
    change[:1] = True
    for c in ("m", "path", "block"):
        values = part.column(c).to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a block ends, of bounded size unless one block is larger."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches(([] if held is None else held.to_batches()) + [batch]).combine_chunks()
        starts = np.append(block_starts(held), held.num_rows)
        cells = np.concatenate([[0], np.cumsum(held.column("m").to_numpy() + 1)])
        at = 0
        # The last block may go on in the next batch.
        while at < len(starts) - 2:
            upto = int(np.searchsorted(cells[starts], cells[starts[at]] + SCAN_CELLS, "right")) - 1
            upto = min(max(upto, at + 1), len(starts) - 2)
            yield held.slice(starts[at], starts[upto] - starts[at])
            at = upto
        held = held.slice(starts[at])
    if held is not None and held.num_rows:
        yield held


def roots(links: DataFrame) -> DataFrame:
    """word and root: the end of each word's chain of forms. links: word and form, by which counts only rise.

    The number of rounds is the logarithm of the longest chain's length.
    """
    now = cut(links.select("word", F.col("form").alias("root")))
    while True:
        small = now.count() <= BROADCAST_ROWS
        above = now.select(F.col("word").alias("up"), F.col("root").alias("top"))
        stepped = cut(now.join(F.broadcast(above) if small else above, F.col("root") == F.col("up"), "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        now = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return now


def grouped(words: DataFrame, ratio: int = 5, shortest: int = 6) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    words: word, once each and not null, of shortest code points or more, and n, its count. Near words differ by exactly
    one inserted, deleted or replaced code point. form is the near word of the largest n (of equal ones the first in
    code-point order) if that n is ratio times the word's or more, else null, and form_n its n. root is where forms
    lead to in the end, the word itself if it has none. ratio is above 1, so that no chain closes. An empty table gives
    an empty table.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near"))
    around = near_pairs(words, shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.minus_n") >= ratio * F.col("n")
    named = words.join(around, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus_n")).alias("form_n"))
    named = cut(named)
    ends = roots(named.where("form is not null"))
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, noise: int = 199, shortest: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """grouped() over the words of all texts of docs (doc_id, text), which occur least times or more.

    Rows count one by one, repeated ones too; null and empty texts have no words, and other columns aren't read.
    """
    return grouped(cut(vocabulary(docs, noise, shortest, least)), ratio, shortest)
