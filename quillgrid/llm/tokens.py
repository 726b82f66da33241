"""Token counts of whole texts: distinct pieces are encoded in batches, only lengths come back.

A text is split before each space that stands alone between two other characters. No token of the
vocabulary's pattern reaches over such a place, so the counts of the pieces add up to the count of the
text, long texts need no encoding as a whole, and a piece met before isn't encoded again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Bytes that are encoded in one call.
CALL_BYTES = 1 << 18
#: Piece counts that a worker remembers at most; beyond it forgets and starts anew.
REMEMBERED = 300_000


def batches_by_bytes(pieces: list[str], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """Runs of pieces of about equal bytes; a piece longer than that is a batch of its own."""
    batch, held = [], 0
    for piece in pieces:
        n = 4 * len(piece) if not piece.isascii() else len(piece)
        if batch and held + n > most:
            yield batch
            batch, held = [], 0
        batch.append(piece)
        held += n
    if batch:
        yield batch


class Counter:
    """Counts of one worker. Two memories, as a piece with a space before it is another piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.first: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    def learn(self, known: dict[str, int], pieces: set[str], before: str) -> None:
        new = [p for p in pieces if p not in known]
        for batch in batches_by_bytes(new):
            found = self.tokenizer.encode_batch_fast([before + p for p in batch], add_special_tokens=False)
            known.update(zip(batch, map(len, found)))

    def counts(self, texts: list[str]) -> list[int]:
        for known in (self.first, self.spaced):
            if len(known) > REMEMBERED:
                known.clear()
        split = [SAFE.split(t) for t in texts]
        heads, rest = {s[0] for s in split}, set()
        for s in split:
            rest.update(s[1:])
        self.learn(self.first, heads, "")
        self.learn(self.spaced, rest, " ")
        return [self.first[s[0]] + sum(map(self.spaced.__getitem__, s[1:])) for s in split]


def runs(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts of about a megabyte together, so that a batch of long texts stays small."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t)
        if held > most:
            yield run
            run, held = [], 0
    if run:
        yield run


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than limit) for every row of docs.

    path is a vocabulary file of the tokenizers library, readable on every executor. A null text
    counts as empty: no bytes, no tokens. Repeated rows are counted row by row, other columns are
    not read, an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n_tokens = [n for part in runs(texts) for n in counter.counts(part)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    schema = rows.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
