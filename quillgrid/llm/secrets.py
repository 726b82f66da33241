"""Secret scans: fixed patterns, and values in credential contexts judged by what guessing them would cost.

The guess cost of a value is the least total over all segmentations into known words, dates, repeats,
runs of neighbouring keys or letters, and brute-force spans, found by dynamic programming from left to
right. A value that is cheap to guess is a placeholder; a costly one is reported as kind "value".
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the contract.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "value")

#: Contexts whose values are judged by guess cost; wider than the contract's.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_-]?key)?|(?:access|auth|bearer|refresh)?[_-]?token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|bearer|authorization)"""
    r"""["']?(?:\x20*(=>|:=|[:=])\x20*|\x20+(?:is|was)\x20+|\x20+)["']?([^\s"'<>,;]{6,})""",
    re.ASCII | re.IGNORECASE,
)
HINTS = ("pass", "pwd", "secret", "token", "api", "key", "credential", "bearer", "authorization")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
# Fixed words that people choose, most usual first.
WORDS = """password admin welcome login secret letmein master qwerty monkey dragon football baseball iloveyou sunshine princess shadow
superman hello freedom whatever trust user root guest test demo example sample changeme default your my the key token api pass
word auth access private public client server service account database oracle mysql postgres redis spring summer autumn winter
january february march april may june july august september october november december monday tuesday wednesday thursday friday
saturday sunday company office home love god money power star black white red green blue orange silver gold happy lucky magic
secure security system manager support temp temporary none null undefined placeholder dummy redacted xxx here enter insert value
string text name email phone address http https www com org net localhost production staging development""".split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
LONGEST_WORD = max(map(len, WORDS))
LEET = str.maketrans("@431!05$7", "aaeiiosst")
# Fixed rows of keys and letters along which a walk goes.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
STEPS = {pair for row in ROWS for a, b in zip(row, row[1:]) for pair in (a + b, b + a)}
SEGMENT = 0.4  # what each further segment adds to the cost (log10)
SEPARATOR = 0.3  # what a mark between segments adds


def character_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isalpha():
        return math.log10(26)
    return math.log10(33)


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes; 0 for an empty value."""
    n = len(value)
    low = value.lower()
    plain = low.translate(LEET)
    single = [character_cost(c) for c in low]
    upper = [0] * (n + 1)
    for i, c in enumerate(value):
        upper[i + 1] = upper[i] + (c != low[i])
    sums = [0.0] * (n + 1)
    for i, c in enumerate(single):
        sums[i + 1] = sums[i] + c
    # How far from each place a repeat of period p, or a walk, goes on.
    repeat = {p: [0] * (n + 1) for p in (1, 2, 3, 4)}
    walk = [0] * (n + 1)
    for i in range(n - 2, -1, -1):
        for p, run in repeat.items():
            run[i] = run[i + 1] + 1 if i + p < n and low[i] == low[i + p] else 0
        walk[i] = walk[i + 1] + 1 if low[i : i + 2] in STEPS else 0
    best = [math.inf] * (n + 1)  # of the first i characters
    brute = [math.inf] * (n + 1)  # the same, when a brute-force span ends there
    best[0] = 0.0

    def offer(end: int, cost: float) -> None:
        best[end] = min(best[end], cost)

    for i in range(n):
        step = SEGMENT if i else 0.0
        brute[i + 1] = min(best[i] + step, brute[i]) + single[i] + (math.log10(2) if value[i] != low[i] else 0.0)
        best[i + 1] = min(best[i + 1], brute[i + 1])
        if value[i] in "_-.":
            offer(i + 1, best[i] + SEPARATOR)
        base = best[i] + step
        for k in range(2, min(LONGEST_WORD, n - i) + 1):
            word = plain[i : i + k]
            if word in RANK:
                changed = upper[i + k] - upper[i] + sum(a != b for a, b in zip(word, low[i : i + k]))
                offer(i + k, base + math.log10(RANK[word]) + changed * 0.5)
        for p, run in repeat.items():
            if run[i] >= max(2, p):
                length = run[i] + p
                offer(i + length, base + sums[i + p] - sums[i] + math.log10(length))
        if walk[i] >= 2:
            offer(i + walk[i] + 1, base + math.log10(len(STEPS)) + math.log10(walk[i] + 1))
        for m in [DATE.match(value, i)] if value[i].isdigit() else []:
            if m:
                offer(m.end(), base + math.log10(365 * 120))
    return best[n]


def spans(text: str, least_cost: float = 10.0) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The spans of the fixed patterns and the added ones: (from, to, kind), in code points, to exclusive."""
    base, added = [], []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(h in low for h in HINTS):
        found = sorted(base)
        for m in CONTEXT.finditer(text):
            value = m[2].rstrip(".)!?")
            # Where no sign separates them, as in prose, a value of small letters alone is a word like any other.
            likely = m[1] is not None or any(c.isdigit() for c in value) or value.lower() != value
            if len(value) >= 6 and likely and guess_cost(value) >= least_cost:
                start = m.start(2)
                if not any(a <= start and start + len(value) <= b for a, b, _ in found):
                    added.append((start, start + len(value), "value"))
    return base, added


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame, least_cost: float = 10.0) -> DataFrame:
    """doc_id, counts of the fixed kinds, base_spans and spans ("kind:from:to" by start, comma-joined) of every row.

    A null text counts as empty and has no spans. Repeated rows are scanned row by row, other columns
    are not read, an empty table gives an empty table. least_cost is the log10 of guesses from which a
    value in a credential context is reported.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
            base_spans, all_spans = [], []
            for text in batch.column("text"):
                base, added = spans(text.as_py() or "", least_cost)
                for kind, n in counts.items():
                    n.append(sum(s[2] == kind for s in base))
                base_spans.append(listed(base))
                all_spans.append(listed(base + added))
            arrays = [batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts.values()), pa.array(base_spans, pa.string()), pa.array(all_spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    rows = docs.select("doc_id", "text")
    zero, empty = F.lit(0).cast("long"), F.lit("")
    schema = rows.select("doc_id", zero.alias("n_assign"), zero.alias("n_access"), zero.alias("n_hex"), empty.alias("base_spans"), empty.alias("spans")).schema
    return rows.mapInArrow(run, schema)

