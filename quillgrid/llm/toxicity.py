"""Toxicity by a bidirectional gated recurrent network over overlapping windows of words.

A word enters as an embedding of its own and as the mean of embeddings of its character n-grams, both
hashed into tables of fixed size. Two gated recurrent layers read a window of words forward and
backward, attention over their states pools them, and a logistic unit scores the pool. A text's score is
that of its highest window, and windows cover every text whole, each sharing words with the next.

The network is written and trained in numpy. A document's label says only that some window of it is
toxic, so training goes in rounds: the network scores all windows of its sample, then learns from
the highest windows of each document and from some others of clean ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Longer runs are read as several words of at most this many code points.
LONGEST = 48
GRAMS = (3, 4, 5)
#: Tables of embeddings: words, character n-grams.
WORD_ROWS, WORD_WIDE = 1 << 13, 8
GRAM_ROWS, GRAM_WIDE = 1 << 15, 24
STATE = 12
ATTENTION = 12
WINDOW, STRIDE = 40, 30
#: Words that a task remembers, some 400 bytes each, and words and windows that it works on at once.
REMEMBERED, AT_ONCE, WINDOWS_AT_ONCE = 150_000, 400_000, 2048
#: Bounds of the sample that the network is fitted on: labelled rows of each class, and code points of each of their texts.
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 16_384
ROUNDS = 7
BATCH = 96


@dataclass
class Network:
    """The network's weights by name; float32."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)

        def some(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        inputs = WORD_WIDE + GRAM_WIDE
        w = {
            "words": some(WORD_ROWS, WORD_WIDE, scale=0.1),
            "grams": some(GRAM_ROWS, GRAM_WIDE, scale=0.1),
            "into": some(inputs, 6 * STATE, scale=inputs**-0.5),
            "into_b": np.zeros(6 * STATE, np.float32),
            "over": some(2, STATE, 3 * STATE, scale=STATE**-0.5),
            "look": some(2 * STATE, ATTENTION, scale=(2 * STATE) ** -0.5),
            "look_b": np.zeros(ATTENTION, np.float32),
            "weigh": some(ATTENTION, scale=ATTENTION**-0.5),
            "out": some(2 * STATE, scale=0.3),
            "out_b": np.zeros(1, np.float32),
        }
        return cls(w)


def words_of(text: str | None) -> list[str]:
    """The lower-case words of a text; none for null."""
    found = WORD.findall((text or "").lower())
    if any(len(x) > LONGEST for x in found):
        found = [x[i : i + LONGEST] for x in found for i in range(0, len(x), LONGEST)]
    return found


@dataclass
class Hashes:
    """For each word its row of the word table and, one word's after another's, its rows of the n-gram table."""

    whole: np.ndarray
    grams: np.ndarray
    n: np.ndarray

    def take(self, at: np.ndarray) -> Hashes:
        n = self.n[at]
        first = (np.cumsum(self.n) - self.n)[at]
        return Hashes(self.whole[at], self.grams[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())], n)


def hashed(words: list[str]) -> Hashes:
    """The hashes of words; short words are hashed apart from longer ones, which would widen their table."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(length, kind="stable")
    edges = np.searchsorted(length[order], [0, 9, 15, LONGEST + 1])
    parts = [hashed_alike([words[i] for i in order[x:y]]) for x, y in zip(edges, edges[1:]) if y > x]
    put = np.empty(len(words), np.int64)
    put[order] = np.arange(len(words))
    return Hashes(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("whole", "grams", "n"))).take(put)


def hashed_alike(words: list[str]) -> Hashes:
    width = max(map(len, words)) + 2
    cells = np.zeros((len(words), max(width, 3)), np.uint64)
    if width > 2:
        cells[:, 1 : width - 1] = np.array(words, f"U{width - 2}").view(np.uint32).reshape(len(words), -1)
    length = np.fromiter(map(len, words), np.int64, len(words))
    cells[:, 0] = 2
    cells[np.arange(len(words)), length + 1] = 3  # marks of a word's two ends
    width = cells.shape[1]
    factor = 0x9E3779B97F4A7C15
    # The place of a code point counts, by powers of the factor; sums go around at 64 bits.
    powers = np.array([pow(factor, i + 1, 1 << 64) for i in range(width)], np.uint64)
    whole = mixed((cells * powers).sum(axis=1, dtype=np.uint64)) % np.uint64(WORD_ROWS)
    rows, live = [], []
    for n in GRAMS:
        if width >= n:
            total = sum((cells[:, k : width - n + 1 + k] * powers[k] for k in range(n)), np.zeros((len(words), width - n + 1), np.uint64))
            rows.append(mixed(total + np.uint64(n)) % np.uint64(GRAM_ROWS))
            live.append((np.arange(width - n + 1)[None, :] + n <= length[:, None] + 2) | ((n == GRAMS[0]) & (np.arange(width - n + 1) == 0))[None, :])
    rows, live = np.concatenate(rows, axis=1), np.concatenate(live, axis=1)
    return Hashes(whole.astype(np.int64), rows[live].astype(np.int64), live.sum(axis=1))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20)


def features(net: Network, h: Hashes) -> np.ndarray:
    """The inputs of words: their own embedding beside the scaled sum of their n-grams'."""
    own = np.empty((len(h.whole), WORD_WIDE + GRAM_WIDE), np.float32)
    own[:, :WORD_WIDE] = net.w["words"][h.whole]
    total = np.add.reduceat(net.w["grams"][h.grams], np.cumsum(h.n) - h.n, axis=0)
    own[:, WORD_WIDE:] = total / np.sqrt(h.n)[:, None].astype(np.float32)
    return own


def gate_inputs(net: Network, h: Hashes) -> np.ndarray:
    """2 x words x 3 states: what the gates of either direction get from words."""
    both = features(net, h) @ net.w["into"] + net.w["into_b"]
    return np.ascontiguousarray(both.reshape(len(both), 2, 3 * STATE).transpose(1, 0, 2))


def window_starts(n: int) -> range:
    """Where windows over n words begin; one for a text without words, and the last one holds its end."""
    return range(0, max(n - (WINDOW - STRIDE), 1), STRIDE)


@dataclass
class Trace:
    """What a forward pass leaves for the backward one."""

    steps: list = field(default_factory=list)
    states: np.ndarray | None = None
    looked: np.ndarray | None = None
    share: np.ndarray | None = None
    pooled: np.ndarray | None = None


def forward(net: Network, inputs: np.ndarray, places: np.ndarray, keep: Trace | None = None) -> np.ndarray:
    """The logit of each window. inputs: gate_inputs of words; places: windows x times of words, -1 beyond a text's end."""
    w, s = net.w, STATE
    here = places.T >= 0
    times, n = here.shape
    h = np.zeros((2, n, s), np.float32)
    x = np.empty((2, n, 3 * s), np.float32)
    states = np.empty((times, n, 2 * s), np.float32)
    full = here.all(axis=1)
    for t in range(times):
        back = times - 1 - t
        np.take(inputs[0], places[:, t], axis=0, out=x[0], mode="wrap")
        np.take(inputs[1], places[:, back], axis=0, out=x[1], mode="wrap")
        u = h @ w["over"]
        zr = x[..., : 2 * s] + u[..., : 2 * s]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r = zr[..., :s], zr[..., s:]
        c = r * u[..., 2 * s :]
        c += x[..., 2 * s :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        live = None
        if not (full[t] and full[back]):
            live = np.stack([here[t], here[back]])[..., None]
            new = np.where(live, new, h)
        if keep is not None:
            keep.steps.append((h, z, r, c, u[..., 2 * s :], live))
        h = new
        states[t, :, :s], states[back, :, s:] = h[0], h[1]
    looked = np.tanh(states @ w["look"] + w["look_b"])
    share = np.where(here, looked @ w["weigh"], np.float32(-1e9))
    share = np.exp(share - share.max(axis=0)) * here
    share = share / np.maximum(share.sum(axis=0), np.float32(1e-9))
    pooled = np.einsum("tn,tns->ns", share, states)
    if keep is not None:
        keep.states, keep.looked, keep.share, keep.pooled = states, looked, share, pooled
    return pooled @ w["out"] + w["out_b"][0]


def backward(net: Network, trace: Trace, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of all weights behind the inputs, and of the gates' inputs (windows x times x 6 states), from the logits' slopes."""
    w, s = net.w, STATE
    times = len(trace.steps)
    g = {"out": trace.pooled.T @ slope, "out_b": np.array([slope.sum()], np.float32)}
    d_pool = slope[:, None] * w["out"]
    d_share = np.einsum("ns,tns->tn", d_pool, trace.states)
    d_states = trace.share[..., None] * d_pool
    d_look = trace.share * (d_share - (trace.share * d_share).sum(axis=0))
    g["weigh"] = np.einsum("tn,tna->a", d_look, trace.looked)
    inner = d_look[..., None] * w["weigh"] * (1 - trace.looked**2)
    g["look"] = np.einsum("tns,tna->sa", trace.states, inner)
    g["look_b"] = inner.sum(axis=(0, 1))
    d_states = d_states + inner @ w["look"].T
    g["over"] = np.zeros_like(w["over"])
    d_gates = np.zeros((len(slope), times, 6 * s), np.float32)
    later = np.zeros((2, len(slope), s), np.float32)
    for t in reversed(range(times)):
        back = times - 1 - t
        h, z, r, c, u, live = trace.steps[t]
        d = later.copy()
        d[0] += d_states[t, :, :s]
        d[1] += d_states[back, :, s:]
        passed = 0 if live is None else d * ~live
        d = d if live is None else d * live
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (h - c) * z * (1 - z)
        dr = dc * u * r * (1 - r)
        into = np.concatenate([dz, dr, dc], axis=2)
        around = np.concatenate([dz, dr, dc * r], axis=2)
        g["over"] += h.transpose(0, 2, 1) @ around
        later = d * z + around @ w["over"].transpose(0, 2, 1) + passed
        d_gates[:, t, : 3 * s] += into[0]
        d_gates[:, back, 3 * s :] += into[1]
    return g, d_gates


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of values (rows x wide) over equal row numbers."""
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], axis=1).astype(np.float32)


@dataclass
class Sample:
    """Documents as rows of a word list, with the windows of all of them."""

    hashes: Hashes
    windows: np.ndarray  # windows x WINDOW: places in the word list, -1 beyond a text's end
    doc: np.ndarray  # the document of each window
    toxic: np.ndarray  # of each document

    @classmethod
    def of(cls, texts: list[str | None], toxic: list[int]) -> Sample:
        places: dict[str, int] = {}
        windows, doc = [], []
        for d, text in enumerate(texts):
            ids = [places.setdefault(x, len(places)) for x in words_of(text)]
            for at in window_starts(len(ids)):
                held = ids[at : at + WINDOW]
                windows.append(held + [-1] * (WINDOW - len(held)))
                doc.append(d)
        return cls(hashed(list(places) or [""]), np.array(windows, np.int64), np.array(doc), np.array(toxic))


def logits(net: Network, inputs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The logit of each window; inputs: gate_inputs of the words that windows names."""
    found = np.empty(len(windows), np.float32)
    for at in range(0, len(windows), WINDOWS_AT_ONCE):
        found[at : at + WINDOWS_AT_ONCE] = forward(net, inputs, windows[at : at + WINDOWS_AT_ONCE])
    return found


def gradients(net: Network, sample: Sample, picked: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The loss over the windows picked, both classes weighing the same, and its gradient for every weight."""
    w = net.w
    windows = sample.windows[picked]
    used, inverse = np.unique(windows, return_inverse=True)
    inverse = inverse.reshape(windows.shape)
    h = sample.hashes.take(used)  # place -1 reads the last word, which no live step uses
    own = features(net, h)
    both = own @ w["into"] + w["into_b"]
    inputs = both.reshape(len(both), 2, 3 * STATE).transpose(1, 0, 2)
    trace = Trace()
    logit = forward(net, inputs, np.where(windows >= 0, inverse, -1), trace)
    y = sample.toxic[sample.doc[picked]]
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)).astype(np.float32)
    loss = float((weight * np.logaddexp(0, np.where(y == 1, -logit, logit))).sum())
    g, d_gates = backward(net, trace, ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight).astype(np.float32))
    d_word = summed(inverse.reshape(-1), d_gates.reshape(-1, d_gates.shape[2]), len(used))
    g["into"], g["into_b"] = own.T @ d_word, d_word.sum(axis=0)
    d_own = d_word @ w["into"].T
    g["words"] = summed(h.whole, d_own[:, :WORD_WIDE], WORD_ROWS)
    g["grams"] = summed(h.grams, np.repeat(d_own[:, WORD_WIDE:] / np.sqrt(h.n)[:, None], h.n, axis=0), GRAM_ROWS)
    return loss, g


def learn(net: Network, sample: Sample, picked: np.ndarray, moments: dict, rate: float) -> None:
    """One step of Adam on the windows picked."""
    _, g = gradients(net, sample, picked)
    moments["step"] = t = moments.get("step", 0) + 1
    for name, d in g.items():
        m, v = moments.setdefault(name, [np.zeros_like(net.w[name]), np.zeros_like(net.w[name])])
        m += 0.1 * (d - m)
        v += 0.01 * (d * d - v)
        net.w[name] -= (rate / (1 - 0.9**t)) * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)


def highest(score: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The greatest score of each of n documents' windows."""
    best = np.full(n, -np.inf, np.float32)
    np.maximum.at(best, doc, score)
    return best


def chosen_windows(score: np.ndarray, sample: Sample, rng: np.random.Generator, first: bool) -> np.ndarray:
    """Windows to learn from: at first any of each document, later the highest ones, of clean documents others as well."""
    any_order = rng.random(len(score))
    rank_any = ranks(any_order, sample.doc)
    if first:
        return np.flatnonzero(rank_any < 4)
    rank = ranks(score, sample.doc)
    toxic = sample.toxic[sample.doc] == 1
    return np.flatnonzero((rank < 2) | (~toxic & (rank_any < 1)))


def ranks(value: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The place of each value in its group, from 0 for the greatest."""
    order = np.lexsort((-value, group))
    begins = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    place = np.arange(len(value)) - np.repeat(begins, np.diff(np.r_[begins, len(value)]))
    out = np.empty(len(value), np.int64)
    out[order] = place
    return out


def fitted(texts: list[str | None], toxic: list[int], rounds: int = ROUNDS, seed: int = 7) -> Network:
    """A network fitted on labelled texts of both classes, its threshold where it tells them apart best."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(seed)
    sample = Sample.of(texts, toxic)
    moments: dict = {}
    score = np.zeros(len(sample.doc), np.float32)
    for k in range(rounds):
        picked = rng.permutation(chosen_windows(score, sample, rng, first=k == 0))
        for _ in range(2 if k else 1):
            for at in range(0, len(picked), BATCH):
                learn(net, sample, picked[at : at + BATCH], moments, rate=0.01 if k < rounds - 2 else 0.003)
        score = logits(net, gate_inputs(net, sample.hashes), sample.windows)
    net.w["out_b"] -= best_threshold(highest(score, sample.doc, len(toxic)), sample.toxic)
    return net


def best_threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap among the cuts that set fewest documents on the wrong side, classes weighing the same."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], toxic[order]
    below_toxic = np.concatenate([[0], np.cumsum(y == 1)]) / max((y == 1).sum(), 1)
    above_clean = 1 - np.concatenate([[0], np.cumsum(y == 0)]) / max((y == 0).sum(), 1)
    wrong = (below_toxic + above_clean)[1:-1]
    gap = np.diff(s)
    at = max(np.flatnonzero(wrong <= wrong.min() + 1e-12), key=lambda i: gap[i])
    return float(s[at] + s[at + 1]) / 2


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, rows: int, chars: int) -> list[tuple[str | None, int]]:
    """Up to so many labelled rows of each class outside fold 0, in the order of a hash of their ids; texts beyond chars are left out.

    Labels that are neither 0 nor 1 are; of several labels of one doc_id the greatest counts.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = labels.where(F.col("toxic").isin(0, 1)).where(fold != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(*order).limit(4 * rows)
        some = part if some is None else some.unionByName(part)
    held = docs.select("doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) <= chars).join(F.broadcast(some), "doc_id")
    found = []
    for y in (0, 1):
        part = held.where(F.col("toxic") == y).orderBy(*order, "text").limit(rows)
        found += [(r["text"], y) for r in part.select("text").collect()]
    return found


class Reader:
    """Scores texts with a network; remembers a bounded number of words' inputs."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.inputs = np.zeros((2, 0, 3 * STATE), np.float32)

    def places_of(self, words: list[str]) -> np.ndarray:
        if len(self.place) > REMEMBERED:
            self.clear()
        fresh = [x for x in dict.fromkeys(words) if x not in self.place]
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        made = [gate_inputs(self.net, hashed(fresh[at : at + 8192])) for at in range(0, len(fresh), 8192)]
        self.inputs = np.concatenate([self.inputs, *made], axis=1)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The logit of each text: that of its highest window."""
        best = np.full(len(texts), -np.inf, np.float32)
        held: list[tuple[int, list[str]]] = []
        n = 0
        for d, text in enumerate(texts):
            words = words_of(text)
            # A very long text goes in pieces that share words as its windows do.
            whole = AT_ONCE // STRIDE * STRIDE
            for at in range(0, max(len(words) - (WINDOW - STRIDE), 1), whole):
                held.append((d, words[at : at + whole + WINDOW - STRIDE]))
                n += len(held[-1][1])
                if n >= AT_ONCE:
                    self.score_into(best, held)
                    held, n = [], 0
        if held:
            self.score_into(best, held)
        return best

    def score_into(self, best: np.ndarray, held: list[tuple[int, list[str]]]) -> None:
        places = self.places_of([x for _, words in held for x in words])
        size = np.array([len(words) for _, words in held])
        first = np.cumsum(size) - size
        n = np.maximum(-(-(size - (WINDOW - STRIDE)) // STRIDE), 1)
        owner = np.repeat(np.arange(len(held)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        offset = nth * STRIDE
        at = offset[:, None] + np.arange(WINDOW)[None, :]
        live = at < size[owner][:, None]
        windows = np.full(live.shape, -1, np.int64)
        windows[live] = places[(first[owner][:, None] + at)[live]]
        inputs = self.inputs if self.inputs.shape[1] else np.zeros((2, 1, 3 * STATE), np.float32)
        np.maximum.at(best, np.array([d for d, _ in held])[owner], logits(self.net, inputs, windows))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    held_out: whether folds divides the CRC-32 of doc_id as text; labels (doc_id, toxic) of such rows aren't learned from.
    The network is fitted on up to rows labelled rows of each class, of texts up to chars code points; both are parameters
    and bound what comes to the driver. It scores every text whole: a null or empty text is one window without
    words. Repeated rows are scored one by one; a null doc_id isn't held out. Where labels lack a class, every score is
    the other class's (0 without any). Other columns of docs and labels aren't read; an empty table gives an empty one.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    known = training_rows(docs, labels, folds, rows, chars)
    classes = {y for _, y in known}
    if classes != {0, 1}:
        only = F.lit(1.0 if classes == {1} else 0.0)
        return docs.select("doc_id", held_out.alias("held_out"), only.alias("score"), (only >= 0.5).cast("int").alias("predicted"))
    net = fitted(*map(list, zip(*known)))
    rows_ = docs.select("doc_id", "text", held_out.alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                logit = reader.scores(part.column("text").to_pylist()).astype(np.float64)
                score = np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 6)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    schema = rows_.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return rows_.mapInArrow(run, schema)
