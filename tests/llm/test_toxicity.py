import zlib

import numpy as np
import pytest

from quillgrid.llm import queries, toxicity
from quillgrid.llm.toxicity import Network, Reader, Sample

AT = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def known(spark):
    docs, labels = spark.read.parquet(f"{AT}/documents.parquet"), spark.read.parquet(f"{AT}/labels.parquet")
    return [(r.doc_id, r.text, r.toxic) for r in docs.join(labels, "doc_id").orderBy("doc_id").select("doc_id", "text", "toxic").collect()]


def plain_logit(net, words):
    """One window, one word and one state at a time, by the definition of the network."""
    w, s = net.w, toxicity.STATE
    h = toxicity.hashed(words or [""])
    own = toxicity.features(net, h)[: len(words)]

    def layer(side, order):
        state, out = np.zeros(s), {}
        for t in order:
            x = (own[t] @ w["into"] + w["into_b"])[side * 3 * s : (side + 1) * 3 * s]
            u = state @ w["over"][side]
            z, r = (1 / (1 + np.exp(-(x[k * s : k * s + s] + u[k * s : k * s + s]))) for k in (0, 1))
            c = np.tanh(x[2 * s :] + r * u[2 * s :])
            state = z * state + (1 - z) * c
            out[t] = state
        return out

    n = len(words)
    if not n:
        return float(w["out_b"][0])
    ahead, back = layer(0, range(n)), layer(1, reversed(range(n)))
    states = [np.concatenate([ahead[t], back[t]]) for t in range(n)]
    e = np.array([np.tanh(x @ w["look"] + w["look_b"]) @ w["weigh"] for x in states])
    share = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return float(sum(a * x for a, x in zip(share, states)) @ w["out"] + w["out_b"][0])


def plain_score(net, text):
    words = toxicity.words_of(text)
    return max(plain_logit(net, words[at : at + toxicity.WINDOW]) for at in toxicity.window_starts(len(words)))


def test_scores_equal_the_plain_network_over_all_windows(monkeypatch):
    net = Network.fresh(3)
    rng = np.random.default_rng(1)
    words = ["alpha", "bé", "c", "word" * 30, "déjà_vu", "x1"]
    texts = [None, "", "  ", "one", *(" ".join(rng.choice(words, n)) for n in (3, 10, 39, 40, 41, 70, 71, 333))]
    want = [plain_score(net, t) for t in texts]
    assert np.allclose(Reader(net).scores(texts), want, atol=1e-4)
    # Pieces of long texts, forgotten words and small batches change nothing.
    monkeypatch.setattr(toxicity, "AT_ONCE", 60)
    monkeypatch.setattr(toxicity, "REMEMBERED", 2)
    monkeypatch.setattr(toxicity, "WINDOWS_AT_ONCE", 3)
    assert np.allclose(Reader(net).scores(texts), want, atol=1e-4)


def test_windows_overlap_and_cover_everything():
    for n in (0, 1, 39, 40, 41, 69, 70, 71, 1000):
        starts = list(toxicity.window_starts(n))
        assert {i for s in starts for i in range(s, min(s + toxicity.WINDOW, n))} == set(range(n))
        assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:]))


def test_gradients_equal_differences():
    net = Network({k: v.astype(np.float64) for k, v in Network.fresh(5).w.items()})
    sample = Sample.of(["a bad word " * 9, "quite good words here " * 14, "tiny"], [1, 0, 0])
    picked = np.arange(len(sample.doc))
    _, g = toxicity.gradients(net, sample, picked)
    rng = np.random.default_rng(0)
    for name, d in g.items():
        spots = [np.unravel_index(np.abs(d).argmax(), d.shape), *(tuple(rng.integers(0, k) for k in d.shape) for _ in range(3))]
        for at in spots:
            was, step = net.w[name][at], 1e-3
            net.w[name][at] = was + step
            up, _ = toxicity.gradients(net, sample, picked)
            net.w[name][at] = was - step
            down, _ = toxicity.gradients(net, sample, picked)
            net.w[name][at] = was
            assert abs((up - down) / (2 * step) - d[at]) < 2e-3 * max(1, abs(d[at])), (name, at)


def test_threshold_weighs_both_classes():
    assert toxicity.best_threshold(np.array([-3.0, -2, -1, 4, 5]), np.array([0, 0, 0, 1, 1])) == 1.5


def test_held_out_accuracy(spark, known):
    got = {r.doc_id: r for r in queries.QUERIES["op12_toxicity"](spark, AT).collect()}
    assert len(got) == spark.read.parquet(f"{AT}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in known if got[i].held_out]
    toxic, clean = [p for p, y in held if y == 1], [p for p, y in held if y == 0]
    assert len(toxic) > 80 and np.mean(toxic) > 0.88
    assert np.mean(clean) < 0.03


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score double, held_out int")


def test_edges_and_missing_classes(spark):
    rows = [(None, "no id", 1.0, 1), (1, None, 1.0, 1), (2, "", 1.0, 1), (3, "x" * 200_000, 1.0, 1), (3, "again", None, None), (3, "again", None, None)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.scored(frame(spark, rows), labels.where("doc_id = 2")).collect()
    assert len(got) == 6 and {(r.score, r.predicted) for r in got} == {(0.0, 0)}
    none = toxicity.scored(frame(spark, rows), labels.where("false"))
    assert none.columns == ["doc_id", "held_out", "score", "predicted"] and none.count() == 6
    learnt = [(10 + i, "vile nasty brute talk" if i % 2 else "fair mild weather talk", 0.0, 0) for i in range(60)]
    marks = spark.createDataFrame([(10 + i, i % 2) for i in range(60)] + [(11, 0), (13, 7)], "doc_id long, toxic int")
    both = toxicity.scored(frame(spark, rows + learnt), marks)
    assert both.count() == 66
    said = {r.doc_id: r.predicted for r in both.where("doc_id >= 10").collect()}
    assert [said[10 + i] for i in range(60)] == [i % 2 for i in range(60)]
    assert toxicity.scored(frame(spark, []), marks).count() == 0


def test_no_label_of_a_held_out_row_is_read(spark):
    docs = frame(spark, [(i, f"text {i}", 0.0, 0) for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    seen = {t for t, _ in toxicity.training_rows(docs, labels, 5, 1000, 100)}
    assert seen == {f"text {i}" for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert len(toxicity.training_rows(docs, labels, 5, 7, 100)) == 14
