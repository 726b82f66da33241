from collections import Counter

from quillgrid.llm import mixing


def exact_worst(counts, block_docs=16):
    """The greatest deviation from the unrounded targets while all sources have blocks."""
    weights = {s: n**0.5 for s, n in counts.items()}
    total = sum(weights.values())
    until = min(-(-n // block_docs) * total / weights[s] for s, n in counts.items())
    had, worst = dict.fromkeys(counts, 0), 0.0
    for t, (s, _) in enumerate(mixing.plan(counts, None, 0.5, block_docs), 1):
        had[s] += 1
        if t <= until:
            worst = max(worst, *(abs(had[x] - w / total * t) for x, w in weights.items()))
    return worst, had


def test_long_phase_stays_under_a_block_of_the_unrounded_targets():
    counts = {f"s{i}": 9_000 + 2_137 * i for i in range(20)} | {"big": 300_000}
    worst, had = exact_worst(counts)
    assert worst < 1 and had == {s: -(-n // 16) for s, n in counts.items()}


def test_more_sources_than_a_period_has_slots(spark):
    docs = [(i, "t", f"d{i % 2500}.org") for i in range(5001)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), block_docs=1).collect()
    assert sorted(r.mix_position for r in got) == list(range(5001)) == sorted(r.mix_slot for r in got)
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d[0], d[2]) for d in docs)


def test_ranges_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, "t", "aab"[i % 3]) for i in range(200)], "doc_id long, text string, source string")
    want = sorted((r.doc_id, r.mix_position) for r in mixing.mix(df, block_docs=3).collect())
    monkeypatch.setattr(mixing, "RANGE", 7)
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", 5)
    assert sorted((r.doc_id, r.mix_position) for r in mixing.mix(df, block_docs=3).collect()) == want
