import random
from collections import Counter
from fractions import Fraction

import pytest

from quillgrid.llm import mixing


def lag(order, slots):
    """The greatest deviation of any source from its share, at any slot."""
    period, had, worst = len(order), Counter(), Fraction(0)
    for t, s in enumerate(order, 1):
        had[s] += 1
        worst = max(worst, *(abs(had[x] - Fraction(n * t, period)) for x, n in slots.items()))
    return worst


@pytest.mark.parametrize("seed", range(40))
def test_less_than_one_block_off(seed):
    rnd = random.Random(seed)
    weights = {f"s{i}": rnd.random() ** rnd.choice([1, 4]) + 1e-3 for i in range(rnd.randint(1, 25))}
    slots = mixing.whole_weights(weights, rnd.choice([64, 256, 512]))
    order = mixing.pfair(slots)
    assert Counter(order) == slots
    assert lag(order, slots) < 1


def test_phases_place_every_block_once():
    blocks, weights = {"a": 100, "b": 7, "c": 1, "d": 40}, {"a": 1.0, "b": 2.0, "c": 0.1, "d": 1.5}
    counts = {s: n * 4 - 1 for s, n in blocks.items()}
    made = mixing.plan(counts, weights, 1, 4)
    slots = sorted(mixing.slot_of(made, s, b) for s, n in blocks.items() for b in range(n))
    assert slots == list(range(sum(blocks.values())))


def rows_of(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, source string, m_source string, mix_slot string")


def test_rows_are_whole_and_positions_dense(spark):
    docs = [(i, f"t{i}", rand, "m", "z") for i, rand in enumerate(random.Random(1).choices(["a", "b", None], [8, 3, 1], k=500))]
    docs += [(7, None, "a", "m", "z")] * 3 + [(None, "", "only", "m", "z")]
    df = rows_of(spark, docs)
    got = mixing.mix(df, block_docs=4, per_piece=16).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(docs)))
    assert Counter((r.doc_id, r.text, r.source, r.m_source) for r in got) == Counter(d[:4] for d in docs)
    by_slot = {}
    for r in sorted(got, key=lambda r: r.mix_position):
        by_slot.setdefault(r.mix_slot, []).append(r)
    assert list(by_slot) == list(range(len(by_slot)))
    assert all(len({(r.source, r.mix_block) for r in rs}) == 1 and len(rs) <= 4 for rs in by_slot.values())
    again = mixing.mix(df.repartition(7), block_docs=4, per_piece=16).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.mix_position)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(df.limit(0)).count() == 0


def test_shares_follow_given_weights(spark):
    docs = [(i, "t", "ab"[i % 2], "m", "z") for i in range(800)] + [(1000 + i, "t", "unnamed", "m", "z") for i in range(30)]
    got = mixing.mix(rows_of(spark, docs), {"a": 3, "b": 1}, block_docs=2).collect()
    first = Counter(r.source for r in got if r.mix_position < 400)
    assert abs(first["a"] - 300) <= 2
    assert {r.source for r in got if r.mix_position >= 800} == {"unnamed"}


def test_query_deviates_by_less_than_a_block(spark):
    from quillgrid.llm.queries import op10_mixing

    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "source").collect()
    got = op10_mixing(spark, at).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted((d.doc_id, d.source) for d in docs)
    assert sorted(r.mix_position for r in got) == list(range(len(docs)))
    counts = Counter(d.source for d in docs)
    total = sum(n**0.5 for n in counts.values())
    last = min(max(r.mix_slot for r in got if r.source == s) for s in counts)
    slots = dict(sorted((r.mix_slot, r.source) for r in got))
    had = Counter()
    for t in range(last):
        had[slots[t]] += 1
        assert all(abs(had[s] - (t + 1) * n**0.5 / total) < 1 + (t + 1) / mixing.PERIOD for s, n in counts.items())
