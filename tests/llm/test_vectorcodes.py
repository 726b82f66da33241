import hashlib
import random

import numpy as np
import pytest

from quillgrid.llm import queries, vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def floor_parts(vector, parts):
    whole = [int(np.floor(256 * np.float64(np.float32(x)))) for x in vector]
    wide = len(whole) // parts
    return [whole[i * wide : (i + 1) * wide] for i in range(parts)]


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract, one part at a time, in plain Python."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    cut = [floor_parts(v, parts) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: kept[k][0])[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def assign(p):
        return [min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for c in cut]

    for _ in range(rounds):
        for p in range(parts):
            codes = assign(p)
            for e in range(len(books[p])):
                own = [c[p] for c, code in zip(cut, codes) if code == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    codes = list(zip(*(assign(p) for p in range(parts))))
    errors = [sum(far(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes)]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{c:02x}" for c in code), error, by_label[label], sha) for (i, _, label), code, error in zip(kept, codes, errors))


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, l, "clash") for i, v, l in rows], SCHEMA).repartition(5)
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectorcodes.compressed(df, **how).collect())


def test_equals_brute_force_with_ties_repeats_and_bad_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(200)]  # one vector very often
    rows += [(2000 + i, [rng.choice([0.0, 1 / 256]) for _ in range(32)], 3) for i in range(100)]  # ties
    rows += [(3000, None, 1), (3001, [float("nan")] + [0.0] * 31, 1), (3002, [None] + [0.0] * 31, 2), (3003, [float("inf")] + [0.0] * 31, None)]
    rows += [(5, rows[5][1], 1)]  # a repeated row
    assert run(spark, rows) == brute(rows)


def test_fewer_rows_than_entries_and_one_row(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(16)], None) for i in range(9)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == brute(rows[:1])


def test_empty_and_unusable(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1), (2, [], 1), (3, [1.0] * 15, 1)]) == []


def test_vectors_of_other_lengths_are_left_out(spark):
    rows = [(i, [0.1 * i] * 16, 1) for i in range(3)]
    assert run(spark, rows + [(9, [0.5] * 32, 1)]) == brute(rows)


def test_components_too_large_are_refused(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e9] * 16, 1)])


def test_subtrees_are_assigned_whole():
    rng = np.random.default_rng(0)
    points = rng.integers(-40, 40, (5000, 4))
    entries = points[:64].copy()
    codes, sums, counts = vectorcodes.filtered(points, entries)
    far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (codes == far.argmin(axis=1)).all()
    assert (counts == np.bincount(codes, minlength=64)).all()
    assert all((sums[e] == points[codes == e].sum(axis=0)).all() for e in range(64))
    # Two well separated groups never come to single comparisons.
    apart = np.concatenate([rng.integers(0, 5, (3000, 4)), rng.integers(1000, 1005, (3000, 4))])
    order, levels = vectorcodes.kd_tree(apart)
    low, high = levels[1].low, levels[1].high
    left = vectorcodes.surviving(low, high, np.array([[2] * 4, [1002] * 4]), np.ones((2, 2), bool))
    assert left.sum() == 2


def test_query_equals_brute_force(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    got = queries.QUERIES["op11_vector_codes"](spark, at)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
