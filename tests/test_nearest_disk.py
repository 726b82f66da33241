"""Nearest vectors: what is shuffled doesn't grow with the number of blocks that a vector meets."""

from __future__ import annotations

import random

from quillgrid.operators import matching


def distance_of(a, b):
    norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return 1 - sum(x * y for x, y in zip(a, b)) / norm


def test_no_vector_is_copied_for_each_block(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = matching.nearest(frame, frame, 2, 10)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Cartesian" in plan and "CoGroup" not in plan
    want = sorted((q, v) for q, _ in rows for _, v in sorted((round(distance_of(dict(rows)[q], x), 6), v) for v, x in rows if v != q)[:2])
    assert sorted((r.query_id, r.vec_id) for r in found.collect()) == want


def test_ids_of_other_types_and_lengths_that_differ(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), ("a", [1.0, 0.05])]
    frame = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = {}
    for block in (2, 100):
        found = [(r.query_id, r.vec_id, r.distance) for r in matching.nearest(frame.where("vec_id = 'c'"), frame, 9, block).orderBy("rank").collect()]
        got[block] = found
        assert [x[1] for x in found] == ["b", "a", None, "a", "d"] and found[-1][2] == found[-2][2] == 1.0
    assert got[2] == got[100]
