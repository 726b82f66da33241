import random

import pytest

from quillgrid.operators import columns, matching
from quillgrid.sources import readers


def test_the_gate_leaves_quoted_texts_alone():
    assert readers.gate("SELECT '-- x' AS a, \"/* y */\" /* gone */ FROM t -- end\n;") == "SELECT '-- x' AS a, \"/* y */\"   FROM t"
    assert readers.gate("VALUES (1)") == "VALUES (1)"


@pytest.mark.parametrize("text", ["", None, "select 1; select 2", "SET  ROLE x", "with a as (select 1) execute b", "EXPLAIN  ANALYZE select 1", "select do from t", "explain set\nsession x", "select 'drop'", "merge into a"])
def test_the_gate_refuses(text):
    with pytest.raises(ValueError):
        readers.gate(text)


def brute(queries, vectors, k):
    def unit(v):
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    out = {}
    for i, q in queries:
        if q is None:
            continue
        far = []
        for j, v in vectors:
            if v is not None and j != i:
                far.append((round(1 - sum(x * y for x, y in zip(unit(q), unit(v))), 6) if len(q) == len(v) else 1.0, j))
        out[i] = [j for _, j in sorted(far)[:k]]
    return out


def test_nearest_equals_brute_force_in_any_blocks(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(90)] + [(200, None), (201, [1.0]), (202, [0.0, 0.0, 0.0]), (203, [])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    asked = frame.where("vec_id % 3 = 0 or vec_id >= 200")
    want = brute([x for x in vectors if x[0] % 3 == 0 or x[0] >= 200], vectors, 4)
    for block in (4096, 7):
        got = {}
        for r in matching.nearest(asked, frame, 4, block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want
    assert matching.nearest(frame.where("false"), frame, 4).count() == 0


def test_equal_columns_have_equal_sets(spark):
    cells = [("t", c, v) for c, values in {"a": "xyz", "b": "ZYX", "c": "xyw", "d": "xx"}.items() for v in values] + [("u", "e", "x"), ("u", "e", " ")]
    found = columns.equivalent_columns(spark.createDataFrame(cells, "table_name string, column_name string, value string")).collect()
    assert sorted((r.members, r.n_columns, r.n_values) for r in found) == [("t.a,t.b", 2, 3), ("t.d,u.e", 2, 1)]
