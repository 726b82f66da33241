"""Nearest vectors meet block by block: no query goes through the driver, and a limit of distance cuts before anything is ranked."""

from __future__ import annotations

from pyspark.sql.classic.dataframe import DataFrame as Classic

from quillgrid.operators import matching


def test_queries_stay_off_the_driver_and_limits_hold(spark, monkeypatch):
    def refused(self):
        raise AssertionError("queries on the driver")

    monkeypatch.setattr(Classic, "toArrow", refused)
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(i, [0.0, 1.0]) for i in range(30, 33)] + [(40, [1.0, 1.0]), (41, [None, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in matching.nearest(frame, frame, 2, 8, most=0.2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    assert got[0] == [(1, 0.0), (2, 0.0)] and got[1] == [(0, 0.0), (2, 0.0)] and got[29] == [(0, 0.0), (1, 0.0)]
    assert got[31] == [(30, 0.0), (32, 0.0)]
    assert 40 not in got and 41 not in got
