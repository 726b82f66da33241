"""Cells are counted before they meet the kinds of their columns."""

from __future__ import annotations

from quillgrid.operators import columns


def test_only_counts_meet_kinds(spark):
    cells = spark.createDataFrame([("t", c, v) for c in "ab" for v in ("x", "y", None)], "table_name string, column_name string, value string")
    kinds = spark.createDataFrame([("t", "a", "measure"), ("t", "a", "measure"), ("t", "b", "measure"), ("t", "b", "geo")], "table_name string, column_name string, kind string")
    found = columns.alignment_issues(cells, kinds)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join") :].count("Aggregate") >= 2
    # A kind that is told twice counts its cells twice, as a join of cells would.
    assert [tuple(r) for r in found.collect()] == [("t", "a", "measure", "non_numeric_measure")]
