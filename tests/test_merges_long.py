"""Runs of blank cells in long bodies: rows meet their own run only, never all runs of their unit."""

from __future__ import annotations

from quillgrid.operators import merges


def test_runs_of_a_long_body_are_not_joined_with_its_rows(spark):
    rows = [(1, i, [f"n{i}" if i % 4 == 0 else "", "Total" if i % 8 == 5 else "", str(i) if i % 2 == 0 else ""]) for i in range(4000)]
    frame = spark.createDataFrame(rows, "unit int, row int, cells array<string>")
    found = merges.inferred(frame, spark.createDataFrame([(1, ["Name", "District", "Cases"])], "unit int, names array<string>"), "unit")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and ">=" in line]
    got = [tuple(r)[1:] for r in found.collect()]
    assert len([x for x in got if x[1] == 0]) == 1000 and len([x for x in got if x[1] == 2]) == 2000
    assert {(0, 0, 4, 2), (0, 2, 2, 1), (5, 1, 3, 1)} <= set(got)
