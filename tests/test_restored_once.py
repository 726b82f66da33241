"""Restored rows come from windows over one dealing by unit; the two tables are read once each."""

from __future__ import annotations

import __spark_entry__ as entry
from quillgrid.operators import restore

KIND = "unit int, row int, cells array<string>"


def test_rows_restored_joins_nothing(spark):
    plan = entry.queries()["rows_restored"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_units_without_number_or_candidate_stay(spark):
    mine = spark.createDataFrame([(None, 0, ["a", "1", "2"]), (1, 0, ["a", "1", "2"]), (2, 0, ["a", "1", "2"])], KIND)
    theirs = spark.createDataFrame([(None, 0, ["a", "1", "2"]), (None, 1, ["b", "3", "4"]), (2, 0, ["b", "3", "4"]), (2, 1, ["a", "1", "2"])], KIND)
    got = sorted((r.unit or 0, r.row, r.cells[0], r.source) for r in restore.restored(mine, theirs, "unit").collect())
    assert got == [(0, 0, "a", "kept"), (1, 0, "a", "kept"), (2, 0, "b", "restored"), (2, 1, "a", "kept")]
