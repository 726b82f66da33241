"""Paths of headers come from the rows on top in one pass."""

from __future__ import annotations

import __spark_entry__ as entry


def test_headers_resolved_reads_the_grids_for_widths_and_paths_only(spark):
    plan = entry.queries()["headers_resolved"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("part.parquet") <= 2 or plan.count("Relation") <= 2
    assert plan.count("strategy=merge") == 1
