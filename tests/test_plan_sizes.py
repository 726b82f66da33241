"""Expressions whose steps read the one before several times, which must not be written out each time."""

from __future__ import annotations

import __spark_entry__ as entry


SF = "/root/testdata/sf0.001"


def plan_size(spark, name: str) -> int:
    return len(entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString())


def test_titles_normal_writes_each_step_once(spark):
    assert plan_size(spark, "titles_normal") < 20_000


def test_stacked_apart_computes_what_comes_before_once(spark):
    assert plan_size(spark, "stacked_apart") < 90_000


def test_glued_spread_writes_each_step_once(spark):
    assert plan_size(spark, "glued_spread") < 10_000


def test_json_extracted_is_dealt_and_reads_each_object_once(spark):
    assert plan_size(spark, "json_extracted") < 5_500
    assert "Repartition" in entry.queries()["json_extracted"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
