"""Folds of tables shuffle what they know of units, whatever size Spark guesses."""

from __future__ import annotations

import __spark_entry__ as entry


def test_shares_folded_shuffles_every_fact_of_a_unit(spark):
    plan = entry.queries()["shares_folded"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 4
