"""Proposals that follow on each other in one long chain."""

from __future__ import annotations

from quillgrid.operators import singletons


def test_a_chain_of_a_thousand_proposals_is_settled_in_order_without_rounds(spark):
    n = 1000
    proposals = spark.range(n).selectExpr("'s' AS scope", "id AS ord", "'high' AS confidence", "array(cast(id AS string), cast(id + 1 AS string)) AS ids")
    singles = spark.range(n + 1).selectExpr("'s' AS scope", "cast(id AS string) AS id", "'paper mill output' AS title")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    found = singletons.accepted_merges(proposals, singles).collect()
    spark.sparkContext.setJobGroup("", "")
    assert sorted((r.ord, r.ids) for r in found) == [(i, [str(i), str(i + 1)]) for i in range(0, n, 2)]
    assert len(tracker.getJobIdsForGroup("chain")) < 15
