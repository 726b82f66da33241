"""Joins of rows made from a well packed file, whose size misleads Spark into sending all of them."""

from __future__ import annotations

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def shuffled_joins(spark, name: str) -> int:
    return entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge")


def test_phantom_columns_shuffles_rows_and_cells(spark):
    assert shuffled_joins(spark, "phantom_columns") >= 4


def test_parent_columns_shuffles_rows_and_cells(spark):
    assert shuffled_joins(spark, "parent_columns") >= 5


def test_fuzzy_search_shuffles_the_words_of_tables(spark):
    assert shuffled_joins(spark, "fuzzy_search") >= 2
