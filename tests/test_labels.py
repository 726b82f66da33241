"""Names, labels and rows of printed tables at their edges."""

from pyspark.sql import functions as F

from quillgrid.functions import labels as L
from quillgrid.operators import columns, grid


def told(spark, values, of, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(of(F.col("v"))).collect()]


def test_nulls_have_a_result(spark):
    assert told(spark, [None], L.is_junk_name) == [True]
    assert told(spark, [None], L.is_aggregate_label) == [False]
    assert told(spark, [None], L.content_tokens) == [[]]
    assert told(spark, [None, "etc.", " and "], L.phrases) == [[""], ["."], ["and"]]
    assert told(spark, [None, "sl. no."], L.group_name) == ["Untitled group", "Sl. No."]
    assert told(spark, [None], lambda v: L.match_confidence(v, True), "double") == ["low"]
    assert told(spark, [None, []], L.is_banner, "array<string>")[1] is False


def test_plural_is_added(spark):
    assert told(spark, ["Glass cutters, others and bus crews"], L.content_tokens) == [["glass", "cutters", "cutter", "others", "bus", "crews", "crew"]]


def test_banners_only_at_the_start(spark):
    rows = [(1, ["A", None, "A "]), (2, ["B", "C", None]), (3, ["A", "A", None])]
    df = spark.createDataFrame([("t", i, c) for i, c in rows], "u string, i int, cells array<string>")
    assert sorted(r.i for r in grid.strip_banners(df, "u", "i", "cells").collect()) == [2, 3]
    assert grid.strip_banners(df.where("false"), "u", "i", "cells").collect() == []


def test_dimensions_are_no_pages_or_remarks(spark):
    rows = [("t", i, c, v) for i in range(4) for c, v in (("Remarks", f"r{i}"), ("leaf", ["i", "ii", "iv", "x"][i]), ("area", f"area {i % 2}"))]
    df = spark.createDataFrame(rows, "table_name string, row_key int, column_name string, value string")
    assert [r.dimension for r in columns.discover_dimensions(df).collect()] == ["area"]
