from quillgrid.operators import merges

GRIDS = {
    # A total runs right over the next label column, districts run down, the footer's blank cells stay apart.
    "labels": (["Sl. No.", "District", "Sex", "Cases"], [["1", "North", "Male", "10"], ["", "", "Female", "20"], ["2", "South", "Male", "30"], ["", "", "Female", "40"], ["Total", "", "Male", "4"], ["", "", "All", "100"]]),
    "section": (["Name", "A", "B"], [["Delhi", "", "-"], ["North", "1", "2"], ["South", "3", "4"]]),
    "figures": (["Name", "Population", "Rate"], [["MCD", "500", "1.5"], ["NDMC", "", "2.5"], ["DCB", "", "3.5"], ["All India", "700", "4"]]),
    "no labels": (["A", "B"], [["1", ""], ["", "2"]]),
}


def frames(spark):
    rows = [(u, i, r) for u, (_, grid) in GRIDS.items() for i, r in enumerate(grid)]
    return spark.createDataFrame(rows, "unit string, row int, cells array<string>"), spark.createDataFrame([(u, n) for u, (n, _) in GRIDS.items()], "unit string, names array<string>")


def test_inferred_merges_of_known_bodies(spark):
    got = {}
    for r in merges.inferred(*frames(spark), "unit").collect():
        got.setdefault(r.unit, set()).add((r.row, r.col, r.row_span, r.col_span))
    assert got == {
        "labels": {(0, 0, 2, 1), (0, 1, 2, 1), (2, 0, 2, 1), (2, 1, 2, 1), (4, 0, 1, 2)},
        "section": {(0, 0, 1, 3)},
        "figures": {(0, 1, 3, 1)},
    }


def test_spans_and_merges_are_inverses(spark):
    found = merges.inferred(*frames(spark), "unit")
    sizes = spark.createDataFrame([(u, len(g), len(n)) for u, (n, g) in GRIDS.items()], "unit string, n_rows int, n_cols int")
    from pyspark.sql import functions as F

    spans = merges.cell_spans(found.withColumn("ord", F.monotonically_increasing_id()), sizes, "unit")
    assert sorted(map(tuple, merges.merges_of(spans).select(*found.columns).collect())) == sorted(map(tuple, found.collect()))
    area = {r.unit: r.n for r in spans.groupBy("unit").agg(F.sum(F.col("row_span") * F.col("col_span")).alias("n")).collect()}
    assert area == {u: len(g) * len(n) for u, (n, g) in GRIDS.items()}


def test_overlaps_outsides_and_unmerging(spark):
    rows = [(1, 1, 0, 0, 2, 2), (1, 2, 1, 1, 2, 2), (1, 3, 2, 1, 9, 1), (1, 4, 7, 0, 1, 2), (1, 5, 0, 2, None, 0)]
    frame = spark.createDataFrame(rows, "unit int, ord int, row int, col int, row_span int, col_span int")
    spans = merges.cell_spans(frame, spark.createDataFrame([(1, 3, 3), (2, 0, 4)], "unit int, n_rows int, n_cols int"), "unit")
    got = {(r.row, r.col): (r.row_span, r.col_span) for r in spans.collect()}
    assert got == {(0, 0): (2, 2), (0, 2): (1, 1), (1, 2): (1, 1), (2, 0): (1, 1), (2, 1): (9, 1), (2, 2): (1, 1)}
    left = merges.unmerged(frame, spark.createDataFrame([(1, 1, 0), (1, 5, 5)], "unit int, row int, col int"), "unit")
    assert sorted(r.ord for r in left.collect()) == [2, 3, 4, 5]


def test_empty(spark):
    none = spark.createDataFrame([], "unit int, row int, cells array<string>")
    names = spark.createDataFrame([(1, ["A"])], "unit int, names array<string>")
    assert merges.inferred(none, names, "unit").count() == 0
    assert merges.inferred(spark.createDataFrame([(1, 0, None)], none.schema), names, "unit").count() == 0
