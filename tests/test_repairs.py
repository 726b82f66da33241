from pyspark.sql import functions as F

from quillgrid.functions import replies
from quillgrid.operators import repairs


def rows(spark, grid):
    return spark.createDataFrame([("u", i, r) for i, r in enumerate(grid)], "unit string, row int, cells array<string>")


def heads(spark, *columns):
    return spark.createDataFrame([("u", i, n, p) for i, (n, p) in enumerate(columns)], "unit string, col int, name string, path array<string>")


def read(found):
    cells, names = found
    return [r.name for r in names.orderBy("col").collect()], [r.cells for r in cells.orderBy("row").collect()]


def test_numbers_spread_where_they_fit(spark):
    cases = {
        ("a", "1 2 3", None, None): ["a", "1", "2", "3"],
        (None, None, "1 2 3", "x"): ["1", "2", "3", "x"],
        (None, "1 2 3", None, "x"): ["1", "2", "3", "x"],
        ("x", "1 2 3", None, "y"): ["x", "1 2 3", None, "y"],
        ("1 2", "", "3 4", ""): ["1", "2", "3", "4"],
        ("1 a", "", "(1.5) 20%", None): ["1 a", "", "(1.5)", "20%"],
        (None, None, None, "7 8"): [None, None, "7", "8"],
        (): [],
    }
    frame = spark.createDataFrame([(list(c),) for c in cases], "cells array<string>")
    got = [r.x for r in frame.select(repairs.spread_numbers(F.col("cells")).alias("x")).collect()]
    assert got == list(cases.values())


def test_columns_of_one_path_come_together(spark):
    grid = [["Septicae", "mia", "1", None], ["Cholera", None, None, "2"], ["Old age", "Old age", "3", "3"], ["Fever of", "unknown origin", "", "4"]]
    cause, male = ("Cause", ["Cause"]), ("Male", ["Sex", "Male"])
    names, cells = read(repairs.coalesced(rows(spark, grid[:3]), heads(spark, cause, ("Cause (2)", ["Cause"]), male, ("Male (2)", ["Sex", "Male"])), "unit"))
    assert names == ["Cause", "Male"]
    assert cells == [["Septicaemia", "1"], ["Cholera", "2"], ["Old age", "3"]]
    # Two rows with different values side by side: the columns are no split of one.
    names, cells = read(repairs.coalesced(rows(spark, grid), heads(spark, cause, ("Cause (2)", ["Cause"]), male, ("Male (2)", None)), "unit"))
    assert names == ["Cause", "Cause (2)", "Male", "Male (2)"] and cells[3] == ["Fever of", "unknown origin", None, "4"]


def test_values_move_out_of_a_parents_column(spark):
    columns = [("Name", ["Name"]), ("Births", ["Births"]), ("M", ["Births", "M"]), ("F", ["Births", "F"]), ("T", ["Births", "T"])]
    names, cells = read(repairs.without_parents(rows(spark, [["a", "1", "2", "3", None], ["b", "4", "5", "", ""], ["c", None, None, None, None]]), heads(spark, *columns), "unit"))
    assert names == ["Name", "M", "F", "T"]
    assert cells == [["a", "1", "2", "3"], ["b", "4", "5", None], ["c", None, None, None]]
    # The last column has a value, so nothing moves; a parent with values stays.
    names, cells = read(repairs.without_parents(rows(spark, [["a", "1", "2", "3", "6"], ["b", "4", "5", "", ""]]), heads(spark, *columns), "unit"))
    assert names == ["Name", "Births", "M", "F", "T"] and cells[0] == ["a", "1", "2", "3", "6"]


def test_objects_in_broken_replies(spark):
    deep = '{"a": "' + "x" * 60_000 + '\\"}", "b": {"c": 1}}'
    cases = [
        ('say {"a": "}{", "b": {"c": 1}} {"d": 2}', '{"a": "}{", "b": {"c": 1}}'),
        (deep + "}", deep),
        ('{"open": "never', None),
        ("none", None),
        ("} {}", "{}"),
        ('"{" {"a\\\\": 1}', None),
        (None, None),
        ("", None),
    ]
    frame = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r.x for r in frame.select(replies.first_object(F.col("t")).alias("x")).collect()] == [x for _, x in cases]


def test_mended_replies_can_be_read(spark):
    cases = {"```json\n{“title”: “A”, \"n\": [1, 2, ],}\n```": "A", '{"title": null}': None, "no": None, 'x {"title": {"b": 1}, } y': '{"b":1}'}
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r.title for r in frame.select(replies.fields(F.col("t"), ("title",))["title"].alias("title")).collect()] == list(cases.values())
