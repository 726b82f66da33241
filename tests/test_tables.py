from quillgrid.operators import tables


def grid(spark, units):
    return spark.createDataFrame([(u, i, r) for u, rows in units.items() for i, r in enumerate(rows)], "unit string, row int, cells array<string>")


def heads(spark, units):
    return spark.createDataFrame([(u, i, n, [n]) for u, names in units.items() for i, n in enumerate(names)], "unit string, col int, name string, path array<string>")


def read(frame):
    got = {}
    for r in frame.orderBy("unit", "row").collect():
        got.setdefault(r.unit, []).append([c or "" for c in r.cells])
    return got


def test_label_wraps_join_the_row_above(spark):
    rows = {
        "wraps": [["1", "Fever of", "12", "5"], ["", "unknown cause", "", ""], ["", "(R50)", "", ""], ["2", "Plague", "7", "8"], ["", "Other Title here", "", ""], ["", "and more", "", ""], ["3", "Ague", "1", "2"]],
        "narrow": [["a", "1"], ["b c", ""]],
        "first": [["", "starts low", "", ""], ["", "goes on", "", ""], ["1", "A", "2000", "3000"], ["2", "B", "2000", "3000"], ["3", "C", "2000", "3000"]],
    }
    names = {"wraps": ["S. No.", "Cause", "M", "F"], "narrow": ["x", "y"], "first": ["S. No.", "Cause", "M", "F"]}
    got = read(tables.wraps_folded(grid(spark, rows), heads(spark, names), "unit"))
    assert got["wraps"] == [["1", "Fever ofunknown cause (R50)", "12", "5"], ["2", "Plague", "7", "8"], ["", "Other Title hereand more", "", ""], ["3", "Ague", "1", "2"]]
    assert got["narrow"] == rows["narrow"]
    assert got["first"][0] == ["", "starts lowgoes on", "", ""] and len(got["first"]) == 4


def test_sparse_shares_join_the_figures_above(spark):
    rows = {
        "sparse": [["A", "10", "20", "30"], ["", "", "(5.5)", "-"], ["", "(1)", "", ""], ["B", "11", "21", "31"], ["", "(1.1)", "(2.2)", "(3.3)"], ["C", "x", "", ""], ["", "(9)", "", ""]],
        "lead": [["", "(1)", "", ""], ["D", "1", "2", "3"]],
    }
    got = read(tables.shares_folded(grid(spark, rows), heads(spark, {u: ["Name", "a", "b", "c"] for u in rows}), "unit"))
    assert got["sparse"] == [["A", "10 (1)", "20 (5.5)", "30"], ["B", "11", "21", "31"], ["", "(1.1)", "(2.2)", "(3.3)"], ["C", "x", "", ""], ["", "(9)", "", ""]]
    assert got["lead"] == rows["lead"]


def test_a_grid_becomes_a_table(spark):
    rows = {
        "deaths": [
            ["TABLE: D-1", None, None, None, None],
            ["S.No.", "Name of the Disease", "Sex", "Deaths", None],
            [None, None, None, "2001", "2011"],
            ["(1)", "(2)", "(3)", "(4)", "(5)"],
            ["1\n2", "Cholera (A00)\nPlague (A20)", "M\nF\nM\nF", "120\n230\n340\n450", "100\n200\n300\n400"],
            [None, None, None, None, None],
            ["3", "Ague", "M", "500 600", None],
        ]
    }
    found, columns = tables.built(grid(spark, rows), "unit")
    assert [(r.name, r.path) for r in columns.orderBy("col").collect()] == [("S.No.", ["S.No."]), ("Name of the Disease", ["Name of the Disease"]), ("Sex", ["Sex"]), ("2001", ["Deaths", "2001"]), ("2011", ["Deaths", "2011"])]
    assert read(found)["deaths"] == [
        ["(1)", "(2)", "(3)", "(4)", "(5)"],
        ["1", "Cholera (A00)", "M", "120", "100"],
        ["", "", "F", "230", "200"],
        ["2", "Plague (A20)", "M", "340", "300"],
        ["", "", "F", "450", "400"],
        ["3", "Ague", "M", "500", "600"],
    ]
    assert tables.built(grid(spark, {}), "unit")[0].count() == 0
