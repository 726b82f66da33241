from quillgrid.operators import headers

GRIDS = {
    "groups filled": ([["State", "URBAN", "URBAN", "RURAL", "RURAL"], ["State", "Male", "Female", "Male", "Female"], ["01", "10", "20", "30", "40"]], 2, ["State", "URBAN / Male", "URBAN / Female", "RURAL / Male", "RURAL / Female"]),
    "one row": ([["Scheme name", "Beneficiaries", "Budget", "Year"], ["S1", "100", "2000", "2020"]], 1, ["Scheme name", "Beneficiaries", "Budget", "Year"]),
    "banner, blanks, strip": (
        [["TABLE: B-10"] * 5, ["Sl. No.", "State", "Births", None, None], [None, None, "2001", "2011", "2021"], ["(1)", "(2)", "(3)", "(4)", "(5)"], ["1", "Assam", "1200", "3400", "990"]],
        3,
        ["Sl. No.", "State", "Births / 2001", "Births / 2011", "Births / 2021"],
    ),
    "three levels": (
        [["Area", "Workers", "", "", ""], ["", "Main", "", "Marginal", ""], ["", "Male", "Female", "Male", "Female"], ["Goa", "120", "130", "140", "150"]],
        3,
        ["Area", "Workers / Main / Male", "Workers / Main / Female", "Workers / Marginal / Male", "Workers / Marginal / Female"],
    ),
    "lost codes": ([["Mother", "BIRTH ORDER", None, None], ["A", "12", "345", "600"]], 1, ["Mother", "BIRTH ORDER / 1", "BIRTH ORDER / 2", "BIRTH ORDER / 3"]),
    "no labels": ([["12", "300", "450"], ["13", "301", "451"]], 1, ["12", "300", "450"]),
    "blank only": ([[None, ""], ["nan", " "]], 1, ["Col_1", "Col_2"]),
    "repeated": ([["Name", "Rate", "Share", "Rate"], ["x", "120", "130", "140"]], 1, ["Name", "Rate", "Share", "Rate (2)"]),
    "ragged": ([["Name", "Total"], ["x", "120", "130"]], 1, ["Name", "Total", "Total (2)"]),
}


def test_headers_of_known_grids(spark):
    rows = [(u, i, r) for u, (grid, _, _) in GRIDS.items() for i, r in enumerate(grid)]
    found = headers.headers_resolved(spark.createDataFrame(rows, "unit string, i int, c array<string>"), "unit", "i", "c").collect()
    for unit, (_, count, names) in GRIDS.items():
        own = sorted((r for r in found if r.unit == unit), key=lambda r: r.col)
        assert {r.header_count for r in own} == {count}, unit
        assert [r.unique_name for r in own] == names, unit


def test_null_rows_and_no_rows(spark):
    shape = "unit int, i int, c array<string>"
    assert headers.headers_resolved(spark.createDataFrame([], shape), "unit", "i", "c").count() == 0
    found = headers.headers_resolved(spark.createDataFrame([(1, 0, None), (1, 1, ["A", "B"])], shape), "unit", "i", "c")
    assert [r.name for r in found.orderBy("col").collect()] == ["A", "B"]
