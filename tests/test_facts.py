from pyspark.sql import functions as F

from quillgrid.operators import catalogue, facts


def test_row_dimensions(spark):
    columns = {
        "Sl No": ["a", "b", "a"],
        "Age group": ["1", "2", "60+"],
        "Age": ["1", "2", "3"],
        "Unit": ["kg", "KG", "kg", " ", None],
        "Unique": ["x", "y", "z"],
        "Constant": ["x", "x"],
        "Mostly numbers": ["1", "1", "2", "x"],
        "Many": [f"v{i % 40}" for i in range(80)],
        "Too many": [f"v{i % 41}" for i in range(80)],
    }
    cells = spark.createDataFrame([("t", c, v) for c, values in columns.items() for v in values], "table_name string, column_name string, value string")
    got = {r.column_name: r.category_values for r in facts.row_dimensions(cells).collect()}
    assert set(got) == {"Age group", "Unit", "Many"}
    assert got["Age group"] == ["60+"] and got["Unit"] == ["KG", "kg"] and len(got["Many"]) == 40
    assert facts.row_dimensions(cells.where("false")).count() == 0


def test_text_facts(spark):
    texts = ["Births by State, 2001-02 and 2011–2012 (in Lakh) (note) B-12 b-12", "12001 statewide (%)", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*(c.alias(n) for n, c in facts.text_facts(F.col("t")).items())).collect()
    assert rows[0].asDict() == {"years": ["2001", "2011", "2012"], "year_ranges": ["2001-02", "2011–2012"], "units": ["in Lakh"], "codes": ["B-12"], "places": ["STATE"]}
    assert rows[1].units == ["%"] and rows[1].years == [] and rows[1].places == []
    assert all(v == [] for r in rows[2:] for v in r)


def test_search_pages_count_all(spark):
    items = spark.createDataFrame([(i, f"Births {i}", "r1" if i % 2 else None) for i in range(9)], "id int, title string, release string")
    found = catalogue.search_page(items, "BIRTHS", ["title"], [F.col("id")], offset=2, limit=3)
    assert [(r.id, r.total) for r in found.collect()] == [(2, 9), (3, 9), (4, 9)]
    assert [(r.id, r.total) for r in catalogue.search_page(items, "", ["title"], [F.col("id")], release=" r1 ").collect()] == [(i, 4) for i in (1, 3, 5, 7)]
    assert catalogue.search_page(items, "deaths", ["title"], [F.col("id")]).count() == 0
