from quillgrid.operators import inventory

TABLES = "scope int, ord long, id string, table_id string, title string, sheet string, source_file string"
ITEMS = "scope int, ord long, workbook string, unique_dataset_id string, table_id string, short_description string"


def test_tiers_in_order_each_row_once(spark):
    tables = [
        (1, 1, "A-1_2021_V1", None, "Births (urban)", "s", "f1"),
        (1, 2, "a1_2021_v1", None, "Births (rural)", "s", "f2"),  # the same id again: its row is taken, its title groups it
        (1, 3, "B_2_1999_X", None, "Deaths", "s", "f3"),  # stem
        (1, 4, None, "Table C-3 (old)", "Marriages of hindus", "s (ii)", "f4"),  # code and sheet
        (1, 5, "x", "D-4", "Workers by religion", "s", "f5"),  # two rows of one code, told by a word
        (1, 6, "y", "D-4", "nothing said", "s", "f5"),  # the one that is left
        (1, 7, "z", "E-5", "no word", "s", "f9"),  # two rows, no word
        (1, 8, None, None, None, None, None),
        (2, 1, "A-1_2021_V1", None, "other scope", "s", "f1"),
    ]
    items = [
        (1, 1, "w1", "A1_2021_V1", None, None),
        (1, 2, "w2", "B2_2020_V1", "", "d"),
        (1, 3, "w2", None, "c-32", "d"),
        (1, 4, "w3", "", "D 4", "workers religion"),
        (1, 5, "w3", "", "d4", "workers education"),
        (1, 6, "w4", "", "e5", "alike"),
        (1, 7, "w4", "", "E-5", "alike"),
    ]
    found = inventory.matched(spark.createDataFrame(tables, TABLES), spark.createDataFrame(items, ITEMS))
    got = {(r.scope, r.ord): (r.item, r.workbook, r.confidence) for r in found.collect()}
    assert got == {
        (1, 1): (1, "w1", "exact"),
        (1, 2): (None, "w1", "grouped"),
        (1, 3): (2, "w2", "stem"),
        (1, 4): (3, "w2", "code"),
        (1, 5): (4, "w3", "code+keyword"),
        (1, 6): (5, "w3", "code"),
        (1, 7): (None, None, "ambiguous"),
        (1, 8): (None, None, "none"),
        (2, 1): (None, None, "none"),
    }
    assert sorted(r.ord for r in inventory.unmatched_items(spark.createDataFrame(items, ITEMS), found).collect()) == [6, 7]


def test_empty_sides(spark):
    none_t, none_i = spark.createDataFrame([], TABLES), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, 1, "A", "T", "t", "s", "f")], TABLES)
    assert inventory.matched(none_t, none_i).count() == 0
    assert [(r.item, r.confidence) for r in inventory.matched(one, none_i).collect()] == [(None, "none")]


def test_a_key_that_no_row_has_links_no_tables(spark, monkeypatch):
    tables = [(1, k, "w_1", None, "t", "s", "f") for k in range(50)] + [(1, 50, "A_1", None, "t", "s", "f")]
    items = [(1, 1, "w", "A_1", None, None), (1, 2, "w", "B_1", "b1", None), (1, 3, "w", "B_1", "b1", None)]
    seen, components = [], inventory.components
    monkeypatch.setattr(inventory, "components", lambda nodes, edges: seen.append(edges.count()) or components(nodes, edges))
    found = inventory.matched(spark.createDataFrame(tables, TABLES), spark.createDataFrame(items, ITEMS))
    assert [(r.ord, r.item) for r in found.where("item is not null").collect()] == [(50, 1)]
    assert seen == [1]
