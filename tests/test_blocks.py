from quillgrid.operators import blocks, rehome

LONG = "a note that is much longer than forty-eight characters in all"
DATA = ["1", "2", "3"]
SHEETS = {
    "markers": ([["intro"], ["TABLE: D-1", None], ["h", "i", "j"], DATA, [None], [LONG], ["D-2", "D-2"], ["x", "y", "z"], DATA, [], ["B 7"]], [(1, 3, 0, "marker"), (6, 8, 1, "marker")]),
    "gaps": ([["Births"], ["h", "i", "j"], DATA, [], [" "], ["Deaths", "deaths"], ["h", "i", "j"], DATA, [None], []], [(0, 2, 0, "gap"), (5, 7, 1, "gap")]),
    "decoration": ([["Births"], ["h", "i", "j"], DATA, [], [], ["x", "y"], ["1", "2"]], [(0, 6, 0, "whole")]),
    "one row": ([[], ["only"], []], [(1, 1, 0, "whole")]),
    "blank": ([[], [None, " "]], []),
    "lone marker": ([["D-1"], [], ["a", "b"]], [(0, 2, 0, "marker")]),
    "no rows behind": ([["a", "b", "c"], ["D-1"]], [(0, 1, 0, "whole")]),
}


def test_blocks_by_the_strongest_evidence(spark):
    rows = [(u, i, r) for u, (grid, _) in SHEETS.items() for i, r in enumerate(grid)]
    got = {}
    for r in blocks.chosen_blocks(spark.createDataFrame(rows, "unit string, row int, cells array<string>"), "unit").collect():
        got.setdefault(r.unit, {}).setdefault((r.block, r.chosen_by), []).append(r.row)
    for unit, (_, wanted) in SHEETS.items():
        assert sorted((min(v), max(v), *k) for k, v in got.get(unit, {}).items()) == wanted, unit
    assert blocks.chosen_blocks(spark.createDataFrame([], "unit string, row int, cells array<string>"), "unit").count() == 0


def test_only_tables_with_another_base_title_move(spark):
    members = [("s", 0, 0, "a", "Births (urban)"), ("s", 0, 1, "b", "Births"), ("s", 1, 0, "c", "Deaths"), ("s", 2, 0, "d", None), ("s", None, 0, "e", "Crops"), ("s", None, 1, "f", None), ("t", 0, 0, "a", "Births")]
    fixes = [("s", "a", "births (rural)"), ("s", "b", "Deaths (all)"), ("s", "c", "Rain"), ("s", "e", "rain (daily)"), ("s", "f", " ")]
    found = rehome.rehomed(spark.createDataFrame(members, "scope string, group_no int, place int, table_id string, title string"), spark.createDataFrame(fixes, "scope string, table_id string, title string"))
    got = {(r.scope, r.table_id): (r.group_no, r.place, r.group_name) for r in found.collect()}
    assert got == {
        ("s", "a"): (0, 0, "Births"),
        ("s", "b"): (3, 0, "Deaths"),
        ("s", "c"): (4, 0, "Rain"),
        ("s", "e"): (4, 1, "Rain"),
        ("s", "d"): (2, 0, "Untitled group"),
        ("s", "f"): (None, got["s", "f"][1], None),
        ("t", "a"): (0, 0, "Births"),
    }
