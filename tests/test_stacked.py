from pyspark.sql import functions as F

from quillgrid.functions import stacks
from quillgrid.operators import stacked

HEAD = ["S.No.", "Name of the Disease", "Sex", "<1", "Total"]
CASES = {
    "continuation": (
        [HEAD, ["1\n1\n2", "INTESTINAL INFECTIOUS DISEASES (A00-A09)\nCholera (A00)\nTyphoid Fever (A01)", "M\nF\nM\nF\nM\nF", "59", "195"], ["", "", "", "35\n0\n0\n0\n1", "154\n1\n2\n9\n11"]],
        [["1", "INTESTINAL INFECTIOUS DISEASES (A00-A09)", "M", "59", "195"], [None, None, "F", "35", "154"], ["1", "Cholera (A00)", "M", "0", "1"], [None, None, "F", "0", "2"], ["2", "Typhoid Fever (A01)", "M", "0", "9"], [None, None, "F", "1", "11"]],
    ),
    "glued digits": (
        [HEAD, ["12", "Cholera (A00)\nPlague (A20)", "M\nF\nM\nF", "3 5 0 1", "8 4 9 5"]],
        [["1", "Cholera (A00)", "M", "3", "8"], [None, None, "F", "5", "4"], ["2", "Plague (A20)", "M", "0", "9"], [None, None, "F", "1", "5"]],
    ),
    "lone total": ([HEAD, ["1", "Cholera (A00)\nPlague (A20)", "M\nF\nM\nF", None, "1955"]], [["1", "Cholera (A00)", "M", None, "1955"], [None, None, "F", None, None], [None, "Plague (A20)", "M", None, None], [None, None, "F", None, None]]),
    "fewer sexes": (
        [HEAD, ["1\n2\n3", "Cholera\nTyphoid\nPlague", "M\nF", "0\n1\n2\n3\n4\n5", "10\n11\n12\n13\n14\n15"]],
        [["1", "Cholera", "M", "0", "10"], ["2", "Typhoid", "F", "1", "11"], ["3", "Plague", None, "2", "12"], [None, None, None, "3", "13"], [None, None, None, "4", "14"], [None, None, None, "5", "15"]],
    ),
    "shares": ([HEAD, ["1", "A", "M\nF", "7\n(1.5)\n8\n(2.5)", "9\n10"]], [["1", "A", "M", "7\n(1.5)", "9"], [None, None, "F", "8\n(2.5)", "10"]]),
    "glued sexes": (
        [HEAD, ["6\n1", "Protozoal diseases (B50-B64)\nMalaria (B50-B54)", "M\nF\n0M\nF", "1\n2\n3\n4", "95\n47\n90\n42"]],
        [["6", "Protozoal diseases (B50-B64)", "M", "1", "95"], [None, None, "F", "2", "47"], ["1", "Malaria (B50-B54)", "M", "3", "90"], [None, None, "F", "4", "42"]],
    ),
    "slipped label": (
        [HEAD, ["8", "Septicaemia (A40-A41)", "M", "1", "2"], [None, "Plague of the old", "F", "3", "4"], ["9", "(A20)", "M", "5", "6"]],
        [["8", "Septicaemia (A40-A41)", "M", "1", "2"], [None, None, "F", "3", "4"], ["9", "Plague of the old (A20)", "M", "5", "6"]],
    ),
    "no sexes": (
        [["Cause", "North", "South"], ["Fever of\nunknown cause\nTetanus neonatorum such as\nlockjaw", "1\n2", "3\n4"], ["plain", "5", "6"]],
        [["Fever of unknown cause", "1", "3"], ["Tetanus neonatorum such as lockjaw", "2", "4"], ["plain", "5", "6"]],
    ),
    "two columns": ([["Sex", "N"], ["M\nF", "1\n2"]], [["M\nF", "1\n2"]]),
}


def test_known_grids(spark):
    rows = [(u, i, r) for u, (grid, _) in CASES.items() for i, r in enumerate(grid)]
    got = {}
    for r in stacked.expanded(spark.createDataFrame(rows, "unit string, row int, cells array<string>"), "unit").orderBy("unit", "row").collect():
        got.setdefault(r.unit, []).append(r.cells)
    for unit, (grid, wanted) in CASES.items():
        assert got[unit] == [grid[0], *wanted], unit
    assert stacked.expanded(spark.createDataFrame([], "unit string, row int, cells array<string>"), "unit").count() == 0


def test_wraps_of_long_titles_stay_with_their_pair(spark):
    parts = [
        "Protozoal diseases (B50-B64)", "Malaria (B50-B54", "All other types of protozoal diseases (B55-B64)", "Other certain infectious and pasastic",
        "diseases & late effect of infectious and", "parasitic diseases (A65-A69 & A75-A79, B35-", "B49 B65-B94 & B99)", "Filariasis (B74)",
    ]
    frame = spark.createDataFrame([(parts, 5), (["Diarrhoea of presume", "infectious origin (A09)"], 1), (["A", "B", "C D (X1) e f"], 1)], "p array<string>, n int")
    out = [r.x for r in frame.select(stacks.labels_on_pairs(F.col("p"), F.col("n")).alias("x")).collect()]
    assert out[0][::2] == [parts[0], parts[1], parts[2], parts[3], parts[7]] and out[0][7] == " ".join(parts[4:7]) and out[0][1::2].count(None) == 4
    assert out[1] == ["Diarrhoea of presume", "infectious origin (A09)"]
    assert out[2] == ["A", "B C D (X1) e f"]


def test_neighbours_join_by_the_lowest_score(spark):
    frame = spark.createDataFrame([(["Ulcer of stomach and", "Duodenum", "Long title here", "Another long title"], 3), (["Aaaaa bbbbb", "Ccccc ddddd", "Pregnancy"], 2), (["a"], 3), ([], 2)], "p array<string>, n int")
    out = [r.x for r in frame.select(stacks.labels_on_rows(F.col("p"), F.col("n")).alias("x")).collect()]
    assert out == [["Ulcer of stomach and Duodenum", "Long title here", "Another long title"], ["Aaaaa bbbbb", "Ccccc ddddd Pregnancy"], ["a", None, None], [None, None]]


def test_sexes_line_by_line(spark):
    cases = {("M\nF\n?\nF", 4): ["M", "F", "M", "F"], ("M\n\nM\nF", 4): ["M", "F", "M", "F"], ("M F", 2): ["M", "F"], ("F", 3): ["F", None, None], (None, 2): [None, None], ("0M\nF3", 2): ["M", "F"]}
    frame = spark.createDataFrame(list(cases), "c string, n int")
    assert [r.x for r in frame.select(stacks.sexes_on_rows(F.col("c"), F.col("n")).alias("x")).collect()] == list(cases.values())
