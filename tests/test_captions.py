from pyspark.sql import functions as F

from quillgrid.functions import captions


def told(spark, values, build):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in frame.select("i", build(F.col("t")).alias("x")).orderBy("i").collect()]


def test_doubled_letters(spark):
    cases = {"MMaaiinn TTaabbllee": "Main Table", "Mississippi": "Mississippi", "All Ages": "All Ages", "aabb": "aabb", "AaBbCc 11": "ABC 11", "éÉèÈaa": "éèa", "": "", None: None}
    assert told(spark, cases, captions.undoubled) == list(cases.values())


def test_broken_characters(spark):
    assert told(spark, ["ok é", "", "a�", "Ã©", "Ã", None], captions.is_garbled) == [False, True, True, True, False, False]


def test_titles(spark):
    names = F.array(F.lit("State"), F.lit("Births"), F.lit("No"))
    long = "word " * 60
    cases = {
        "  Births   by area ": "Births by area",
        "Births by area — State, Births, No": "Births by area",
        "Births by area – Sl. No.": "Births by area",
        "Births — by age and sex": "Births — by age and sex",
        "Table 4": "",
        "State of births": "",
        "Name, age / sex": "",
        " — State, Births": "",
        long: long[:220].rsplit(" ", 1)[0],
        "xy" * 150: "xy" * 110,
        None: "",
    }
    assert told(spark, cases, lambda t: captions.normal_title(t, names)) == list(cases.values())


def test_issues_of_ids_and_titles(spark):
    rows = [(None, " "), ("", "T"), ("TABLE: 1", None), ("D-1", "Table 2"), ("D-1", "Births"), ("table-1", "Births")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, t string")
    got = [r.x for r in frame.select("i", captions.id_title_issues(F.col("a"), F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [["id and title missing"], ["id missing"], ["title missing"], ["id and title swapped"], ["id without table"], []]
