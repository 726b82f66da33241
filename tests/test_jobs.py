from pyspark.sql import functions as F

from quillgrid.operators import jobs


def test_serials_and_names_of_cells(spark):
    cases = [
        (["Name", "S.No."], ["a", "7"], "7"), (["S.No.", "sl_no"], ["7", None], "None"), (["a"], ["12"], "12"), (["a"], ["x"], "4"), ([], [], "4"), (["a", "b"], [None], "4"), (["", "x"], ["1", "2", "3"], "1"),
    ]
    frame = spark.createDataFrame([(c, r) for c, r, _ in cases], "c array<string>, r array<string>")
    got = frame.select(jobs.serial(F.col("c"), F.col("r"), F.lit(3)).alias("s"), jobs.named_cells(F.col("c"), F.col("r")).alias("m")).collect()
    assert [r.s for r in got] == [s for _, _, s in cases]
    assert got[-1].m == {"column_1": "1", "x": "2"} and got[5].m == {"a": None, "b": None}


def test_empty_tables_leave_their_dataset_without_rows(spark):
    old = spark.createDataFrame([("a", 0, "1", {"x": "1"}), ("b", 0, "1", {"x": "2"})], "dataset_id string, row_index int, sl_no string, row_data map<string,string>")
    new = spark.createDataFrame([("a", ["x"], []), ("c", ["x"], [["9"], None])], "dataset_id string, columns array<string>, rows array<array<string>>")
    got = sorted((r.dataset_id, r.row_index, r.sl_no) for r in jobs.replaced_rows(old, new).collect())
    assert [g[:2] for g in got] == [("b", 0), ("c", 0), ("c", 1)] and got[1][2] == "9"


def test_tables_die_and_come_back(spark):
    now = F.to_timestamp(F.lit("2024-02-01"))
    shape = "job_id string, table_id string, page int"
    current = spark.createDataFrame([("j", "old", 1), ("j", "kept", 2), ("k", "other", 1)], shape).withColumns({"deleted_at": F.when(F.col("table_id") == "kept", F.to_timestamp(F.lit("2024-01-01"))), "updated_at": F.to_timestamp(F.lit("2024-01-01"))})
    given = spark.createDataFrame([("j", "kept", 5, 1), ("j", "kept", 6, 2), ("j", "", 1, 3), ("e", None, 1, 4)], shape + ", ord int")
    got = {(r.job_id, r.table_id): (r.page, r.deleted_at is None) for r in jobs.approved(current, given, now).collect()}
    assert got == {("j", "kept"): (6, True), ("j", "old"): (1, False), ("k", "other"): (1, True)}
    alive = jobs.active(jobs.approved(current, given, now))
    assert sorted((r.table_id, r.place) for r in alive.collect()) == [("kept", 0), ("other", 0)]
    groups = jobs.saved_groups(spark.createDataFrame([], "job_id string, sort_order int, name string, table_ids array<string>"), spark.createDataFrame([("j", 3, None, ["kept", "gone"]), ("j", 9, " x ", [])], "job_id string, sort_order int, name string, table_ids array<string>"))
    loaded = sorted((r.job_id, r.sort_order is None, r.sort_order, r.name, r.table_ids) for r in jobs.loaded_groups(groups, alive).collect())
    assert loaded == [("j", False, 0, "Group 1", ["kept"]), ("j", False, 1, "x", []), ("k", True, None, None, ["other"])]
