"""Every catalogue query against DuckDB, and the operators' own edges."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators import catalogue, columns, grid, matching, publish
from quillgrid.plans import catalogue_queries
from quillgrid.sources import readers
from quillgrid.streaming import progress

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    found.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{AT}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return found


def plain(value):
    return "~" if value is None else f"{value:.6g}" if isinstance(value, float) else str(value)


def test_queries_without_sql_are_known():
    # Matching blocks and wraps of labels are beyond SQL; other tests hold these against all pairs and known grids.
    assert set(catalogue_queries.queries()) - set(catalogue_queries.oracle_sql()) == {"occupation_match", "stacked_apart", "tables_built"}


@pytest.mark.parametrize("name", sorted(catalogue_queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue_queries.queries()[name](spark, AT)
    got = df.collect()
    want = duck.execute(catalogue_queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(df.columns)
    rows = want.fetchall()
    at = {n: i for i, n in enumerate(names)}
    assert sorted(tuple(plain(r[c]) for c in order) for r in got) == sorted(tuple(plain(r[at[c]]) for c in order) for r in rows)


def test_titles(spark):
    df = spark.createDataFrame([("Births  by sex (Urban)",), ("(only)",), (None,)], "t string")
    assert [r[0] for r in df.select(T.base_title(F.col("t"))).collect()] == ["BIRTHS BY SEX", "(ONLY)", None]


def test_numbers(spark):
    cells = ["1,234", "(5.5)", "12%", "NA", "-", "x1", "", None, "7*"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [bool(r[0]) for r in df.select(T.is_numeric(F.col("c"))).collect()] == [True, True, True, False, False, False, False, False, True]


def test_filters_are_checked(spark):
    store = catalogue.as_row_store(spark.createDataFrame([(1, "50%"), (2, None), (3, "a\\b")], "k int, v string"), "k")
    assert [r.row_key for r in catalogue.filter_rows(store, ["v"], "v", contains="\\B").collect()] == [3]
    assert [r.row_key for r in catalogue.filter_rows(store, ["v"], "v", equals="50%", contains="zzz").collect()] == [1]
    for bad in ({"column": "w", "equals": "1"}, {"equals": "1"}):
        with pytest.raises(ValueError):
            catalogue.filter_rows(store, ["v"], **bad)


def test_gate():
    assert readers.gate("select 1; ") == "select 1"
    for bad in ("", "select 1; select 2", "delete from t", "select * from t where a = 'drop'", "with x as (insert into t values (1)) select 1"):
        with pytest.raises(ValueError):
            readers.gate(bad)
    assert readers.kind_of("a.XLSX") == "sheet"
    with pytest.raises(ValueError):
        readers.kind_of("a.csv", "pdf")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "a,b"), ("2", None)], "Year string, Name string")
    readers.write_csv(df, str(tmp_path / "x.csv"))
    assert sorted(map(tuple, readers.read(spark, str(tmp_path / "x.csv")).collect())) == sorted(map(tuple, df.collect()))


def test_code_list_keeps_first_entry(spark):
    rows = spark.createDataFrame([("A ",), (None,), ("z",)], "v string")
    codes = spark.createDataFrame([(2, "second", "a", "d2"), (1, "first", " A", "d1")], "ord int, code string, value string, definition string")
    assert sorted((r.v or "", r.Code) for r in catalogue.enrich_codes(rows, "v", codes).collect()) == [("", None), ("A ", "first"), ("z", None)]


def test_chain_of_components(spark):
    nodes = spark.range(40).withColumnRenamed("id", "id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 29)] + [(35, 35)], "a long, b long")
    got = {r.id: r.component for r in matching.components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 29 else i for i in range(40)}


def test_zero_vectors_are_far(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([2.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(matching.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0]


def test_empty_overlay_and_soft_delete(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    none = base.limit(0)
    assert publish.overlay(base, none, "k", ["v"], none).count() == 3
    assert all(r.deleted for r in publish.soft_delete_missing(base, none, "k").collect())


def test_wrapped_lines(spark):
    df = spark.createDataFrame([(1, 0, "heart"), (1, 1, "and lung"), (1, 2, "Total"), (2, 0, "x")], "u int, o int, t string")
    got = sorted((r.u, r.label_no, r.t) for r in grid.fold_wrapped(df, "u", "o", "t").collect())
    assert got == [(1, 1, "heart and lung"), (1, 2, "Total"), (2, 1, "x")]


def test_profile_of_placeholders(spark):
    cells = spark.createDataFrame([("t", i, "c", v) for i, v in enumerate(["1", "2", "NA", None, "word word", "x"])], "table_name string, row_key int, column_name string, value string")
    row = columns.profile(cells).first()
    assert (row.n_rows, row.fill_ratio, row.mixed) == (6, 0.667, True)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{AT}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = progress.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("progress_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    want = {tuple(r) for r in progress.windowed_counts(events).collect()}
    assert {tuple(r) for r in spark.table("progress_rows").collect()} == want
