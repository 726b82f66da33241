"""Merged cells are inferred and laid out unit by unit: no cell is exploded, sorted and joined for itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import merges


def test_cells_are_neither_windowed_nor_joined(spark):
    rows = [(u, i, [f"n{i}" if i % 3 == 0 else "", "Total" if i % 4 == 1 else "x", str(i) if i % 2 == 0 else " - "]) for u in (1, 2, None) for i in range(6)]
    frame = spark.createDataFrame(rows, "unit int, row int, cells array<string>")
    names = spark.createDataFrame([(1, ["Name", "District", "Cases"]), (2, ["Name", "Kind", None])], "unit int, names array<string>")
    found = merges.inferred(frame, names, "unit")
    sizes = frame.groupBy("unit").agg((F.max("row") + 1).alias("n_rows")).withColumn("n_cols", F.lit(3))
    spans = merges.cell_spans(found.withColumn("ord", F.col("row")), sizes, "unit")
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (found, spans)]
    assert "Window" not in plans[0] and "windowspecdefinition" not in plans[0]
    assert sum("Join" in line for line in plans[1].splitlines()) - sum("Join" in line for line in plans[0].splitlines()) == 1
    seen = {(r.unit, r.row, r.col): (r.row_span, r.col_span) for r in spans.collect()}
    assert len([x for x in seen if x[0] is None]) == 18 and {seen[x] for x in seen if x[0] is None} == {(1, 1)}
    want = [(0, 0, 3, 1), (0, 1, 1, 1), (0, 2, 2, 1), (1, 1, 1, 2), (2, 1, 1, 1), (2, 2, 2, 1), (3, 0, 2, 1), (3, 1, 1, 2), (4, 1, 1, 1), (4, 2, 2, 1), (5, 0, 1, 1), (5, 1, 1, 2)]
    assert sorted((*x[1:], *seen[x]) for x in seen if x[0] == 1) == want
