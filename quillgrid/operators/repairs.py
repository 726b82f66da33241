"""Repairs of extracted grids: glued numbers spread, split columns put together, values shifted out of a parent's column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions import cells as C
from quillgrid.functions.stacks import let, steps
from quillgrid.session import unsent

#: What a reader puts behind the second and later of equal names.
NUMBERED = r"\s*\([0-9]+\)\s*$"


def in_a_row(flags: Column) -> Column:
    """How many flags at the start of an array are true."""
    return let({"flags": flags}, lambda x: F.coalesce(F.nullif(F.array_position(x["flags"], False), F.lit(0)) - 1, F.size(x["flags"])).cast("int"))


def spread_numbers(cells: Column) -> Column:
    """cells with numbers glued into one spread over blank neighbours: those after it, else those before it, else both.

    A cell counts as glued if it is two numbers or more with blanks between. Over both sides the numbers end with the last blank cell.
    What doesn't fit stays. Cells are taken from the left, and what one has filled is no longer blank for the next.
    """
    kind = "struct<cells:array<string>,next:int>"

    def step(state: Column, j: Column) -> Column:
        def parted(x: Column) -> dict[str, Column]:
            # Nothing is looked for around a cell that is filled already or no glued numbers.
            parts = F.when(j >= state["next"], F.split(C.canonical(F.get(state["cells"], j)), " "))
            return {"parts": parts}

        def looked(x: Column) -> dict[str, Column]:
            glued = (F.size(x["parts"]) >= 2) & F.forall(x["parts"], lambda p: C.size_of(p).isNotNull())
            return {"parts": F.when(glued, x["parts"])}

        def counted(x: Column) -> dict[str, Column]:
            blank = F.when(x["parts"].isNotNull(), F.transform(state["cells"], lambda c: C.canonical(c) == ""))
            return {"parts": x["parts"], "n": F.size(x["parts"]), "blank": blank}

        def bounded(x: Column) -> dict[str, Column]:
            after, before = in_a_row(F.slice(x["blank"], j + 2, F.size(x["blank"]))), in_a_row(F.reverse(F.slice(x["blank"], F.lit(1), j)))
            return {"parts": x["parts"], "n": x["n"], "after": after, "before": before}

        def placed(x: Column) -> dict[str, Column]:
            n, after, before = x["n"], x["after"], x["before"]
            start = F.when(n <= after + 1, j).when(n <= before + 1, j - n + 1).when(n <= before + after + 1, j + after - n + 1)
            return {"parts": x["parts"], "n": n, "start": F.when(x["parts"].isNotNull(), start)}

        def filled(x: Column) -> Column:
            now = F.transform(state["cells"], lambda c, i: F.when((i >= x["start"]) & (i < x["start"] + x["n"]), F.get(x["parts"], i - x["start"])).otherwise(c))
            return F.when(x["start"].isNotNull(), F.named_struct(F.lit("cells"), now, F.lit("next"), x["start"] + x["n"]).cast(kind)).otherwise(state)

        return steps({"at": j}, parted, looked, counted, bounded, placed, body=filled)

    begin = F.named_struct(F.lit("cells"), cells, F.lit("next"), F.lit(0)).cast(kind)
    places = F.when(F.size(cells) > 0, F.sequence(F.lit(0), F.size(cells) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, begin, step, lambda s: s["cells"])


def joined_text(a: Column, b: Column) -> Column:
    """Two pieces of one cell as one: the longer where it holds the other, a word's tail set on, else with a blank between."""
    first = F.left(b, F.lit(1))
    tail = F.right(a, F.lit(1)).rlike(r"[\p{L}\p{N}]") & first.rlike(r"[\p{L}\p{N}]") & (first.rlike(r"\p{Ll}") | ((F.length(b) <= 6) & ~F.contains(b, F.lit(" ")) & ~first.rlike("[0-9]")))
    return F.when(a == "", b).when((b == "") | F.contains(a, b), a).when(F.contains(b, a), b).when(tail, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def bare_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), NUMBERED, ""))


def long_cells(rows: DataFrame, unit: str) -> DataFrame:
    return rows.select(unit, "row", F.posexplode("cells").alias("col", "text")).withColumn("text", C.canonical(F.col("text")))


def coalesced(rows: DataFrame, columns: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """rows and columns in which neighbouring columns of one header path are one.

    rows: unit, row and cells; columns: unit, col, name and path (an array of text; where it is blank the name without its number
    counts). Columns of which two rows or more hold different values side by side stay apart. A joined column has the first
    one's name without its number, and each row's pieces from left to right. Blank cells come out as null. Cells beyond the
    columns are left out.
    """
    said = F.filter(F.transform(F.coalesce("path", F.array().cast("array<string>")), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    key = F.when(F.size(said) > 0, F.array_join(said, "\u0001")).otherwise(F.lower(bare_name(F.col("name"))))
    along = W.partitionBy(unit).orderBy("col")
    keyed = columns.select(unit, "col", "name", "path", key.alias("key"))
    keyed = keyed.withColumn("run", F.sum(F.coalesce((F.col("key") != F.lag("key").over(along)).cast("int"), F.lit(1))).over(along))
    wide = keyed.groupBy(unit, "run").agg(F.count(F.lit(1)).alias("wide"))
    each = long_cells(rows, unit).join(unsent(keyed.select(unit, "col", "run")), [unit, "col"])
    differ = each.where("text <> ''").groupBy(unit, "run", "row").agg(F.countDistinct("text").alias("d")).where("d >= 2")
    apart = differ.groupBy(unit, "run").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(unit, "run", F.lit(True).alias("apart"))
    runs = wide.join(unsent(apart), [unit, "run"], "left").select(unit, "run", (F.col("apart").isNotNull() | (F.col("wide") == 1)).alias("alone"), "wide")
    placed = keyed.join(unsent(runs), [unit, "run"]).withColumn("new", F.dense_rank().over(W.partitionBy(unit).orderBy("run", F.when(F.col("alone"), F.col("col")).otherwise(-1))) - 1)
    name = F.when(F.col("alone") | (bare_name(F.col("name")) == ""), F.col("name")).otherwise(bare_name(F.col("name")))
    heads = placed.groupBy(unit, F.col("new").alias("col")).agg(F.min_by(F.struct(name.alias("name"), "path"), "col").alias("x")).select(unit, "col", "x.*")
    pieces = each.drop("run").join(unsent(placed.select(unit, "col", "new")), [unit, "col"]).groupBy(unit, "row", "new").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("p"))
    merged = pieces.select(unit, "row", F.col("new").alias("col"), F.aggregate("p", F.lit(""), lambda a, x: joined_text(a, x["text"])).alias("text"))
    return as_rows(merged, unit), heads


def as_rows(cells: DataFrame, unit: str) -> DataFrame:
    """unit, row and cells from cells one by one (unit, row, col from 0 and text); blank and missing ones are null."""
    width = cells.groupBy(unit).agg((F.max("col") + 1).alias("w"))
    held = cells.groupBy(unit, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m")).join(unsent(width), unit)
    return held.select(unit, "row", F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda c: F.nullif(F.col("m")[c], F.lit(""))).alias("cells"))


def without_parents(rows: DataFrame, columns: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """rows and columns without blank columns that only name the group of others.

    A column that heads a group of two or more columns right behind it, has two values or more, and before whose last column none
    has any, holds its group's values one place too far left: they move right. Then a blank column named as a group goes,
    unless all would. columns: unit, col, name and path, whose last but one label is the group.
    """
    group = F.lower(F.trim(F.when(F.size("path") > 1, F.element_at("path", -2)).otherwise("")))
    named = columns.select(unit, "col", "name", "path", F.lower(bare_name(F.col("name"))).alias("low"), group.alias("group"))
    named = named.withColumn("under", F.when((F.col("group") != "") & (F.col("group") != F.col("low")), F.col("group")))
    along = W.partitionBy(unit).orderBy("col")
    named = named.withColumn("run", F.sum(F.when(F.col("under").eqNullSafe(F.lag("under").over(along)), 0).otherwise(1)).over(along))
    families = named.where("under is not null").groupBy(unit, "run", "under").agg(F.min("col").alias("first"), F.max("col").alias("last")).where("last > first")
    heads = named.where("group = '' or group = low").select(unit, F.col("col").alias("head"), "low")
    families = families.join(unsent(heads), unit).where("head = first - 1 and low = under").select(unit, "head", "last")
    cells = long_cells(rows, unit)
    filled = cells.where("text <> ''").groupBy(unit, "col").agg(F.count(F.lit(1)).alias("n"))
    own = families.join(unsent(filled.select(unit, F.col("col").alias("head"), F.col("n").alias("n_head"))), [unit, "head"], "left").join(unsent(filled.select(unit, F.col("col").alias("last"), F.col("n").alias("n_last"))), [unit, "last"], "left")
    shifts = own.where("coalesce(n_head, 0) >= 2 and coalesce(n_last, 0) = 0").select(unit, "head", "last")
    over = shifts.groupBy(unit).agg(F.collect_list(F.struct("head", "last")).alias("blocks"))
    inside = F.exists(F.coalesce("blocks", F.array().cast("array<struct<head:int,last:int>>")), lambda b: (F.col("col") >= b["head"]) & (F.col("col") <= b["last"]))
    # The last column of such a block is blank, so nothing moves out of it.
    moved = cells.join(unsent(over), unit, "left").select(unit, "row", F.when(inside & (F.col("text") != ""), F.col("col") + 1).otherwise(F.col("col")).alias("col"), "text", inside.alias("inside"))
    moved = moved.where("text <> ''").select(unit, "row", "col", "text")
    used = moved.select(unit, "col").distinct().withColumn("used", F.lit(True))
    groups = named.where("group <> ''").select(unit, F.col("group").alias("low")).distinct().withColumn("is_group", F.lit(True))
    kept = named.join(unsent(used), [unit, "col"], "left").join(unsent(groups), [unit, "low"], "left")
    kept = kept.withColumn("keep", F.col("used").isNotNull() | F.col("is_group").isNull())
    kept = kept.withColumn("keep", F.col("keep") | ~F.max("keep").over(W.partitionBy(unit))).where("keep")
    kept = kept.withColumn("new", F.row_number().over(along) - 1)
    names = kept.select(unit, F.col("new").alias("col"), "name", "path")
    width = names.groupBy(unit).agg(F.count(F.lit(1)).cast("int").alias("w"))
    placed = moved.join(unsent(kept.select(unit, "col", "new")), [unit, "col"]).groupBy(unit, "row").agg(F.map_from_entries(F.collect_list(F.struct("new", "text"))).alias("m"))
    whole = rows.select(unit, "row").join(unsent(width), unit).join(unsent(placed), [unit, "row"], "left")
    blank = F.create_map().cast("map<int,string>")
    return whole.select(unit, "row", F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda c: F.coalesce("m", blank)[c]).alias("cells")), names
