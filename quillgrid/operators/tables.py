"""Extracted grids into tables, end to end, and the folds of rows that belong to the row before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions import cells as C
from quillgrid.functions import stacks as S
from quillgrid.operators import headers, repairs, stacked
from quillgrid.operators.matching import checkpointed
from quillgrid.session import unsent

# Names of serial columns, and cells that say nothing where shares are looked for.
SERIAL_NAME = r"(?i)^(?:sl\.?\s*no\.?|s\.?\s*no\.?|serial(?:\s*no\.?)?|#)$"
SILENT = ("", "—", "–", "-", "−", ".", "..", "...", "NA", "N/A")
FLAGS = "array<int>"


def column_facts(rows: DataFrame, columns: DataFrame, unit: str) -> DataFrame:
    """unit, col, name and, over a column's texts, how many there are, are numbers or small whole numbers, and how long they are."""
    each = repairs.long_cells(rows, unit).where("text <> ''")
    small = F.when(F.col("text").rlike("^[0-9]{1,3}$"), F.col("text").try_cast("int"))
    facts = each.groupBy(unit, "col").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(C.size_of(F.col("text")).isNotNull()).alias("numbers"), F.count(small).alias("whole"), F.min(small).alias("least"), F.max(small).alias("largest"), F.sum(F.length("text")).alias("letters")
    )
    return facts.join(unsent(columns.select(unit, "col", "name")), [unit, "col"])


def large_enough(rows: DataFrame, columns: DataFrame, unit: str) -> DataFrame:
    """The units of two rows and three columns or more."""
    wide = columns.groupBy(unit).agg(F.count(F.lit(1)).alias("w")).where("w >= 3").select(unit)
    return rows.groupBy(unit).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(unit).join(unsent(wide), unit)


def wraps_folded(rows: DataFrame, columns: DataFrame, unit: str) -> DataFrame:
    """rows in which a row that only goes on with the label above is part of that row; rows are numbered anew.

    A row goes on if it has a label that does (in the label column with most letters before the first measures), no serial and
    no figure. Its other labels join those of the row above. Units without labels before measures stay as they are, as do those of
    fewer than two rows or three columns. Only a row with its candidates behind it is gathered.
    """
    facts = column_facts(rows, columns, unit).join(unsent(large_enough(rows, columns, unit)), unit, "left_semi")
    serial = F.trim("name").rlike(SERIAL_NAME) | ((F.col("whole") >= F.greatest(F.lit(3), F.floor(0.6 * F.col("n")))) & (F.col("least") >= 1) & (F.col("largest") <= F.col("n") + 5))
    kind = F.when(F.coalesce(serial, F.lit(False)), "serial").when(F.col("numbers") >= F.greatest(F.lit(1), F.floor(0.6 * F.col("n"))), "measure").otherwise("label")
    kinds = facts.withColumn("kind", kind).withColumn("first", F.min(F.when(F.col("kind") == "measure", F.col("col"))).over(W.partitionBy(unit))).where("first is not null")
    before = F.col("col") < F.col("first")
    roles = kinds.groupBy(unit).agg(
        F.collect_list(F.when(F.col("kind") == "measure", F.col("col"))).cast(FLAGS).alias("figures"),
        F.collect_list(F.when(before & (F.col("kind") == "serial"), F.col("col"))).cast(FLAGS).alias("serials"),
        F.collect_list(F.when(before, F.col("col"))).cast(FLAGS).alias("labels"),
        F.coalesce(F.max_by(F.when(before & (F.col("kind") == "label"), F.col("col")), F.when(before & (F.col("kind") == "label"), F.struct("letters", "n", (-F.col("col")).alias("c")))), F.max(F.when(before, F.col("col")))).alias("own"),
    ).where("size(labels) > 0")
    held = rows.join(unsent(roles), unit, "left").withColumn("cells", F.transform("cells", C.canonical))

    def any_of(places: str, test) -> Column:
        return F.exists(F.col(places), lambda i: test(F.coalesce(F.get("cells", i), F.lit(""))))

    goes = (F.get("cells", F.col("own")) != "") & ~any_of("serials", lambda c: c != "") & ~any_of("figures", lambda c: C.size_of(c).isNotNull())
    held = held.withColumn("goes", F.coalesce(goes, F.lit(False)))
    along = W.partitionBy(unit).orderBy("row")
    held = held.withColumn("block", F.sum((~F.col("goes")).cast("int")).over(along))

    def step(done: Column, x: Column) -> Column:
        def of(y: Column) -> Column:
            last = y["last"]
            more = F.transform(last, lambda c, i: F.when(F.array_contains(x["labels"], i), repairs.joined_text(c, F.get(x["cells"], i))).otherwise(c))
            joins = last.isNotNull() & x["goes"] & S.continues(F.get(x["cells"], x["own"]), F.get(last, x["own"]))
            return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(more))).otherwise(F.concat(done, F.array(x["cells"])))

        return S.let({"last": F.get(done, F.size(done) - 1)}, of)

    blocks = held.groupBy(unit, "block").agg(F.array_sort(F.collect_list(F.struct("row", "goes", "own", "labels", "cells"))).alias("all"))
    folded = blocks.select(unit, "block", F.posexplode(F.aggregate("all", F.array().cast("array<array<string>>"), step)).alias("part", "cells"))
    place = F.row_number().over(W.partitionBy(unit).orderBy("block", "part")) - 1
    return folded.select(unit, place.alias("row"), F.transform("cells", lambda c: F.nullif(c, F.lit(""))).alias("cells"))


def shares_folded(rows: DataFrame, columns: DataFrame, unit: str) -> DataFrame:
    """rows in which a row of a few shares in brackets only is set behind the figures of the row above; rows are numbered anew.

    A row whose shares fill three quarters of the measures, two or more, is a row of its own, and so is one below a row without
    figures. Units without measures, of fewer than two rows or three columns, stay as they are.
    """
    facts = column_facts(rows, columns, unit).join(unsent(large_enough(rows, columns, unit)), unit, "left_semi")
    kinds = facts.withColumn("measure", F.col("numbers") >= F.greatest(F.lit(1), F.floor(0.55 * F.col("n"))))
    kinds = kinds.withColumn("first", F.min(F.when(F.col("measure"), F.col("col"))).over(W.partitionBy(unit))).where("first is not null")
    roles = kinds.groupBy(unit).agg(F.collect_list(F.when(F.col("measure"), F.col("col"))).cast(FLAGS).alias("figures"), F.collect_list(F.when(~F.col("measure") & (F.col("col") < F.col("first")), F.col("col"))).cast(FLAGS).alias("stubs"))
    held = rows.join(unsent(roles), unit, "left").withColumn("cells", F.transform("cells", C.canonical))

    def count(places: str, test) -> Column:
        return F.coalesce(F.size(F.filter(F.col(places), lambda i: test(F.coalesce(F.get("cells", i), F.lit(""))))), F.lit(0))

    shares = count("figures", S.is_share)
    others = count("figures", lambda c: ~c.isin(*SILENT) & ~S.is_share(c))
    m = F.coalesce(F.size("figures"), F.lit(0))
    sparse = (m > 0) & (count("stubs", lambda c: ~c.isin(*SILENT)) == 0) & (shares > 0) & (others == 0) & (shares < F.greatest(F.lit(2), F.floor(0.75 * m))) & (shares < m)
    counts = count("figures", lambda c: C.size_of(c).isNotNull() & ~S.is_share(c)) > 0
    along = W.partitionBy(unit).orderBy("row")
    held = held.withColumns({"sparse": F.coalesce(sparse, F.lit(False)), "counts": counts})
    held = held.withColumn("base", F.last(F.when(~F.col("sparse"), F.struct("row", "counts")), ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0)))
    joins = F.col("sparse") & F.coalesce(F.col("base.counts"), F.lit(False))
    held = held.withColumn("into", F.when(joins, F.col("base.row")).otherwise(F.col("row")))

    def step(done: Column, x: Column) -> Column:
        return F.zip_with(done, x["cells"], lambda a, b: F.when(S.is_share(b) & ~F.contains(a, b), F.trim(F.concat(a, F.lit(" "), b))).otherwise(a))

    blocks = held.groupBy(unit, "into").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("all"))
    folded = blocks.select(unit, "into", F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0))["cells"], step).alias("cells"))
    place = F.row_number().over(W.partitionBy(unit).orderBy("into")) - 1
    return folded.select(unit, place.alias("row"), F.transform("cells", lambda c: F.nullif(c, F.lit(""))).alias("cells"))


def built(grids: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """Rows (unit, row, cells) and columns (unit, col, name and path) of the tables that extracted grids hold.

    grids: unit, row (from 0 without gaps) and cells as a reader gives them. Stacked rows come apart, glued numbers spread, header rows
    become column paths, and what is below them the body: without blank rows and banners, with the row that numbers the
    columns if it stands right below the headers. Split columns then come together, blank parents go, and rows that only
    go on with the row before are folded into it. Names are the paths' last labels, told apart by (2), (3) and so on.
    """
    apart = stacked.expanded(grids, unit)
    # Each step reads the one before several times, so it is computed once, in the shared folder.
    spread = checkpointed(apart.select(unit, "row", repairs.spread_numbers(F.transform("cells", lambda c: F.nullif(C.canonical(c), F.lit("")))).alias("cells")))
    top = checkpointed(headers.top_rows(spread, unit, "row", "cells"))
    paths = headers.column_paths(top, unit)
    nth = F.row_number().over(W.partitionBy(unit, "name").orderBy("col"))
    columns = paths.select(unit, "col", F.when(nth > 1, F.concat("name", F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("name"), F.col("header_path").alias("path"))
    heads = top.groupBy(unit).agg(F.max("header_count").alias("h"), F.max_by("row", "row").alias("seen"))
    # The row that numbers the columns counts only as long as nothing else has come below the header.
    odd = F.min(F.when((F.col("row") >= F.col("header_count")) & ((F.col("role") != "skipped") | F.col("banner")), F.col("row"))).over(W.partitionBy(unit))
    strips = top.withColumn("odd", odd).where("role = 'skipped' and row >= header_count and not banner and (odd is null or row < odd)").select(unit, "row")
    gone = top.where("role = 'skipped'").select(unit, "row").join(unsent(strips), [unit, "row"], "left_anti")
    body = spread.join(unsent(heads.select(unit, "h")), unit).where("row >= h").join(unsent(gone), [unit, "row"], "left_anti").where(F.exists("cells", lambda c: c.isNotNull()))
    rows, columns = map(checkpointed, repairs.coalesced(checkpointed(body.select(unit, "row", "cells")), checkpointed(columns), unit))
    rows, columns = map(checkpointed, repairs.without_parents(rows, columns, unit))
    return shares_folded(checkpointed(wraps_folded(rows, columns, unit)), columns, unit), columns
