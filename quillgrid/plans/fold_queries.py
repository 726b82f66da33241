"""Queries whose result depends on the order in which rows are met, beside the SQL (recursive where it must be) they are compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.operators import boxes, collapse, restore
from quillgrid.session import table


def dim_collapse(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("size "), F.col("p_size") % 30)).otherwise(F.concat(F.lit("Size."), F.col("p_size")))
    entries = part.select(F.col("p_type").alias("scope"), F.col("p_size").alias("ord"), name.alias("name"), F.col("p_partkey").alias("place"), F.substring_index("p_name", " ", -1).alias("value"), F.col("p_brand").alias("code"), F.col("p_name").alias("definition"))
    return collapse.collapse(entries)


def printed_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of the lines of four orders on one page, by several methods."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"), F.min("l_partkey").alias("p"))
    x, y = F.col("l_orderkey") % 4 * 9 + F.col("l_linenumber") % 3 * 2, F.col("q") % 12
    return lines.select(
        F.floor(F.col("l_orderkey") / 4).alias("page"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box"),
        F.get(F.array(*map(F.lit, boxes.METHODS)), (F.col("p") % 3).cast("int")).alias("method"),
        x.cast("double").alias("x0"),
        y.cast("double").alias("y0"),
        (x + 6 + F.col("q") % 4).cast("double").alias("x1"),
        (y + 3 + F.col("p") % 9).cast("double").alias("y1"),
        (F.col("p") % 17).alias("n_rows"),
        (F.col("q") % 9).alias("n_cols"),
    )


def boxes_deduped(spark: SparkSession, sf: str) -> DataFrame:
    return boxes.deduped(printed_boxes(spark, sf), "page", "box").select("page", "box", "place")


def box_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    found = boxes.overlapping(printed_boxes(spark, sf), "page", "box")
    return found.select("page", "a", "b", F.round("iou", 4).alias("iou"), F.round("of_smaller", 4).alias("of_smaller"))


def order_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each customer's orders as a rebuilt table, and the candidate that has all of them below a row that numbers the columns."""
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    stub = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("Order "), (key % 40).cast("string")))
    price = F.round("o_totalprice").cast("long").cast("string")
    every = orders.select("o_custkey", "o_orderkey", stub.alias("stub"), price.alias("price"), "o_orderstatus")
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    strip = orders.select("o_custkey").distinct().select(F.col("o_custkey").alias("unit"), F.lit(0).alias("row"), F.array(F.lit("(1)"), F.lit("(2)"), F.lit("(3)")).alias("cells"))
    candidate = every.select(F.col("o_custkey").alias("unit"), nth.alias("row"), F.array("stub", "price", F.when(key % 5 == 0, "12.5").otherwise(F.col("o_orderstatus"))).alias("cells")).unionByName(strip)
    mine = every.where("o_orderkey % 4 <> 1").select(F.col("o_custkey").alias("unit"), (nth - 1).alias("row"), F.array("stub", F.when(key % 8 == 2, "about 7").otherwise(F.col("price")), F.when(key % 5 == 0, "12.5").otherwise(F.col("o_orderstatus"))).alias("cells"))
    return mine, candidate


def rows_restored(spark: SparkSession, sf: str) -> DataFrame:
    mine, candidate = order_rows(spark, sf)
    return restore.restored(mine, candidate, "unit").select("unit", "row", F.array_join("cells", "|", "").alias("cells"), "source")


def rows_aligned(spark: SparkSession, sf: str) -> DataFrame:
    mine, candidate = order_rows(spark, sf)
    return restore.aligned(mine, candidate, "unit")


PAGES = """p AS (SELECT l_orderkey // 4 AS page, l_orderkey * 10 + l_linenumber AS box, ['lines_strict', 'lines', 'text'][p % 3 + 1] AS method, (p % 3)::INT AS rank,
        x::DOUBLE AS x0, y::DOUBLE AS y0, (x + 6 + q % 4)::DOUBLE AS x1, (y + 3 + p % 9)::DOUBLE AS y1,
        CASE WHEN p % 17 = 0 OR q % 9 = 0 THEN 0 ELSE q % 9 END AS wide, CASE WHEN p % 17 = 0 OR q % 9 = 0 THEN 0 ELSE (q % 9) * (p % 17) END AS cells
      FROM (SELECT *, l_orderkey % 4 * 9 + l_linenumber % 3 * 2 AS x, q % 12 AS y
            FROM (SELECT l_orderkey, l_linenumber, min(l_quantity)::INT AS q, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)))"""
BOTH = "(greatest(least(k.x1, c.x1) - greatest(k.x0, c.x0), 0) * greatest(least(k.y1, c.y1) - greatest(k.y0, c.y0), 0))"
AREAS = "((k.x1 - k.x0) * (k.y1 - k.y0))", "((c.x1 - c.x0) * (c.y1 - c.y0))"
SAME = f"({BOTH} > 0 AND ({BOTH} / ({AREAS[0]} + {AREAS[1]} - {BOTH}) >= 0.55 OR {BOTH} / least({AREAS[0]}, {AREAS[1]}) >= 0.65))"
ROWS = """o AS (SELECT o_custkey AS unit, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Order ' || (o_orderkey % 40) END AS stub, round(o_totalprice)::BIGINT::VARCHAR AS price,
             CASE WHEN o_orderkey % 5 = 0 THEN '12.5' ELSE o_orderstatus END AS mark FROM orders),
    cand AS (SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY k) AS "row", stub, price, mark, false AS strip FROM o
             UNION ALL SELECT DISTINCT unit, 0, '(1)', '(2)', '(3)', true FROM o),
    mine AS (SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY k) - 1 AS "row", stub, CASE WHEN k % 8 = 2 THEN 'about 7' ELSE price END AS price, mark FROM o WHERE k % 4 <> 1),
    nm AS (SELECT unit, count(*) AS n FROM mine GROUP BY unit), nc AS (SELECT unit, count(*) AS nc FROM cand GROUP BY unit)"""

SQL: dict[str, str] = {
    "dim_collapse": """WITH RECURSIVE e AS (SELECT p_type AS scope, p_size AS ord, CASE WHEN p_size % 2 = 0 THEN 'size ' || (p_size % 30) ELSE 'Size.' || p_size END AS name, p_partkey AS place,
                   split_part(p_name, ' ', -1) AS value, p_brand AS code, p_name AS definition FROM part),
        d AS (SELECT scope, name, min(ord) AS ord, list(DISTINCT lower(value)) AS vals, lower(regexp_replace(name, '[ _./-]', '', 'g')) AS slug FROM e GROUP BY scope, name),
        q AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ord, name) AS i FROM d),
        f AS (SELECT scope, 0::BIGINT AS i, []::STRUCT(slug VARCHAR, names VARCHAR[], vals VARCHAR[])[] AS g FROM (SELECT DISTINCT scope FROM d)
              UNION ALL
              SELECT scope, i, CASE WHEN k > 0 THEN list_transform(g, lambda x, j: CASE WHEN j = k THEN struct_pack(slug := x.slug, names := list_append(x.names, name), vals := list_distinct(list_concat(x.vals, vals))) ELSE x END)
                                    ELSE list_append(g, struct_pack(slug := slug, names := [name], vals := vals)) END
              FROM (SELECT f.scope AS scope, q.i AS i, f.g AS g, q.name AS name, q.vals AS vals, q.slug AS slug,
                           coalesce(list_position(list_transform(f.g, lambda x: x.slug = q.slug OR (len(list_intersect(x.vals, q.vals)) > 0
                               AND (len(list_intersect(x.vals, q.vals)) >= 0.85 * (len(x.vals) + len(q.vals) - len(list_intersect(x.vals, q.vals)))
                                    OR len(list_intersect(x.vals, q.vals)) >= 0.9 * least(len(x.vals), len(q.vals))))), true), 0) AS k
                    FROM f JOIN q ON q.scope = f.scope AND q.i = f.i + 1)),
        h AS (SELECT scope, unnest(g) AS x FROM f WHERE (scope, i) IN (SELECT scope, max(i) FROM f GROUP BY scope)),
        n AS (SELECT scope, x.names AS names, unnest(x.names) AS name FROM h),
        m AS (SELECT scope, name, (list_sort(list_transform(names, lambda y: struct_pack(a := len(y), b := lower(y), c := y)))[1]).c AS dimension FROM n),
        r AS (SELECT e.scope AS scope, dimension, e.value AS value, code, definition, d.ord AS o, place, row_number() OVER (PARTITION BY e.scope, dimension, lower(e.value) ORDER BY e.ord, place) AS nth, e.ord AS eo
              FROM e JOIN m ON m.scope = e.scope AND m.name = e.name JOIN d ON d.scope = e.scope AND d.name = e.name)
        SELECT scope, dimension, (row_number() OVER (PARTITION BY scope, dimension ORDER BY eo, place) - 1)::INT AS place, value, code, definition FROM r WHERE nth = 1""",
    "box_overlaps": f"""WITH {PAGES} SELECT page, k.box AS a, c.box AS b, round({BOTH} / ({AREAS[0]} + {AREAS[1]} - {BOTH}), 4) AS iou, round({BOTH} / least({AREAS[0]}, {AREAS[1]}), 4) AS of_smaller
        FROM p k JOIN p c USING (page) WHERE k.box < c.box AND {BOTH} > 0""",
    "boxes_deduped": f"""WITH RECURSIVE {PAGES},
        q AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY rank, y0, box) AS i FROM p),
        f AS (SELECT DISTINCT page, 0::BIGINT AS i, []::STRUCT(box BIGINT, rank INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, score STRUCT(wide BIGINT, cells BIGINT, bonus INT))[] AS kept FROM p
              UNION ALL
              SELECT page, i, CASE WHEN len(rivals) = 0 THEN list_append(kept, c)
                                   WHEN c.rank = 2 AND len(list_filter(rivals, lambda k: k.rank < 2)) > 0 THEN kept
                                   WHEN (c.score.wide >= best.wide + 3 AND c.score.cells > best.cells) OR (c.score.wide > best.wide AND c.score.cells >= greatest(2 * best.cells, best.cells + 20))
                                        OR (c.score.wide = best.wide AND c.score.cells >= 2 * best.cells + 10)
                                   THEN list_append(list_filter(kept, lambda k: NOT {SAME}), c) ELSE kept END
              FROM (SELECT *, list_max(list_transform(rivals, lambda k: k.score)) AS best FROM (
                    SELECT *, list_filter(kept, lambda k: {SAME}) AS rivals FROM (
                    SELECT f.page AS page, q.i AS i, f.kept AS kept, struct_pack(box := q.box, rank := q.rank, x0 := q.x0, y0 := q.y0, x1 := q.x1, y1 := q.y1,
                           score := struct_pack(wide := q.wide::BIGINT, cells := q.cells::BIGINT, bonus := (CASE WHEN q.cells = 0 THEN 0 ELSE 3 - q.rank END)::INT)) AS c
                    FROM f JOIN q ON q.page = f.page AND q.i = f.i + 1)))),
        h AS (SELECT page, unnest(kept) AS k FROM f WHERE (page, i) IN (SELECT page, max(i) FROM f GROUP BY page))
        SELECT page, k.box AS box, (row_number() OVER (PARTITION BY page ORDER BY k.y0, k.rank, k.box) - 1)::INT AS place FROM h""",
    "rows_aligned": f"""WITH {ROWS},
        k AS (SELECT unit, lower(stub) AS key, min("row") AS by_key FROM cand WHERE stub <> '' GROUP BY 1, 2),
        j AS (SELECT mine.unit AS unit, mine."row" AS "row", by_key, n, nc, count(by_key) OVER (PARTITION BY mine.unit) AS hits
              FROM mine LEFT JOIN k ON k.unit = mine.unit AND k.key = lower(mine.stub) AND mine.stub <> '' JOIN nm ON nm.unit = mine.unit JOIN nc ON nc.unit = mine.unit)
        SELECT unit, "row", (CASE WHEN n <> nc AND hits >= greatest(1, floor(0.6 * n)) THEN by_key WHEN "row" < nc THEN "row" END)::INT AS candidate_row FROM j""",
    "rows_restored": f"""WITH {ROWS},
        k AS (SELECT c.unit AS unit, m AS mine, c.t AS theirs FROM (SELECT unit, lower(stub) AS key, min("row") AS t FROM cand WHERE stub <> '' AND NOT strip GROUP BY 1, 2) c
              JOIN (SELECT unit, lower(stub) AS key, min("row") AS m FROM mine WHERE stub <> '' GROUP BY 1, 2) x ON x.unit = c.unit AND x.key = c.key),
        w AS (SELECT c.unit AS unit, m AS mine, c.t AS theirs FROM
              (SELECT unit, concat_ws('#', nullif(lower(stub), ''), lower(price), lower(mark)) AS key, min("row") AS t FROM cand WHERE (unit, "row") NOT IN (SELECT unit, theirs FROM k) GROUP BY 1, 2) c
              JOIN (SELECT unit, concat_ws('#', nullif(lower(stub), ''), lower(price), lower(mark)) AS key, min("row") AS m FROM mine WHERE (unit, "row") NOT IN (SELECT unit, mine FROM k) GROUP BY 1, 2) x
              ON x.unit = c.unit AND x.key = c.key),
        u AS (SELECT * FROM k UNION ALL SELECT * FROM w),
        ok AS (SELECT unit FROM nm JOIN nc USING (unit) WHERE nc > n),
        back AS (SELECT unit, "row" AS spot, 0 AS behind, coalesce(stub, '') || '|' || price || '|' || mark AS cells, 'restored' AS source FROM cand
                 WHERE unit IN (SELECT unit FROM ok) AND (unit, "row") NOT IN (SELECT unit, theirs FROM u) AND (strip OR mark = '12.5')),
        stay AS (SELECT mine.unit AS unit, coalesce(theirs, mine."row") AS spot, (theirs IS NULL)::INT AS behind, stub || '|' || price || '|' || mark AS cells, 'kept' AS source
                 FROM mine LEFT JOIN u ON u.unit = mine.unit AND u.mine = mine."row" WHERE mine.unit IN (SELECT unit FROM back)),
        z AS (SELECT unit, (row_number() OVER (PARTITION BY unit ORDER BY behind, spot) - 1)::INT AS "row", cells, source FROM (SELECT * FROM back UNION ALL SELECT * FROM stay))
        SELECT * FROM z UNION ALL SELECT unit, "row"::INT, stub || '|' || price || '|' || mark, 'kept' FROM mine WHERE unit NOT IN (SELECT unit FROM back)""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dim_collapse": dim_collapse,
    "box_overlaps": box_overlaps,
    "boxes_deduped": boxes_deduped,
    "rows_aligned": rows_aligned,
    "rows_restored": rows_restored,
}
