"""The catalogue queries registered for checking; the SQL each is compared to is in catalogue_sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators import catalogue, columns, grid, matching, publish
from quillgrid.plans import block_queries, caption_queries, fact_queries, fold_queries, header_queries, inventory_queries, job_queries, label_queries, occupation_queries, repair_queries, search_queries
from quillgrid.plans.catalogue_sql import SQL
from quillgrid.session import table
from quillgrid.sources import readers
from quillgrid.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def dataset_list_counts(spark: SparkSession, sf: str) -> DataFrame:
    owners = catalogue.with_counts(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return owners.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("dataset_id"), F.col("c_name").alias("title"), F.col("n_name").alias("release_name"), "row_count"
    )


def order_store(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.as_row_store(table(spark, sf, "orders").select(*ORDER_COLUMNS), "o_orderkey")


def shaped(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("row_key", *(F.col("row_data")[c].alias(c) for c in names))


def rows_equals_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalogue.filter_rows(order_store(spark, sf), ORDER_COLUMNS, "o_orderstatus", equals="F")
    return shaped(catalogue.page(rows, [F.col("row_key")], 20, 100), ["o_custkey", "o_orderpriority"])


def rows_contains_page(spark: SparkSession, sf: str) -> DataFrame:
    store = catalogue.as_row_store(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    rows = catalogue.filter_rows(store, ["p_name", "p_brand"], "p_brand", contains="RAND#1")
    return shaped(catalogue.page(rows, [F.col("row_key")], 0, 200), ["p_name", "p_brand"])


def rows_total(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.filter_rows(order_store(spark, sf), ORDER_COLUMNS, "o_orderpriority", contains="urgent").agg(F.count(F.lit(1)).alias("total"))


def json_row_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return readers.flatten_json(table(spark, sf, "events").select("event_id", "props"), "props", ["k"]).select("event_id", "k")


def dataset_search(spark: SparkSession, sf: str) -> DataFrame:
    found = catalogue.search(table(spark, sf, "documents"), " ThAt ", ["text", "source"])
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n_found"), F.min("doc_id").alias("first_id"))


def dataset_cards(spark: SparkSession, sf: str) -> DataFrame:
    cards = catalogue.cards(table(spark, sf, "part"), ["p_type", "p_brand", "p_type"], ["p_name", "p_brand"])
    return cards.select("p_partkey", "tags", "keywords")


def release_rollup(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    datasets = table(spark, sf, "nation").join(sizes, F.col("n_nationkey") == F.col("c_nationkey"))
    return catalogue.release_rollup(table(spark, sf, "region"), "r_regionkey", datasets, "n_regionkey", "n").select("r_name", "n_tables", "row_count")


def dashboard_status(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    joined = table(spark, sf, "documents").select("doc_id", "source", "lang").join(labels, "doc_id", "left")
    found = joined.groupBy("source").agg(F.count("quality").alias("filled"), F.count(F.lit(1)).alias("entries"), F.countDistinct("lang").alias("dimensions"))
    return found.withColumns(catalogue.readiness(F.col("filled"), F.col("entries"), F.col("dimensions")))


def dashboard_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("title"))
    b = table(spark, sf, "customer").where("c_acctbal < 0").select(F.lit("customer"), F.col("c_custkey").cast("long"), "c_name")
    return a.union(b)


def code_definition_enrich(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, "U", "1-urgent", "At once"), (2, "H", " 2-HIGH ", "Soon"), (3, "X", "1-URGENT", "Repeated"), (4, "L", "5-LOW", None)]
    codes = spark.createDataFrame(rows, "ord int, code string, value string, definition string")
    return catalogue.enrich_codes(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", codes)


def long_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = columns.long_form(table(spark, sf, "orders"), "orders", "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"])
    part = columns.long_form(table(spark, sf, "part"), "part", "p_partkey", ["p_brand", "p_type", "p_name", "p_size"])
    customer = columns.long_form(table(spark, sf, "customer"), "customer", "c_custkey", ["c_mktsegment", "c_name", "c_acctbal"])
    return orders.unionByName(part).unionByName(customer)


def column_stats(spark: SparkSession, sf: str) -> DataFrame:
    return columns.column_stats(long_orders(spark, sf))


def discover_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return columns.discover_dimensions(long_orders(spark, sf))


def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    cells = columns.long_form(table(spark, sf, "part"), "part", "p_partkey", ["p_brand", "p_type"])
    return columns.facet_counts(cells, "row_key", "column_name", "value").withColumnRenamed("value", "facet_value")


def brand_sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("k"), F.col("p_brand").alias("value"))


def dim_value_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return columns.near_sets(brand_sets(spark, sf), "k")


def code_list_union(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    entries = part.select(
        F.col("p_type").alias("dimension"),
        F.col("p_partkey").alias("ord"),
        F.col("p_brand").alias("value"),
        F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("c"), F.col("p_size").cast("string"))).otherwise("").alias("code"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("definition"),
    )
    return columns.code_list_union(entries)


def equivalent_columns(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.lower("l_returnflag").alias("flag_copy"), "l_linestatus")
    return columns.equivalent_columns(columns.long_form(lineitem, "lineitem", "l_orderkey", ["l_returnflag", "flag_copy", "l_linestatus"]))


def fill_ratio(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.round(F.count("quality") / F.count(F.lit(1)), 4).alias("fill"))


def regex_years_units(spark: SparkSession, sf: str) -> DataFrame:
    captions = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Orders, "), F.year("o_orderdate").cast("string"), F.lit(" and 2001 (Number)")).alias("caption"))
    return captions.select("o_orderkey", F.array_join(T.years_in(F.col("caption")), ",").alias("years"), T.unit_in(F.col("caption")).alias("unit"))


def blanked(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal").cast("string")).alias("balance"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.col("c_mktsegment")).alias("blend"),
        F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")).otherwise(" - ").alias("rare"),
    )
    return columns.long_form(rows, "customer", "c_custkey", ["balance", "blend", "rare"])


def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    return columns.profile(blanked(spark, sf))


def route_tables(spark: SparkSession, sf: str) -> DataFrame:
    return columns.route(columns.profile(blanked(spark, sf).unionByName(long_orders(spark, sf))))


def alignment_issues(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [("customer", "balance", "measure"), ("customer", "blend", "measure"), ("customer", "rare", "measure"), ("orders", "o_orderpriority", "measure"), ("orders", "o_totalprice", "measure")]
    kinds = spark.createDataFrame(kinds, "table_name string, column_name string, kind string")
    return columns.alignment_issues(blanked(spark, sf).unionByName(long_orders(spark, sf)), kinds)


def column_uniquify(spark: SparkSession, sf: str) -> DataFrame:
    return columns.uniquify(table(spark, sf, "part").select("p_partkey", "p_brand", "p_name"), "p_brand", "p_partkey", "p_name")


def base_title_groups(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.when(F.col("p_partkey") % 3 == 0, F.lit(" (urban)")).when(F.col("p_partkey") % 3 == 1, F.lit("  (rural)")).otherwise("")
    return matching.base_title_groups(table(spark, sf, "part").select("p_partkey", F.concat("p_name", suffix).alias("title")), "p_partkey", "title")


def tiered_match(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    part = table(spark, sf, "part")
    letters = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("T-"), key)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("t "), key, F.lit("A"))).otherwise(F.concat(F.lit("Z"), key))
    return matching.tiered_match(part.select(letters.alias("table_id")), part.select(F.concat(F.lit("T"), key).alias("item_id")))


def leftover_inventory(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return matching.leftover(table(spark, sf, "customer").select("c_custkey"), used, "c_custkey")


def title_pair_compatible(spark: SparkSession, sf: str) -> DataFrame:
    # Titles of which those of one product share two words, whatever their kind.
    titled = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lit("by"), "p_type", F.lit("total")).alias("title"))
    return matching.compatible_titles(titled, "p_partkey", "title")


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    found = matching.nearest(vectors.where("vec_id % 20 = 0"), vectors, 5)
    return found.select("query_id", "vec_id", F.round("distance", 4).alias("distance"), "rank")


def neighbouring_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors, of which the second and third of every four lie close to the first."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("own"))
    turn = F.col("vec_id") % 4
    first = vectors.where(turn == 0).select(F.col("vec_id").alias("first_id"), F.col("own").alias("first"))
    near = F.transform("first", lambda x, i: x + 0.01 * turn * (i % 3 - 1))
    joined = vectors.join(first, (F.col("vec_id") - turn == F.col("first_id")) & turn.isin(1, 2), "left")
    return joined.select("vec_id", F.coalesce(near, F.col("own")).alias("embedding"))


def knn_edges(spark: SparkSession, sf: str) -> DataFrame:
    return matching.knn_edges(neighbouring_vectors(spark, sf), 8, 0.42)


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    vectors = neighbouring_vectors(spark, sf)
    return matching.components(vectors.select(F.col("vec_id").alias("id")), matching.knn_edges(vectors, 2, 0.25))


def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return matching.hash_embedding(table(spark, sf, "benchmark"), "item_id", "text")


def hierarchy_nodes(spark: SparkSession, sf: str) -> DataFrame:
    leaves = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return matching.hierarchy_nodes(leaves, [("division", "r_regionkey", "r_name"), ("group", "n_nationkey", "n_name")])


def token_cosine(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select("p_name").distinct()
    tokens = T.title_tokens(F.col("p_name"))
    left = names.select(F.col("p_name").alias("key"), F.concat(tokens, F.array(F.array_min(tokens))).alias("tokens"))
    return matching.token_cosine(left, left).where("left_key < right_key")


def shortlist_quota(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey", F.round("p_retailprice", 2).alias("score"))
    return matching.shortlist(scored, "p_brand", "p_type", "score", "p_partkey", {"STANDARD": 2, "PROMO": 1}, 4).select("p_brand", "p_partkey", "rank")


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    changes = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).otherwise(F.to_timestamp(F.lit("1990-01-01"))).alias("o_orderdate"))
    return publish.upsert_latest(orders, changes, "o_orderkey", "o_orderdate").select("o_orderkey", "o_orderstatus")


def soft_delete_not_in(spark: SparkSession, sf: str) -> DataFrame:
    keep = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return publish.soft_delete_missing(table(spark, sf, "customer").select("c_custkey"), keep, "c_custkey")


def append_ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    old = F.when(key % 4 != 0, F.array(F.lit("a"), F.col("p_brand")))
    new = F.array(F.col("p_brand"), F.when(key % 2 == 0, F.lit("b")), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(publish.appended(old, new), ",").alias("ids"))


def monotone_step(spark: SparkSession, sf: str) -> DataFrame:
    step = publish.monotone_step(F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") % 7), F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 9))
    return table(spark, sf, "part").select("p_partkey", step.cast("long").alias("step"))


def review_overlay(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf, "labels")
    edits = labels.where("quality = 0").select("doc_id", F.lit("poor").alias("source"))
    return publish.overlay(docs, edits, "doc_id", ["source"], labels.where("toxic = 1").select("doc_id"))


def review_ids(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("page"))
    return publish.review_ids(lines.dropDuplicates(["l_orderkey", "l_linenumber"]), "l_orderkey", "page", "l_linenumber", "TB", "PRC").select("l_orderkey", "l_linenumber", "review_id")


def ttl_purge(spark: SparkSession, sf: str) -> DataFrame:
    return publish.live(table(spark, sf, "events"), "ts", "2024-01-30 00:00:00").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_live"))


def batch_status(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", F.when(F.col("o_custkey") % 3 == 0, "done").otherwise("error")).otherwise("running")
    return publish.batch_status(table(spark, sf, "orders").select("o_custkey", state.alias("state")), "o_custkey", "state")


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return grid.expand_stacked(table(spark, sf, "documents").select("doc_id", "text"), "text")


def stacked_rows_expand(spark: SparkSession, sf: str) -> DataFrame:
    return document_lines(spark, sf).select("doc_id", "part", F.md5("text").alias("line_md5"))


def blocks_by_gap(spark: SparkSession, sf: str) -> DataFrame:
    lines = document_lines(spark, sf).withColumn("gap", F.length("text") < 40)
    return grid.blocks_by_gap(lines, "doc_id", "part", "gap").groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n_rows"))


def header_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_size", "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(" ").alias("label"))
    return grid.fill_forward(rows, "p_size", "p_partkey", "label")


def wrap_fold(spark: SparkSession, sf: str) -> DataFrame:
    folded = grid.fold_wrapped(document_lines(spark, sf), "doc_id", "part", "text")
    return folded.select("doc_id", "label_no", "n_lines", F.md5("text").alias("label_md5"))


def side_by_side_stack(spark: SparkSession, sf: str) -> DataFrame:
    return grid.stack_halves(table(spark, sf, "part"), "p_partkey", ["p_brand", "p_size"], ["p_type", "p_partkey"])


def bbox_iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"))
    x, y = F.col("l_linenumber") * 7 % 20, F.col("q") % 15
    made = lines.select("l_orderkey", F.col("l_linenumber").alias("box"), x.alias("x0"), y.alias("y0"), (x + 12).alias("x1"), (y + 9).alias("y1"))
    return grid.overlapping_boxes(made, "l_orderkey", "box", 0.3)


def nearest_above(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("y"), "event_type")
    marks = events.where("event_id % 7 = 0").select("user_id", F.col("event_id").alias("mark"), "y")
    return grid.nearest_above(events.where("event_id % 7 <> 0").select("user_id", F.col("event_id").alias("item"), "y"), marks, "user_id")


def candidate_best(spark: SparkSession, sf: str) -> DataFrame:
    return grid.best_candidate(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice")


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return progress.windowed_counts(table(spark, sf, "events"))


def gated_query(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "supplier").createOrReplaceTempView("quillgrid_supplier")
    return readers.query(spark, "SELECT s_nationkey, count(*) AS n_suppliers FROM quillgrid_supplier GROUP BY s_nationkey;")


def garbled_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\ue000"))).otherwise(F.col("text")).alias("text"))
    return docs.where(F.col("text").rlike("[\ue000-\uf8ff]")).select("doc_id")


def codes_prefer_own(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    members = nation.select(F.col("n_nationkey").alias("dataset"), F.col("n_regionkey").alias("release"))
    own = nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("dataset"), F.lit("area").alias("column"), F.lit("N").alias("code"), F.col("n_name").alias("value"))
    region = table(spark, sf, "region")
    lent = region.select(F.col("r_regionkey").alias("release"), F.explode(F.array(F.lit("area"), F.lit("place"))).alias("column"), F.lit("R").alias("code"), F.col("r_name").alias("value"))
    return catalogue.prefer_own_codes(own, lent, members)


def release_tables(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    datasets = table(spark, sf, "customer").select(
        key.cast("string").alias("dataset_id"),
        F.when(key % 3 == 0, F.lit("0f8fad5b-d9cb-469f-a165-70867728950e")).when(key % 3 == 1, F.concat(F.lit(" DS-"), key)).alias("unique_dataset_id"),
        F.when(key % 2 == 0, F.concat(F.lit("T-"), key)).otherwise("").alias("table_id"),
        F.when(key % 5 != 0, F.col("c_name")).alias("title"),
        F.col("c_nationkey").alias("release"),
    )
    return catalogue.tables_of_releases(datasets, table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("dataset_id")))


def release_facet_filter(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "part").groupBy("p_name").agg(F.collect_set("p_type").alias("facets"), F.min("p_brand").alias("brand"))
    return catalogue.facet_filter(held, "facets", "PROMO", ["p_name", "brand"], " RING").select("p_name", "brand")


def keyword_chips(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    tags = F.when(key % 2 == 0, F.array("p_type", F.lit(" "), "p_type", F.lit("—"), "p_brand")).otherwise(F.array(F.lit("—"), F.lit(None)))
    chips = catalogue.keyword_chips(tags, F.concat_ws("  ", "p_name", F.lit("x"), "p_name", "p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(chips, "|").alias("chips"))


def dataset_id_summary(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 4 != 0, F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).otherwise("")))
    return table(spark, sf, "nation").groupBy((F.col("n_nationkey") % 9).alias("part")).agg(catalogue.id_summary(ids).alias("summary"))


def occupation_keys(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat_ws(" / ", F.upper("p_type"), "p_name", F.concat(F.lit("("), F.col("p_brand"), F.lit(")")))
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.col("p_partkey").cast("string")).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", T.occupation_key(label).alias("label_key"), T.is_hierarchy_code(code).alias("coded"))


def id_keys(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("b-"), F.col("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, "_2021_V1").otherwise(" (Provisional) Table (3)"))
    return table(spark, sf, "part").select("p_partkey", T.id_key(raw).alias("id_key"), T.id_stem(raw).alias("id_stem"), T.inventory_code(raw).alias("inventory_code"))


QUERIES: dict[str, Query] = {name: found for name, found in list(globals().items()) if name in SQL}


#: Modules that hold further queries and their SQL, as QUERIES and SQL.
MORE = (header_queries, occupation_queries, fold_queries, inventory_queries, search_queries, repair_queries, job_queries, block_queries, fact_queries, caption_queries)


def queries() -> dict[str, Query]:
    found = QUERIES | label_queries.queries()
    for module in MORE:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = SQL | label_queries.oracle_sql()
    for module in MORE:
        found |= module.SQL
    return found
