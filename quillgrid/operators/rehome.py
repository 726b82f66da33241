"""Tables whose titles were corrected, moved to the group of their new base title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions.labels import group_name
from quillgrid.functions.text import base_title


def rehomed(members: DataFrame, corrections: DataFrame) -> DataFrame:
    """scope, group_no, place, table_id, title and group_name of every table once corrections are made.

    members: scope, group_no (null for tables in none), place (in the group), table_id, title; corrections: scope, table_id and
    title, once each. Only a table whose base title changes moves: to the first group whose first table that stays has that
    base title, else with others of its kind to a new group behind the rest. Groups that lose all tables go; the others keep
    their numbers. Tables that move come last, in the order of their old groups and places. A group is named for its first table as
    corrected, before any moves. Titles that are null count as blank.
    """
    own = F.coalesce("title", F.lit(""))
    fixed = members.join(corrections.select("scope", "table_id", F.col("title").alias("_new")), ["scope", "table_id"], "left")
    fixed = fixed.withColumn("moves", F.col("_new").isNotNull() & (base_title(F.coalesce("_new", F.lit(""))) != base_title(own)))
    fixed = fixed.withColumn("title", F.coalesce("_new", "title")).withColumn("key", base_title(own)).drop("_new")
    old_names = fixed.where("group_no is not null").groupBy("scope", "group_no").agg(F.min_by("title", "place").alias("t")).select("scope", "group_no", group_name(base_title(F.coalesce("t", F.lit("")))).alias("group_name"))
    stay = fixed.where("not moves")
    firsts = stay.where("group_no is not null").groupBy("scope", "group_no").agg(F.min_by("key", "place").alias("key"))
    homes = firsts.groupBy("scope", "key").agg(F.min("group_no").alias("home"))
    pulled = fixed.where("moves").withColumn("turn", F.row_number().over(W.partitionBy("scope").orderBy(F.col("group_no").asc_nulls_last(), "place", "table_id")))
    last = members.groupBy("scope").agg(F.coalesce(F.max("group_no"), F.lit(-1)).alias("last"))
    moved = pulled.drop("group_no").join(homes, ["scope", "key"], "left").join(last, "scope")
    new = moved.where("home is null").groupBy("scope", "key").agg(F.min("turn").alias("first"))
    new = new.withColumn("nth", F.row_number().over(W.partitionBy("scope").orderBy("first"))).select("scope", "key", "nth")
    moved = moved.join(new, ["scope", "key"], "left").withColumn("group_no", F.coalesce("home", F.col("last") + F.col("nth")))
    both = stay.select("scope", "group_no", "table_id", "title", "key", F.lit(0).alias("late"), F.col("place").cast("long").alias("at")).unionByName(moved.select("scope", "group_no", "table_id", "title", "key", F.lit(1).alias("late"), F.col("turn").cast("long").alias("at")))
    in_group = W.partitionBy("scope", "group_no").orderBy("late", "at", "table_id")
    both = both.withColumn("place", F.row_number().over(in_group) - 1).withColumn("first_key", F.first("key").over(in_group))
    named = both.join(old_names, ["scope", "group_no"], "left")
    name = F.when(F.col("group_no").isNotNull(), F.coalesce("group_name", group_name(F.col("first_key"))))
    return named.select("scope", "group_no", "place", "table_id", "title", name.alias("group_name"))
