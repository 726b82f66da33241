"""Dimensions with nearly the same values made one, in order: the values so far decide about what comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions.text import slug
from quillgrid.operators.matching import components

# The least Jaccard similarity, and the least share of the smaller set, of sets that are near.
JACCARD, CONTAINED = 0.85, 0.9


def near_values(a: Column, b: Column, jaccard: float = JACCARD, contained: float = CONTAINED) -> Column:
    """Whether two arrays of distinct values nearly agree; never where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return (both > 0) & ((both >= jaccard * (F.size(a) + F.size(b) - both)) | (both >= contained * F.least(F.size(a), F.size(b))))


def folded(dims: Column) -> Column:
    """The groups of an ordered array of dims (name, slug, values): arrays of names, with the values of all of them.

    Each dim joins the first group whose values so far are near its own or whose first name reads like its own; else
    it begins a group.
    """
    kind = "array<struct<slug:string,names:array<string>,values:array<string>>>"

    def add(groups: Column, dim: Column) -> Column:
        fits = F.transform(groups, lambda g: near_values(g["values"], dim["values"]) | (g["slug"] == dim["slug"]))
        at = F.array_position(fits, True)
        begun = F.concat(groups, F.array(F.struct(dim["slug"].alias("slug"), F.array(dim["name"]).alias("names"), dim["values"].alias("values"))))
        grown = F.transform(
            groups,
            lambda g, i: F.when(i + 1 == at, F.struct(g["slug"].alias("slug"), F.concat(g["names"], F.array(dim["name"])).alias("names"), F.array_union(g["values"], dim["values"]).alias("values"))).otherwise(g),
        )
        return F.when(at > 0, grown).otherwise(begun).cast(kind)

    return F.aggregate(dims, F.array().cast(kind), add)


def collapsed_names(entries: DataFrame) -> DataFrame:
    """scope, name, ord and dimension: the dimension that each name of a scope becomes.

    entries: scope, ord (place of the name in its scope), name and value. Only dimensions of a scope that share a value, or
    whose names read alike, or that are linked through such ones can come together; each such set is folded by itself. The
    shortest name of a group stays, of equal ones the first in lower case. Values are compared without regard to case;
    blank ones don't count, and a name without any is left out.
    """
    each = entries.where(F.trim("value") != "").select("scope", "name", "ord", F.lower("value").alias("v"))
    dims = each.groupBy("scope", "name").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_set("v")).alias("values"))
    named = dims.select("scope", "name", "ord", slug(F.col("name")).alias("slug"), "values")
    marks = named.select("scope", "name", F.explode(F.concat(F.transform("values", lambda v: F.concat(F.lit("v"), v)), F.array(F.concat(F.lit("n"), F.col("slug"))))).alias("mark"))
    first = marks.groupBy("scope", "mark").agg(F.min("name").alias("first"))
    met = marks.join(first, ["scope", "mark"]).where("first <> name")
    edges = met.select(F.struct("scope", "name").alias("a"), F.struct(F.col("scope"), F.col("first").alias("name")).alias("b")).distinct()
    linked = components(named.select(F.struct("scope", "name").alias("id")), edges)
    linked = linked.select(F.col("id.scope").alias("scope"), F.col("id.name").alias("name"), F.col("component.name").alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "name", "slug", "values")))
    groups = named.join(linked, ["scope", "name"]).groupBy("scope", "part").agg(folded(ordered).alias("groups"))
    best = F.array_min(F.transform("names", lambda n: F.named_struct(F.lit("length"), F.length(n), F.lit("low"), F.lower(n), F.lit("name"), n)))["name"]
    chosen = groups.select("scope", F.explode("groups").alias("g")).select("scope", F.col("g.names").alias("names")).select("scope", best.alias("dimension"), F.explode("names").alias("name"))
    return chosen.join(named.select("scope", "name", "ord"), ["scope", "name"])


def collapse(entries: DataFrame) -> DataFrame:
    """scope, dimension, place, value, code and definition of the dimensions that collapsed_names() leaves.

    entries: scope, ord, name, place (of the entry in its dimension), value, code and definition. Of entries with one
    value the one of the first name stays, and place numbers them from 0 as their names and they come in.
    """
    joined = entries.where(F.trim("value") != "").join(collapsed_names(entries).select("scope", "name", "dimension"), ["scope", "name"])
    order = F.struct("ord", "place")
    first = joined.groupBy("scope", "dimension", F.lower("value").alias("_v")).agg(F.min_by(F.struct("value", "code", "definition"), order).alias("e"), F.min(order).alias("o"))
    place = F.row_number().over(W.partitionBy("scope", "dimension").orderBy("o")) - 1
    return first.select("scope", "dimension", place.alias("place"), "e.*")
