"""Rough search of tables by words: each word of a query meets the words of the tables through indexes, then is checked.

A query's word fits a word that contains it, that it contains, whose letters hold its letters in order, or that is a few
edits away. Words that hold letters in order hold every pair of them in order, so a query's word looks them up by its rarest pair;
words a few edits away share a text after a few deletions, or for long words a piece at about the same place. Distinct words meet,
not tables, and no list of all words stands against all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.session import unsent

# Edits that a word of up to 4, up to 8 and more letters may be away, and the longest word that edits are counted in.
EDITS = ((4, 1), (8, 2))
MOST_EDITS, LONGEST = 3, 32


def plain(text: Column) -> Column:
    """Lower-case letters and digits, with single blanks for all else."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain(text), " "), lambda w: w != ""))


def edits_of(word: Column) -> Column:
    n = F.length(word)
    return F.when(n <= EDITS[0][0], EDITS[0][1]).when(n <= EDITS[1][0], EDITS[1][1]).otherwise(MOST_EDITS)


def is_number(word: Column) -> Column:
    return word.rlike("^[0-9]+$")


def letters_in_order(word: Column) -> Column:
    """Each pair of letters of which the first stands before the second, once."""
    letters = F.split(word, "")
    return F.array_distinct(F.flatten(F.transform(letters, lambda x, i: F.transform(F.slice(letters, i + 2, F.length(word)), lambda y: F.concat(x, y)))))


def without(word: Column, most: int) -> Column:
    """The word with up to so many letters taken out, in every way."""
    made = F.array(word)
    level = made
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))))
        made = F.array_union(made, level)
    return made


def pieces(word: Column) -> Column:
    """A word of more than eight letters in four parts as even as may be: its length, and text, place of each."""
    n = F.length(word)
    starts = [F.floor(n * k / (MOST_EDITS + 1)).cast("int") for k in range(MOST_EDITS + 2)]
    return F.array(*(F.struct(word.substr(starts[k] + 1, starts[k + 1] - starts[k]).alias("text"), starts[k].alias("place")) for k in range(MOST_EDITS + 1)))


def parts_at(word: Column, sizes: tuple[int, ...]) -> Column:
    """Each part of a word of one of these sizes, with its place."""

    def of_size(k: int) -> Column:
        places = F.when(F.length(word) >= k, F.sequence(F.lit(0), F.length(word) - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.struct(F.substring(word, p + 1, F.lit(k)).alias("text"), p.alias("place")))

    return F.flatten(F.array(*map(of_size, sizes)))


def fits(asked: Column, word: Column) -> Column:
    """Whether a query's word fits a word."""
    long = (F.length(asked) >= 3) & (F.length(word) >= 3)
    in_order = F.length(asked) < F.aggregate(F.split(word, ""), F.lit(1), lambda at, c: F.when(F.substring(asked, at, F.lit(1)) == c, at + 1).otherwise(at))
    near = ~is_number(word) & (F.greatest(F.length(asked), F.length(word)) <= LONGEST) & (F.levenshtein(asked, word) <= edits_of(asked))
    return F.contains(word, asked) | (~is_number(asked) & ((long & (F.contains(asked, word) | in_order)) | near))


def meeting(asked: DataFrame, words: DataFrame) -> DataFrame:
    """asked and word: pairs that may fit, among distinct words in columns asked and word."""
    letters = asked.where(F.length("asked") <= 2)
    grams = words.select("word", F.explode(F.array_distinct(F.transform(parts_at(F.col("word"), (1, 2)), lambda x: x["text"]))).alias("g"))
    short = letters.join(grams, letters["asked"] == grams["g"]).select("asked", "word")

    spread = words.where(F.length("word") >= 2).select("word", F.explode(letters_in_order(F.col("word"))).alias("pair"))
    often = spread.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    own = asked.where(F.length("asked") >= 3).select("asked", F.explode(letters_in_order(F.col("asked"))).alias("pair"))
    rarest = own.join(often, "pair", "left").groupBy("asked").agg(F.min_by("pair", F.struct(F.coalesce("n", F.lit(0)), "pair")).alias("pair"))
    in_order = rarest.join(spread, "pair").select("asked", "word")

    told = asked.where(~is_number(F.col("asked")))
    held = told.where(F.length("asked") >= 3).select("asked", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("asked") - 2), lambda i: F.transform(F.sequence(F.lit(3), F.length("asked") - i + 1), lambda k: F.substring("asked", i, k)))))).alias("word"))
    within = held.join(words, "word").select("asked", "word")

    spelled = words.where(~is_number(F.col("word")))
    met = short.unionByName(in_order).unionByName(within)
    for low, (high, most) in zip((1, EDITS[0][0] + 1), EDITS):
        mine = told.where(F.length("asked").between(low, high)).select("asked", F.explode(without(F.col("asked"), most)).alias("cut"))
        theirs = spelled.where(F.length("word").between(max(low - most, 1), high + most)).select("word", F.explode(without(F.col("word"), most)).alias("cut"))
        met = met.unionByName(mine.join(theirs, "cut").select("asked", "word"))
    sizes = tuple(sorted({n * (k + 1) // 4 - n * k // 4 for n in range(EDITS[1][0] + 1, LONGEST + 1) for k in range(4)}))
    mine = told.where(F.length("asked").between(EDITS[1][0] + 1, LONGEST)).select("asked", F.explode(pieces(F.col("asked"))).alias("x")).select("asked", "x.text", F.col("x.place").alias("p"))
    theirs = spelled.where(F.length("word").between(EDITS[1][0] + 1 - MOST_EDITS, LONGEST)).select("word", F.explode(parts_at(F.col("word"), sizes)).alias("x")).select("word", "x.text", F.col("x.place").alias("q"))
    long = mine.join(theirs, "text").where(f"abs(p - q) <= {MOST_EDITS} and abs(length(asked) - length(word)) <= {MOST_EDITS}").select("asked", "word")
    return met.unionByName(long).distinct()


def search(tables: DataFrame, queries: DataFrame, texts: list[str], key: str = "id", page: str = "page") -> DataFrame:
    """query_id and key of each table that a query fits.

    tables: key, page and texts; queries: query_id and query, once each. A query that is a page number (15, p15, page 15) fits
    the tables of that page only. Any other fits a table if each of its words fits some word of the table's texts, of which the
    page counts as "page 15". A query without words fits every table.
    """
    bare = F.trim(F.coalesce("query", F.lit("")))
    number = F.regexp_extract(bare, r"(?i)^(?:p(?:age)?\.?\s*)?([0-9]+)$", 1)
    asked = queries.select("query_id", F.nullif(number, F.lit("")).alias("number"), word_set(bare).alias("words"))
    own_page = F.trim(F.coalesce(F.col(page).cast("string"), F.lit("")))
    by_page = tables.select(key, own_page.alias("number")).join(unsent(asked.where("number is not null").select("query_id", "number")), "number").select("query_id", key)
    every = asked.where("number is null and size(words) = 0").select("query_id").join(tables.select(key), how="cross")
    spoken = asked.where("number is null and size(words) > 0")
    said = F.concat_ws(" ", *(F.coalesce(F.col(t).cast("string"), F.lit("")) for t in texts), F.when(own_page != "", F.concat(F.lit("page "), own_page)))
    held = tables.select(key, F.explode(word_set(said)).alias("word"))
    tokens = spoken.select("query_id", F.size("words").alias("n"), F.explode("words").alias("asked"))
    words = held.select("word").distinct()
    pairs = meeting(tokens.select("asked").distinct(), words).where(fits(F.col("asked"), F.col("word")))
    found = tokens.join(pairs, "asked").join(unsent(held), "word").select("query_id", "n", key, "asked").distinct().groupBy("query_id", key).agg(F.count(F.lit(1)).alias("met"), F.max("n").alias("n"))
    return found.where("met = n").select("query_id", key).unionByName(by_page).unionByName(every)

