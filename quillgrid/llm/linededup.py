"""Line dedup by an exact set-similarity join, in DataFrame functions only.

Each line is read once into the 32-bit hashes of its distinct tokens. Equal lines meet in a grouping that
aggregates before its shuffle; of each distinct line the first place goes on. The join of setjoin.py
then orders tokens by rarity and applies the prefix, length, positional and sketch filters; Jaccard is
verified on the words themselves. A line goes when an earlier line is equal or similar enough.

Groups of near copies are thinned before the join: each line is first compared with the first line of the
same least or largest token hash or rarest token, and what is found to go by that is no longer looked up,
only listed.

What is written for later steps is deleted once its last reader is done, but for what the result reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import setjoin
from quillgrid.llm.common import cut, forget, free_name, written

WHITE = " \t\n\x0b\x0c\r"
#: Rows with removed lines, and removed lines, up to this many are sent to every executor; beyond it texts are shuffled.
BROADCAST_LINES = 1_000_000
#: A row: whether its doc_id is null, the doc_id, and a hash of the text for rows that share a doc_id or have none.
ROW = ["late", "ord", "body"]
#: The order of lines.
PLACE = [*ROW, "line_no"]


def row_of(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"].isNull(), F.coalesce(docs["doc_id"], F.lit(0)).cast("long"), F.xxhash64(docs["text"])]


def rows_of(docs: DataFrame) -> DataFrame:
    """The columns of ROW, odd (whether the text has white space other than blanks and line feeds) and text."""
    odd = F.lit(False)
    for c in "\t\x0b\x0c\r":
        odd = odd | docs["text"].contains(c)
    return docs.select(*(x.alias(c) for x, c in zip(row_of(docs), ROW, strict=True)), odd.alias("odd"), "text")


def exploded(docs: DataFrame) -> DataFrame:
    """The columns of PLACE, odd and line of every line."""
    # The outer form, as Spark would split twice to filter empty arrays before the plain one.
    lines = rows_of(docs).select(*ROW, "odd", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where("line is not null")


def words_of(lines: DataFrame) -> Column:
    """The distinct lower-case words of a line."""
    plain = F.when(lines["odd"], F.translate(lines["line"], "\t\x0b\x0c\r", "    ")).otherwise(lines["line"])
    return F.array_remove(F.array_distinct(F.split(F.lower(plain), " ")), "")


def verified(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """The lids b of pairs a, b of lids whose words (lid, words) are similar enough."""
    left, right = (words.select(F.col("lid").alias(c), F.col("words").alias(f"{c}_words")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("a_words", "b_words"))
    similar = (100 + percent) * common >= percent * (F.size("a_words") + F.size("b_words"))
    return both.where(similar).select(F.col("b").alias("lid")).distinct()


def words_asked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """lid and words of all lines of pairs a, b (structs of lid and place), once more from the documents.

    Only texts with a line that is asked for are split.
    """
    asked = pairs.select("a.*").unionByName(pairs.select("b.*")).distinct()
    asked = cut(asked.groupBy(ROW).agg(F.collect_list(F.struct("lid", "line_no")).alias("asked")))
    texts = rows_of(docs).join(setjoin.few(asked), ROW).select("odd", F.split("text", "\n").alias("lines"), "asked")
    found = texts.select("odd", F.explode(F.arrays_zip(F.col("asked.lid").alias("lid"), F.transform("asked.line_no", lambda i: F.get("lines", i)).alias("line"))).alias("one"))
    found = found.select("odd", "one.*")
    found = found.select("lid", words_of(found).alias("words"))
    return written(found.groupBy("lid").agg(F.first("words").alias("words")))  # rows may repeat


def removed_lines(docs: DataFrame, percent: int = 80, min_tokens: int = 1) -> DataFrame:
    """The place of every line that an earlier one matches.

    A blank line, and one of fewer than min_tokens distinct tokens, stays wherever it stands and matches
    nothing. Of the others a line goes if an earlier line has a token set of similarity percent / 100 or
    more, whether that one goes itself or not; equal lines are the plain case. Earlier is by doc_id (null
    last), then by a hash of the text, then by line. Rows that repeat both doc_id and text are one.

    As one earlier match is enough, a line that has been found to go isn't asked about again; it still
    counts as an earlier line for others.
    """
    docs = docs.select("doc_id", "text")
    read = exploded(docs)
    read = read.select(*PLACE, F.xxhash64("line").alias("same1"), F.xxhash64(F.lit(1), "line").alias("same2"), words_of(read).alias("words"))
    read = read.select(*PLACE, "same1", "same2", F.size("words").alias("n"), F.transform("words", lambda w: F.hash(w)).alias("tokens"))
    sets = written(read, plain=True)
    long_enough = sets.where(F.col("n") >= max(1, min_tokens))
    lines = written(long_enough.select(PLACE))
    told = setjoin.described(long_enough, setjoin.literal(setjoin.class_masks(sets)), percent)
    # Equal lines (by 128 bits) meet here, after each task has reduced its own.
    firsts = told.groupBy("same1", "same2").agg(F.min(F.struct(*PLACE, *setjoin.DESCRIPTION)).alias("f")).select("f.*")
    firsts = written(firsts.withColumn("lid", F.monotonically_increasing_id()))
    forget(sets)

    pairs = cut(setjoin.first_meetings(firsts, PLACE, percent))
    words = words_asked(pairs, docs)
    gone = cut(verified(pairs.select(F.col("a.lid").alias("a"), F.col("b.lid").alias("b")), words, percent))
    forget(words)

    pairs = cut(setjoin.meetings(firsts, gone, percent))
    one = firsts.select("lid", F.struct(*PLACE, "lid").alias("one"))
    pairs = pairs.join(one.select(F.col("lid").alias("a"), F.col("one").alias("a_one")), "a").join(one.select(F.col("lid").alias("b"), F.col("one").alias("b_one")), "b")
    pairs = pairs.select(F.least("a_one", "b_one").alias("a"), F.greatest("a_one", "b_one").alias("b"))
    pairs = cut(pairs.join(setjoin.few(gone), F.col("b.lid") == gone["lid"], "left_anti"))
    words = words_asked(pairs, docs)
    gone = cut(gone.unionByName(verified(pairs.select(F.col("a.lid").alias("a"), F.col("b.lid").alias("b")), words, percent)))
    forget(words)
    # What stays: the first of equal lines, if it has no similar one before it.
    stay = firsts.join(setjoin.few(gone), "lid", "left_anti").select(PLACE)
    return lines.join(stay, PLACE, "left_anti")


def by_row(removed: DataFrame) -> DataFrame:
    """The columns of ROW and removed: the numbers of its removed lines, as many as the text has at most."""
    return removed.groupBy(ROW).agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def with_removed(docs: DataFrame, percent: int, min_tokens: int) -> tuple[DataFrame, Column]:
    """docs with a further column, and that column: the numbers of the lines that go, null for none."""
    gone = cut(by_row(removed_lines(docs, percent, min_tokens)))
    size = gone.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("removed")).alias("lines")).first()
    name = free_name(docs, "gone_lines")
    keys = [free_name(docs, f"gone_{c}") for c in ROW]
    gone = gone.select(*(F.col(c).alias(k) for c, k in zip(ROW, keys, strict=True)), F.col("removed").alias(name))
    if max(size.rows, size.lines or 0) <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    same = [x == gone[k] for x, k in zip(row_of(docs), keys, strict=True)]
    return docs.join(gone, same, "left"), F.col(name)


def report(docs: DataFrame, percent: int = 80, min_tokens: int = 5) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (line numbers from 0, comma-joined) of every row.

    A null text has no lines, an empty one has one. Rows that repeat both doc_id and text say the same.
    An empty table gives an empty table; other columns are not read.
    """
    rows, removed = with_removed(docs.select("doc_id", "text"), percent, min_tokens)
    return rows.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(removed.cast("array<string>"), ","), F.lit("")).alias("removed"),
    )


def dedup_lines(docs: DataFrame, percent: int = 80, min_tokens: int = 5) -> DataFrame:
    """docs with the lines that match an earlier one taken out of text; every row stays.

    Null texts stay null, empty ones empty; a text that loses all its lines becomes empty. Rows of null
    doc_id come last, by a hash of their texts. Other columns pass through unchanged; n_chars, where there
    is one, counts the new text. An empty table gives an empty table.
    """
    joined, gone = with_removed(docs, percent, min_tokens)
    lines = F.split(docs["text"], "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.transform(F.arrays_zip(F.array(lines).alias("all"), F.array(stays).alias("at")), lambda x: F.array_join(F.transform(x["at"], lambda i: F.get(x["all"], i)), "\n"))[0]
    joined = joined.withColumn("text", F.when(gone.isNull(), docs["text"]).otherwise(kept))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns))
