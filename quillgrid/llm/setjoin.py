"""What an exact set-similarity join of whole-number token sets needs, in DataFrame functions only.

A set is described by its size n, its prefix and two sketches. The prefix: its tokens, the rarest
first, up to the place from which on a set of Jaccard similarity percent / 100 or more must have met it.
Of two sets the longer one is looked up by its whole prefix, and the shorter one (by n, then by number)
is listed under the first n - ceil(2t / (1 + t) n) + 1 tokens alone, as both share more than t of it.
A meeting passes by the sizes, by the places of the shared token in both sets, and by the sketches.

The two sketches are 128 bits, each the number of its tokens modulo 2. Every token of one set only flips one
bit, so the bits in which two sketches differ are no more than the tokens that aren't shared: a bound
without error.

Tokens are 32-bit hashes. Two tokens of one hash can only make sets look more alike than they are,
so no pair is lost; whoever asks for pairs compares the real tokens of what is left.

Rarity comes from counts over all sets. A hash is relabelled by the rank of its top 16 bits among 65,536
counted classes; the relabelling is one to one, and what the driver sees of the counts has one size
whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASS_BITS = 16
LOW_BITS = 32 - CLASS_BITS
#: Numbers of sets up to this many (some 50 bytes each) are sent to every executor; beyond it rows are shuffled.
BROADCAST_ROWS = 1_000_000
#: What described adds.
DESCRIPTION = ["n", "low", "high", "sketch1", "sketch2", "prefix"]


def class_of(token: Column) -> Column:
    return F.shiftrightunsigned(token, LOW_BITS)


def class_masks(sets: DataFrame) -> list[int]:
    """For each class of tokens, what turns its top bits into its rank by how often its tokens occur, the rarest first."""
    counted = sets.select(F.explode("tokens").alias("t")).groupBy(class_of(F.col("t")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return ranked({r["class"]: r["n"] for r in counted.collect()})  # 65,536 rows at most


def ranked(counts: dict[int, int]) -> list[int]:
    """The masks that go with the counts of the classes, in the order of signed numbers."""
    half, masks = 1 << (CLASS_BITS - 1), [0] * (1 << CLASS_BITS)
    for rank, c in enumerate(sorted(range(1 << CLASS_BITS), key=lambda c: (counts.get(c, 0), c))):
        top = (rank ^ half) ^ c
        masks[c] = (top - (1 << CLASS_BITS) if top >= half else top) << LOW_BITS
    return masks


def literal(masks: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, masks)) + "]"), "array<int>")


def prefix_size(n: Column, percent: int) -> Column:
    return (n - F.ceil(percent * n / 100) + 1).cast("int")


def listed_size(n: Column, percent: int) -> Column:
    """The tokens under which a set is found by sets that are as long or longer."""
    return (n - F.ceil(2 * percent * n / (100 + percent)) + 1).cast("int")


def needed(n: Column, m: Column, percent: int) -> Column:
    """How many tokens two sets of n and m must share for a similarity of percent / 100 or more."""
    return F.ceil(percent * (n + m) / (100 + percent))


def described(sets: DataFrame, masks: Column, percent: int) -> DataFrame:
    """sets without n and tokens, with the columns of DESCRIPTION; none may be empty. n may be less than the tokens are."""

    def sketch(only: str) -> Column:
        return F.expr(f"aggregate(tokens, 0L, (s, t) -> if({only}, s ^ shiftleft(1L, t & 63), s))")

    ordered = F.sort_array(F.transform("tokens", lambda t: t.bitwiseXOR(F.get(masks, class_of(t)))))
    kept = [c for c in sets.columns if c not in ("n", "tokens")]
    return sets.select(
        *kept,
        "n",
        F.array_min("tokens").alias("low"),
        F.array_max("tokens").alias("high"),
        sketch("(t & 64) = 0").alias("sketch1"),
        sketch("(t & 64) <> 0").alias("sketch2"),
        F.slice(ordered, 1, prefix_size(F.size("tokens"), percent)).alias("prefix"),
    )


def unshared(percent: int, a: str = "a.", b: str = "b.") -> Column:
    """How many tokens at most only one of two similar sets has."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return n + m - 2 * needed(n, m, percent)


def differing(a: str = "a.", b: str = "b.") -> Column:
    one, two = (F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in ("sketch1", "sketch2"))
    return one + two


def of_like_size(percent: int, a: str = "a.", b: str = "b.") -> Column:
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def first_meetings(firsts: DataFrame, order: list[str], percent: int) -> DataFrame:
    """Pairs a, b of structs of lid and the columns of order: each set b and the first set a (by order) of the same least or largest hash or rarest token.

    Of a group of near copies most meet here the one that comes first, so that the group needs no pairs
    among its own. What this misses is left to meetings.
    """
    one = F.struct(*order, "lid", "n", "sketch1", "sketch2")
    keyed = firsts.select(F.explode(F.array_distinct(F.array("low", "high", F.get("prefix", F.lit(0))))).alias("key"), one.alias("b"))
    heads = keyed.groupBy("key").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "a")
    met = keyed.join(heads, "key").where((F.col("a.lid") != F.col("b.lid")) & of_like_size(percent) & (differing() <= unshared(percent)))
    name = [F.struct(*(F.col(f"{s}.{c}") for c in [*order, "lid"])).alias(s) for s in "ab"]
    return met.select(*name).distinct()


def postings(firsts: DataFrame, size: Column | None = None) -> DataFrame:
    """token, at (its place) and the set's columns for each token of the prefixes, or the first size of each."""
    prefix = F.col("prefix") if size is None else F.slice("prefix", 1, F.least(size, F.size("prefix")))
    return firsts.select(*(c for c in firsts.columns if c != "prefix"), F.posexplode(prefix).alias("at", "token"))


def alike(percent: int) -> Column:
    """Whether two postings a and b of one token leave room for the similarity."""
    a_rest, b_rest = F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")
    shared = F.least("a.at", "b.at") + F.least(a_rest, b_rest)
    return of_like_size(percent) & (shared >= needed(F.col("a.n"), F.col("b.n"), percent)) & (differing() <= unshared(percent))


def shorter_first() -> Column:
    return (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.lid") < F.col("b.lid")))


def meetings(firsts: DataFrame, gone: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a, b of lids that pass the filters, at least one of which is not among gone (lid).

    A set that is gone is listed under its whole prefix and not looked up, so that a group of copies
    of which most are gone is met by what is left of it only.
    """
    marked = firsts.join(few(gone).withColumn("out", F.lit(True)), "lid", "left").select("lid", "n", "sketch1", "sketch2", F.coalesce("out", F.lit(False)).alias("out"), "prefix")
    asking = postings(marked.where("not out").drop("out")).alias("b")
    listed = postings(marked, F.when(F.col("out"), F.size("prefix")).otherwise(listed_size(F.col("n"), percent))).alias("a")
    met = listed.join(asking, (F.col("a.token") == F.col("b.token")) & (F.col("a.out") | shorter_first()) & alike(percent))
    return met.select(F.col("a.lid").alias("a"), F.col("b.lid").alias("b")).distinct()


def few(rows: DataFrame) -> DataFrame:
    """rows (computed already), to be sent to every executor if they are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
