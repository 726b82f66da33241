"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Fixed rules fail a text first. Of the texts that pass, each language and source gets a minimum-covariance-
determinant estimate of its transformed statistics: from medians and quartile ranges, concentration steps
re-estimate mean and covariance from the nearest three quarters of the rows. A text goes when its
Mahalanobis distance exceeds the cutoff. Statistics are held as whole 1024ths, so sums, and with them
the verdicts, don't depend on how the rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import SPACE_RUN, cut, free_name, let

SCALE = 1024
#: Names of the transformed statistics, and the least spread each is granted.
VECTOR = {"word_length": 0.06, "symbols": 0.05, "dup_lines": 0.15, "repeats": 0.15, "upper": 0.06}
#: The median of the chi-squared distribution with as many degrees of freedom as VECTOR has.
CHI2_MEDIAN = 4.351
WHITE = " \t\n\x0b\x0c\r"
#: Groups up to this many are sent to every executor (under 1 KB each); more are joined by shuffles.
BROADCAST_GROUPS = 20_000


def with_counts(docs: DataFrame, prefix: str = "q_") -> DataFrame:
    """docs with the counts of the contract and two more, named by the prefix."""
    text = F.coalesce(docs["text"], F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    rows = docs.withColumns({f"{prefix}words": words, f"{prefix}lines": lines})
    w, ls = F.col(f"{prefix}words"), F.col(f"{prefix}lines")
    return rows.withColumns(
        {
            f"{prefix}n_words": F.size(w).cast("long"),
            f"{prefix}word_chars": F.length(F.array_join(w, "")).cast("long"),
            f"{prefix}n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            f"{prefix}n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
            f"{prefix}n_repeat_words": repeat_words(w).cast("long"),
            f"{prefix}n_lines": F.size(ls).cast("long"),
            f"{prefix}n_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        }
    ).drop(f"{prefix}words", f"{prefix}lines")


def repeat_words(words: Column, width: int = 3) -> Column:
    """How many words lie in windows of so many words that occur twice or more.

    Windows are compared by 64-bit hashes within one text. Sorted by hash, then place, equal ones are
    neighbours; the places of those, in order, each add what they don't share with the place before.
    """

    def places(ordered: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(ordered, i - 1)["h"] == x["h"])
            after = F.get(ordered, i + 1)["h"] == x["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.transform(F.filter(ordered, twin), lambda x: x["i"])

    def count(w: Column) -> Column:
        n = F.size(w) - width + 1
        hashed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(width))).alias("h"), i.alias("i")))
        at = F.array_sort(let(F.array_sort(hashed), places))
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        total = F.aggregate(at, start, lambda s, i: F.struct((s["n"] + F.least(F.lit(width), i - s["last"])).alias("n"), i.alias("last")))["n"]
        return F.when(n >= 2, total).otherwise(0)

    return let(words, count)


def base_failed(prefix: str = "q_", least_words: int = 50, most_percent: int = 50) -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < least_words) | (100 * F.col(f"{prefix}n_repeat_words") > most_percent * n)


def vector(prefix: str = "q_") -> dict[str, Column]:
    """The transformed statistics in whole 1024ths; all 0 for a text without words."""

    def c(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    raw = {
        "word_length": F.log1p(share(c("word_chars"), c("n_words"))),
        "symbols": F.sqrt(share(c("n_symbols"), c("word_chars"))),
        "dup_lines": F.sqrt(share(c("n_dup_lines"), c("n_lines"))),
        "repeats": F.sqrt(share(c("n_repeat_words"), c("n_words"))),
        "upper": share(c("n_upper"), c("word_chars")),
    }
    return {f"{prefix}v_{k}": F.round(v * SCALE).cast("long") for k, v in raw.items()}


def group_keys() -> dict[str, Column]:
    """q_key for language and source, q_lang for the language alone; null differs from any value."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return {"q_key": F.concat(F.lit("source"), lang, F.lit("\n"), source), "q_lang": F.concat(F.lit("lang"), lang)}


EVERYTHING = "all"

NAMES = list(VECTOR)
P = len(NAMES)


def factored(sums: DataFrame) -> DataFrame:
    """q_key, n, mu_i and the Cholesky factor l_ij of the covariance, from n, s_i and s_ij of each group."""
    n = F.col("n").cast("double")
    model = sums.withColumns({f"mu_{i}": F.col(f"s_{i}") / n / SCALE for i in range(P)})
    for j in range(P):
        made = {}
        for i in range(j, P):
            cov = F.col(f"s_{j}_{i}") / n / SCALE / SCALE - F.col(f"mu_{i}") * F.col(f"mu_{j}")
            if i == j:
                cov = cov + VECTOR[NAMES[i]] ** 2
            for k in range(j):
                cov = cov - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            made[i] = cov
        model = model.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(made[j], F.lit(1e-9))))
        model = model.withColumns({f"l_{i}_{j}": made[i] / F.col(f"l_{j}_{j}") for i in range(j + 1, P)})
    return model.select("q_key", "n", *(f"mu_{i}" for i in range(P)), *(f"l_{i}_{j}" for i in range(P) for j in range(i + 1)))


def distance2(prefix: str = "q_") -> Column:
    """The squared Mahalanobis distance of a row joined with its group's model."""
    z: list[Column] = []
    for i, name in enumerate(NAMES):
        x = F.col(f"{prefix}v_{name}") / SCALE - F.col(f"mu_{i}")
        for j in range(i):
            x = x - F.col(f"l_{i}_{j}") * z[j]
        z.append(x / F.col(f"l_{i}_{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def joined(rows: DataFrame, model: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(model) if small else model, "q_key", "left")


def estimates(rows: DataFrame, percent: int = 75, steps: int = 3, least_rows: int = 40) -> tuple[DataFrame, bool]:
    """The model of each language and source, and whether those are few enough to broadcast.

    A group of fewer than least_rows rows takes the estimate of its language, a language of fewer that
    of all rows; where those are too few as well it has none. rows: q_key, q_lang and the vector columns
    of the texts that pass the fixed rules. Columns of the model: q_key, n, mu_i, l_ij, and median (of
    the squared distances over the whole group).
    """
    v = [f"q_v_{name}" for name in NAMES]
    groups = rows.select("q_key", "q_lang").distinct()
    rows = rows.select(F.explode(F.array("q_key", "q_lang", F.lit(EVERYTHING))).alias("q_key"), *v)
    start = rows.groupBy("q_key").agg(
        F.count(F.lit(1)).alias("n"), *(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p_{i}") for i, c in enumerate(v))
    )
    start = cut(start.where(F.col("n") >= least_rows))
    small = groups.count() <= BROADCAST_GROUPS
    floor = list(VECTOR.values())
    spread = [F.greatest((F.col(f"p_{i}")[2] - F.col(f"p_{i}")[0]) / SCALE / 1.349, F.lit(floor[i])) for i in range(P)]
    model = start.select(
        "q_key",
        "n",
        *((F.col(f"p_{i}")[1] / SCALE).alias(f"mu_{i}") for i in range(P)),
        *((spread[i] if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(P) for j in range(i + 1)),
    )
    # Distances are compared in whole 64ths, capped far beyond any cutoff, so that percentiles hold few values.
    step = F.floor(F.least(distance2(), F.lit(1000.0)) * 64)
    for _ in range(steps):
        near = joined(rows, model, small).where("n is not null").select("q_key", *v, step.alias("d"))
        bound = near.groupBy("q_key").agg(F.percentile("d", F.lit(percent / 100)).alias("bound"))
        core = near.join(F.broadcast(bound) if small else bound, "q_key").where("d <= bound")
        sums = core.groupBy("q_key").agg(
            F.count(F.lit(1)).alias("n"),
            *(F.sum(v[i]).alias(f"s_{i}") for i in range(P)),
            *(F.sum(F.col(v[j]) * F.col(v[i])).alias(f"s_{j}_{i}") for j in range(P) for i in range(j, P)),
        )
        model = cut(factored(sums))
    near = joined(rows, model, small).where("n is not null").select("q_key", step.alias("d"))
    median = near.groupBy("q_key").agg((F.percentile("d", F.lit(0.5)) / 64).alias("median"))
    model = cut(model.join(median, "q_key"))
    names = [c for c in model.columns if c != "q_key"]
    packed = model.select(F.col("q_key").alias("k"), F.struct(*names).alias("m"))
    found = groups
    for level, key in enumerate((F.col("q_key"), F.col("q_lang"), F.lit(EVERYTHING))):
        found = found.join(packed.select(F.col("k").alias(f"k{level}"), F.col("m").alias(f"m{level}")), key == F.col(f"k{level}"), "left")
    best = F.coalesce("m0", "m1", "m2")
    return cut(found.select("q_key", *(best[c].alias(c) for c in names))), small


def verdict(cutoff: float) -> Column:
    """Whether a row joined with its group's model stays: the distance is scaled so that its median is the normal one."""
    scale = F.greatest(F.col("median") / CHI2_MEDIAN, F.lit(1.0))
    return F.coalesce(distance2() / scale <= cutoff, F.lit(True))


def judged(docs: DataFrame, cutoff: float = 36.0, least_words: int = 50, most_percent: int = 50) -> DataFrame:
    """doc_id, the counts, base_failed, distance2 and kept of every row.

    A null text has no words and fails; a null language or source is a group of its own. Groups of
    few passing rows are judged by their language's estimate; see estimates. Repeated rows are judged alike, other
    columns are not read, an empty table gives an empty table.
    """
    rows = with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text")
    rows = cut(rows.withColumns({"q_failed": base_failed("q_", least_words, most_percent), **group_keys(), **vector()}).drop("lang", "source"))
    model, small = estimates(rows.where(~F.col("q_failed")))
    return joined(rows, model, small).select(
        "doc_id",
        *(F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("q_failed").alias("base_failed"),
        distance2().alias("distance2"),
        (~F.col("q_failed") & verdict(cutoff)).alias("kept"),
    )


def keep_good(docs: DataFrame, cutoff: float = 36.0, least_words: int = 50, most_percent: int = 50) -> DataFrame:
    """The rows of docs that the rules keep, with their columns; see judged.

    The counts are made twice, for the estimates and for the verdicts, so that texts are never shuffled.
    """
    taken = set(docs.columns)
    prefixed = [c for c in taken if c.lower() in {"n", "median"} or c.lower().startswith(("q_", "mu_", "l_"))]
    if prefixed:  # columns whose names the operator uses itself
        hidden = {c: free_name(docs, f"kept_{i}") for i, c in enumerate(sorted(prefixed))}
        back = {v: k for k, v in hidden.items()}
        return keep_good(docs.withColumnsRenamed(hidden), cutoff, least_words, most_percent).withColumnsRenamed(back).select(docs.columns)
    rows = with_counts(docs).withColumns({"q_failed": base_failed("q_", least_words, most_percent), **group_keys(), **vector()})
    # Filters wait until the counts are made; pushed below them, they would be made twice.
    few = cut(rows.select("q_failed", "q_key", "q_lang", *(f"q_v_{name}" for name in NAMES)))
    model, small = estimates(few.where(~F.col("q_failed")))
    stays = F.when(F.col("q_failed"), F.lit(False)).otherwise(verdict(cutoff))
    return joined(rows, model, small).where(stays).select(docs.columns)
