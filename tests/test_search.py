import random
import re

from quillgrid.operators import fuzzy, singletons
from quillgrid.sources import expand


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fits(asked, word):
    if asked in word:
        return True
    if asked.isdigit():
        return False
    letters = iter(word)
    if len(asked) >= 3 and len(word) >= 3 and (word in asked or all(c in letters for c in asked)):
        return True
    most = 1 if len(asked) <= 4 else 2 if len(asked) <= 8 else 3
    return not word.isdigit() and max(len(asked), len(word)) <= 32 and distance(asked, word) <= most


def test_every_pair_of_words_that_fits_is_met(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abco1") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 9, 12]))) for _ in range(150)} | {"aa", "a", "1", "x" * 31, "x" * 40}
    long = ["constabulary", "registration", "infantmortality"]
    words |= set(long)
    asked = set(rng.sample(sorted(words), 60)) | {w[:k] + rng.choice("abxy") + w[k + d :] for w in long for k in range(len(w)) for d in (0, 1, 2, 3)} | {"x" * 33, "x" * 29}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    wanted = spark.createDataFrame([(a,) for a in asked], "asked string")
    from pyspark.sql import functions as F

    got = {(r.asked, r.word) for r in fuzzy.meeting(wanted, frame).where(fuzzy.fits(F.col("asked"), F.col("word"))).collect()}
    assert got == {(a, w) for a in asked for w in words if fits(a, w)}


def test_queries_of_every_kind(spark):
    tables = spark.createDataFrame([(1, "TABLE 10(I): Religion and births", 15, "R-1", None), (2, "Deaths by age", 5, None, "file15.xlsx"), (3, None, None, "", "")], "id int, title string, page int, table_id string, file string")
    asked = ["15", "p.15", "Page 5", "relgion", "birts religon", "10 i", "xlsx deaths", "", "  !", "zzzz", None, "p15 x"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {}
    for r in fuzzy.search(tables, queries, ["title", "table_id", "file"]).collect():
        got.setdefault(asked[r.query_id], set()).add(r.id)
    every = {1, 2, 3}
    assert got == {"15": {1}, "p.15": {1}, "Page 5": {2}, "relgion": {1}, "birts religon": {1}, "10 i": {1}, "xlsx deaths": {2}, "": every, "  !": every, None: every}


def brute_merges(proposals, titles):
    def tokens(title):
        base = re.sub(r"\s*\([^()]*\)\s*$", "", title).lower()
        return {w for w in re.findall("[a-z0-9]+", base) if len(w) >= 3 and w not in ("and", "the", "table", "urban", "rural") and not w.isdigit()}

    used, out = set(), []
    for ord_, confidence, ids in sorted(proposals):
        free = [x for x in dict.fromkeys(i.strip() for i in ids if i) if x in titles and x not in used]
        told = [tokens(titles[x]) for x in free if titles[x].strip()]
        agree = all(len(a & b) >= 2 or (a & b and len(a & b) >= 0.7 * min(len(a), len(b))) for k, a in enumerate(told) for b in told[:k])
        if confidence.strip().lower() == "high" and len(free) >= 2 and len(told) >= 2 and agree:
            used |= set(free)
            out.append((ord_, free))
    return out


def test_merges_equal_one_by_one_settlement(spark):
    rng = random.Random(5)
    nouns = ["births", "deaths", "infant", "literacy", "workers", "crops"]
    titles = {f"t{i}": " and ".join(rng.sample(nouns, rng.randint(1, 3))) + rng.choice(["", " (urban)"]) if i % 9 else " " for i in range(120)}
    proposals = [(i, rng.choice(["high", "High ", "low"]), [rng.choice([*titles, "none"]) for _ in range(rng.randint(1, 4))]) for i in range(150)]
    frame = spark.createDataFrame([("s", *p) for p in proposals], "scope string, ord long, confidence string, ids array<string>")
    got = singletons.accepted_merges(frame, spark.createDataFrame([("s", *x) for x in titles.items()], "scope string, id string, title string"))
    assert sorted((r.ord, r.ids) for r in got.collect()) == brute_merges(proposals, titles)
    assert singletons.accepted_merges(frame.where("false"), spark.createDataFrame([], "scope string, id string, title string")).count() == 0


def test_ragged_and_broken_datasets(spark):
    rows = [("a", 1, 1, '{"y": 1, "x": "p"}'), ("a", 0, 2, '{"x": null, "z": {"k": [1]}}'), ("a", None, 3, '{"w": true}'), ("a", 2, 4, "junk"), ("b", 0, 5, "[1]"), ("b", 1, 6, None)]
    frame = spark.createDataFrame(rows, "dataset string, row_index int, id int, payload string")
    sets = spark.createDataFrame([("a", " T1 ", None, "Health"), ("b", "", "Bee", None), ("c", None, None, "")], "dataset string, table_id string, title string, category string")
    order = ["row_index", "id"]
    tables = {r.dataset: r for r in expand.expanded_tables(sets, frame, "dataset", order, "payload", {"Category": "category"}).collect()}
    assert (tables["a"].table_id, tables["a"].title, tables["a"].columns, tables["a"].n_rows, tables["a"].notes) == ("T1", "T1", ["x", "z", "y", "w"], 4, ["Category: Health"])
    assert tables["b"].columns == ["_error"] and tables["b"].error and tables["b"].title == "Bee"
    assert (tables["c"].columns, tables["c"].n_rows, tables["c"].error) == ([], 0, None)
    cells = [(r.dataset, r.row, r.cells) for r in expand.expanded_rows(frame, "dataset", order, "payload").orderBy("row").collect()]
    assert cells == [("a", 0, [None, '{"k":[1]}', None, None]), ("a", 1, ["p", None, "1", None]), ("a", 2, [None, None, None, "true"])]
