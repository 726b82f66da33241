import itertools

import xxhash

from quillgrid.llm import simhash


def brute_print(text, width=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    parent = {i: i for i in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= radius:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: top(i) for i in prints}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, variant int")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = {r[0]: brute_print(r[1]) for r in rows}
    groups = brute_components(prints)
    assert got == {i: (prints[i], groups[i]) for i in prints}


def test_edges_of_the_input(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    texts = [None, "", " \t\n", "One", "one", "a b", base, base.upper(), base + " thirteen", "É é x y", base * 400]
    texts += [base] * 20
    check(spark, [(i, t, "clash", 1) for i, t in enumerate(texts)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0


def test_links_of_near_values_match_brute_force(spark):
    import random

    random.seed(1)
    centres = [random.getrandbits(64) for _ in range(30)]
    prints = set(centres)
    for c in centres:
        for _ in range(12):
            v = c
            for b in random.sample(range(64), random.choice([1, 2, 3])):
                v ^= 1 << b
            prints.add(v)
    signed = {p - 2**64 if p >> 63 else p: p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.fp: r.root for r in simhash.components(simhash.linked_pairs(df)).collect()}
    want = brute_components({s: p for s, p in signed.items()})
    classes = {}
    for s, t in want.items():
        classes.setdefault(t, set()).add(s)
    for members in classes.values():
        assert {roots.get(s, s) for s in members} == {min(members)}


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(3, base), (1, base), (1, base), (2, base + " end"), (7, "alone here now"), (None, "x"), (None, "x")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 7]


def test_query_matches_brute_force(spark):
    from quillgrid.llm.queries import op8_simhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op8_simhash(spark, "/root/testdata/sf0.001").collect()}
    prints = {d.doc_id: brute_print(d.text) for d in docs}
    groups = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}
