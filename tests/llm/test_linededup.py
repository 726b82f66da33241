import random

from quillgrid.llm import linededup


def tokens(line):
    out = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return {w for w in out.split(" ") if w}


def brute(docs, percent=80, least=5):
    """Removed (doc, line number) by comparing every pair of lines."""
    lines = []
    for doc, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            lines.append((doc, i, tokens(line)))
    lines = [x for x in lines if len(x[2]) >= least]
    gone = set()
    for k, (doc, i, s) in enumerate(lines):
        for _, _, t in lines[:k]:
            if 100 * len(s & t) >= percent * len(s | t):
                gone.add((doc, i))
                break
    return gone


def got(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as line", "1 as ord", "2 as token")
    rows = linededup.report(df).collect()
    return {(r.doc_id, int(i)) for r in rows for i in r.removed.split(",") if i}


def random_docs(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["the", "of", "and"] * 10
    bank = [[rnd.choice(words) for _ in range(rnd.choice([3, 5, 8, 12, 30, 60]))] for _ in range(40)]
    docs = []
    for d in range(n):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            line = list(rnd.choice(bank))
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                line[rnd.randrange(len(line))] = rnd.choice(words)
            lines.append(" ".join(line))
        docs.append((d, "\n".join(lines)))
    return docs


def test_matches_brute_force(spark):
    for seed in (1, 2):
        docs = random_docs(seed)
        assert got(spark, docs) == brute(docs)


def test_edges_and_texts(spark):
    a = "one two three four five six seven eight nine ten"
    docs = [
        (1, a + "\nshort\n" + a.upper()), (2, "short\n" + a + " eleven\n\nnew words in this line here"), (3, None), (4, ""), (5, a), (5, a),
        (None, "x\n" + a), (7, "tail of its own with words\t" + "z " * 30000),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "length(text) as n_chars", "'q' as removed", "3 as gone_ord")
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns
    texts = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    want = [(1, a + "\nshort"), (2, "short\n\nnew words in this line here"), (3, None), (4, ""), (5, ""), (5, ""), (None, "x"), (7, docs[-1][1])]
    assert texts == sorted(((d, t, None if t is None else len(t)) for d, t in want), key=str)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    from quillgrid.llm.queries import op1_line_dedup

    at = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    rows = op1_line_dedup(spark, at).collect()
    assert {(r.doc_id, int(i)) for r in rows for i in r.removed.split(",") if i} == brute(docs, least=1)
    assert {r.doc_id: r.n_lines for r in rows} == {d: t.count("\n") + 1 for d, t in docs}
