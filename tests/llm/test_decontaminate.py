import hashlib
import re

from quillgrid.llm import decontaminate


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(len(w), width)
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    ids |= {str(x) for x in found if x is not None}
        out.append((doc, len(w), len(hit), ",".join(sorted(ids))))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as words", "1 as item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as words", "2 as doc_id")
    return sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.contaminated(d, b).collect()), key=str)


TEXT = " ".join(f"w{i}" for i in range(40))


def test_edges(spark):
    items = [(1, TEXT), (2, "short item"), (3, None), (4, "..."), (5, "a " * 12), (None, "null id here"), (10, TEXT), (10, "the the the the the the the the the the the end")]
    docs = [
        (1, TEXT), (2, "x " + " ".join(TEXT.split()[5:15]) + " y"), (3, " ".join(TEXT.split()[5:14])), (4, None), (5, ""), (6, "a Short, item! short item"),
        (7, "a " * 30), (8, "and null id here"), (9, "the " * 500 + "end"), (9, "the " * 500 + "end"), (None, TEXT[:100]), (11, (TEXT + " z ") * 200),
    ]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items[:0]) == brute(docs, [])
    assert run(spark, docs[:0], items) == []


def test_blocks_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"w{j}" for j in range(i, i + 15))) for i in range(0, 40, 4)]
    docs = [(1, TEXT), (2, "none"), (3, " ".join(f"w{j}" for j in range(10, 25)))]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert run(spark, docs, items) == brute(docs, items)


def test_clean_documents_stay(spark):
    d = spark.createDataFrame([(1, TEXT), (2, "clean words"), (2, "clean words"), (None, "also clean"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    assert sorted((r.doc_id or 0) for r in decontaminate.without_contaminated(d, b).collect()) == [0, 2, 2, 3]


def test_query_matches_brute_force(spark):
    from quillgrid.llm.queries import op6_decontaminate

    at = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    want = sorted(((d, n, h, hashlib.sha256(s.encode()).hexdigest(), h > 0) for d, n, h, s in brute(docs, items)), key=str)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in op6_decontaminate(spark, at).collect()), key=str)
    assert got == want
