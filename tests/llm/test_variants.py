import random
import re
import zlib
from collections import Counter

from quillgrid.llm import queries, variants


def brute_words(rows, noise=199, shortest=6, least=5):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= shortest and n >= least}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        top = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= ratio * words[w] else None
    out = []
    for w in words:
        end = w
        while form[end]:
            end = form[end]
        out.append((w, form[w], end, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def make(rng, alphabet, lengths, n):
    return {"".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))): rng.choice([5, 6, 25, 30, 150, 151, 900]) for _ in range(n)}


def grouped(spark, words):
    return got(variants.grouped(spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)))


def test_dense_words_divide_blocks(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK_WORDS", 3)
    words = make(random.Random(1), "ab", [6, 7, 8, 9], 350)
    assert grouped(spark, words) == brute(words)


def test_a_hot_prefix_and_a_hot_suffix(spark):
    rng = random.Random(2)
    words = {f"vorbei{w}": n for w, n in make(rng, "abé", [4, 5, 6], 250).items()} | {f"{w}lichkeit": n for w, n in make(rng, "abÿ", [4, 5], 150).items()}
    assert grouped(spark, words) == brute(words)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK_WORDS", 8)
    monkeypatch.setattr(variants, "BROADCAST_ROWS", 0)
    words = make(random.Random(5), "abc", [6, 7], 300)
    assert grouped(spark, words) == brute(words)


def test_small_scans_give_the_same(spark, monkeypatch):
    pairs = {w: n for w, n in make(random.Random(6), "abc", [6, 7, 40], 200).items()}
    import numpy as np

    word = np.array(sorted(pairs), object)
    m = np.array([len(w) for w in word])
    everything = {(i, j) for i in range(len(word)) for j in range(i + 1, len(word)) if len(word[i]) == len(word[j]) and one_edit(word[i], word[j])}
    for cells in (50, 1 << 22):
        monkeypatch.setattr(variants, "SCAN_CELLS", cells)
        i, j = variants.near_in(word, m, np.array([""] * len(word), object), np.array([0]))
        assert {(a, b) for a, b in zip(i.tolist(), j.tolist()) if len(word[a]) == len(word[b])} == everything


def test_very_long_words_and_chains(spark):
    long = "x" * 5000
    words = {long: 5, long + "y": 25, "y" + long: 5, "z" + long[1:]: 6, "abcdef": 5, "abcdeg": 25, "abcdegh": 125, "abcdegi": 125, "abcdefé": 25}
    assert grouped(spark, words) == brute(words)


def test_empty(spark):
    assert grouped(spark, {}) == []
    assert got(variants.variants(spark.createDataFrame([(1, None, "x"), (None, "", "y")], "doc_id long, text string, word string"))) == []


def test_texts_with_nulls_repeats_and_case(spark):
    rng = random.Random(7)
    base = [w for w in make(rng, "abcdeé", [5, 6, 7, 8], 40)] + ["ÉCOLES", "écoles", "x×y÷zz", "STRASSE"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice(["", ",", "-"]) for _ in range(60))) for i in range(120)]
    rows += [(None, "null doc words " * 9), (5, None), (6, ""), (7, "中文 abcdefg" * 30), (7, "中文 abcdefg" * 30)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, block string")
    assert got(variants.variants(df)) == brute(brute_words(rows))


def test_query_equals_brute_force(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    found = queries.QUERIES["op13_spelling_variants"](spark, at)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(found) == brute(brute_words(rows))
