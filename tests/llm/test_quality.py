import math
import random
import re

from quillgrid.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "x y z q x y z", "é ünï #*$ \x0b| <b>&", "l\nl\n \nl \nm", "w " * 20000, "\n\na b c\n\na b c\n", "p q r s " * 30 + " ".join(f"u{i}" for i in range(200))]


def rows(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n long, q_words string, mu_0 double")
    return df


def test_counts(spark):
    df = rows(spark, [(i, t, None, "s", i, "clash", 0.0) for i, t in enumerate(TEXTS)])
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judged(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert quality.judged(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def made(seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(60, 300))), "en", "a", i, "x", 0.0) for i in range(200)]
    for i in range(200, 220):
        docs.append((i, " ".join(rnd.choice(words) + "$$$###" for _ in range(100)), "en", "a", i, "x", 0.0))
    docs += [(300, docs[0][1], None, None, 1, "x", 0.0), (None, docs[1][1], "en", "a", 1, "x", 0.0)]
    return docs


def test_outliers_go_and_clean_rows_stay(spark):
    df = rows(spark, made())
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == set(range(200)) | {300, None}
    assert {r.doc_id for r in quality.judged(df).where("kept").collect()} == ids


def test_distance_matches_numpy(spark):
    import numpy as np

    df = rows(spark, made())
    counted = quality.with_counts(df.select("doc_id", "lang", "source", "text")).withColumns(quality.vector()).withColumns(quality.group_keys())
    counted = counted.where("lang = 'en'")
    got = counted.select("doc_id", *(f"q_v_{n}" for n in quality.NAMES)).collect()
    x = np.array([r[1:] for r in got]) / quality.SCALE
    floor = np.array(list(quality.VECTOR.values()))
    q = np.percentile(x, [25, 50, 75], axis=0)
    d = (((x - q[1]) / np.maximum((q[2] - q[0]) / 1.349, floor)) ** 2).sum(1)
    for _ in range(3):
        whole = np.floor(np.minimum(d, 1000) * 64)
        core = x[whole <= np.percentile(whole, 75)]
        cov = np.cov(core.T, bias=True) + np.diag(floor**2)
        diff = x - core.mean(0)
        d = np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)
    model, small = quality.estimates(counted)
    mine = {r.doc_id: r.d for r in quality.joined(counted, model, small).select("doc_id", quality.distance2().alias("d")).collect()}
    for r, want in zip(got, d):
        assert math.isclose(mine[r.doc_id], want, rel_tol=1e-6, abs_tol=1e-6)


def test_query_matches_brute_force(spark):
    from quillgrid.llm.queries import op5_quality

    at = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    got = op5_quality(spark, at).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {i: brute(t) for i, t in docs.items()}
    assert not any(r.kept and r.base_failed for r in got)


def test_labelled_clean_documents_stay(spark):
    from quillgrid.llm.queries import op5_quality

    at = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = [r for r in op5_quality(spark, at).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in got if labels[r.doc_id] == 1]
    poor = [r.kept for r in got if labels[r.doc_id] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(poor) <= 0.5 * len(poor)
