import re

from quillgrid.llm import licenses


def brute(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


TEXTS = [
    None, "", " .,; ", "cc by cc by CC-BY", "All rights reserved", "x All  Rights\nReserved. all rights reserved", "GNU General Public License, version 3.",
    "éCC by", "the general public license general public license", "cc", "word " * 20000 + "cc by 4.0", "cc by " * 3000, "Licensed under the Apache License, Version 2.0.",
]


def test_base_counts(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert licenses.scan(df.limit(0)).count() == 0


def labels_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.labels for r in licenses.scan(df).orderBy("doc_id").collect()]


def test_rules_and_suppression(spark):
    got = labels_of(
        spark,
        [
            "Licensed under the Apache License, Version 2.0.",
            "Released under the MIT License.",
            "SPDX-License-Identifier: BSD 3-Clause",
            "This work is licensed under the GNU General Public License, version 3.",
            "Licensed under CC BY-NC 4.0.",
            "A commit to the summit of words",
            "Das Haus mit dem Garten",
            "Permission is hereby granted, free of charge, to any person obtaining a copy",
        ],
    )
    # The bare name and the general notice lie inside the better detection and are suppressed.
    assert got == ["apache-2.0", "mit", "bsd-3-clause", "gpl,gpl-3.0", "cc-by,cc-by-nc", "", "", "mit"]


def test_rules_are_hundreds_and_gated():
    made = licenses.rules()
    assert len(made) > 250
    for _, _, key, _, _ in made:
        assert key == key.lower()


def test_query_matches_brute_force(spark):
    from quillgrid.llm.queries import op2_license_scan

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = op2_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {d.doc_id: brute(d.text) for d in docs}
    for r in rows:
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
