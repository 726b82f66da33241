from quillgrid.llm import linededup
from tests.llm.test_linededup import brute, random_docs


def removed(spark, docs):
    rows = linededup.report(spark.createDataFrame(docs, "doc_id long, text string"), min_tokens=1).collect()
    return {(r.doc_id, int(i)) for r in rows for i in r.removed.split(",") if i}


def test_short_lines_go_as_well(spark):
    docs = [(1, "All rights reserved.\n\nna na na na na na"), (2, "all rights reserved.\n\n \t\nx"), (3, "x\nna na\none two three four"), (4, "one two three four five\n\nx y")]
    want = {(2, 0), (3, 0), (3, 1), (4, 0)}
    assert removed(spark, docs) == brute(docs, least=1) == want


def test_lines_of_all_lengths_match_brute_force(spark):
    docs = random_docs(3)
    assert removed(spark, docs) == brute(docs, least=1)


def test_query_removes_short_repeats(spark):
    from quillgrid.llm.queries import op1_line_dedup

    at = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    got = {(r.doc_id, int(i)) for r in op1_line_dedup(spark, at).collect() for i in r.removed.split(",") if i}
    assert got == brute(docs, least=1) > brute(docs)
