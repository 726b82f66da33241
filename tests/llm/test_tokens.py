import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgrid.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = ["", " ", "a b", "a  b", "it's a dog's life", "a<|endoftext|> b <|endoftext|>", " lead", "trail ", "a\n b  c d", "x" * 70000, "één twee " * 9000, "日本語 テキスト", "a ​b \x1c c \x85 d"]


def test_counts_equal_the_library():
    assert tokens.Counter(PATH).counts(TEXTS) == plain(TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab' \n\t1.é <|>中\x1c", max_size=40), max_size=6))
def test_counts_equal_the_library_on_any_text(texts):
    assert tokens.Counter(PATH).counts(texts) == plain(texts)


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", None), (2, "", None), (None, "hello world", "y")], "doc_id long, text string, n_tokens string")
    got = tokens.token_counts(df, PATH, limit=1).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [(0, 11, 2, True), (1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False)]
    assert tokens.token_counts(df.limit(0), PATH).count() == 0


def test_query_matches_the_library(spark):
    from quillgrid.llm.queries import op7_token_counts

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in op7_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d.doc_id: (len((d.text or "").encode()), n) for d, n in zip(docs, plain([d.text or "" for d in docs]))}
