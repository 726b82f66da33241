"""Each stage of the pipeline against brute force on the stage's own input."""

import pytest

import corpus_pipeline
from quillgrid.llm import quality
from quillgrid.llm.common import written
from tests.llm import test_decontaminate, test_linededup, test_neardup, test_quality

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], AT)))
    return [(df, df.collect()) for df in seen]


def test_columns_stay_until_the_last(stages):
    assert all(df.columns == stages[0][0].columns for df, _ in stages[:-1])
    assert stages[-1][0].columns == [*stages[0][0].columns, "mix_source", "mix_block", "mix_slot", "mix_position"]


def test_quality_stage(stages):
    (df, before), (_, after) = stages[0], stages[1]
    kept = {r.doc_id for r in quality.judged(df).where("kept").collect()}
    assert {r.doc_id for r in after} == kept and kept <= {r.doc_id for r in before if not test_quality.brute(r.text)[5]}
    assert set(after) <= set(before)


def test_line_stage(stages):
    before, after = stages[1][1], stages[2][1]
    gone = test_linededup.brute([(r.doc_id, r.text) for r in before], least=1)
    want = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone) for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)


def test_near_stage(stages):
    before, after = stages[2][1], stages[3][1]
    assert sorted(r.doc_id for r in after) == test_neardup.brute_kept([(r.doc_id, r.text) for r in before])


def test_benchmark_stage(spark, stages):
    before, after = stages[3][1], stages[4][1]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in test_decontaminate.brute([(r.doc_id, r.text) for r in before], items) if n}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - hit


def test_mixing_stage(stages):
    before, after = stages[4][1], stages[5][1]
    assert sorted(r.mix_position for r in after) == list(range(len(before)))
    assert {(r.doc_id, r.text) for r in after} == {(r.doc_id, r.text) for r in before}


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, AT).collect()
    assert sorted((r.doc_id, r.mix_position) for r in got) == sorted((r.doc_id, r.mix_position) for r in stages[5][1])
