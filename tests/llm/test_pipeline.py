"""The corpus pipeline against a stage-by-stage model on a small table."""

import pytest

import corpus_pipeline
from versionlog.llm import packing, quality
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_neardup import classes

DATA = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    before = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    frame = docs
    rows = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, DATA).checkpoint()
        assert [f.name for f in frame.schema] == [f.name for f in docs.schema]
        rows.append({r.doc_id: r for r in frame.collect()})
    judged = quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert set(rows[0]) == {r.doc_id for r in judged.collect() if not r.rejected}
    assert set(rows[1]) == set(rows[0])
    assert all(len(r.text) <= len(before[i].text) and r.n_chars == len(r.text) for i, r in rows[1].items())
    pairs = sorted((i, r.text) for i, r in rows[1].items())
    of = classes(pairs)
    assert set(rows[2]) == {min(i for (i, _), c in zip(pairs, of, strict=True) if c == d) for d in of}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    dirty = {x[0] for x in contamination([(i, r.text) for i, r in rows[2].items()], items) if x[-1]}
    assert dirty and set(rows[3]) == set(rows[2]) - dirty
    packed = corpus_pipeline.run(spark, DATA).collect()
    tokens = {i: len(packing.encode(r.text, packing.vocabulary("byte_bpe_50k.json"))) + 1 for i, r in rows[3].items()}
    assert {r.doc_id: r.doc_tokens for r in packed} == tokens
    assert sum(r.length for r in packed) == sum(tokens.values())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, docs, stage):
    assert stage(spark, docs.limit(0), DATA).count() == 0
