"""The pipeline and its stages, against what each operator says of the same rows."""

import pytest

import corpus_pipeline
from strandlog.llm import near_dedup, packing, quality_classifier, secret_scan

STAGES = dict(corpus_pipeline.STAGES)


def test_stage_order():
    assert [n.split()[0] for n in STAGES] == ["quality", "MinHash", "secret", "mixing", "best-fit"]


def test_run_equals_the_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    good = corpus_pipeline.classify(spark, docs, sf).cache()
    model = quality_classifier.fitted(spark, docs.select("doc_id", "text"), sf)
    want = {r["doc_id"] for r in quality_classifier.score(docs, model).filter("score >= 0.3").collect()}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == want < ids
    one = corpus_pipeline.dedup(spark, good, sf).cache()
    kept = {r["doc_id"] for r in near_dedup.near_duplicates(good).filter("kept").collect()}
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(kept)
    clean = corpus_pipeline.scrub(spark, one, sf).cache()
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {i: secret_scan.redacted(t) for i, t in before.items()}
    assert clean.columns == columns and secret_scan.scan(clean).filter("n_assign + n_access + n_hex > 0").count() == 0
    mixed = corpus_pipeline.mix(spark, clean, sf).cache()
    assert mixed.columns == columns and 0 < mixed.count() < clean.count()
    packed = corpus_pipeline.pack(spark, mixed, sf)
    rows = [(r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed.collect()]
    assert {i for i, _, _ in rows} == {r["doc_id"] for r in mixed.collect()}
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(rows)
    assert packed.groupBy("sequence_id").sum("length").filter(f"`sum(length)` > {packing.CAPACITY}").count() == 0


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_edge_cases(spark, edge, nothing, sf, name):
    for docs in (edge, nothing):
        out = STAGES[name](spark, docs, sf)
        assert out.count() <= docs.count() + (name == "best-fit packing") * 100
        if name != "best-fit packing":
            assert out.columns == docs.columns
