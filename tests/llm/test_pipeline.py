import pyarrow.parquet as pq

import corpus_pipeline
from sarstack.llm import decontaminate, mixing, near_dedup, quality_model

SF = "/root/testdata/sf0.001"


def test_stages_follow_from_their_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF).cache()
        if name == "quality_classifier":
            good = quality_model.classify(seen, quality_model.fitted(spark, seen, SF)).where("predicted = 1")
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in good.collect())
        if name == "minhash_near_dedup":
            kept = near_dedup.near_duplicates(seen).where("kept")
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in kept.collect())
        if name == "benchmark_decontamination":
            bad = {r.doc_id for r in decontaminate.matches(seen, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert bad and {r.doc_id for r in out.collect()} == {r.doc_id for r in seen.collect()} - bad
        if name == "source_mixing":
            assert out.count() == sum(r.copies for r in mixing.copies(seen).collect())
        if name == "token_files":
            assert out.count() == seen.count()
        else:
            assert out.columns == docs.columns
        seen = out
    assert corpus_pipeline.run(spark, SF).count() == seen.count()


def test_pipeline_keeps_good_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    assert sum(i in out for i, q in labels.items() if q == 1) >= 0.98 * sum(q == 1 for q in labels.values())
    assert not any(i in out for i, q in labels.items() if q == 0)
