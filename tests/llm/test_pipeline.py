from pyspark.sql import functions as F

import corpus_pipeline
from lodestrand.llm import queries


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "PII", "mixing sources to target weights", "best-fit packing"]
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialise(stage(spark, docs, small), f"stage-{k}")
        if k < 4:
            assert out.columns == columns and out.schema.simpleString() == docs.schema.simpleString()
            assert all(r.n_chars == len(r.text) for r in out.collect())
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids and now
        docs, ids = out, now


def test_edge_rows_pass_all_stages(spark, edge_docs, no_docs, small):
    for docs in (edge_docs, no_docs):
        docs = docs.select("doc_id", "text", "source", F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("n_chars"))
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, small), "edge")
        assert docs.columns[-2:] == ["sequence_id", "offset"]


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
