"""The pipeline's stages on the small tables: each keeps what plain Python keeps."""

import corpus_pipeline
from turnloom.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == before.columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, t in kept["near_duplicates"].items() if any(x in " ".join(t.lower().split()) for x in items)}
    assert set(kept["decontamination"]) <= set(kept["near_duplicates"]) - dirty
    assert set(kept["pii"]) == set(kept["decontamination"])
    assert {r.doc_id for r in docs.collect()} == set(kept["pii"])


def test_names():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
