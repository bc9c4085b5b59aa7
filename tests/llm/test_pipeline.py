"""The pipeline's stages one after another."""

from __future__ import annotations

import corpus_pipeline
from objgrove.llm import toxicity
from tests.llm.test_jaccard import brute as near
from tests.llm.test_suffix import brute as repeats


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        rows = out.collect()
        if name != "packing":
            assert out.dtypes == docs.dtypes
            at = spark.createDataFrame(rows, docs.schema).coalesce(2)
        seen[name] = rows
    # ten toxic labels teach little; how well the classifier does is measured on more of them, in test_models
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert {r["doc_id"] for r in seen["toxicity"]} == {r["doc_id"] for r in scored if not r["predicted"]}
    assert len(seen["toxicity"]) >= 0.8 * docs.count()
    classes = near([(r["doc_id"], r["text"]) for r in seen["toxicity"]])
    assert {r["doc_id"] for r in seen["near copies"]} == {c for _, c, _ in classes}
    want = {r[0]: r for r in repeats([(r["doc_id"], r["text"]) for r in seen["near copies"]])}
    before = {r["doc_id"]: r for r in seen["near copies"]}
    for r in seen["repeated passages"]:
        assert len(r["text"].encode()) <= want[r["doc_id"]][1] - want[r["doc_id"]][2]
        assert r["n_chars"] == (before[r["doc_id"]]["n_chars"] if r["text"] == before[r["doc_id"]]["text"] else len(r["text"]))
    assert {r["doc_id"] for r in seen["mix"]} <= set(before)
    counted = {}
    for r in seen["mix"]:
        counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + 1
    assert max(counted.values()) <= 3
    once = [p for p in seen["packing"] if counted[p.doc_id] == 1]
    assert {p.doc_id for p in seen["packing"]} == set(counted) and sum(p.length for p in once) == sum({p.doc_id: p.doc_tokens for p in once}.values())


def test_run_writes_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
