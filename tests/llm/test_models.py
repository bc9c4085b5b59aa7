"""Classifiers by held-out accuracy, language-model scores against a direct computation."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from objgrove.llm import lm_scoring, quality, toxicity

SF = "/root/testdata/sf0.1"


def rates(scored, labels, label):
    rows = scored.where("held_out").join(labels.select("doc_id", label), "doc_id").select("predicted", label).collect()
    hit = lambda v: np.mean([r[0] == v for r in rows if r[1] == v])
    assert len(rows) > 200
    return hit(0), hit(1)


@pytest.fixture(scope="module")
def data(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return spark.read.parquet(f"{SF}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi").where("doc_id % 2 = 0"), labels


def test_quality_held_out(data):
    low, high = rates(quality.quality(*data), data[1], "quality")
    assert low >= 0.85 and high >= 0.97


def test_toxicity_held_out(data):
    ordinary, toxic = rates(toxicity.toxicity(*data), data[1], "toxic")
    assert ordinary >= 0.95 and toxic >= 0.7


def test_votes_against_plain_cosines():
    """Every neighbour by a loop over all labelled vectors."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(rng.choice(words[30 * k :][:40], 30)).encode()
    labels = np.array([i % 2 for i in range(80)])
    hashed = quality.Hashed()
    model = quality.Model(hashed.rows([text(k) for k in labels]), labels, 0.7)
    asked = [text(i % 2) for i in range(12)] + [b""]
    got = model.score(hashed.rows(asked))
    for raw, score in zip(asked, got, strict=True):
        x = np.zeros(quality.TERMS)
        for term, n in quality.terms(raw).items():
            x[zlib.crc32(term) % quality.TERMS] += n
        v = np.log1p(x) * model.idf
        v = (v / np.linalg.norm(v)) @ model.axes
        cosines = sorted(((float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)), i) for i, u in enumerate(model.vectors)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(c, 1e-6) ** quality.POWER * (0.7 / 0.5 if labels[i] else 0.3 / 0.5), labels[i]) for c, i in cosines]
        assert np.isclose(score, sum(w for w, k in votes if k) / sum(w for w, _ in votes), atol=1e-3)


def insults(rng, n):
    """(text, toxic): prose of made-up words, with insults in every third text."""
    common, bad = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ala", "eri", "oso", "umo", "ine")], ["zwoggle", "xyrfhead", "qubbish"]
    for i in range(n):
        w = list(rng.choice(common, rng.integers(20, 200)))
        for _ in range(4 if i % 3 == 0 else 0):
            w.insert(int(rng.integers(len(w))), bad[int(rng.integers(3))])
        yield " ".join(w), int(i % 3 == 0)


def test_windows_against_plain_compression():
    """Every window's two lengths by a compressor made for it, and what each dictionary is trained on."""
    import zstandard as z

    rows = [(toxic, text.encode()) for text, toxic in insults(np.random.default_rng(1), 900)]
    model = toxicity.train(rows)
    assert b"zwoggle" in model.toxic and b"zwoggle" not in model.ordinary and b"ala " in model.ordinary and model.toxic.endswith(model.ordinary)
    raw, got = rows[0][1], model.differences(rows[0][1], model.tools())
    params = z.ZstdCompressionParameters(
        window_log=15, chain_log=13, hash_log=13, search_log=6, min_match=5, target_length=64, strategy=z.STRATEGY_LAZY2,
        format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    plain, at = [], 0
    while at == 0 or at < len(raw) - toxicity.WINDOW + toxicity.STRIDE:
        lengths = [len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress(raw.lower()[at : at + toxicity.WINDOW] + toxicity.TAIL)) for d in (model.ordinary, model.toxic)]
        plain.append(lengths[0] - lengths[1])
        at += toxicity.STRIDE
    assert got.tolist() == plain and at >= len(raw) - toxicity.WINDOW + toxicity.STRIDE


def test_clean_rejects_toxic_documents(spark):
    rows = [(i, text, toxic) for i, (text, toxic) in enumerate(insults(np.random.default_rng(3), 1200))]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, toxic) for i, _, toxic in rows], "doc_id long, toxic int")
    kept = {r["doc_id"] for r in toxicity.clean(df, labels).collect()}
    gone = {i for i, _, toxic in rows if toxic}
    assert len(gone & kept) <= 0.05 * len(gone) and len(kept - gone) >= 0.98 * (len(rows) - len(gone))


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_edges(spark, run):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (None, "a b"), (5, "a b"), (5, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (3, 1, 0), (3, 0, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = run(df, known).collect()
        assert len(rows) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        assert {r["held_out"] for r in rows if r["doc_id"] is None} == {True}
        assert len({r["score"] for r in rows if r["doc_id"] in (5, None)}) == 1
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert run(df.limit(0), labels).collect() == []


def test_clean_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, None)], "doc_id long, text string, `__score` double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.clean(df, labels)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, "a", 2.0), (2, None, None)]


def test_entropy_difference(spark):
    texts = ["the cat sat", "the cat ran off", None, "", "dog dog dog", "the cat sat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    goal = spark.createDataFrame([(1, "the cat sat on the mat")], "item_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs, goal).collect()}

    def model(corpus):
        words, before, pairs = {}, {}, {}
        for t in corpus:
            w = ["\0", *re.findall(r"\S+", t or "")]
            for a, b in zip(w, w[1:]):
                words[b] = words.get(b, 0) + 1
                before[a] = before.get(a, 0) + 1
                pairs[a, b] = pairs.get((a, b), 0) + 1
        n, (pair, one, flat) = sum(words.values()), lm_scoring.SHARES
        return lambda a, b: -math.log(pair * pairs.get((a, b), 0) / max(before.get(a, 0), 1) + one * words.get(b, 0) / n + flat / lm_scoring.VOCABULARY)

    target, background = model(["the cat sat on the mat"]), model(texts)
    for i, t in enumerate(texts):
        w = ["\0", *re.findall(r"\S+", t or "")]
        n = len(w) - 1
        x, y = (sum(m(a, b) for a, b in zip(w, w[1:])) / max(1, n) for m in (target, background))
        assert got[i]["n_tokens"] == n
        assert np.allclose([got[i]["target_loss"], got[i]["background_loss"], got[i]["score"]], [x, y, x - y], atol=1e-4)
    assert got[0]["score"] < got[4]["score"]
    assert lm_scoring.cross_entropy_difference(docs.limit(0), goal.limit(0)).collect() == []
    assert lm_scoring.cross_entropy_difference(docs.withColumn("n_tokens", F.lit(1)), goal.limit(0)).count() == 6


def test_entropy_counts_are_exact_in_a_wide_corpus(spark, monkeypatch):
    """More words and pairs than any fixed table of 2^18 and 2^22 keeps apart: nothing unseen looks seen."""
    monkeypatch.setattr(lm_scoring, "ENTRIES", 1 << 20, raising=False)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 999), lambda i: F.concat(F.lit("w"), i.cast("string")))).alias("text"))
    goal = spark.createDataFrame([(1, "w0 w1 w2")], "item_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs, goal).where("doc_id in (0, 7)").collect()}
    pair, one, flat = lm_scoring.SHARES
    loss = lambda pairs, words: -math.log(pair * pairs + one * words + flat / lm_scoring.VOCABULARY)
    # every word occurs once, and a document's first one after the start of one text in 6000
    background = (999 * loss(1, 1 / 6e6) + loss(1 / 6000, 1 / 6e6)) / 1000
    assert got[7]["n_tokens"] == 1000
    assert np.allclose([got[i]["background_loss"] for i in (0, 7)], background, atol=1e-6)
    assert np.isclose(got[7]["target_loss"], loss(0, 0), atol=1e-6)
    assert np.isclose(got[0]["target_loss"], (3 * loss(1, 1 / 3) + 997 * loss(0, 0)) / 1000, atol=1e-6)
