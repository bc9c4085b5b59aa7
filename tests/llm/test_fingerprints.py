"""Winnowing against brute force."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from objgrove.llm import fingerprints as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(spark, texts):
    """Each text's gram hashes, as Spark's hash function gives them."""
    rows = [(i, j, *(w[j : j + W.K] + [None] * W.K)[: W.K]) for i, t in enumerate(texts) for w in [WORD.findall(t)] for j in range(max(1, len(w) - W.K + 1)) if w]
    names = [f"w{k}" for k in range(W.K)]
    df = spark.createDataFrame(rows, "i int, j int, " + ", ".join(f"{n} string" for n in names))
    gram = F.xxhash64(*[F.when(F.col(n).isNotNull(), F.xxhash64(n)) for n in names])
    out = [[] for _ in texts]
    for i, _, h in sorted(df.select("i", "j", F.shiftrightunsigned(gram, W.POSITION_BITS + 1)).collect()):
        out[i].append(h)
    return out


def winnowed(hashes):
    kept = []
    for a in range(max(1, len(hashes) - W.WINDOW + 1) if hashes else 0):
        window = list(enumerate(hashes))[a : a + W.WINDOW]
        best = min(window, key=lambda x: (x[1], -x[0]))
        if best not in kept:
            kept.append(best)
    return kept


def shown(kept):
    return " ".join(f"{h:x}@{p:x}" for p, h in kept)


def likeness(a, b):
    x, y = {h for _, h in a}, {h for _, h in b}
    return 1.0 if not x | y else len(x & y) / len(x | y)


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in W.fingerprints(df).collect())
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    texts = [t or "" for _, t in order]
    edited = [t[: len(t) - len(t) // 2] + texts[i - 1][: len(t) // 2] for i, t in enumerate(texts)]
    own = [winnowed(h) for h in grams(spark, texts)]
    changed = [winnowed(h) for h in grams(spark, edited)]
    want = [(order[i][0], len(t), hashlib.sha256(edited[i].encode()).hexdigest(), shown(own[i]), shown(changed[i]), likeness(own[i], changed[i]), likeness(own[i], own[i - 1])) for i, t in enumerate(texts)]
    assert got == sorted(want)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(W, "BUCKET_ROWS", 4)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(["é", "𝄞x", "the", "a b", "\n", " ", " ", "of"]) for _ in range(n))
    rows = [(rng.randrange(1000) * 3, text(rng.randrange(200))) for _ in range(40)]
    rows += [(-5, "a b"), (7, None), (8, ""), (10**12, " \t "), (9, "word " * 500), (9, "word " * 400), (11, text(60)), (11, text(61))]
    check(spark, rows)


def test_one_row_and_none(spark):
    check(spark, [(4, "one two three four five six seven eight nine ten eleven twelve thirteen")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert W.fingerprints(empty).collect() == []


def test_null_id_sorts_first_and_plan_is_native(spark):
    df = spark.createDataFrame([(None, "x y z"), (1, "p q r")], "doc_id long, text string")
    out = W.fingerprints(df)
    got = {r["doc_id"]: r["edited_sha256"] for r in out.collect()}
    assert got == {None: hashlib.sha256(b"x yp ").hexdigest(), 1: hashlib.sha256(b"p qx ").hexdigest()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_match_guarantee(spark):
    """A run of K + WINDOW - 1 words that two texts share gives them a common hash, with its position."""
    rng = random.Random(4)
    words = lambda n: [str(rng.randrange(10**9)) for _ in range(n)]
    run = words(W.K + W.WINDOW - 1)
    df = spark.createDataFrame([(i, " ".join(words(30 + i) + run + words(20))) for i in range(8)], "doc_id long, text string")
    fp = df.select("doc_id", W.winnow(F.col("text")).alias("fp"))
    rows = fp.select("doc_id", W.hashes(F.col("fp")).alias("h"), W.positions(F.col("fp")).alias("p")).collect()
    common = set.intersection(*[set(r["h"]) for r in rows])
    assert common
    for r in rows:
        at = [p - 30 - r["doc_id"] for p, h in zip(r["p"], r["h"], strict=False) if h in common]
        assert at and all(0 <= x < W.WINDOW for x in at)
