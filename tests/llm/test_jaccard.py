"""The chosen-path join against brute force."""

from __future__ import annotations

import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from objgrove.llm import jaccard


def brute(rows):
    words = {}
    for i, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            x, y = words[a], words[b]
            if not x and not y or x and y and Fraction(len(x & y), len(x | y)) >= Fraction(4, 5):
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low.setdefault(find(i), []).append(doc)
    return sorted((doc, min(low[find(i)]), links[i]) for i, (doc, _) in enumerate(rows))


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, copies int") if rows and len(rows[0]) == 3 else spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in jaccard.similar_documents(df).collect())


def test_documents_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r[0], r[1]) for r in d.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in jaccard.similar_documents(d).collect()) == brute(rows)


def families(rng):
    """Near copies of one text, and texts that share a third with it."""
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:40] + [str(rng.randrange(10**6)) for _ in range(80)])) for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("group", [6, jaccard.GROUP])
def test_near_copies_in_large_nodes(spark, monkeypatch, group):
    """Small limits: nodes are split by joins, a level at a time, and clusters have several blocks."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    rows = families(random.Random(5))
    assert result(spark, rows) == brute(rows)


def test_recall_of_large_nodes(monkeypatch):
    """Pairs at the threshold, in nodes that a shared passage makes far larger than brute force takes."""
    monkeypatch.setattr(jaccard, "PAIRS", 2000)
    rng = np.random.default_rng(3)
    passage, sets, pairs = rng.integers(0, 2**63, 300, dtype=np.uint64), [], 1000
    for _ in range(pairs):
        own = rng.integers(0, 2**63, 150, dtype=np.uint64)
        # 399 of 498 shingles in common, then 0.8 and a little more
        for _ in range(2):
            sets.append(np.unique(np.concatenate([passage, own[:100], rng.integers(0, 2**63, 49, dtype=np.uint64)])))
    roots, tokens = jaccard.signature(sets)
    met, steps = np.zeros(pairs, bool), []
    for r in range(jaccard.RUNS):
        for node in np.unique(roots[:, r]):
            at = np.flatnonzero(roots[:, r] == node)
            steps.append(len(at))
            label = np.full(len(sets), -1)
            label[at] = jaccard.linked(tokens[at], int(node))
            met |= (label[::2] >= 0) & (label[::2] == label[1::2])
    assert max(steps) > 500
    assert met.mean() >= 0.995


def test_runs_follow_the_target():
    assert jaccard.runs_for(0.9) < jaccard.runs_for(0.99) < jaccard.runs_for(0.9999)
    assert (1 - 0.8 * jaccard.survival(0.8)) ** jaccard.RUNS <= 1 - jaccard.RECALL


def test_edge_cases(spark):
    rows = [(3, ""), (2, None), (9, "a b"), (7, "a b"), (7, "a b"), (5, "x " * 3000), (6, " \n"), (1, "a"), (8, "y z " * 2000)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_null_id_and_one_of_each(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (4, "a b c", 2), (5, "q r s", 3), (5, "q r s", 3)], "doc_id long, text string, `__set` int").withColumn("a.b`c", F.lit(1))
    got = sorted(((r[0] is not None, r[0] or 0, r[1], r[2]) for r in jaccard.similar_documents(df).collect()))
    assert got == [(False, 0, None, 1), (True, 4, None, 1), (True, 5, 5, 1), (True, 5, 5, 1)]
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r[0] or 0, r[1]) for r in kept.collect()) == [(0, "a b c"), (5, "q r s")]
