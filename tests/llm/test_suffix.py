"""Long repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from objgrove.llm import suffix
from objgrove.llm.run_index import MATCH, RunIndex


def brute(rows):
    first, out = {}, []
    low = lambda d: -(2**63) if d is None else d
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - MATCH + 1):
            s = raw[i : i + MATCH]
            first[s] = min(first.get(s, low(doc)), low(doc))
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - MATCH + 1):
            if first[raw[i : i + MATCH]] < low(doc):
                gone[i : i + MATCH] = True
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_index_streams_windows():
    rng = random.Random(1)
    base = bytes(rng.choices(b"abcd \x00\xff", k=400))
    parts = [base[a : a + rng.randrange(MATCH, 120)] for a in (rng.randrange(280) for _ in range(60))] + [b"\x00" * 130, b"ab" * 60]
    values = np.array(rng.sample(range(1000), len(parts)))
    index = RunIndex(parts, values)
    assert index.runs < index.n
    queries = parts + [base, bytes(rng.choices(b"abcd", k=90)), base[:55] + b"?" + base[60:140], b"short"]
    want = []
    for q in queries:
        for i in range(len(q) - MATCH + 1):
            want.append(min((v for p, v in zip(parts, values, strict=True) if q[i : i + MATCH] in p), default=-1))
    assert index.smallest(queries, -1).tolist() == want


def test_memory_follows_runs():
    """A hundred near copies of a text take little more than the text, and the samples of the run ends are the answers."""
    rng = random.Random(5)
    base = bytes(rng.choices(b"abcdefgh ", k=3000))
    copies = [base[:at] + b"!" + base[at + 1 :] for at in rng.sample(range(3000), 100)]
    one, many = RunIndex([base], np.array([7])), RunIndex([base, *copies], np.arange(100, -1, -1))
    assert many.n > 100 * one.n and many.nbytes < 6 * one.nbytes
    assert many.smallest([base], -1).tolist() == [next(100 - i for i in range(100, -1, -1) if base[a : a + MATCH] in [base, *copies][i]) for a in range(3000 - MATCH + 1)]
    many.samples = many.samples + 1000
    assert min(many.smallest([base], -1)) >= 1000


def test_ties_and_segments_without_windows():
    assert RunIndex([b"short", b""], np.array([1, 2])).smallest([b"x" * 60], -1).tolist() == [-1] * 11
    index = RunIndex([b"x" * 60, b"x" * 50, b"y" + b"x" * 60], np.array([5, 5, 3]))
    assert index.smallest([b"x" * 51 + b"y", b"y" + b"x" * 49], -1).tolist() == [3, 3, -1, 3]


def test_documents_against_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted((tuple(r) for r in suffix.removals(d).collect()), key=str) == brute([tuple(r) for r in d.collect()])


def test_hot_passages_and_edges(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 3)
    monkeypatch.setattr(suffix, "UNIT_ROWS", 7)
    monkeypatch.setattr(suffix, "SEGMENT_BUCKET", 2000)
    monkeypatch.setattr(suffix, "HASH_BUCKET", 2000)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(2, 9)))
    line = " ".join(word() for _ in range(14))
    rows = []
    for i in range(60):
        t = " ".join(word() for _ in range(rng.randrange(1, 40)))
        if i % 2:
            t = t[: len(t) // 2] + line + t[len(t) // 2 :]
        rows.append((i, t))
    rows += [(70, rows[3][1]), (71, rows[3][1][5:80]), (3, rows[3][1]), (None, rows[9][1]), (80, None), (81, ""), (82, "x" * 500), (83, "x" * 49), (84, "x" * 70 + "y"), (85, "ab" * 200), (86, "ba" * 100)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in suffix.removals(df).collect()), key=str) == brute(rows)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.removals(empty).collect() == []
    text = "a passage that is longer than fifty bytes, so that it is found again"
    df = spark.createDataFrame([(1, text, "k", 9), (2, "é" + text + "é", "u", 7), (3, None, None, None)], "doc_id long, text string, __text string, n_chars long")
    out = suffix.deduplicated(df.withColumnsRenamed({"__text": "un.it"}))
    assert sorted(tuple(r) for r in out.collect()) == [(1, text, "k", 9), (2, "éé", "u", 2), (3, None, None, None)]


def test_units_are_bounded_in_bytes(spark, monkeypatch):
    """A file's row groups are units of their own."""
    monkeypatch.setattr(suffix, "UNIT_BYTES", 20_000)
    rng = random.Random(4)
    lines = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)) for _ in range(60)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(1, 8)))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    corpus = suffix.Corpus.store(df.selectExpr("doc_id AS __id", "text AS __text"))
    units = [u for b in corpus.files(spark).toArrow().to_batches() for u in corpus.units([b])]
    assert len(corpus.paths) == 1 and len(units) > 2
    assert sorted((tuple(r) for r in suffix.removals(df).collect()), key=str) == brute(rows)


def test_units_are_bounded_in_text(spark, monkeypatch):
    """Copies that are next to nothing when stored are units by their text, and every job cuts them alike."""
    monkeypatch.setattr(suffix, "UNIT_BYTES", 20_000)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh ", k=3000)) for _ in range(2)] + ["", "é" * 15_000]
    rows = [(i, texts[3 if i == 150 else 2 if i % 50 == 7 else i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    corpus = suffix.Corpus.store(df.selectExpr("doc_id AS __id", "text AS __text"))
    files = corpus.files(spark).toArrow().to_batches()
    assert len(corpus.paths) == 1 and len([u for b in files for u in corpus.units([b])]) >= 45
    units = [(u, list(suffix.documents(r))) for b in files for u, r in corpus.units([b])]
    assert len({u for u, _ in units}) == len(units) and [d for _, own in units for d, _ in own] == list(range(300))
    sizes = [[len(raw) for _, raw in own if raw] for _, own in units]
    assert all(sum(s) <= 20_000 or s == [30_000] for s in sizes)
    again = [(u, [d for x in r for d in x.column("__id").to_pylist()]) for b in files for u, r in corpus.units([b], ("__text", "__id"))]
    assert again == [(u, [d for d, _ in own]) for u, own in units]
    assert sorted((tuple(r) for r in suffix.removals(df).collect()), key=str) == brute(rows)
