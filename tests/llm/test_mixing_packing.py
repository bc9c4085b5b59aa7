"""The mix against sorting, packing against an exact round trip."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from objgrove.llm import mixing, packing


def sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken, copies FROM ({mixing.SQL})").fetchall(), key=str)


def test_mix_against_sorting(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "b", "b", "b", "b", "ü", "", None]), rng.choice(["", None, "x " * rng.randrange(400), "y\tz\n" * 30])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumnsRenamed({})
    got = sorted((tuple(r) for r in mixing.mix(df).collect()), key=str)
    assert got == sql(rows)
    by = defaultdict(list)
    for (doc, size, total, target, taken, copies), (_, source, _) in zip(sorted(got, key=lambda r: r[0]), sorted(rows, key=lambda r: r[0]), strict=True):
        assert taken == size * copies and copies <= 3
        by[source].append((target, taken, total))
    for x in by.values():
        assert abs(sum(t for _, t, _ in x) - x[0][0]) <= max(30, 0.03 * x[0][0])
    assert abs(sum(x[0][0] for x in by.values()) - sum(x[0][2] for x in by.values())) < 1e-3


def test_mixed_documents_and_edges(spark):
    rows = [(1, "a", "x y", "own"), (2, "a", "z", None), (None, None, "q r s t", "k"), (4, "b", None, "m")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    want = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert sum(want.values()) == out.count()
    empty = spark.createDataFrame([], df.schema)
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == []


def check_pieces(pieces, texts, capacity=packing.CAPACITY):
    encode = packing.tokenizer()
    ids = {d: np.array([*encode(t or ""), 0], "<u4") for d, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
        by_seq[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        at = 0
        for start, length, crc, total in sorted(parts):
            assert start == at and total == len(ids[d]) and crc == zlib.crc32(ids[d][start : start + length].tobytes())
            at += length
        assert at == len(ids[d])
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and len(parts) <= packing.MAX_SEGMENTS
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(map(len, ids.values()))


def test_documents_round_trip(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(3)
    padding, total = check_pieces(packing.pack_documents(d).collect(), {r[0]: r[1] for r in d.collect()})
    assert padding <= 0.001 * total


def test_edge_texts(spark):
    rows = [(1, None), (2, ""), (3, "a<|endoftext|>b"), (4, "é𝄞 " * 4000), (5, " "), (6, "x")] + [(100 + i, "y") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_pieces(packing.pack_documents(df).collect(), dict(rows))
    assert packing.pack_documents(df.limit(0)).collect() == []
    from tokenizers import Tokenizer
    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.tokenizer()
    for text in [t for _, t in rows if t] + ["  a  b\n\n c\t", "it's 12 o'clock!", "ÀÉ ñandú\r\n"]:
        assert encode(text) == slow.encode(text, add_special_tokens=False).ids


def test_limits_hold_together():
    rng = random.Random(7)
    packer = packing.Packer((100, 4, 30), cut=False, waiting=32)
    items = [(i, rng.randrange(1, 100)) for i in range(400)]
    items = [(i, n, rng.randrange(0, min(n, 30) + 1)) for i, n in items]
    bins = [b for i, n, loss in items for b in packer.place((i, loss), n, loss)] + list(packer.finish())
    assert sorted(x[0][0] for b in bins for x in b) == list(range(400))
    for b in bins:
        assert sum(x[2] for x in b) <= 100 and len(b) <= 4 and sum(x[0][1] for x in b) <= 30
    assert len(bins) < 1.35 * max(sum(n for _, n, _ in items) / 100, sum(x for _, _, x in items) / 30, 100)
    with pytest.raises(ValueError):
        list(packer.place("x", 101, 0))


def test_conversations(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    long = spark.createDataFrame([(-7, 1, "assistant", "word " * 3000), (-7, 2, "user", "word " * 3000)], "conv_id long, turn int, role string, text string")
    c = c.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text").unionByName(long)
    rows = packing.pack_conversations(c).collect()
    assert {r["conv_id"] for r in rows} == {r[0] for r in c.select("conv_id").distinct().collect()}
    by, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
        parts[r["conv_id"]].append(r)
    assert all(sum(r["tokens"] for r in x) <= 1024 and sum(r["loss_tokens"] for r in x) <= 512 and len(x) <= 16 for x in by.values())
    for x in by.values():
        at = 0
        for r in sorted(x, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["tokens"]
    assert all(sorted(r["part"] for r in x) == list(range(len(x))) for x in parts.values())
    encode = packing.tokenizer()
    turns = [len(encode("word " * 3000)) + 1] * 2
    assert (sum(r["tokens"] for r in parts[-7]), sum(r["loss_tokens"] for r in parts[-7])) == (sum(turns), turns[0])


def test_short_documents_leave_little_padding(spark):
    rows = [(i, "a b c") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    padding, total = check_pieces(packing.pack_documents(df).collect(), dict(rows))
    assert padding <= 0.01 * total


def test_ids_of_all_documents(spark):
    """Both libraries' ids of every text of a whole table."""
    from tokenizers import Tokenizer
    import public_tokenizers

    slow, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.tokenizer()
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").distinct().collect()]
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        assert [encode(t) for t in part] == [e.ids for e in slow.encode_batch(part, add_special_tokens=False)]
