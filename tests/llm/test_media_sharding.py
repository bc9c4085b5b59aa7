"""Media round trips, and the lookup table against its definition."""

from __future__ import annotations

import hashlib
import tarfile
import zlib
from collections import Counter

import pytest

from objgrove.llm import media, sharding
from objgrove.llm.common import new_folder, open_fs


def test_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "abc"), (4, "é" * 5000), (5, "abc"), (6, "z" * 192), (7, "z" * 193), (None, "abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r["doc_id"]: r for r in media.media(df).collect()}
    for doc, text in rows:
        raw = (text or "").encode()
        data = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        png = media.encode_png(data)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(png), hashlib.sha256(png).hexdigest(), media.feature(data))
        assert (r["width"], r["height"], r["bits"]) == (192, len(data) // 192, 8)
    assert media.media(df.limit(0)).collect() == []


def test_shards_are_tar_files_and_headers_suffice(spark):
    df = spark.createDataFrame([(i, f"text {i % 3} " * 50) for i in range(30)], "doc_id long, text string").coalesce(1)
    folder = new_folder(spark, "media-test")
    index = media.store(df, folder, shard_bytes=10_000)
    rows = index.collect()
    assert len({(r["shard"], r["offset"]) for r in rows}) == 3
    for r in rows:
        _, path = open_fs(r["shard"])
        with tarfile.open(path) as t:
            member = next(m for m in t.getmembers() if m.offset_data == r["offset"])
            assert member.size == r["length"] and r["digest"] in member.name
            assert hashlib.sha256(media.decode_png(t.extractfile(member).read())).hexdigest() == r["digest"]
    assert {tuple(r)[-3:] for r in media.with_metadata(index).collect()} == {(192, 2, 8)}
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(b"a" * 192)[:-20] + b"x" * 20)


def brute(shards, size):
    number = lambda name, salt: int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")
    orders = [[(number(s, "offset") + j * (number(s, "step") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    table, turn = {}, 0
    while len(table) < size:
        slot = next(x for x in orders[turn % len(shards)] if x not in table)
        table[slot] = turn % len(shards)
        turn += 1
    return [table[i] for i in range(size)]


def test_table_against_definition():
    for n, size in ((1, 2), (3, 7), (5, 101), (7, 251)):
        names = [f"s{i}" for i in range(n)]
        assert sharding.fill(names, size).tolist() == brute(names, size)
    full, less = sharding.fill(sharding.SHARDS), sharding.fill(sharding.SHARDS[:-1])
    count = Counter(full.tolist())
    assert max(count.values()) - min(count.values()) <= 1
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.05 * sharding.TABLE_SIZE
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_placement(spark):
    rows = [(None, "x"), (1, "x"), (1, "y"), (10**15, None)]
    df = spark.createDataFrame(rows, "doc_id long, shard string")
    out = sharding.place(df, "doc_id", to="owner")
    assert out.columns == ["doc_id", "shard", "owner"]
    owners = sharding.fill(sharding.SHARDS)
    for r in out.collect():
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert r["owner"] == sharding.SHARDS[owners[int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE]]
    assert sharding.place(df.limit(0), "doc_id").collect() == []


def test_placement_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mine", 2, "x", "y"), (1, "mine", 2, None, "y" * 100_000)], "doc_id long, __at_shard string, slot int, `a.b` string, row string")
    out = sharding.place(df, "doc_id")
    assert out.columns == [*df.columns, "shard"]
    assert sorted((tuple(r)[:-1] for r in out.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    again = sharding.place(out, "doc_id", ["one"])
    assert again.columns == out.columns and {r["shard"] for r in again.collect()} == {"one"}


def test_media_takes_metadata_from_headers(spark, monkeypatch):
    """Metadata columns come from the header-only reads: without these there are none."""
    df = spark.createDataFrame([(1, "abc", "x"), (2, "def", "y")], "doc_id long, text string, width string")
    assert [r["width"] for r in media.media(df).collect()] == [192, 192]
    monkeypatch.setattr(media, "with_metadata", lambda index: index)
    with pytest.raises(Exception, match="width"):
        media.media(df).collect()
