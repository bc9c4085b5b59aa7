"""Settings, instrumentation, SQL functions, routes, and the codecs' guards and growth."""

from __future__ import annotations

import os
import time
import zlib

import pytest
from pyspark.sql import functions as F

from objgrove import instrument, schema as S
from objgrove.functions.register import register
from objgrove.settings import Settings, settings
from objgrove.sources import packs, routes, wire


def test_settings():
    assert settings({}) == Settings()
    assert settings({"OBJGROVE_GC_ENABLED": "0", "OBJGROVE_GC_GRACE_SECONDS": "1.5", "OBJGROVE_PORT": "9"}) == Settings(port=9, gc_enabled=False, gc_grace_seconds=1.5)
    for key, value in (("GC_ENABLED", "yes"), ("PORT", "0"), ("GC_GRACE_SECONDS", "-1"), ("GC_INTERVAL_MS", "x")):
        with pytest.raises(ValueError, match=key):
            settings({f"OBJGROVE_{key}": value})


def test_instrumentation(spark):
    instrument.count("lost")
    done = []
    with pytest.raises(RuntimeError), instrument.request("GET", "/x", done):
        with instrument.phase("a"):
            instrument.record_query("q1", 2.0)
            with instrument.phase("b"):
                instrument.record_query("q2", 1.0)
            instrument.record_query("q3", 1.0)
        instrument.count("bytes", 3)
        instrument.count("bytes", 4)
        instrument.label("l")
        raise RuntimeError
    (r,) = done
    assert [q["phase"] for q in r.queries] == ["a", "b", "a"] and r.counters == {"bytes": 7} and r.label == "l" and r.phase_ms["a"] >= r.phase_ms["b"] > 0
    df, seen = instrument.observed(spark.range(10), "n", rows=F.count("*"))
    df.collect()
    assert seen.get == {"rows": 10}
    assert [instrument.nearest_rank([5, 1, 3], p) for p in (0, 50, 100)] == [1, 3, 5] and instrument.nearest_rank([], 50) is None


def test_sql_functions(spark):
    register(spark)
    blob, tree = b"x\n", b"100644 a b\0" + bytes(20) + "40000 é".encode() + b"\0" + b"\1" * 20
    pack = packs.write_pack([("blob", blob), ("tree", tree)])
    spark.createDataFrame([(bytearray(blob), bytearray(tree), bytearray(pack), bytearray(wire.line("hi") + wire.FLUSH + b"00"))], "blob binary, tree binary, pack binary, lines binary").createOrReplaceTempView("surface")
    assert spark.sql("SELECT git_oid('blob', blob), apply_delta(blob, X'02029002'), apply_delta(blob, X'0202B0') FROM surface").first() == (packs.object_id("blob", blob), bytearray(blob), None)
    assert [tuple(r) for r in spark.sql("SELECT e.* FROM surface, LATERAL tree_entries(tree) e").collect()] == [("100644", "a b", "00" * 20), ("40000", "é", "01" * 20)]
    assert [(r["ordinal"], r["type"], r["error"]) for r in spark.sql("SELECT p.* FROM surface, LATERAL read_pack(pack) p").collect()] == [(0, "blob", None), (1, "tree", None)]
    assert spark.sql("SELECT error FROM read_pack(X'00')").first()[0] == "bad-magic"
    assert [r["kind"] for r in spark.sql("SELECT p.* FROM surface, LATERAL pkt_lines(lines) p").collect()] == ["data", "flush", "rest"]


def test_truncated_deltas_are_format_errors():
    base = b"abcdefgh" * 10
    delta = bytes([80, 80, 0b10110000, 40, 0, 0b10010001, 40, 40])
    whole = bytes([80, 4, 0b10010000, 4])
    assert packs.apply_delta(base, whole) == base[:4]
    for n in range(len(delta)):
        with pytest.raises(S.FormatError):
            packs.apply_delta(base, delta[:n])


def test_one_bad_delta_does_not_fail_other_packs(spark):
    import hashlib
    import struct

    base = b"base" * 20
    bad = bytes([80, 80, 0b10010001, 4])
    entry = packs.write_header(S.BLOB, len(base)) + zlib.compress(base)
    delta = packs.write_header(S.OFS_DELTA, len(bad)) + packs.write_offset(len(entry)) + zlib.compress(bad)
    body = b"PACK" + struct.pack(">II", 2, 2) + entry + delta
    df = spark.createDataFrame([(1, bytearray(body + hashlib.sha1(body).digest())), (2, bytearray(packs.write_pack([("blob", base)])))], "repo_id long, pack binary")
    assert sorted((r["repo_id"], r["error"]) for r in packs.parsed(df).collect()) == [(1, "delta-target-size-mismatch"), (2, None)]


def test_reading_a_pack_grows_with_it_alone():
    def seconds(n):
        pack = packs.write_pack([("blob", os.urandom(300)) for _ in range(n)])
        return min(_timed(lambda: packs.read_pack(pack)) for _ in range(3))

    assert seconds(16_000) < 4 * seconds(8_000) + 0.2


def _timed(f):
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


class Fake:
    def fetch(self, repo, body):
        return b"fetched " + repo.encode() + wire.parse_request(body).command.encode()

    def push(self, repo, body, now):
        raise OSError("disk")


def test_routes():
    go = lambda *a, **k: routes.answer(Fake(), *a, **k)
    assert routes.target("/a/b/c/info/refs") == ("a/b/c", "info/refs") and routes.target("/info/refs") is None
    assert go("GET", "/health")[::2] == (200, b"ok")
    assert go("GET", "/r/info/refs", {"Git-Protocol": "x:version=2"}, {"service": "git-upload-pack"})[::2] == (200, wire.capability_advertisement())
    assert go("GET", "/r/info/refs", {}, {"service": "git-upload-pack"})[0] == 400
    assert go("GET", "/r/info/refs", {}, {"service": "x"})[0] == 403
    assert go("GET", "/r/other")[0] == go("POST", "/git-upload-pack")[0] == go("POST", "/r/info/refs")[0] == 404
    body = wire.line("command=fetch") + wire.FLUSH
    import gzip

    assert go("POST", "/a/b/git-upload-pack", {"Content-Encoding": "gzip"}, body=gzip.compress(body))[::2] == (200, b"fetched a/bfetch")
    assert go("POST", "/r/git-upload-pack", {"Content-Encoding": "br"}, body=body)[0] == 400
    assert go("POST", "/r/git-upload-pack", body=body[:-2])[0] == 400
    assert go("POST", "/r/git-receive-pack", now=F.lit(None))[::2] == (500, b"internal server error")
