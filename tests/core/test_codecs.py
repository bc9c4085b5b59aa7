"""Packs, packets and object parsing, against hand vectors and the git binary."""

from __future__ import annotations

import gzip
import hashlib
import random
import shutil
import struct
import subprocess
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from objgrove import schema as S
from objgrove.functions import objects as O
from objgrove.schema import FormatError, ProtocolError
from objgrove.sources import packs, wire

git = pytest.mark.skipif(not shutil.which("git"), reason="no git")
EMPTY_BLOB, EMPTY_TREE = "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def size(n):
    out = []
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(0, 2**40), st.integers(1, 2**50))
def test_varints(code, n, back):
    assert packs.read_header(packs.write_header(code, n), 0)[:2] == (code, n)
    data = packs.write_offset(back)
    assert packs.read_offset(data, 0) == (back, len(data))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.lists(st.one_of(st.binary(min_size=1, max_size=127), st.tuples(st.integers(0, 399), st.integers(1, 400))), max_size=8))
def test_deltas(base, steps):
    body, want = b"", b""
    for x in steps:
        if isinstance(x, bytes):
            body, want = body + bytes([len(x)]) + x, want + x
        elif x[0] + x[1] <= len(base):
            body, want = body + bytes([0x80 | 0b110011]) + struct.pack("<H", x[0]) + struct.pack("<H", x[1]), want + base[x[0] : sum(x)]
    delta = size(len(base)) + size(len(want)) + body
    assert packs.apply_delta(base, delta) == want
    for bad, code in ((size(len(base) + 1) + delta[len(size(len(base))) :], "delta-base-size-mismatch"), (delta + b"\0", "delta-reserved-opcode"), (size(len(base)) + size(len(want) + 1) + body, "delta-target-size-mismatch")):
        with pytest.raises(FormatError) as e:
            packs.apply_delta(base, bad)
        assert e.value.code == code


def test_copy_of_size_zero_is_64_kib():
    base = bytes(range(256)) * 300
    assert packs.apply_delta(base, size(len(base)) + size(0x10000) + b"\x80") == base[:0x10000]


def raw(entries, version=2, count=None):
    data = b"PACK" + struct.pack(">II", version, len(entries) if count is None else count) + b"".join(entries)
    return data + hashlib.sha1(data).digest()


def entry(code, data, base=b"", n=None):
    return packs.write_header(code, len(data) if n is None else n) + base + zlib.compress(data)


def test_pack_round_trip_and_delta_chains():
    objects = [("blob", b""), ("blob", b"x" * 1000), ("tree", b""), ("commit", b"tree " + EMPTY_TREE.encode() + b"\n\nm")]
    assert packs.read_pack(packs.write_pack(objects)) == objects
    a, b, c = b"hello world", b"hello there", b"hello there!"
    d1 = size(len(a)) + size(len(b)) + b"\x90\x06" + b"\x05there"
    d2 = size(len(b)) + size(len(c)) + b"\x90\x0b" + b"\x01!"
    e1 = entry(S.BLOB, a)
    by_offset = raw([e1, entry(S.OFS_DELTA, d1, packs.write_offset(len(e1)))])
    assert packs.read_pack(by_offset) == [("blob", a), ("blob", b)]
    oid = lambda x: bytes.fromhex(packs.object_id("blob", x))
    # a delta on a delta that comes later, by id
    assert packs.read_pack(raw([entry(S.REF_DELTA, d2, oid(b)), entry(S.REF_DELTA, d1, oid(a)), e1])) == [("blob", c), ("blob", b), ("blob", a)]
    thin = raw([entry(S.REF_DELTA, d2, oid(b)), entry(S.REF_DELTA, d1, oid(a))])
    assert packs.read_pack(thin, {oid(a).hex(): ("blob", a)}.get) == [("blob", c), ("blob", b)]
    assert packs.external_bases(thin) == sorted([oid(a).hex(), oid(b).hex()])


def test_malformed_packs():
    good = packs.write_pack([("blob", b"abc")])
    e = entry(S.BLOB, b"abc")
    cases = {
        "bad-magic": b"KCAP" + good[4:], "unsupported-version": raw([e], 3), "trailer-mismatch": good[:-1] + bytes([good[-1] ^ 1]), "unknown-object-type": raw([entry(5, b"abc")]), "size-mismatch": raw([entry(S.BLOB, b"abc", n=4)]),
        "trailing-bytes": raw([e, b"xx"], count=1), "unresolved-base": raw([entry(S.REF_DELTA, b"\0\0", b"\1" * 20)]), "inflate-failed": raw([packs.write_header(S.BLOB, 3) + b"\0\0\0"]),
    }
    for code, data in cases.items():
        with pytest.raises(FormatError) as x:
            packs.read_pack(data)
        assert x.value.code == code


@git
def test_git_reads_our_packs_and_we_read_its(tmp_path):
    run = lambda *a, data=None: subprocess.run(["git", "-C", str(tmp_path), *a], input=data, capture_output=True, check=True).stdout
    run("init", "-q")
    rng = random.Random(8)
    for i in range(6):
        lines = [f"line {j} {rng.random() if j % 17 == i else ''}\n" for j in range(400)]
        (tmp_path / "dir").mkdir(exist_ok=True)
        (tmp_path / "dir" / "file.txt").write_text("".join(lines))
        (tmp_path / f"f {i}.bin").write_bytes(bytes(rng.randrange(256) for _ in range(300)))
        run("add", ".")
        run("-c", "user.name=n", "-c", "user.email=e@example.org", "commit", "-qm", f"commit {i}")
    run("-c", "user.name=n", "-c", "user.email=e@example.org", "tag", "-a", "v1", "-m", "t")
    oids = sorted({x.split()[0].decode() for x in run("rev-list", "--objects", "--all").splitlines()})
    pack = run("pack-objects", "--stdout", "--delta-base-offset", data="\n".join(oids).encode())
    objects = packs.read_pack(pack)
    assert sorted(packs.object_id(*o) for o in objects) == oids
    for kind, content in objects:
        assert run("hash-object", "-t", kind, "--stdin", data=content).strip().decode() == packs.object_id(kind, content)
    other = tmp_path / "other"
    subprocess.run(["git", "init", "-q", str(other)], check=True)
    subprocess.run(["git", "-C", str(other), "index-pack", "--stdin"], input=packs.write_pack(objects), check=True, capture_output=True)
    assert subprocess.run(["git", "-C", str(other), "cat-file", "-t", oids[0]], capture_output=True, check=True).stdout


def test_packet_lines():
    assert wire.line("hi\n") == b"0007hi\n" and wire.decode(b"0007hi\n00000001") == ([("data", b"hi\n"), ("flush", b""), ("delim", b"")], b"")
    assert wire.decode(b"0007hi\n0008a") == ([("data", b"hi\n")], b"0008a")
    assert wire.decode(b"0000PACK", stop_at_flush=True) == ([("flush", b"")], b"PACK")
    for bad in (b"zzzz", b"0003", b"fff1" + b"x" * 70_000, b"+00a"):
        with pytest.raises(ProtocolError):
            wire.decode(bad)
    with pytest.raises(ProtocolError):
        wire.line(b"x" * (wire.WRITE_MAX + 1))
    data = bytes(70_000)
    packets, rest = wire.decode(wire.side_band(1, data))
    assert not rest and [len(p) for _, p in packets] == [65_515, 4487] and b"".join(p[1:] for _, p in packets) == data


def test_requests_and_responses():
    body = wire.line("command=fetch\n") + wire.line("object-format=sha1") + wire.DELIM + wire.line(f"want {'a' * 40}\n") + wire.line(f"have {'b' * 40}") + wire.line("filter blob:none") + wire.line("done") + wire.line("thin-pack") + wire.FLUSH
    r = wire.parse_request(body)
    f = wire.parse_fetch(r.arguments)
    assert (r.command, f.wants, f.haves, f.done, f.omit_blobs, f.include_tag) == ("fetch", ["a" * 40], ["b" * 40], True, True, False)
    assert not wire.parse_fetch(["filter tree:0"]).omit_blobs
    for bad in (["want xyz"], ["deepen 1"], ["shallow " + "a" * 40]):
        with pytest.raises(ProtocolError):
            wire.parse_fetch(bad)
    for bad in (b"0000", wire.line("command=fetch") + wire.line("object-format=sha256") + wire.FLUSH):
        with pytest.raises(ProtocolError):
            wire.parse_request(bad)
    got = wire.parse_receive(wire.line(f"{S.ZERO} {'c' * 40} refs/heads/x\0 atomic report-status") + wire.FLUSH + b"PACKrest")
    assert got == wire.Receive([(S.ZERO, "c" * 40, "refs/heads/x")], ["atomic", "report-status"], b"PACKrest")
    assert wire.report("ok", [("refs/heads/x", True, None), ("r", False, None)]) == b"000eunpack ok\n0014ok refs/heads/x\n0010ng r failed\n0000"
    assert wire.acknowledgments([], False) == b"0014acknowledgments\n0008NAK\n0000"
    assert wire.acknowledgments(["d" * 40], True).endswith(b"0031ACK " + b"d" * 40 + b"\n000aready\n0001")
    assert wire.ref_line("HEAD", None, "refs/heads/main") == b"002eunborn HEAD symref-target:refs/heads/main\n"
    assert wire.receive_advertisement([]).startswith(b"00") and b"capabilities^{}\0report-status" in wire.receive_advertisement([])
    assert wire.capability_advertisement().startswith(b"000eversion 2\n") and wire.error("x") == b"000aERR x\n"
    assert wire.request_body(gzip.compress(b"q"), "gzip") == b"q" == wire.request_body(b"q", None)
    for data, encoding in ((b"q", "br"), (b"q", "gzip")):
        with pytest.raises(ProtocolError):
            wire.request_body(data, encoding)


def tree(*entries):
    return bytearray(b"".join(m + b" " + n + b"\0" + bytes.fromhex(o) for m, n, o in entries))


def test_object_expressions(spark):
    a, b = "1" * 40, "2" * 40
    sub = tree((b"100644", b"bad\xff name.txt", a), (b"40000", b"dir", b), (b"160000", b"mod", a), (b"120000", b"link", b))
    rows = [
        (S.BLOB, bytearray()), (S.TREE, bytearray()), (S.TREE, sub), (S.TREE, sub[:-1]), (S.COMMIT, bytearray(f"tree {a}\nparent {b}\nparent {a}\nauthor x\n\nparent {'9' * 40}\n".encode())),
        (S.COMMIT, bytearray(b"author x\n\ntree y")), (S.COMMIT, bytearray(f"tree {a}\ntree {b}\n\n".encode())), (S.COMMIT, bytearray(b"tree xyz\n\n")), (S.TAG, bytearray(f"object {a}\ntype commit\n\n".encode())),
        (S.TAG, bytearray(b"type commit\n\n")), (S.TAG, bytearray(f"object {a}\nobject {b}\n\n".encode())),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, type short, content binary")
    got = df.select("i", O.validation_code("type", "content").alias("code"), O.object_id(O.type_name("type"), "content").alias("oid"), O.commit_parents("content").alias("parents"), O.tree_entries("content").alias("e")).orderBy("i").collect()
    assert [r["code"] for r in got] == [None, None, None, "malformed-tree", None, "missing-tree-header", "multiple-tree-headers", "malformed-oid", None, "missing-tag-object", "multiple-tag-objects"]
    assert got[0]["oid"] == EMPTY_BLOB and got[1]["oid"] == EMPTY_TREE
    assert all(r["oid"] == packs.object_id(S.TYPE_NAMES[t], bytes(c)) for r, (t, c) in zip(got, rows, strict=True))
    assert got[4]["parents"] == [b, a]
    assert [tuple(x) for x in got[2]["e"]] == [("100644", "bad� name.txt", a), ("40000", "dir", b), ("160000", "mod", a), ("120000", "link", b)]
    objects = df.withColumn("oid", F.lpad("i", 40, "0")).withColumn("repo_id", F.lit(7)).where("i in (2, 4, 8)")
    assert sorted((r["parent"][-1], r["child"][0], r["kind"]) for r in O.edges(objects).collect()) == [("2", "2", 3), ("4", "1", 1), ("4", "2", 2), ("8", "1", 5)]
    assert sorted(r["oid"][0] for r in O.tree_blobs(objects).collect()) == ["1", "2"]
    with pytest.raises(Exception, match="missing-tree-header"):
        O.checked(df.where("i = 5")).collect()


def test_packs_as_tables(spark):
    objects = [("blob", b"one"), ("tree", b""), ("blob", b"two" * 100)]
    bad = packs.write_pack(objects)[:-1] + b"?"
    df = spark.createDataFrame([(1, bytearray(packs.write_pack(objects))), (2, bytearray(bad))], "repo_id long, pack binary")
    rows = packs.parsed(df).orderBy("repo_id", "ordinal").collect()
    assert [(r["repo_id"], r["ordinal"], r["error"]) for r in rows] == [(1, 0, None), (1, 1, None), (1, 2, None), (2, 0, "trailer-mismatch")]
    assert [bytes(r["content"]) for r in rows[:3]] == [c for _, c in objects]
    back = packs.packed(packs.parsed(df.where("repo_id = 1"))).collect()
    assert sorted(packs.read_pack(bytes(back[0]["pack"]))) == sorted(objects)
    lines = spark.createDataFrame([(bytearray(70_000),), (bytearray(),)], "d binary").select(wire.line_column(F.lit(bytearray(b"hi"))).alias("l"), wire.band_column(F.col("d"), 1).alias("b")).collect()
    assert bytes(lines[0]["l"]) == b"0006hi" and sorted(bytes(r["b"]) for r in lines) == [b"", wire.side_band(1, bytes(70_000))]
    p = spark.createDataFrame([(bytearray(b"0006hi0000000"),), (bytearray(b"zzzz"),)], "d binary").select(wire.packets_column(F.col("d")).alias("p")).collect()
    assert [x["kind"] for x in p[0]["p"]["packets"]] == ["data", "flush"] and bytes(p[0]["p"]["rest"]) == b"000" and p[1]["p"]["error"]
    assert spark.range(1).select(O.repo_path(F.lit("/a/b.git/info/refs")), O.repo_path(F.lit("/x/y"))).first() == ("a/b.git", "")


def test_a_repository_in_several_packs(spark):
    rng = random.Random(3)
    rows = [(repo, S.BLOB, bytearray(rng.randbytes(n))) for repo in (1, 2) for n in [1000] * 40 + [9000, 0]]
    df = spark.createDataFrame(rows, "repo_id long, type short, content binary").withColumn("oid", O.object_id(O.type_name("type"), "content"))
    made = packs.packed_in_parts(df, 5000).collect()
    assert len(made) >= 16 and all(len(r["pack"]) < 5100 or len(packs.read_pack(bytes(r["pack"]))) == 1 for r in made)
    back = [(r["repo_id"], S.BLOB, c) for r in made for _, c in packs.read_pack(bytes(r["pack"]))]
    assert sorted(back) == sorted((repo, code, bytes(c)) for repo, code, c in rows)


def test_round_trip_has_blobs(spark, sf, monkeypatch):
    from objgrove.plans import catalog, corpus

    read, back = packs.parsed, []
    monkeypatch.setattr(packs, "parsed", lambda *a: back.append(read(*a)) or back[0])
    rows = catalog.pack_round_trip(spark, sf).collect()
    ids = lambda df: sorted(tuple(r) for r in df.select("repo_id", "type", "oid", "content").collect())
    assert ids(back[0]) == ids(corpus.objects(spark, sf)) and back[0].where(f"type = {S.BLOB}").count()
    assert {r["type"] for r in rows} == {"commit", "tree", "tag"}


def test_packs_and_parsed_batches_are_bounded_by_contents(spark):
    """Contents that deflate to little close a pack too, and a pack's objects leave in small batches, however many packs come at once."""
    import pyarrow as pa

    zeros = [("blob", b"%d" % i + bytes(1 << 20)) for i in range(24)]
    one = packs.write_pack(zeros)
    came = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([one, b"PACK"], pa.binary()), pa.nulls(2)], ["repo_id", "pack", "bases"])
    out = list(packs._read(iter([came])))
    assert max(b.nbytes for b in out) < 5 << 20
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["repo_id"], r["ordinal"], r["content"]) for r in rows[:-1]] == [(1, i, c) for i, (_, c) in enumerate(zeros)] and rows[-1]["error"] == "bad-magic"
    o = spark.createDataFrame([(1, packs.object_id(k, c), 3, bytearray(c)) for k, c in zeros], "repo_id long, oid string, type short, content binary")
    made = packs.packed_in_parts(o.coalesce(1), 1 << 20).collect()
    assert max(sum(len(c) for _, c in packs.read_pack(bytes(r["pack"]))) for r in made) <= packs.INFLATED << 20
    assert sorted(c for r in made for _, c in packs.read_pack(bytes(r["pack"]))) == sorted(c for _, c in zeros)
