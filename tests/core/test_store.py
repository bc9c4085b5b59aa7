"""The store end to end, against the git binary."""

from __future__ import annotations

import datetime as dt
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from objgrove import schema as S
from objgrove.operators.store import Conflict, Store
from objgrove.sources import packs, wire

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="no git")
T0 = dt.datetime(2024, 1, 1)


class Git:
    def __init__(self, path):
        self.path = str(path)
        subprocess.run(["git", "init", "-q", "-b", "main", self.path], check=True)

    def __call__(self, *args, data=None):
        env = {"GIT_AUTHOR_NAME": "n", "GIT_AUTHOR_EMAIL": "e@example.org", "GIT_COMMITTER_NAME": "n", "GIT_COMMITTER_EMAIL": "e@example.org", "GIT_AUTHOR_DATE": "1700000000 +0000", "GIT_COMMITTER_DATE": "1700000000 +0000", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": self.path}
        return subprocess.run(["git", "-C", self.path, *args], input=data, capture_output=True, check=True, env=env).stdout

    def pack(self, new, *have):
        if new == "--all":
            return self("pack-objects", "--revs", "--all", "--stdout", data=b"")
        return self("pack-objects", "--revs", "--stdout", "--thin", data="\n".join([new, *[f"^{h}" for h in have]]).encode() + b"\n")

    def tree(self, rev):
        out = self("ls-tree", "-r", "-z", "--full-tree", rev).split(b"\0")
        return sorted((p.decode("utf-8", "replace"), m.split()[0].decode(), m.split()[2].decode()) for m, _, p in (x.partition(b"\t") for x in out if x))


def request(commands, pack=b"", caps="report-status"):
    lines = [wire.line(f"{old} {new} {ref}" + (f"\0 {caps}" if i == 0 else "")) for i, (old, new, ref) in enumerate(commands)]
    return b"".join(lines) + wire.FLUSH + pack


def fetch(wants, haves=(), done=True, extra=()):
    args = [*[f"want {w}" for w in wants], *[f"have {h}" for h in haves], *extra, *(["done"] if done else [])]
    return wire.line("command=fetch") + wire.DELIM + b"".join(map(wire.line, args)) + wire.FLUSH


def received(response):
    packets, _ = wire.decode(response)
    at = packets.index(("data", b"packfile\n"))
    return {packs.object_id(*o) for o in packs.read_pack(b"".join(p[1:] for k, p in packets[at + 1 :] if k == "data"))}


def test_push_read_fetch_collect(spark, tmp_path):
    git, store = Git(tmp_path / "git"), Store(spark, f"file://{tmp_path}/store")
    base = tmp_path / "git"
    (base / "a").mkdir()
    (base / "a" / "x.txt").write_text("one\n" * 300)
    (base / "b c.txt").write_text("two\n")
    git("add", ".")
    git("commit", "-qm", "c1")
    git("tag", "-a", "v1", "-m", "t")
    c1, v1 = git("rev-parse", "HEAD").decode().strip(), git("rev-parse", "v1").decode().strip()
    at = lambda n: F.lit(T0 + dt.timedelta(seconds=n))
    report = store.push("r", request([(S.ZERO, c1, "refs/heads/main"), (S.ZERO, v1, "refs/tags/v1")], git.pack("--all")), at(0))
    assert report == wire.report("ok", [("refs/heads/main", True, None), ("refs/tags/v1", True, None)])
    rows = lambda: store.read()["repo_file"].collect()
    assert sorted((r["path"], r["mode"], r["blob_oid"]) for r in rows()) == git.tree("HEAD")
    refs = {r["name"]: (r["oid"], r["peeled_oid"], r["symref_target"]) for r in store.read()["git_ref"].collect()}
    assert refs == {"refs/heads/main": (c1, None, None), "refs/tags/v1": (v1, c1, None), "HEAD": (None, None, "refs/heads/main")}
    listing = store.fetch("r", wire.line("command=ls-refs") + wire.DELIM + wire.line("symrefs") + wire.line("peel") + wire.line("ref-prefix refs/tags/") + wire.line("ref-prefix HEAD") + wire.FLUSH)
    assert listing == wire.ref_line("HEAD", c1, "refs/heads/main") + wire.ref_line("refs/tags/v1", v1, None, c1) + wire.FLUSH
    every = lambda *x: set(y.split()[0] for y in git("rev-list", "--objects", *x).decode().splitlines())
    assert received(store.fetch("r", fetch([c1], extra=["include-tag"]))) == every("--all")
    assert store.get("r", c1)[0] == "commit" and store.get("r", "0" * 40) is None
    store.register_views()
    assert spark.sql("SELECT f.path FROM repo_file f JOIN repos r ON r.id = f.repo_id JOIN git_object o ON o.repo_id = f.repo_id AND o.oid = f.blob_oid WHERE r.name = 'r' AND f.path LIKE 'a/%'").count() == 1

    (base / "a" / "x.txt").write_text("one\n" * 299 + "three\n")
    git("commit", "-qam", "c2")
    c2 = git("rev-parse", "HEAD").decode().strip()
    thin = git.pack(c2, c1)
    stale = store.push("r", request([(c2, c2, "refs/heads/main")], thin), at(5))
    assert stale == wire.report("ok", [("refs/heads/main", False, "stale ref (compare-and-swap failed)")])
    assert store.push("r", request([(c1, c2, "refs/heads/main")], thin), at(10)) == wire.report("ok", [("refs/heads/main", True, None)])
    assert sorted((r["path"], r["mode"], r["blob_oid"]) for r in rows()) == git.tree("HEAD")
    assert received(store.fetch("r", fetch([c2], [c1]))) == every(c2, f"^{c1}")
    assert store.fetch("r", fetch([c2], [c1], done=False)).startswith(wire.line("acknowledgments\n") + wire.line(f"ACK {c1}\n") + wire.line("ready\n"))
    assert store.fetch("r", fetch([c2], done=False)) == wire.acknowledgments([], False)
    assert b"not our ref " + b"9" * 40 in store.fetch("r", fetch(["9" * 40]))
    blobless = received(store.fetch("r", fetch([c2], extra=["filter blob:none"])))
    assert blobless == {o for o in every(c2) if git("cat-file", "-t", o).strip() != b"blob"}
    missing = store.push("r", request([(S.ZERO, "8" * 40, "refs/heads/y")]), at(11))
    assert missing == wire.report("ok", [("refs/heads/y", False, "missing necessary objects")])
    assert store.push("r", request([(S.ZERO, c1, "refs/heads/z")], b"PACKjunk" + bytes(40)), at(12)).startswith(wire.line("unpack unsupported-version\n")[:10])

    # a forced update and a deleted tag leave orphans, which go once they are older than the window
    git("checkout", "-q", "--orphan", "other")
    git("commit", "-qm", "c3")
    c3 = git("rev-parse", "HEAD").decode().strip()
    store.push("r", request([(c2, c3, "refs/heads/main"), (v1, S.ZERO, "refs/tags/v1")], git.pack(c3)), at(20))
    assert [(r["repo"], r["deleted_objects"]) for r in store.gc(at(30), 10_000).collect()] == [("r", 0)]
    assert store.gc(at(31), 0).count() == 0
    store.push("r", request([(S.ZERO, c3, "refs/heads/w")]), at(40))
    store.gc(at(50), 15)
    assert {r["oid"] for r in store.read()["git_object"].collect()} == every(c3)
    version = store.version()
    assert store.compact() == version + 1 and store.read()["git_object"].count() == len(every(c3))
    with pytest.raises(Conflict):
        store.commit(version, {})


def test_views_of_old_versions_and_tenants(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    a, b = store.ensure_repo("a"), store.ensure_repo("b")
    assert store.ensure_repo("a") == a != b and store.repo_id("zz") is None
    rows = spark.createDataFrame([(a, S.BLOB, bytearray(b"x")), (a, S.BLOB, bytearray(b"x")), (b, S.BLOB, bytearray(b"y"))], "repo_id long, type int, content binary")
    before = store.version()
    assert store.put(rows, F.lit(T0)).count() == 2
    store.put(rows, F.lit(T0 + dt.timedelta(days=1)))
    assert {r["created_at"] for r in store.read()["git_object"].collect()} == {T0}
    assert store.read(before)["git_object"].count() == 0 and store.get("b", packs.object_id("blob", b"x")) is None


def test_a_push_writes_and_reads_its_own_part(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    a, b = store.ensure_repo("a"), store.ensure_repo("b")
    assert len(store.parts_of([a, b])) == 2
    row = lambda repo, data: spark.createDataFrame([(repo, S.BLOB, bytearray(data))], "repo_id long, type int, content binary")
    store.put(row(a, b"x"), F.lit(T0))
    store.put(row(b, b"y"), F.lit(T0))
    before = store._manifest(store.version())["git_object"]
    store.put(row(b, b"z" * 1000), F.lit(T0))
    after = store._manifest(store.version())["git_object"]
    new = [p for p in after if p not in before]
    assert before == [p for p in after if p in before] and {int(p.rsplit("=")[1]) for p in new} == store.parts_of([b])
    assert sum(spark.read.parquet(f"{store.root}/{p}").count() for p in new) == 1
    scanned = store.of(b)["git_object"].inputFiles()
    assert scanned and not any(f"part={p}/" in f for f in scanned for p in store.parts_of([a]))
    assert store.of(b)["git_object"].count() == 2 and store.get("a", packs.object_id("blob", b"x")) == ("blob", b"x")
    store.compact()
    assert len(store._manifest(store.version())["git_object"]) == 2 and store.read()["git_object"].count() == 3
    assert store.expire(keep=1, min_age_seconds=0) > 0 and store.versions() == [store.version()]
    assert store.read()["git_object"].count() == 3 and not list(tmp_path.glob("s/.aside*"))


def test_manifests_appear_whole_and_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store._publish(1, '{"schema": 2, "tables": {}}')
    with pytest.raises(Conflict):
        store._publish(1, "{}")
    store._fs.create(store._path(f"{store.root}/.one"), False).close()
    store._rename(f"{store.root}/.one", f"{store.root}/two")
    store._fs.create(store._path(f"{store.root}/.one"), False).close()
    with pytest.raises(Exception, match="FileAlreadyExists"):
        store._rename(f"{store.root}/.one", f"{store.root}/two")
    assert S.migrated({"repos": "data/x/repos"}) == {"schema": 2, "tables": {"repos": ["data/x/repos"]}}
    with pytest.raises(ValueError):
        S.migrated({"schema": 99, "tables": {}})


def test_one_bad_repository_does_not_stop_a_pass(spark, tmp_path, monkeypatch):
    from objgrove.operators import collect

    store, failed = Store(spark, f"file://{tmp_path}/s"), []
    ids = [store.ensure_repo(n) for n in ("a", "bad", "c")]
    store.put(spark.createDataFrame([(i, S.BLOB, bytearray(b"x%d" % i)) for i in ids], "repo_id long, type int, content binary"), F.lit(T0))
    drain = collect.drain

    def poisoned(*args, only, **kw):
        if ids[1] in [r[0] for r in only.collect()]:
            raise RuntimeError("poison")
        return drain(*args, only=only, **kw)

    monkeypatch.setattr(collect, "drain", poisoned)
    later = F.lit(T0 + dt.timedelta(days=1))
    got = store.gc(later, 0, on_error=lambda repo, e: failed.append((repo, str(e))))
    assert sorted((r["repo"], r["deleted_objects"]) for r in got.collect()) == [("a", 1), ("c", 1)] and failed == [(ids[1], "poison")]
    monkeypatch.setattr(collect, "drain", drain)
    assert [(r["repo"], r["deleted_objects"]) for r in store.gc(later, 0, maintain=True).collect()] == [("bad", 1)]
    dead = spark.createDataFrame([(1, f"{i:02d}") for i in range(5)] + [(2, "x")], "repo_id long, oid string")
    assert sorted(tuple(r) for r in collect.victim_batches(dead, 2).collect()) == [(1, "00", 0), (1, "01", 0), (1, "02", 1), (1, "03", 1), (1, "04", 2), (2, "x", 0)]


def test_stale_deletes_fail(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rid, one = store.ensure_repo("r"), packs.object_id("blob", b"x")
    store.put(spark.createDataFrame([(rid, S.BLOB, bytearray(b"x"))], "repo_id long, type int, content binary"), F.lit(T0))
    ref, at = "refs/tags/t", F.lit(T0)
    assert store.push("r", request([(S.ZERO, one, ref)]), at) == wire.report("ok", [(ref, True, None)])
    assert store.push("r", request([("b" * 40, S.ZERO, ref)]), at) == wire.report("ok", [(ref, False, S.STALE_REF)])
    assert store.push("r", request([("b" * 40, S.ZERO, "refs/tags/none")]), at) == wire.report("ok", [("refs/tags/none", False, S.STALE_REF)])
    assert store.push("r", request([(S.ZERO, S.ZERO, "refs/tags/none")]), at) == wire.report("ok", [("refs/tags/none", True, None)])
    assert [r["oid"] for r in store.of(rid)["git_ref"].where(F.col("name") == ref).collect()] == [one]
    assert store.push("r", request([(one, S.ZERO, ref)]), at) == wire.report("ok", [(ref, True, None)])
    assert store.of(rid)["git_ref"].where(F.col("name") == ref).isEmpty()


def test_streaming_packets_and_drain(spark, tmp_path):
    from objgrove.streaming.drains import packets, start_drain

    data = wire.line("one") + wire.line("two") + wire.FLUSH
    folder = tmp_path / "in"
    schema = "connection string, seq long, data binary"
    for i, (lo, hi) in enumerate(((0, 5), (5, 9), (9, len(data)))):
        spark.createDataFrame([("k", i, bytearray(data[lo:hi]))], schema).coalesce(1).write.mode("append").parquet(str(folder))
    q = packets(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))).writeStream.format("memory").queryName("pkts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["kind"], bytes(r["payload"])) for r in spark.sql("SELECT * FROM pkts").collect()] == [("data", b"one"), ("data", b"two"), ("flush", b"")]
    store, seen = Store(spark, f"file://{tmp_path}/s"), []
    rid = store.ensure_repo("r")
    store.put(spark.createDataFrame([(rid, S.BLOB, bytearray(b"x"))], "repo_id long, type int, content binary"), F.lit(T0))
    q = start_drain(spark, store, str(tmp_path / "cp"), interval="1 second", grace_seconds=0, on_summary=lambda s: seen.extend(s.collect()))
    for _ in range(120):
        if seen:
            break
        q.awaitTermination(1)
    q.stop()
    assert [(r["repo"], r["deleted_objects"]) for r in seen][:1] == [("r", 1)]
