"""Graph questions against plain walks, reference batches against a sequential run, collection contracts."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from objgrove import schema as S
from objgrove.operators import collect, graph, tables

EDGES = "repo_id long, parent string, child string, kind short"
NONE = "repo_id long, tree string, oid string"


def dag(rng, repos=3, n=40):
    """Random histories: commits with up to three parents, trees that share subtrees, tag chains."""
    out = set()
    for r in range(repos):
        for i in range(n):
            for j in rng.sample(range(i), min(i, rng.randrange(4))):
                out.add((r, f"c{i}", f"c{j}", S.COMMIT_PARENT))
            out.add((r, f"c{i}", f"t{rng.randrange(n)}", S.COMMIT_TREE))
            if i:
                out.add((r, f"t{i}", f"t{rng.randrange(i)}", S.TREE_SUBTREE))
        for i in range(19):
            out.add((r, f"v{i}", f"v{i + 1}" if i < 18 else "c7", S.TAG_TARGET))
    return sorted(out)


def walk(edges, roots, kinds=None):
    seen, todo = set(roots), list(roots)
    while todo:
        r, o = todo.pop()
        for e in edges:
            if e[0] == r and e[1] == o and (kinds is None or e[3] in kinds) and (r, e[2]) not in seen:
                seen.add((r, e[2]))
                todo.append((r, e[2]))
    return seen


@pytest.fixture(scope="module")
def history():
    return dag(random.Random(9))


@pytest.mark.parametrize("strategy", ["grouped", "frontier"])
def test_closures(spark, history, strategy):
    e = spark.createDataFrame(history, EDGES)
    roots = [(0, "c39"), (1, "v0"), (2, "absent"), (2, "c5"), (0, "c39")]
    df = spark.createDataFrame(roots, "repo_id long, oid string")
    assert sorted(map(tuple, graph.closure(e, df, strategy=strategy).collect())) == sorted(walk(history, roots))
    kinds = (S.COMMIT_PARENT, S.TAG_TARGET)
    assert sorted(map(tuple, graph.closure(e, df, kinds, strategy).collect())) == sorted(walk(history, roots, kinds))
    labelled = graph.closure(e, df.withColumn("root", F.col("oid")).distinct(), strategy=strategy).collect()
    want = sorted((*n, o) for r, o in set(roots) for n in walk(history, [(r, o)]))
    assert sorted(map(tuple, labelled)) == want
    assert graph.closure(e, df.limit(0), strategy=strategy).collect() == []


@pytest.mark.parametrize("strategy", ["auto", "frontier"])
def test_walks_read_edges_twice_at_most(spark, monkeypatch, strategy):
    """Once to count them and once to deal them, however many levels a walk has."""
    monkeypatch.setattr(graph, "GROUPED_EDGES", 5)
    read, chain = spark.sparkContext.accumulator(0), [(0, f"c{i}", f"c{i + 1}", 1) for i in range(12)]

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    e = spark.createDataFrame(chain, EDGES).mapInArrow(seen, EDGES)
    got = graph.closure(e, spark.createDataFrame([(0, "c2")], "repo_id long, oid string"), strategy=strategy)
    assert sorted(r["oid"] for r in got.collect()) == sorted(f"c{i}" for i in range(2, 13))
    assert read.value <= 2 * len(chain)


def test_sweeps_of_unions_are_one_join_each(spark):
    """Anti-joins and semi-joins would be pushed below the unions: a plan of joins by branches, each in few tasks."""
    objects = edges = None
    for i in range(5):
        o = spark.range(i * 10, i * 10 + 10).select(F.lit(1).cast("long").alias("repo_id"), F.col("id").cast("string").alias("oid"), F.timestamp_seconds("id").alias("created_at"))
        e = o.select("repo_id", F.col("oid").alias("parent"), F.lit("x").alias("child"), F.lit(3).cast("short").alias("kind"))
        objects, edges = (o, e) if objects is None else (objects.unionByName(o), edges.unionByName(e))
    edges = edges.unionByName(edges.where("parent = '7'")).unionByName(edges.limit(1).withColumn("parent", F.lit("gone")))
    objects = objects.unionByName(objects.where("oid = '7'"))
    live = objects.where("oid in ('3', '7', '7')").select("repo_id", "oid")
    dead = collect.victims(objects, live, F.timestamp_seconds(F.lit(20)), 0)
    kept, kept_edges = collect.sweep(objects, edges, dead)
    stay = ["3", "7", "7", *map(str, range(20, 50))]
    assert sorted(r["oid"] for r in kept.collect()) == sorted(stay) == sorted(r["parent"] for r in kept_edges.collect())
    assert kept_edges._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3


def test_trees_take_no_texts_along(spark, sf):
    """Texts are hashed where they are read: no shuffle of trees, commits and tags has them."""
    from objgrove.plans import corpus

    plan = corpus.without_blobs(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan
    blobs = corpus.blobs(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in blobs and "SortMergeJoin" not in blobs


def test_auto_splits_by_size(spark, history, monkeypatch):
    monkeypatch.setattr(graph, "GROUPED_EDGES", len([x for x in history if x[0] == 0]) - 1)
    e, roots = spark.createDataFrame(history, EDGES), [(r, "c39") for r in range(3)]
    got = graph.closure(e, spark.createDataFrame(roots, "repo_id long, oid string"))
    assert sorted(map(tuple, got.collect())) == sorted(walk(history, roots))


def test_served_ready_connected_peel(spark, history):
    e = spark.createDataFrame(history, EDGES)
    nodes = {(x[0], o) for x in history for o in x[1:3]}
    held = spark.createDataFrame(sorted(nodes - {(1, "t0")}), "repo_id long, oid string")
    at = lambda *x: spark.createDataFrame(list(x), "repo_id long, oid string")
    blobs = spark.createDataFrame([(0, "t1", "b1"), (0, "t2", "b1"), (0, "t2", "b2")], NONE)
    more = held.unionByName(at((0, "b1"), (0, "b2")))
    want, have = walk(history, [(0, "c39")]), walk(history, [(0, "c20")])
    add = lambda s: s | {(0, b) for r, t, b in [(0, "t1", "b1"), (0, "t2", "b1"), (0, "t2", "b2")] if (r, t) in s}
    got = graph.served(more, e, at((0, "c39")), at((0, "c20"), (0, "absent")), blobs)
    assert sorted(map(tuple, got.collect())) == sorted(add(want) - add(have))
    blobless = graph.served(more, e, at((0, "c20")), at((0, "c39")))
    assert sorted(map(tuple, blobless.collect())) == sorted((have - want) | {(0, "c20")})
    with pytest.raises(S.WantNotFound, match="not our ref"):
        graph.served(more, e, at((0, "nope")), at())
    refs = spark.createDataFrame([(0, "refs/tags/v", "v0", "c7", None)], S.REFS)
    tagged = graph.served(more, e, at((0, "c7")), at(), blobs, refs)
    assert {(0, f"v{i}") for i in range(19)} <= set(map(tuple, tagged.collect()))
    kinds = (S.COMMIT_PARENT, S.TAG_TARGET)
    for commons in (["c0"], ["c20", "c3"], ["c39"]):
        r = graph.ready(e, at((0, "c39"), (0, "c30")), at(*[(0, c) for c in commons])).first()
        assert r["ready"] == all(walk(history, [(0, w)], kinds) & {(0, c) for c in commons} for w in ("c39", "c30"))
    assert graph.ready(e, at((0, "c39")), at()).first()["ready"] is False
    state = {(r["repo_id"], r["tip"]): r["connected"] for r in graph.connected(held, e, at((0, "c39"), (1, "c39"), (2, "gone"))).collect()}
    assert state == {(0, "c39"): True, (1, "c39"): (1, "t0") not in walk(history, [(1, "c39")]), (2, "gone"): False}
    assert {tuple(r) for r in graph.peel(e).collect()} == {(r, f"v{i}", "c7") for r in range(3) for i in range(19)}
    peeled = {r["oid"]: r["peeled_oid"] for r in graph.peeled(at((0, "v3"), (0, "c1")), e).collect()}
    assert peeled == {"v3": "c7", "c1": None}
    order = spark.createDataFrame([(0, i, o) for i, o in enumerate(["c3", "zz", "c1", "c3"])], "repo_id long, pos int, oid string")
    assert [r["oid"] for r in graph.common_haves(held, order).orderBy("pos").collect()] == ["c3", "c1", "c3"]


def oid(x):
    return f"{x:040x}"


@pytest.mark.parametrize("atomic", [False, True])
def test_reference_batches(spark, atomic):
    rng = random.Random(10)
    state = {(r, f"refs/heads/b{i}"): oid(i + 1) for r in range(4) for i in range(0, 12, 2)}
    commands = [(rng.randrange(4), s, f"refs/heads/b{rng.randrange(12)}", oid(rng.choice([0, 1, 3, 5, 7, 50, 51])), oid(rng.choice([0, 50, 51]))) for s in range(40)]
    commands += [(9, 100, "refs/heads/gone", oid(0), oid(0)), (9, 101, "refs/heads/new", oid(0), oid(5)), (9, 102, "refs/heads/new", oid(5), oid(6))]
    want, after = {}, dict(state)
    for r, s, ref, old, new in sorted(commands, key=lambda c: c[1]):
        now = after.get((r, ref))
        if new == S.ZERO:
            ok = old == S.ZERO or now == old  # a delete that names an old value compares it
            want[r, s] = (ok, ok and now is not None)
            if ok:
                after.pop((r, ref), None)
        else:
            ok = now is None if old == S.ZERO else now == old
            want[r, s] = (ok, ok)
            if ok:
                after[r, ref] = new
    if atomic:
        whole = {r: all(ok for (x, _), (ok, _) in want.items() if x == r) for r in {c[0] for c in commands}}
        want = {k: (whole[k[0]], m and whole[k[0]]) for k, (_, m) in want.items()}
        after = {k: v for k, v in after.items() if whole.get(k[0])} | {k: v for k, v in state.items() if not whole.get(k[0])}
    refs = spark.createDataFrame([(r, n, o, None, None) for (r, n), o in state.items()], S.REFS)
    new, results = tables.apply_commands(refs, spark.createDataFrame(commands, "repo_id long, seq long, ref string, old_oid string, new_oid string"), atomic)
    assert {(r["repo_id"], r["seq"]): (r["ok"], r["mutated"]) for r in results.collect()} == want
    rows = new.collect()
    assert {(r["repo_id"], r["name"]): r["oid"] for r in rows if r["oid"]} == after
    assert {r["repo_id"] for r in rows if r["symref_target"] == "refs/heads/main"} == {c[0] for c in commands}


def test_long_names_and_seeding(spark):
    none = spark.createDataFrame([], S.REFS)
    c = spark.createDataFrame([(1, 0, "refs/heads/" + "x" * 1990, oid(0), oid(1)), (1, 1, "refs/heads/" + "x" * 1989, oid(0), oid(1))], "repo_id long, seq long, ref string, old_oid string, new_oid string")
    out = {r["seq"]: (r["ok"], r["reason"]) for r in tables.apply_commands(none, c)[1].collect()}
    assert out == {0: (False, "funny refname (too long to store)"), 1: (True, None)}
    refs = tables.set_refs(none, spark.createDataFrame([(1, "HEAD", oid(1), None)], "repo_id long, name string, oid string, peeled_oid string"))
    refs = tables.set_symrefs(refs, spark.createDataFrame([(1, "HEAD", "refs/heads/x")], "repo_id long, name string, symref_target string"))
    assert [tuple(r) for r in refs.collect()] == [(1, "HEAD", None, None, "refs/heads/x")]
    assert [r["oid"] for r in tables.resolved_heads(refs).collect()] == [None]
    repos = tables.ensure_repos(spark.createDataFrame([(3, "b", None, None)], S.REPOS), spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "name string"))
    assert sorted((r["id"], r["name"]) for r in repos.collect()) == [(3, "b"), (4, "a"), (5, "c")]


NOW = dt.datetime(2024, 5, 1, 12)


def store(spark, history, ages):
    nodes = sorted({(x[0], o) for x in history for o in x[1:3]})
    objects = spark.createDataFrame([(r, o, NOW - dt.timedelta(seconds=ages(r, o))) for r, o in nodes], "repo_id long, oid string, created_at timestamp")
    refs = spark.createDataFrame([(r, "refs/heads/main", "c20", None, None) for r in range(3)] + [(0, "refs/tags/v", "v10", "c7", None)], S.REFS)
    return nodes, objects, spark.createDataFrame(history, EDGES), refs, spark.createDataFrame([], NONE)


def test_collection(spark, history):
    """GC-1, 2, 3, 5, 6, 7, 8: the live stay, old orphans go, young ones stay, no edge dangles, again does nothing."""
    nodes, objects, edges, refs, blobs = store(spark, history, lambda r, o: 100 if o.startswith("c3") else 60)
    live = walk(history, [(r, "c20") for r in range(3)] + [(0, "v10"), (0, "c7")])
    for grace, gone in ((0, set(nodes) - live), (60, {n for n in set(nodes) - live if n[1].startswith("c3")}), (100, set()), (10**6, set())):
        o, e = collect.collect_one(objects, edges, refs, blobs, F.lit(NOW), grace)
        kept = {(r["repo_id"], r["oid"]) for r in o.collect()}
        assert kept == set(nodes) - gone
        left = e.collect()
        assert all((r["repo_id"], r["parent"]) in kept for r in left)
        if grace == 0:
            assert all((r["repo_id"], r["child"]) in kept for r in left) and kept == live
            again, _ = collect.collect_one(o, e, refs, blobs, F.lit(NOW), 0)
            assert {(r["repo_id"], r["oid"]) for r in again.collect()} == kept


def test_drain(spark, history):
    """SCH-3, 4, 5, 8: a pass covers those that are due and no others, and is not repeated."""
    nodes, objects, edges, refs, blobs = store(spark, history, lambda r, o: 100)
    hour = dt.timedelta(hours=1)
    repos = spark.createDataFrame([(0, "a", NOW - hour, None), (1, "b", NOW - hour, NOW - 2 * hour), (2, "c", NOW - 2 * hour, NOW - hour), (3, "d", None, None), (4, "e", NOW - hour, NOW - hour)], S.REPOS)
    state = {"repos": repos, "git_object": objects, "git_edge": edges, "git_ref": refs}
    new, summary = collect.drain(state, blobs, F.lit(NOW), 0)
    live = walk(history, [(r, "c20") for r in range(2)] + [(0, "v10"), (0, "c7")])
    kept = {(r["repo_id"], r["oid"]) for r in new["git_object"].collect()}
    assert kept == live | {n for n in nodes if n[0] == 2}
    got = {r["repo"]: (r["deleted_objects"], r["deleted_edges"]) for r in summary.collect()}
    assert got == {n: (sum(x[0] == i for x in nodes) - sum(x[0] == i for x in live), sum(x[0] == i and (i, x[1]) not in live for x in history)) for i, n in ((0, "a"), (1, "b"))}
    assert {r["name"]: r["last_gc_at"] for r in new["repos"].collect()} == {"a": NOW, "b": NOW, "c": NOW - hour, "d": None, "e": NOW - hour}
    assert collect.due(new["repos"]).count() == 0
    assert collect.drain(state, blobs, F.lit(NOW), 0, enabled=False)[1].count() == 0
    pushed = tables.stamp(new["repos"], spark.createDataFrame([(0,)], "repo_id long"), F.lit(NOW + hour))
    assert [r["name"] for r in collect.due(pushed).collect()] == ["a"]


def test_snapshots_and_upserts(spark):
    files = spark.createDataFrame([(1, "refs/heads/a", "x", "100644", "o1"), (1, "refs/heads/b", "x", "100644", "o2"), (2, "refs/heads/a", "x", "100644", "o3")], S.FILES)
    new = spark.createDataFrame([(1, "refs/heads/a", "y", "100644", "o5"), (1, "refs/heads/a", "y", "100644", "o4")], S.FILES)
    got = tables.replace_snapshots(files, new.select("repo_id", "ref_name"), new)
    assert sorted((r["repo_id"], r["ref_name"][-1], r["path"], r["blob_oid"]) for r in got.collect()) == [(1, "a", "y", "o4"), (1, "b", "x", "o2"), (2, "a", "x", "o3")]
    assert tables.drop_snapshots(files, spark.createDataFrame([(1,)], "repo_id long")).count() == 1
    t = spark.createDataFrame([(1, "old")], "k int, v string")
    rows = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, v string")
    assert sorted(map(tuple, tables.upsert_first(t, rows, ["k"], ["v"]).collect())) == [(1, "old"), (2, "a")]
    chunks = tables.content_chunks(spark.createDataFrame([(1, "a", bytearray(b"abcdefg")), (1, "b", bytearray())], "repo_id long, oid string, content binary"), 3).collect()
    assert sorted((r["oid"], r["part"], bytes(r["bytes"])) for r in chunks) == [("a", 0, b"abc"), ("a", 1, b"def"), ("a", 2, b"g"), ("b", 0, b"")]
    bad = spark.createDataFrame([(1, "n", None, None, None), (1, "n", oid(1), None, "x"), (1, "n", oid(1), None, None)], S.REFS).select(S.constraint_errors("git_ref").alias("e")).collect()
    assert [r["e"] for r in bad] == ["oid xor symref_target", "oid xor symref_target", None]


def test_grace_windows_meet_the_live_set_once(spark, sf):
    from objgrove.plans import catalog

    df = catalog.gc_grace_boundary(spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert [r["grace"] for r in df.collect()] == [0, 86_400, 31_536_000, 2_000_000_000]
