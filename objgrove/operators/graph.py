"""Graph questions over the edge table: closures, differences, ancestry, peeling, flattening.

Every function takes (repo_id, oid, labels...) roots and returns rows; labels, such as a root's id, are carried along, so
many roots are one job. Walks have set semantics, so shared history is visited once.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objgrove import schema as S
from objgrove.lineage import cut, dealt

#: A repository with so many edges at most is walked inside one task; larger ones level by level across the cluster.
GROUPED_EDGES = 200_000
#: Levels between cuts of the growing set of seen nodes.
MERGE_LEVELS = 8


def closure(edges: DataFrame, roots: DataFrame, kinds=None, strategy: str = "auto") -> DataFrame:
    """(repo_id, oid, labels...) of all nodes that roots reach, roots included.

    'frontier' walks level by level with joins; 'grouped' walks each repository's edges inside a task, which suits many
    small or deep repositories; 'auto' counts edges and uses 'grouped' for repositories of up to GROUPED_EDGES only.
    """
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    e = e.select("repo_id", "parent", "child")
    if strategy == "frontier":
        return _frontier(e, roots, e.count())
    if strategy == "grouped":
        return _grouped(e, roots)
    # counts first, so that no edge is dealt by its repository, which may be the only one
    sizes = e.groupBy("repo_id").agg(F.count("*").alias("n")).where(F.col("n") > GROUPED_EDGES)
    large = cut(sizes.join(roots.select("repo_id").distinct(), "repo_id", "left_semi").select("repo_id", "n"))
    rows = large.agg(F.sum("n")).first()[0]
    if rows is None:
        return _grouped(e, roots)
    large = F.broadcast(large.select("repo_id"))  # a row for GROUPED_EDGES edges at least
    big, small = ([d.join(large, "repo_id", how) for d in (e, roots)] for how in ("left_semi", "left_anti"))
    found = _frontier(*big, rows)
    return found if small[1].isEmpty() else found.unionByName(_grouped(*small))


def _frontier(e: DataFrame, roots: DataFrame, rows: int) -> DataFrame:
    """All levels join one copy of the edges, which keeps its dealing and order, so edges are shuffled and sorted once a walk."""
    labels = [c for c in roots.columns if c not in ("repo_id", "oid")]
    key = ["repo_id", "oid", *labels]
    e = dealt(e, rows, "repo_id", "parent").sortWithinPartitions("repo_id", "parent").persist(StorageLevel.DISK_ONLY)
    try:
        e.count()  # a copy that is not there yet has no known dealing, and the first level would shuffle it
        frontier = cut(roots.select(*key).distinct())
        seen, pieces = frontier, 1
        while True:
            step = frontier.join(e, (frontier["repo_id"] == e["repo_id"]) & (frontier["oid"] == e["parent"])).select(frontier["repo_id"], F.col("child").alias("oid"), *[frontier[c] for c in labels])
            frontier = cut(step.distinct().join(seen, key, "left_anti"))
            if frontier.isEmpty():
                return seen
            seen, pieces = seen.unionByName(frontier), pieces + 1
            if pieces > MERGE_LEVELS:
                seen, pieces = cut(seen), 1
    finally:
        e.unpersist()


def _grouped(e: DataFrame, roots: DataFrame) -> DataFrame:
    labels = [c for c in roots.columns if c not in ("repo_id", "oid")]
    schema = roots.select("repo_id", "oid", *labels).schema

    def walk(key, ours, edges):
        import pandas as pd

        children = defaultdict(list)
        for p, c in zip(edges["parent"], edges["child"], strict=True):
            children[p].append(c)
        out = []
        for label, part in ours.groupby(labels, dropna=False) if labels else [((), ours)]:
            seen = dict.fromkeys(part["oid"])
            todo = list(seen)
            while todo:
                for c in children.get(todo.pop(), ()):
                    if c not in seen:
                        seen[c] = None
                        todo.append(c)
            out += [(key[0], oid, *label) for oid in seen]
        return pd.DataFrame(out, columns=["repo_id", "oid", *labels])

    e = e.join(roots.select("repo_id").distinct(), "repo_id", "left_semi")
    return roots.groupBy("repo_id").cogroup(e.groupBy("repo_id")).applyInPandas(walk, schema)


def present(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """The nodes with whether the store holds them."""
    held = objects.select(F.col("repo_id").alias("__repo"), F.col("oid").alias("__oid"), F.lit(True).alias("__held"))
    out = nodes.join(held, (F.col("repo_id") == F.col("__repo")) & (F.col("oid") == F.col("__oid")), "left")
    return out.select(*nodes.columns, F.col("__held").isNotNull().alias("present"))


def reachable(objects: DataFrame, edges: DataFrame, roots: DataFrame, blobs: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """The closure with its present column; `blobs` (repo_id, tree, oid) adds the blobs that present trees name."""
    nodes = closure(edges, roots, strategy=strategy)
    marked = present(nodes, objects)
    if blobs is None:
        return marked
    marked = cut(marked)
    b = blobs.withColumnsRenamed({"oid": "blob"})
    named = marked.where("present").join(b, (marked["repo_id"] == b["repo_id"]) & (marked["oid"] == b["tree"])).select(marked["repo_id"], F.col("blob").alias("oid"), *[marked[c] for c in nodes.columns[2:]]).distinct()
    return marked.unionByName(present(named.join(marked, nodes.columns, "left_anti"), objects))


def served(objects: DataFrame, edges: DataFrame, wants: DataFrame, haves: DataFrame, blobs: DataFrame | None = None, refs: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """(repo_id, oid) that a fetch sends: what wants reach and haves do not.

    A missing object under a want is an error, under a have it is not. Without blobs, wanted objects themselves are sent
    even if haves reach them. With refs, annotated tags whose targets are sent are sent as well.
    """
    wanted = cut(reachable(objects, edges, wants.select("repo_id", "oid"), blobs, strategy))
    missing = [r["oid"] for r in wanted.where("not present").select("oid").limit(100).collect()]
    if missing:
        raise S.WantNotFound(missing)
    had = reachable(objects, edges, haves.select("repo_id", "oid"), blobs, strategy).where("present").select("repo_id", "oid")
    out = wanted.select("repo_id", "oid").join(had, ["repo_id", "oid"], "left_anti")
    if blobs is None:
        out = out.unionByName(present(wants.select("repo_id", "oid"), objects).where("present").select("repo_id", "oid")).distinct()
    return with_tags(out, edges, refs, strategy) if refs is not None else out


def with_tags(sent: DataFrame, edges: DataFrame, refs: DataFrame, strategy: str = "auto") -> DataFrame:
    """What is sent, and the chains of tags whose peeled targets are."""
    sent = cut(sent)
    tags = refs.where("peeled_oid is not null").join(sent.withColumnsRenamed({"oid": "peeled_oid"}), ["repo_id", "peeled_oid"], "left_semi").select("repo_id", "oid")
    chain = closure(edges, tags, kinds=(S.TAG_TARGET,), strategy=strategy)
    return sent.unionByName(chain).distinct()


def common_haves(objects: DataFrame, haves: DataFrame) -> DataFrame:
    """The haves (repo_id, pos, oid) that the store holds; the client's order and repeats stay in pos."""
    return haves.join(objects.select("repo_id", "oid"), ["repo_id", "oid"], "left_semi").select("repo_id", "pos", "oid")


def ready(edges: DataFrame, wants: DataFrame, commons: DataFrame, strategy: str = "auto") -> DataFrame:
    """(repo_id, ready): whether every want's ancestry (parents and tag targets) meets a common object."""
    roots = wants.select("repo_id", "oid", F.col("oid").alias("want")).distinct()
    walk = closure(edges, roots, kinds=(S.COMMIT_PARENT, S.TAG_TARGET), strategy=strategy)
    met = walk.join(commons.select("repo_id", "oid").distinct(), ["repo_id", "oid"], "left_semi").select("repo_id", "want").distinct().withColumn("met", F.lit(True))
    return roots.join(met, ["repo_id", "want"], "left").groupBy("repo_id").agg(F.bool_and(F.coalesce("met", F.lit(False))).alias("ready"))


def connected(objects: DataFrame, edges: DataFrame, tips: DataFrame, blobs: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """(repo_id, tip, connected, missing) for each tip."""
    roots = tips.select("repo_id", "oid", F.col("oid").alias("tip")).distinct()
    found = reachable(objects, edges, roots, blobs, strategy)
    return found.groupBy("repo_id", "tip").agg(F.bool_and("present").alias("connected"), F.count_if(~F.col("present")).alias("missing"))


def peel(edges: DataFrame) -> DataFrame:
    """(repo_id, tag, peeled) of every tag, by pointer jumping, so a chain takes rounds by the logarithm of its length."""
    at = cut(edges.where(F.col("kind") == S.TAG_TARGET).select("repo_id", F.col("parent").alias("tag"), F.col("child").alias("peeled")))
    while True:
        on = at.select("repo_id", F.col("tag").alias("peeled"), F.col("peeled").alias("further"))
        step = cut(at.join(on, ["repo_id", "peeled"], "left").select("repo_id", "tag", F.coalesce("further", "peeled").alias("peeled"), F.col("further").isNotNull().alias("moved")))
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            return at


def peeled(oids: DataFrame, edges: DataFrame) -> DataFrame:
    """oids (repo_id, oid) with peeled_oid: the chain's end for a tag, null for others."""
    p = peel(edges).withColumnsRenamed({"tag": "oid", "peeled": "peeled_oid"})
    return oids.join(p, ["repo_id", "oid"], "left")


def flatten(objects: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, labels..., path, mode, blob_oid) of the commits' whole trees; a tree at two paths is listed at both."""
    from objgrove.functions.objects import commit_tree, is_blob, is_subtree, tree_rows

    labels = [c for c in commits.columns if c not in ("repo_id", "oid")]
    entries = cut(tree_rows(objects).withColumnsRenamed({"oid": "child"}))
    level = commits.join(objects.where(F.col("type") == S.COMMIT).select("repo_id", "oid", commit_tree("content").alias("tree")), ["repo_id", "oid"])
    level = cut(level.select("repo_id", *labels, "tree", F.lit("").alias("prefix")))
    out = []
    while not level.isEmpty():
        rows = cut(level.join(entries, ["repo_id", "tree"]).select("repo_id", *labels, F.concat("prefix", "name").alias("path"), "mode", "child"))
        out.append(rows.where(is_blob("mode")).select("repo_id", *labels, "path", "mode", F.col("child").alias("blob_oid")))
        level = rows.where(is_subtree("mode")).select("repo_id", *labels, F.col("child").alias("tree"), F.concat("path", F.lit("/")).alias("prefix"))
    if not out:
        return level.select("repo_id", *labels, F.lit("").alias("path"), F.lit("").alias("mode"), F.lit("").alias("blob_oid"))
    files = out[0]
    for part in out[1:]:
        files = files.unionByName(part)
    return files
