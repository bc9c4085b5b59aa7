"""Garbage collection with a grace window, and the drain over repositories that are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objgrove.lineage import cut, dealt
from objgrove.operators.graph import reachable


def live_set(objects: DataFrame, edges: DataFrame, refs: DataFrame, blobs: DataFrame, strategy: str = "auto") -> DataFrame:
    """(repo_id, oid) that refs and their peeled targets reach and the store holds; missing objects are tolerated."""
    roots = refs.where("oid is not null").select("repo_id", F.explode(F.array_compact(F.array("oid", "peeled_oid"))).alias("oid")).distinct()
    return reachable(objects, edges, roots, blobs, strategy).where("present").select("repo_id", "oid").distinct()


def expired(now: Column, grace_seconds: int) -> Column:
    """Whether an object is older than the grace window, strictly."""
    return F.col("created_at") < now - F.make_dt_interval(secs=F.lit(grace_seconds))


def victims(objects: DataFrame, live: DataFrame, now: Column, grace_seconds: int) -> DataFrame:
    """Objects that are not live and older than the grace window, strictly."""
    return _without(objects.where(expired(now, grace_seconds)), live)


def _without(objects: DataFrame, others: DataFrame) -> DataFrame:
    """The objects that are not among others. An anti-join would be pushed below a union, with a copy of both sides a branch."""
    marked = objects.join(others.select("repo_id", "oid", F.lit(True).alias("__other")), ["repo_id", "oid"], "left")
    return marked.where("__other is null").select(*objects.columns)


def victim_batches(dead: DataFrame, batch_limit: int) -> DataFrame:
    """(repo_id, oid) with the batch of up to batch_limit objects that each goes with, by id within a repository."""
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy("oid")) - 1
    return dead.select("repo_id", "oid").withColumn("batch", F.floor(rank / batch_limit).cast("long"))


def sweep(objects: DataFrame, edges: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, edges) without the dead, and without edges whose parent is gone."""
    kept = _without(objects, dead)
    parents = kept.select("repo_id", F.col("oid").alias("parent")).distinct()
    return kept, dealt(edges, edges.count(), "repo_id", "parent").join(parents, ["repo_id", "parent"]).select(*edges.columns)


def due(repos: DataFrame) -> DataFrame:
    """Repositories pushed to since their last pass, which they must have been once."""
    return repos.where("last_pushed_at is not null and (last_gc_at is null or last_pushed_at > last_gc_at)")


def drain(tables: dict[str, DataFrame], blobs: DataFrame, now: Column, grace_seconds: int, enabled: bool = True, strategy: str = "auto", only: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """One pass over all repositories that are due, or those of `only` (id) among them, as one job: (new tables, summary).

    `now`, taken before the tables are read, is what last_gc_at becomes, so a later push makes a repository due again.
    """
    repos, objects, edges, refs = (tables[k] for k in ("repos", "git_object", "git_edge", "git_ref"))
    asked = repos if only is None else repos.join(only, "id", "left_semi")
    ready = cut(due(asked).select(F.col("id").alias("repo_id"), "name")) if enabled else cut(repos.limit(0).select(F.col("id").alias("repo_id"), "name"))
    mine = lambda df: df.join(ready.select("repo_id"), "repo_id", "left_semi")
    live = live_set(mine(objects), mine(edges), mine(refs), mine(blobs), strategy)
    dead = cut(victims(mine(objects), live, now, grace_seconds).select("repo_id", "oid"))
    kept, kept_edges = sweep(objects, edges, dead)
    # edges of other repositories stay whatever their parents
    kept_edges = kept_edges.join(ready.select("repo_id"), "repo_id", "left_semi").unionByName(edges.join(ready.select("repo_id"), "repo_id", "left_anti").select(*kept_edges.columns))
    lost = mine(edges).groupBy("repo_id").agg(F.count("*").alias("n")).join(mine(kept_edges).groupBy("repo_id").agg(F.count("*").alias("m")), "repo_id", "left")
    lost = lost.select("repo_id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("deleted_edges"))
    summary = ready.join(dead.groupBy("repo_id").agg(F.count("*").alias("deleted_objects")), "repo_id", "left").join(lost, "repo_id", "left")
    summary = summary.select("repo_id", F.col("name").alias("repo"), F.coalesce("deleted_objects", F.lit(0)).alias("deleted_objects"), F.coalesce("deleted_edges", F.lit(0)).alias("deleted_edges"))
    done = ready.select(F.col("repo_id").alias("id"), F.lit(True).alias("__done"))
    stamped = repos.join(done, "id", "left").withColumn("last_gc_at", F.when(F.col("__done"), now).otherwise(F.col("last_gc_at"))).select(*repos.columns)
    return {**tables, "repos": stamped, "git_object": kept, "git_edge": kept_edges}, summary


def collect_one(objects, edges, refs, blobs, now: Column, grace_seconds: int, strategy: str = "auto"):
    """A pass over the given rows whatever their activity: (objects, edges)."""
    live = live_set(objects, edges, refs, blobs, strategy)
    return sweep(objects, edges, cut(victims(objects, live, now, grace_seconds).select("repo_id", "oid")))
