"""Table maintenance as pure functions from states to states: upserts, reference batches, snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objgrove import schema as S
from objgrove.functions.objects import is_zero
from objgrove.lineage import cut


def upsert_first(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Appends rows whose keys are new; what is there stays, and of rows with equal keys the first in `order` comes in."""
    if order:
        others = [c for c in rows.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in others if c not in order])).alias("__row"))
        rows = best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])
    else:
        rows = rows.dropDuplicates(keys)
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def upsert_last(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replaces or appends rows by key."""
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*target.columns))


def ensure_repos(repos: DataFrame, names: DataFrame) -> DataFrame:
    """repos with a row for every name; new ids follow the largest one, in the names' order."""
    new = names.select("name").where("name is not null").distinct().join(repos.select("name"), "name", "left_anti")
    top = repos.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = new.withColumn("rank", F.row_number().over(Window.orderBy("name")))  # a row a new repository
    new = new.join(F.broadcast(top)).select((F.col("top") + F.col("rank")).alias("id"), "name", F.lit(None).cast("timestamp").alias("last_pushed_at"), F.lit(None).cast("timestamp").alias("last_gc_at"))
    return repos.unionByName(new)


def stamp(repos: DataFrame, touched: DataFrame, now: Column, column: str = "last_pushed_at") -> DataFrame:
    """repos with a time for those touched (repo_id)."""
    t = touched.select(F.col("repo_id").alias("id"), F.lit(True).alias("__t")).distinct()
    return repos.join(t, "id", "left").withColumn(column, F.when(F.col("__t"), now).otherwise(F.col(column))).select(*repos.columns)


def set_refs(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """Writes direct refs (repo_id, name, oid, peeled_oid)."""
    return upsert_last(refs, rows.select("repo_id", "name", "oid", "peeled_oid", F.lit(None).cast("string").alias("symref_target")), ["repo_id", "name"])


def set_symrefs(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """Writes symbolic refs (repo_id, name, symref_target); they have no oid."""
    none = F.lit(None).cast("string")
    return upsert_last(refs, rows.select("repo_id", "name", none.alias("oid"), none.alias("peeled_oid"), "symref_target"), ["repo_id", "name"])


def list_refs(refs: DataFrame) -> DataFrame:
    """Direct refs by name, in byte order."""
    return refs.where("oid is not null").orderBy("repo_id", "name")


def matching_refs(refs: DataFrame, prefixes: list[str]) -> DataFrame:
    """Refs of any of the prefixes; all without prefixes."""
    if not prefixes:
        return refs
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("name").startswith(p)
    return refs.where(hit)


def resolved_heads(refs: DataFrame) -> DataFrame:
    """(repo_id, name, symref_target, oid) of symbolic refs; oid is null for an unborn one."""
    direct = refs.where("oid is not null").select("repo_id", F.col("name").alias("symref_target"), F.col("oid").alias("target"))
    return refs.where("symref_target is not null").select("repo_id", "name", "symref_target").join(direct, ["repo_id", "symref_target"], "left").select("repo_id", "name", "symref_target", F.col("target").alias("oid"))


def classified(commands: DataFrame) -> DataFrame:
    """Adds op: delete if the new id is zero, else create if the old one is, else update."""
    return commands.withColumn("op", F.when(is_zero("new_oid"), "delete").when(is_zero("old_oid"), "create").otherwise("update"))


def apply_commands(refs: DataFrame, commands: DataFrame, atomic: bool = False, peels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One batch (repo_id, seq, ref, old_oid, new_oid) by compare-and-swap; (new refs, results).

    Results have op, ok, mutated and reason. Commands on one ref run in seq order. A delete with an old id compares it like
    an update; one with a zero old id is unconditional, and ok without mutating where the ref is absent. An atomic batch is all or nothing within each repository. Commands stream
    through tasks sorted by ref, with one ref's state at a time. HEAD is made to point at main where it is absent. `peels`
    (repo_id, oid, peeled_oid) gives the peeled ids of new values.
    """
    direct = refs.where("oid is not null").select("repo_id", F.col("name").alias("ref"), F.col("oid").alias("now"))
    long_names = F.octet_length("ref") > S.MAX_REF_NAME_BYTES
    c = classified(commands.select("repo_id", F.col("seq").cast("long").alias("seq"), "ref", "old_oid", "new_oid")).withColumn("long", long_names)
    c = c.join(direct, ["repo_id", "ref"], "left").repartition("repo_id", "ref").sortWithinPartitions("repo_id", "ref", "seq")
    shape = "repo_id long, seq long, ref string, op string, ok boolean, mutated boolean, value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["repo_id"], r["ref"]) != key:
                    key, value = (r["repo_id"], r["ref"]), r["now"]
                before = value
                if r["long"]:
                    ok = False
                elif r["op"] == "delete":
                    ok = r["old_oid"] in (None, S.ZERO) or value == r["old_oid"]
                    value = None if ok else value
                else:
                    ok = value is None if r["op"] == "create" else value == r["old_oid"]
                    value = r["new_oid"] if ok else value
                # setting a ref to what it is counts as a write; deleting what is absent does not
                out.append((r["repo_id"], r["seq"], r["ref"], r["op"], ok, ok and (r["op"] != "delete" or before is not None), value))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in shape.split(", ")])

    done = cut(c.mapInArrow(run, shape))
    if atomic:
        all_ok = done.groupBy("repo_id").agg(F.bool_and("ok").alias("all_ok"))
        done = done.join(all_ok, "repo_id")
        reason = F.when(F.col("all_ok"), F.lit(None)).when(F.col("ok"), S.ATOMIC_FAILED).otherwise(S.STALE_REF)
        done = cut(done.select("repo_id", "seq", "ref", "op", F.col("all_ok").alias("ok"), (F.col("mutated") & F.col("all_ok")).alias("mutated"), "value", reason.alias("reason")))
    else:
        done = done.withColumn("reason", F.when(~F.col("ok"), S.STALE_REF))
    long_reason = F.when(F.octet_length("ref") > S.MAX_REF_NAME_BYTES, S.LONG_REF).otherwise(F.col("reason"))
    results = done.select("repo_id", "seq", "ref", "op", "ok", "mutated", F.when(~F.col("ok"), long_reason).alias("reason"))
    last = done.where("ok").groupBy("repo_id", "ref").agg(F.max_by("value", "seq").alias("oid"), F.bool_or("mutated").alias("mutated"))
    changed = last.where("mutated").select("repo_id", F.col("ref").alias("name"), "oid")
    p = (peels if peels is not None else changed.select("repo_id", "oid", F.lit(None).cast("string").alias("peeled_oid")).limit(0)).select("repo_id", "oid", "peeled_oid")
    new = changed.where("oid is not null").join(p, ["repo_id", "oid"], "left").select("repo_id", "name", "oid", "peeled_oid", F.lit(None).cast("string").alias("symref_target"))
    kept = refs.join(changed, ["repo_id", "name"], "left_anti").unionByName(new)
    name, target = S.DEFAULT_HEAD
    none = F.lit(None).cast("string")
    heads = commands.select("repo_id").distinct().select("repo_id", F.lit(name).alias("name"), none.alias("oid"), none.alias("peeled_oid"), F.lit(target).alias("symref_target"))
    return upsert_first(kept, heads, ["repo_id", "name"]), results


def replace_snapshots(files: DataFrame, targets: DataFrame, new: DataFrame) -> DataFrame:
    """files with the snapshots of targets (repo_id, ref_name) replaced by new rows; repeated paths collapse."""
    kept = files.join(targets.select("repo_id", "ref_name").distinct(), ["repo_id", "ref_name"], "left_anti")
    first = new.groupBy("repo_id", "ref_name", "path").agg(F.min(F.struct("mode", "blob_oid")).alias("f")).select("repo_id", "ref_name", "path", "f.mode", "f.blob_oid")
    return kept.unionByName(first.select(*kept.columns))


def drop_snapshots(files: DataFrame, targets: DataFrame) -> DataFrame:
    """files without those of targets, by repository, or by repository and ref."""
    on = [c for c in ("repo_id", "ref_name") if c in targets.columns]
    return files.join(targets.select(*on).distinct(), on, "left_anti")


def sync_snapshots(files: DataFrame, objects: DataFrame, refs: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Rebuilds the snapshots of branches, of those in changed (repo_id, name) or of all; a deleted branch's goes."""
    from objgrove.operators.graph import flatten

    tips = refs.where(F.col("name").startswith(S.BRANCHES) & F.col("oid").isNotNull()).select("repo_id", F.col("name").alias("ref_name"), "oid")
    if changed is None:
        return replace_snapshots(files, files.select("repo_id", "ref_name").unionByName(tips.select("repo_id", "ref_name")), flatten(objects, tips))
    c = changed.where(F.col("name").startswith(S.BRANCHES)).select("repo_id", F.col("name").alias("ref_name")).distinct()
    return replace_snapshots(files, c, flatten(objects, tips.join(c, ["repo_id", "ref_name"], "left_semi")))


def content_chunks(objects: DataFrame, chunk: int) -> DataFrame:
    """(repo_id, oid, part, bytes) of contents in slices; an empty content is one empty slice."""
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("content") / chunk) - 1, F.lit(0)).cast("int"))
    rows = objects.select("repo_id", "oid", "content", F.explode(parts).alias("part"))
    return rows.select("repo_id", "oid", "part", F.substring("content", F.col("part") * chunk + 1, F.lit(chunk)).alias("bytes"))


def guarded(objects: DataFrame, limit: int) -> DataFrame:
    """Contents under a size; larger ones are null, to be read in slices."""
    return objects.withColumn("content", F.when(F.octet_length("content") < limit, F.col("content")))
