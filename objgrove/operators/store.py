"""The store on a file system: versions of the tables, each committed by its manifest.

A manifest lists, for each table, the folders that hold it. Tables are dealt by a hash of the repository into PARTS, a
folder each, so a reader or writer of one repository lists and scans its part's folders alone. A commit writes its rows
under a folder of its own: added rows are one more folder of a part, changed parts take the place of theirs, and all other
folders stay as they are. Then manifest N+1 is written aside and put in place in one step that fails if another commit has
done so; the loser reads again and retries. Readers see one manifest's tables, so a version is a snapshot. compact()
merges folders, expire() deletes versions and the folders that only they name.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objgrove import schema as S
from objgrove.functions.objects import checked, edges, object_id, tree_blobs, type_name, validation_code
from objgrove.lineage import cut
from objgrove.operators import collect, graph, tables
from objgrove.sources import packs, wire

PARTS = 64


def _part(path: str) -> int | None:
    """The part that a folder has, of a table that is dealt."""
    name = path.rsplit("/", 1)[1]
    return int(name[5:]) if name.startswith("part=") else None


class Conflict(RuntimeError):
    """Another commit came first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = self._hadoop.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def version(self) -> int:
        return max([0, *self.versions()])

    def versions(self) -> list[int]:
        found = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[9:-5]) for n in found if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self, version: int) -> dict[str, list[str]]:
        if not version:
            return {}
        with_lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self._fs.open(self._path(f"{self.root}/manifest-{version:012d}.json"))
        try:
            found = json.loads(with_lines.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return S.migrated(found)["tables"]

    def parts_of(self, ids) -> set[int]:
        """The parts of repositories; folded into constants, so it starts no job."""
        ids = sorted(set(ids))
        if not ids:
            return set()
        return set(self.spark.sql("SELECT " + ", ".join(f"pmod(xxhash64({int(i)}L), {PARTS})" for i in ids)).first())

    def read(self, version: int | None = None, parts: set[int] | None = None) -> dict[str, DataFrame]:
        """The tables of a version, the latest without one; of some parts only, where these are given."""
        paths = self._manifest(self.version() if version is None else version)
        out = {}
        for name, schema in S.TABLES.items():
            folders = [f"{self.root}/{p}" for p in paths.get(name, ()) if parts is None or _part(p) is None or _part(p) in parts]
            out[name] = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return out

    def of(self, repo_id: int | None, version: int | None = None) -> dict[str, DataFrame]:
        """A repository's rows, from its part's folders alone."""
        t = self.read(version, self.parts_of([repo_id] if repo_id is not None else []))
        return {k: df.where(F.col("repo_id" if "repo_id" in df.columns else "id") == F.lit(repo_id)) for k, df in t.items()}

    def _write(self, name: str, df: DataFrame, folder: str) -> list[str]:
        """Writes rows under a folder; the folders that hold them."""
        bad = df.where(S.constraint_errors(name).isNotNull())
        if not bad.isEmpty():
            raise ValueError(f"{name}: a row violates a constraint")
        at = f"{folder}/{name}"
        if "repo_id" not in df.columns:
            df.write.parquet(f"{self.root}/{at}")
            return [at]
        sort = [c for c in ("repo_id", "ref_name", "path", "oid", "parent") if c in df.columns]
        df = df.withColumn("part", F.pmod(F.xxhash64("repo_id"), F.lit(PARTS))).repartition("part", F.col(sort[-1])).sortWithinPartitions("part", *sort)
        df.write.partitionBy("part").parquet(f"{self.root}/{at}")
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/{at}")) if x.isDirectory()]
        return sorted(f"{at}/{n}" for n in names if n.startswith("part="))

    def commit(self, base: int, changed: dict[str, DataFrame], added: dict[str, DataFrame] | None = None, parts: set[int] | None = None) -> int:
        """Writes version base + 1; Conflict if that exists.

        `changed` tables take the place of what is there, of some parts where these are given; `added` rows come to it.
        """
        folder, paths = f"data/{uuid.uuid4().hex}", self._manifest(base)
        for name, df in changed.items():
            kept = [p for p in paths.get(name, ()) if parts is not None and _part(p) is not None and _part(p) not in parts]
            paths[name] = kept + self._write(name, df, folder)
        for name, df in (added or {}).items():
            paths[name] = [*paths.get(name, ()), *self._write(name, df, f"{folder}/added")]
        self._publish(base + 1, json.dumps({"schema": S.VERSION, "tables": paths}))
        return base + 1

    def _publish(self, version: int, text: str) -> None:
        """Puts a whole manifest in place in one step that fails where it exists."""
        target, aside = (f"{self.root}/{n}" for n in (f"manifest-{version:012d}.json", f".aside-{uuid.uuid4().hex}"))
        stream = self._fs.create(self._path(aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                # a local rename would replace what is there; a link does not
                local = lambda p: self._path(p).toUri().getPath()
                os.link(local(aside), local(target))
            else:
                self._rename(aside, target)
        except FileExistsError as e:
            raise Conflict(f"version {version} exists") from e
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} exists") from e
            raise
        finally:
            self._fs.delete(self._path(aside), False)

    def _rename(self, source: str, target: str) -> None:
        context = self._hadoop.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        mode = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(mode, 1)
        options[0] = mode.NONE
        context.rename(self._path(source), self._path(target), options)

    def change(self, step, tries: int = 5, parts: set[int] | None = None):
        """Runs step(tables) -> (changed tables, added rows, result) and commits; a conflict runs it again on what is there now."""
        for left in reversed(range(tries)):
            base = self.version()
            changed, added, result = step(self.read(base, parts))
            try:
                if changed or added:
                    self.commit(base, changed, added, parts)
                return result
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def register_views(self, version: int | None = None) -> None:
        for name, df in self.read(version).items():
            df.createOrReplaceTempView(name)

    def repo_id(self, name: str) -> int | None:
        row = self.read()["repos"].where(F.col("name") == name).select("id").first()
        return row[0] if row else None

    def ensure_repo(self, name: str) -> int:
        def step(t):
            names = self.spark.createDataFrame([(name,)], "name string")
            return ({"repos": tables.ensure_repos(t["repos"], names)} if t["repos"].where(F.col("name") == name).isEmpty() else {}), {}, None

        self.change(step, parts=set())
        return self.repo_id(name)

    def get(self, repo: str, oid: str):
        """(type, content) of an object, else null; its part is the only one listed, and the filter reaches the scan."""
        rid = self.repo_id(repo)
        row = self.of(rid)["git_object"].where(F.col("oid") == oid).select("type", "content").first() if rid is not None else None
        return (S.TYPE_NAMES[row[0]], bytes(row[1])) if row else None

    def put(self, objects: DataFrame, now: Column) -> DataFrame:
        """Adds (repo_id, type, content) objects with their edges and stamps their repositories; returns (repo_id, oid).

        Only new rows are written, and only the repositories' parts are read.
        """
        rows = objects.select("repo_id", F.col("type").cast("short").alias("type"), "content")
        rows = cut(checked(rows).select("repo_id", object_id(type_name("type"), "content").alias("oid"), "type", F.octet_length("content").alias("size"), "content", now.alias("created_at")))
        hashed = F.pmod(F.xxhash64("repo_id"), F.lit(PARTS))
        parts = {r[0] for r in rows.select(hashed).distinct().collect()}  # PARTS numbers at most

        def step(t):
            fresh = lambda name, new: tables.upsert_first(t[name].limit(0), new, S.KEYS[name]).join(t[name].select(*S.KEYS[name]), S.KEYS[name], "left_anti").select(*t[name].columns)
            added = {"git_object": fresh("git_object", rows), "git_edge": fresh("git_edge", edges(rows))}
            return ({"repos": tables.stamp(t["repos"], rows, now)}, added, ids) if parts else ({}, {}, ids)

        ids = rows.select("repo_id", "oid").distinct()
        return self.change(step, parts=parts)

    def gc(self, now: Column, grace_seconds: int, strategy: str = "auto", maintain: bool = False, on_error=None) -> DataFrame:
        """A drain over the repositories that are due; returns its summary.

        Where the pass over all of them fails, halves are tried, down to single repositories; one that fails alone is
        reported to on_error(repo_id, error), keeps its stamp, and is tried again by the next pass. `now` is read before
        the tables are. With `maintain`, a pass that deleted something is followed by compact().
        """
        t0 = F.lit(self.spark.range(1).select(now).first()[0]).cast("timestamp")
        ready = [r[0] for r in collect.due(self.read(parts=set())["repos"]).select("id").collect()]
        todo, done, columns = [ready] if ready else [], [], "repo_id long, repo string, deleted_objects long, deleted_edges long"
        while todo:
            ids = todo.pop()
            try:
                done.append(self._drained(ids, t0, grace_seconds, strategy))
            except Conflict:
                raise
            except Exception as e:
                if len(ids) == 1:
                    (on_error or (lambda repo, error: print(f"gc of repository {repo}: {error}")))(ids[0], e)
                else:
                    todo += [ids[len(ids) // 2 :], ids[: len(ids) // 2]]
        out = self.spark.createDataFrame([], columns)
        for summary in done:
            out = out.unionByName(summary)
        if maintain and not out.where("deleted_objects + deleted_edges > 0").isEmpty():
            self.compact()
        return out

    def _drained(self, ids: list[int], now: Column, grace_seconds: int, strategy: str) -> DataFrame:
        only = self.spark.createDataFrame([(i,) for i in ids], "id long")

        def step(t):
            new, summary = collect.drain(t, tree_blobs(t["git_object"].join(only.withColumnRenamed("id", "repo_id"), "repo_id", "left_semi")), now, grace_seconds, strategy=strategy, only=only)
            summary = cut(summary)
            return ({} if summary.isEmpty() else {k: new[k] for k in ("repos", "git_object", "git_edge")}), {}, summary

        return self.change(step, parts=self.parts_of(ids))

    def compact(self) -> int:
        """Rewrites the dealt tables, a folder a part; a conflict is tried again."""
        self.change(lambda t: ({k: t[k] for k in ("git_object", "git_edge", "git_ref", "repo_file")}, {}, None))
        return self.version()

    def expire(self, keep: int = 10, min_age_seconds: int = 86_400) -> int:
        """Deletes all but the newest versions, and data older than min_age_seconds that none of these names; how many folders."""
        versions = self.versions()
        named = {p.split("/")[1] for v in versions[-keep:] for paths in self._manifest(v).values() for p in paths}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest-{v:012d}.json"), False)
        data, gone = self._path(f"{self.root}/data"), 0
        now = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
        for x in self._fs.listStatus(data) if self._fs.exists(data) else ():
            # a running commit's folder is young and not named yet
            if x.getPath().getName() not in named and now - x.getModificationTime() >= 1000 * min_age_seconds:
                self._fs.delete(x.getPath(), True)
                gone += 1
        return gone

    def push(self, repo: str, body: bytes, now: Column, strategy: str = "auto") -> bytes:
        """A receive-pack request: names, ingest, connectivity, compare-and-swap, snapshots, report."""
        request = wire.parse_receive(body)
        atomic, band = "atomic" in request.capabilities, "side-band-64k" in request.capabilities
        refs = [ref for _, _, ref in request.commands]
        fail = lambda status, why: wire.report(status, [(r, False, why(r)) for r in refs], band)
        long = {r for r in refs if len(r.encode()) > S.MAX_REF_NAME_BYTES}
        if long and (atomic or len(long) == len(refs)):
            return fail("ok", lambda r: S.LONG_REF if r in long else S.ATOMIC_FAILED)
        rid = self.ensure_repo(repo)
        if request.pack:
            one = self.spark.createDataFrame([(rid, bytearray(request.pack))], "repo_id long, pack binary")
            rows = cut(packs.parsed(one, self.of(rid)["git_object"]))
            code = rows.select(F.coalesce("error", validation_code("type", "content")).alias("e")).where("e is not null").first()
            if code:
                return fail(code[0], lambda r: S.UNPACKER_ERROR)
            self.put(rows.select("repo_id", "type", "content"), now)
        t = self.of(rid)
        tips = [new for _, new, _ in request.commands if new != S.ZERO]
        missing = set()
        if tips:
            wanted = self.spark.createDataFrame([(rid, o) for o in set(tips)], "repo_id long, oid string")
            missing = {r["tip"] for r in graph.connected(t["git_object"], t["git_edge"], wanted, tree_blobs(t["git_object"]), strategy).where("not connected").collect()}
        bad = {r: S.MISSING_OBJECTS for _, new, r in request.commands if new in missing} | {r: S.LONG_REF for r in long}
        if bad and atomic:
            return fail("ok", lambda r: bad.get(r, S.ATOMIC_FAILED))
        run = [(rid, i, ref, old, new) for i, (old, new, ref) in enumerate(request.commands) if ref not in bad]
        results = {}
        if run:
            commands = self.spark.createDataFrame(run, "repo_id long, seq long, ref string, old_oid string, new_oid string")

            def step(t):
                mine = {k: t[k].where(F.col("repo_id") == F.lit(rid)) for k in ("git_object", "git_edge")}
                p = graph.peel(mine["git_edge"]).select("repo_id", F.col("tag").alias("oid"), F.col("peeled").alias("peeled_oid"))
                new, out = tables.apply_commands(t["git_ref"], commands, atomic, p)
                rows, new = out.collect(), cut(new)
                touched = self.spark.createDataFrame([(rid, r["ref"]) for r in rows if r["mutated"]], "repo_id long, name string")
                files = {"repo_file": tables.sync_snapshots(t["repo_file"], mine["git_object"], new, touched)} if not touched.isEmpty() else {}
                return {"git_ref": new, **files}, {}, rows

            results = {r["seq"]: r for r in self.change(step, parts=self.parts_of([rid]))}
            if any(r["mutated"] for r in results.values()):
                # stamped once the refs are committed, so a pass that began before cannot take the stamp for its own
                pushed = self.spark.createDataFrame([(rid,)], "repo_id long")
                self.change(lambda t: ({"repos": tables.stamp(t["repos"], pushed, now)}, {}, None), parts=set())
        out = [(ref, i in results and results[i]["ok"], bad.get(ref) or (results[i]["reason"] if i in results else None)) for i, (_, _, ref) in enumerate(request.commands)]
        return wire.report("ok", out, band)

    def fetch(self, repo: str, body: bytes, strategy: str = "auto") -> bytes:
        """A version 2 request: ls-refs or fetch."""
        return b"".join(self.answer(repo, body, strategy))

    def answer(self, repo: str, body: bytes, strategy: str = "auto") -> Iterator[bytes]:
        """fetch() in parts; a pack's entries come a partition at a time."""
        request, rid = wire.parse_request(body), self.repo_id(repo)
        mine = self.of(rid)
        if request.command == "ls-refs":
            yield self._refs(request.arguments, mine["git_ref"])
            return
        if request.command != "fetch":
            raise wire.ProtocolError(f"unknown command: {request.command}")
        f = wire.parse_fetch(request.arguments)
        named = lambda oids: self.spark.createDataFrame([(rid, i, o) for i, o in enumerate(oids)], "repo_id long, pos int, oid string")
        common = [r["oid"] for r in graph.common_haves(mine["git_object"], named(f.haves)).orderBy("pos").collect()] if f.haves else []
        if not f.done:
            met = graph.ready(mine["git_edge"], named(f.wants), named(common), strategy).first() if common and f.wants else None
            is_ready = bool(met and met["ready"])
            yield wire.acknowledgments(common, is_ready)
            if not is_ready:
                return
        blobs = None if f.omit_blobs else tree_blobs(mine["git_object"])
        try:
            sent = graph.served(mine["git_object"], mine["git_edge"], named(f.wants), named(f.haves), blobs, mine["git_ref"] if f.include_tag else None, strategy)
        except S.WantNotFound as e:
            yield wire.error(str(e))
            return
        yield wire.line("packfile\n")
        for part in packs.streamed(mine["git_object"].join(sent, ["repo_id", "oid"], "left_semi")):
            yield wire.side_band(1, part)
        yield wire.FLUSH

    def _refs(self, arguments: list[str], refs: DataFrame) -> bytes:
        prefixes = [a.removeprefix("ref-prefix ") for a in arguments if a.startswith("ref-prefix ")]
        symrefs, peel, unborn = ("symrefs" in arguments, "peel" in arguments, "unborn" in arguments)
        out = []
        for r in tables.matching_refs(tables.resolved_heads(refs), prefixes).orderBy("name").collect():
            if r["oid"] or unborn and symrefs:
                out.append(wire.ref_line(r["name"], r["oid"], r["symref_target"] if symrefs else None))
        out += [wire.ref_line(r["name"], r["oid"], None, r["peeled_oid"] if peel else None) for r in tables.list_refs(tables.matching_refs(refs, prefixes)).collect()]
        return b"".join(out) + wire.FLUSH
