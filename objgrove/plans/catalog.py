"""The engine's registered queries, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objgrove import schema as S
from objgrove.functions import objects as O
from objgrove.operators import collect, graph, tables
from objgrove.plans import corpus as C
from objgrove.sources import wire
from objgrove.streaming.drains import activity

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _corpus(select: str) -> str:
    return f"WITH {C.SQL} {select}"


def _walk(name: str, roots: str, kinds: str = "") -> str:
    """A closure of the sales graph from a select of roots."""
    return f"{name} AS (SELECT oid FROM ({roots}) UNION SELECT e.child FROM {name} c JOIN edge e ON e.parent = c.oid {kinds})"


def _sales(walks: list[str], select: str) -> str:
    return f"WITH RECURSIVE {C.SALES_SQL}, {', '.join(walks)} {select}" if walks else f"WITH {C.SALES_SQL} {select}"


def _nodes(spark: SparkSession, names) -> DataFrame:
    return spark.createDataFrame([(1, n) for n in names], "repo_id long, oid string")


def _values(names) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS oid" for n in names)


# ---- ids, decoding, deduplication


@query("SELECT doc_id, sha1(unhex(hex('blob ' || strlen(coalesce(text, ''))) || '00' || hex(coalesce(text, '')))) AS oid FROM documents")
def blob_oid(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents")
    return d.select("doc_id", O.object_id(F.lit("blob"), F.coalesce("text", F.lit("")).cast("binary")).alias("oid"))


@query(_corpus("SELECT type, count(*) AS objects, sum(size)::BIGINT AS bytes FROM git_object GROUP BY type"))
def object_dedupe(spark, sf_dir):
    return C.objects(spark, sf_dir).groupBy(F.col("type").cast("int").alias("type")).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


@query(_corpus("SELECT repo_id, oid, size::INTEGER AS size FROM git_object WHERE type = 2"))
def tree_oid(spark, sf_dir):
    return C.without_blobs(spark, sf_dir).where(F.col("type") == S.TREE).select("repo_id", "oid", "size")


@query(_corpus("SELECT name, commits.oid AS commit_oid, tree, tags.oid AS tag_oid FROM commits JOIN repos ON id = repo_id JOIN tags USING (repo_id)"))
def commit_oid(spark, sf_dir):
    parts = C.levels(spark, sf_dir)
    r = C.repos(spark, sf_dir).select(F.col("id").alias("repo_id"), "name")
    c = parts["commit"].select("repo_id", F.col("oid").alias("commit_oid"), O.commit_tree("content").alias("tree"))
    return c.join(parts["tag"].select("repo_id", F.col("oid").alias("tag_oid")), "repo_id").join(F.broadcast(r), "repo_id").select("name", "commit_oid", "tree", "tag_oid")


@query("SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY ALL")
def upsert_first_wins(spark, sf_dir):
    """Events as rows of keys (user, type): what is stored first stays, and the earliest of a batch comes in."""
    e = C.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("first_ts"))
    early = e.groupBy("user_id").agg(F.min("first_ts").alias("first_ts"))
    stored = e.join(early, ["user_id", "first_ts"], "left_semi").groupBy("user_id", "event_type").agg(F.min("first_ts").alias("first_ts"))
    return tables.upsert_first(stored.select("user_id", "event_type", "first_ts"), e, ["user_id", "event_type"], ["first_ts"])


# ---- the working tree

_TREE = "SELECT repos.name, f.path, f.mode, f.blob_oid, b.size::INTEGER AS size FROM repo_file f JOIN repos ON id = f.repo_id JOIN git_object b ON b.repo_id = f.repo_id AND b.oid = f.blob_oid"


def _working_tree(spark, sf_dir, where: str) -> DataFrame:
    C.files(spark, sf_dir).createOrReplaceTempView("repo_file")
    C.repos(spark, sf_dir).createOrReplaceTempView("repos")
    C.objects(spark, sf_dir).where(F.col("type") == S.BLOB).createOrReplaceTempView("git_object")
    return spark.sql(f"SELECT r.name, f.path, f.mode, f.blob_oid, o.size FROM repo_file f JOIN repos r ON r.id = f.repo_id JOIN git_object o ON o.repo_id = f.repo_id AND o.oid = f.blob_oid WHERE {where}")


@query(_corpus(_TREE + " WHERE repos.name = 'src3' AND f.ref_name = 'refs/heads/main'"))
def working_tree(spark, sf_dir):
    return _working_tree(spark, sf_dir, "r.name = 'src3' AND f.ref_name = 'refs/heads/main' ORDER BY f.path")


@query(_corpus(_TREE + " WHERE f.path = 'en/00000/00000001.txt'"))
def path_exact(spark, sf_dir):
    return _working_tree(spark, sf_dir, "f.path = 'en/00000/00000001.txt'")


@query(_corpus(_TREE + " WHERE f.path LIKE 'fr/0%'"))
def path_prefix(spark, sf_dir):
    return _working_tree(spark, sf_dir, "f.path LIKE 'fr/0%'")


@query(_corpus("SELECT repo_id, path FROM repo_file WHERE path LIKE 'de/00000/%' AND path NOT LIKE 'de/00000/%/%'"))
def path_depth(spark, sf_dir):
    f = C.files(spark, sf_dir)
    return f.where(F.col("path").startswith("de/00000/") & ~F.col("path").like("de/00000/%/%")).select("repo_id", "path")


@query(_corpus("SELECT name, ref_name, count(*) AS files, count(DISTINCT blob_oid) AS blobs FROM repo_file JOIN repos ON id = repo_id GROUP BY ALL"))
def files_per_ref(spark, sf_dir):
    r = C.repos(spark, sf_dir).select(F.col("id").alias("repo_id"), "name")
    return C.files(spark, sf_dir).join(F.broadcast(r), "repo_id").groupBy("name", "ref_name").agg(F.count("*").alias("files"), F.count_distinct("blob_oid").alias("blobs"))


@query(_corpus("SELECT repo_id, ref_name, path, mode, blob_oid FROM repo_file"))
def flatten_tree(spark, sf_dir):
    """The trees' contents parsed and walked from the branches' commits."""
    tips = C.refs(spark, sf_dir).where(F.col("name").startswith(S.BRANCHES)).select("repo_id", F.col("name").alias("ref_name"), "oid")
    return graph.flatten(C.without_blobs(spark, sf_dir), tips).select("repo_id", "ref_name", "path", "mode", "blob_oid")


# ---- edges


@query(_corpus("SELECT repo_id, parent, child, kind FROM git_edge"))
def derive_edges(spark, sf_dir):
    return O.edges(C.without_blobs(spark, sf_dir)).withColumn("kind", F.col("kind").cast("int"))


@query("SELECT count(*) AS raw_rows, count(DISTINCT (l_orderkey, l_partkey)) AS edges FROM lineitem")
def edge_dedupe(spark, sf_dir):
    rows = C.table(spark, sf_dir, "lineitem").select(F.lit(1).cast("long").alias("repo_id"), C.node("order", "l_orderkey").alias("parent"), C.node("part", "l_partkey").alias("child"), F.lit(5).alias("kind"), F.lit(1).alias("one"))
    per = rows.groupBy("repo_id", "parent", "child").agg(F.min("kind").alias("kind"), F.sum("one").alias("n"))
    return per.agg(F.sum("n").alias("raw_rows"), F.count("*").alias("edges"))


@query(_corpus("SELECT DISTINCT f.repo_id, f.oid AS tree, b.oid FROM leaf f JOIN blob b USING (repo_id, lang, dir)"))
def tree_blobs(spark, sf_dir):
    return O.tree_blobs(C.without_blobs(spark, sf_dir)).distinct()


@query(_corpus("SELECT type, CASE WHEN type = 3 THEN 1 ELSE 2 END * count(*) AS objects, CASE WHEN type = 3 THEN 0 ELSE count(*) END::BIGINT AS malformed FROM git_object GROUP BY type"))
def validation(spark, sf_dir):
    """Every object, and of each but blobs a malformed copy: trees cut by a byte, commits and tags without their first header."""
    o = C.objects(spark, sf_dir)
    cut_off = F.when(F.col("type") == S.TREE, F.substring("content", F.lit(1), F.octet_length("content") - 1)).otherwise(F.encode(F.regexp_replace(F.decode("content", "ISO-8859-1"), "^[^\\n]*\\n", ""), "ISO-8859-1"))
    o = o.select("type", "content").unionByName(o.where(F.col("type") != S.BLOB).select("type", cut_off.alias("content")))
    return o.groupBy(F.col("type").cast("int").alias("type")).agg(F.count("*").alias("objects"), F.count(O.validation_code("type", "content")).alias("malformed"))


# ---- closures


@query(_sales([_walk("c", _values(["region:1"]))], "SELECT oid FROM c"))
def closure_full(spark, sf_dir):
    return graph.closure(C.sales_edges(spark, sf_dir), _nodes(spark, ["region:1"])).select("oid")


@query(_sales([_walk("c", _values(["region:2"]), "AND e.kind IN (1, 2)")], "SELECT oid FROM c"))
def closure_kinds(spark, sf_dir):
    return graph.closure(C.sales_edges(spark, sf_dir), _nodes(spark, ["region:2"]), kinds=(1, 2)).select("oid")


_ROOTS = ["cust:1", "cust:2", "cust:4", "cust:5", "cust:7", "cust:8"]


@query(_sales([_walk("c", _values(_ROOTS))], "SELECT c.oid, obj.oid IS NOT NULL AS present FROM c LEFT JOIN obj USING (oid)"))
def closure_missing(spark, sf_dir):
    return graph.reachable(C.sales_objects(spark, sf_dir), C.sales_edges(spark, sf_dir), _nodes(spark, _ROOTS)).select("oid", "present")


@query("WITH RECURSIVE " + C.SALES_SQL + """, c AS (SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS oid FROM region UNION SELECT c.root, e.child FROM c JOIN edge e ON e.parent = c.oid)
SELECT root, count(*) AS nodes FROM c GROUP BY root""")  # fmt: skip
def closure_multi_root(spark, sf_dir):
    roots = C.table(spark, sf_dir, "region").select(F.lit(1).cast("long").alias("repo_id"), C.node("region", "r_regionkey").alias("oid"), C.node("region", "r_regionkey").alias("root"))
    return graph.closure(C.sales_edges(spark, sf_dir), roots).groupBy("root").agg(F.count("*").alias("nodes"))


_COMPLETE = "nation:3 nation:4".split()
_HAVES = ["cust:1", "cust:10", "cust:100", "nation:4"]


@query(_sales([_walk("w", _values(_COMPLETE), "AND e.kind <> 5"), _walk("h", _values(_HAVES), "AND e.kind <> 5")], "SELECT oid FROM w WHERE oid NOT IN (SELECT oid FROM h JOIN obj USING (oid))"))
def served_want_minus_have(spark, sf_dir):
    e = C.sales_edges(spark, sf_dir).where("kind <> 5")
    o, none = C.sales_objects(spark, sf_dir), C.sales_edges(spark, sf_dir).limit(0).select("repo_id", F.col("parent").alias("tree"), F.col("child").alias("oid"))
    return graph.served(o, e, _nodes(spark, _COMPLETE), _nodes(spark, _HAVES), blobs=none).select("oid")


@query(_sales([_walk("w", _values(_COMPLETE), "AND e.kind <> 5"), _walk("h", _values(_HAVES), "AND e.kind <> 5")], f"SELECT oid FROM w WHERE oid NOT IN (SELECT oid FROM h JOIN obj USING (oid)) UNION {_values(_COMPLETE)}"))
def served_blobless_readd(spark, sf_dir):
    """Without blobs, wanted objects are sent even where haves reach them."""
    e = C.sales_edges(spark, sf_dir).where("kind <> 5")
    return graph.served(C.sales_objects(spark, sf_dir), e, _nodes(spark, _COMPLETE), _nodes(spark, _HAVES)).select("oid")


@query(_corpus("SELECT repo_id, oid FROM (SELECT repo_id, oid FROM commits UNION SELECT repo_id, oid FROM root UNION SELECT repo_id, oid FROM langs UNION SELECT repo_id, oid FROM leaf UNION SELECT repo_id, oid FROM tags)"))
def served_include_tag(spark, sf_dir):
    """Fetching every branch without blobs, with the tags of what is sent."""
    o, refs = C.without_blobs(spark, sf_dir), C.refs(spark, sf_dir)
    wants = refs.where("name = 'refs/heads/main'").select("repo_id", "oid")
    return graph.served(o, O.edges(o), wants, wants.limit(0), refs=refs).select("repo_id", "oid")


_ASKED = ["cust:3", "part:7", "order:1", "cust:3", "part:8", "nation:77"]


@query(_sales([], f"SELECT pos, v.oid FROM (VALUES {', '.join(f'({i}, {chr(39)}{n}{chr(39)})' for i, n in enumerate(_ASKED))}) v(pos, oid) JOIN obj ON obj.oid = v.oid"))
def common_haves(spark, sf_dir):
    haves = spark.createDataFrame([(1, i, n) for i, n in enumerate(_ASKED)], "repo_id long, pos int, oid string")
    return graph.common_haves(C.sales_objects(spark, sf_dir), haves).select("pos", "oid")


@query(_sales([], "SELECT want, bool_or(w.met) AS met FROM (SELECT 'nation:' || n_nationkey AS want, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 50 = 0) AS met FROM nation) w GROUP BY want"))
def ready_to_give_up(spark, sf_dir):
    """Nations as wants, each its own repository; customers of every fiftieth key are common."""
    e = C.sales_edges(spark, sf_dir).where("kind = 2").select(F.col("parent").alias("want"), "parent", "child", F.lit(2).cast("short").alias("kind"))
    ids = F.xxhash64("want").alias("repo_id")
    wants = C.table(spark, sf_dir, "nation").select(C.node("nation", "n_nationkey").alias("want")).select(ids, F.col("want").alias("oid"))
    c = C.table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(C.node("nation", "c_nationkey").alias("want"), C.node("cust", "c_custkey").alias("oid")).select(ids, "oid")
    r = graph.ready(e.select(ids, "parent", "child", "kind"), wants, c)
    return r.join(wants, "repo_id").select(F.col("oid").alias("want"), F.col("ready").alias("met"))


@query("WITH RECURSIVE " + C.SALES_SQL + """, c AS (SELECT 'cust:' || c_custkey AS tip, 'cust:' || c_custkey AS oid FROM customer UNION SELECT c.tip, e.child FROM c JOIN edge e ON e.parent = c.oid)
SELECT tip, bool_and(obj.oid IS NOT NULL) AS connected, count(*) FILTER (WHERE obj.oid IS NULL) AS missing FROM c LEFT JOIN obj USING (oid) GROUP BY tip""")  # fmt: skip
def connectivity(spark, sf_dir):
    tips = C.table(spark, sf_dir, "customer").select(F.lit(1).cast("long").alias("repo_id"), C.node("cust", "c_custkey").alias("oid"))
    return graph.connected(C.sales_objects(spark, sf_dir), C.sales_edges(spark, sf_dir, once=False), tips).select("tip", "connected", "missing")


@query("SELECT conv_id || ':' || turn AS tag, conv_id || ':0' AS peeled FROM (SELECT DISTINCT conv_id, turn FROM conversations) WHERE turn > 0")
def tag_peel(spark, sf_dir):
    """Turns as tags of the turn before, peeled down to the first."""
    t = C.table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().where("turn > 0")
    name = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("string"))
    e = t.select(F.col("conv_id").alias("repo_id"), name(F.col("turn")).alias("parent"), name(F.col("turn") - 1).alias("child"), F.lit(S.TAG_TARGET).cast("short").alias("kind"))
    return graph.peel(e).select("tag", "peeled")


# ---- references


@query(_corpus("SELECT repo_id, name, oid, peeled_oid FROM git_ref WHERE oid IS NOT NULL"))
def list_refs(spark, sf_dir):
    return tables.list_refs(C.refs(spark, sf_dir)).select("repo_id", "name", "oid", "peeled_oid")


@query(_corpus("SELECT h.repo_id, h.name, h.symref_target, r.oid FROM git_ref h LEFT JOIN git_ref r ON r.repo_id = h.repo_id AND r.name = h.symref_target WHERE h.symref_target IS NOT NULL"))
def ls_refs_head(spark, sf_dir):
    return tables.resolved_heads(C.refs(spark, sf_dir))


@query(_corpus("SELECT repo_id, name FROM git_ref WHERE starts_with(name, 'refs/tags/') OR starts_with(name, 'HE')"))
def ref_prefix(spark, sf_dir):
    return tables.matching_refs(C.refs(spark, sf_dir), ["refs/tags/", "HE"]).select("repo_id", "name")


def _batch(spark, sf_dir):
    """Orders as refs: every second key exists; status F updates (every third of them stale), O creates, P deletes (stale like
    updates, but every seventh unconditionally), and every fifth key has a second command that updates from the first one's
    new id."""
    o = C.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 10 + 1).alias("repo_id"), F.concat(F.lit("refs/heads/o"), "o_orderkey").alias("ref"))
    h = lambda x: F.sha1(F.concat(F.lit(x), F.col("o_orderkey").cast("string")).cast("binary"))
    none = F.lit(None).cast("string")
    refs = o.where("o_orderkey % 2 = 0").select("repo_id", F.col("ref").alias("name"), h("a").alias("oid"), none.alias("peeled_oid"), none.alias("symref_target"))
    old = F.when((F.col("o_orderstatus") == "O") | (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 7 == 0), S.ZERO).when(F.col("o_orderkey") % 3 == 0, h("x")).otherwise(h("a"))
    first = o.select("repo_id", (F.col("o_orderkey") * 2).alias("seq"), "ref", old.alias("old_oid"), F.when(F.col("o_orderstatus") == "P", S.ZERO).otherwise(h("b")).alias("new_oid"))
    second = o.where("o_orderkey % 5 = 0").select("repo_id", (F.col("o_orderkey") * 2 + 1).alias("seq"), "ref", h("b").alias("old_oid"), h("c").alias("new_oid"))
    return refs, first.unionByName(second)


_CAS = """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_custkey % 10 + 1 AS repo_id, 'refs/heads/o' || o_orderkey AS ref, o_orderkey % 2 = 0 AS have FROM orders),
s1 AS (SELECT *, CASE WHEN st = 'P' AND k % 7 = 0 THEN TRUE WHEN st = 'O' THEN NOT have ELSE have AND k % 3 <> 0 END AS ok1 FROM o),
s2 AS (SELECT *, CASE WHEN st = 'P' AND ok1 THEN NULL WHEN ok1 THEN 'b' WHEN have THEN 'a' END AS v1, ok1 AND (st <> 'P' OR have) AS m1 FROM s1),
s3 AS (SELECT *, k % 5 = 0 AS two, k % 5 = 0 AND coalesce(v1 = 'b', FALSE) AS ok2 FROM s2),
r AS (SELECT repo_id, k * 2 AS seq, ref, CASE st WHEN 'P' THEN 'delete' WHEN 'O' THEN 'create' ELSE 'update' END AS op, ok1 AS ok, m1 AS mutated FROM s3
      UNION ALL SELECT repo_id, k * 2 + 1, ref, 'update', ok2, ok2 FROM s3 WHERE two)
"""


@query(_CAS + "SELECT repo_id, seq, ref, op, ok, mutated FROM r")
def cas_nonatomic(spark, sf_dir):
    refs, commands = _batch(spark, sf_dir)
    return tables.apply_commands(refs, commands)[1].select("repo_id", "seq", "ref", "op", "ok", "mutated")


@query(_CAS + ", a AS (SELECT repo_id, bool_and(ok) AS all_ok FROM r GROUP BY repo_id) SELECT repo_id, seq, all_ok AS ok, all_ok AND mutated AS mutated FROM r JOIN a USING (repo_id)")
def cas_atomic(spark, sf_dir):
    refs, commands = _batch(spark, sf_dir)
    return tables.apply_commands(refs, commands, atomic=True)[1].select("repo_id", "seq", "ok", "mutated")


@query(_CAS + """SELECT repo_id, ref AS name, sha1(coalesce(CASE WHEN ok2 THEN 'c' END, v1) || k) AS oid, NULL::VARCHAR AS symref_target FROM s3 WHERE v1 IS NOT NULL
UNION ALL SELECT DISTINCT repo_id, 'HEAD', NULL, 'refs/heads/main' FROM o""")  # fmt: skip
def ref_table_after_batch(spark, sf_dir):
    refs, commands = _batch(spark, sf_dir)
    return tables.apply_commands(refs, commands)[0].select("repo_id", "name", "oid", "symref_target")


@query(_CAS + "SELECT repo_id, seq, mutated FROM r WHERE op = 'delete'")
def cas_delete_noop(spark, sf_dir):
    refs, commands = _batch(spark, sf_dir)
    return tables.apply_commands(refs, commands)[1].where("op = 'delete'").select("repo_id", "seq", "mutated")


@query(_CAS + "SELECT repo_id, bool_or(mutated) AS pushed FROM r GROUP BY repo_id")
def ref_mutated(spark, sf_dir):
    refs, commands = _batch(spark, sf_dir)
    return tables.apply_commands(refs, commands)[1].groupBy("repo_id").agg(F.bool_or("mutated").alias("pushed"))


# ---- snapshots


@query(_corpus("SELECT repo_id, ref_name, path, CASE WHEN repo_id % 2 = 0 THEN '100755' ELSE mode END AS mode, blob_oid FROM repo_file"))
def projection_replace(spark, sf_dir):
    f = C.files(spark, sf_dir)
    even = f.where("repo_id % 2 = 0")
    return tables.replace_snapshots(f, even.select("repo_id", "ref_name"), even.withColumn("mode", F.lit("100755")))


@query(_corpus("SELECT repo_id, ref_name, path, mode, blob_oid FROM repo_file WHERE repo_id % 3 <> 0"))
def projection_drop(spark, sf_dir):
    f = C.files(spark, sf_dir)
    return tables.drop_snapshots(f, C.repos(spark, sf_dir).where("id % 3 = 0").select(F.col("id").alias("repo_id")))


# ---- garbage collection

_NOW, _GRACE = "1997-01-01 00:00:00", 86_400 * 365
_REFS = [f"nation:{i}" for i in range(0, 25, 2)]
_GC = [_walk("live", _values(_REFS))]
_DEAD = f"dead AS (SELECT oid FROM obj WHERE created_at < TIMESTAMP '{_NOW}' - INTERVAL {_GRACE} SECOND AND oid NOT IN (SELECT oid FROM live))"


def _collection(spark, sf_dir):
    o, e, steps = C.sales_objects(spark, sf_dir), C.sales_edges(spark, sf_dir), C.sales_edges(spark, sf_dir, once=False)
    refs = _nodes(spark, _REFS).select("repo_id", F.col("oid").alias("name"), "oid", F.lit(None).cast("string").alias("peeled_oid"), F.lit(None).cast("string").alias("symref_target"))
    none = e.limit(0).select("repo_id", F.col("parent").alias("tree"), F.col("child").alias("oid"))
    return o, e, collect.live_set(o, steps, refs, none), F.lit(_NOW).cast("timestamp")


@query(_sales(_GC, "SELECT oid FROM live JOIN obj USING (oid)"))
def gc_live_set(spark, sf_dir):
    return _collection(spark, sf_dir)[2].select("oid")


@query(_sales(_GC + [_DEAD], "SELECT oid FROM dead"))
def gc_victims(spark, sf_dir):
    o, _, live, now = _collection(spark, sf_dir)
    return collect.victims(o, live, now, _GRACE).select("oid")


@query(_sales(_GC + [_DEAD], "SELECT oid FROM obj WHERE oid NOT IN (SELECT oid FROM dead)"))
def gc_survivors(spark, sf_dir):
    o, e, live, now = _collection(spark, sf_dir)
    return collect.sweep(o, e, collect.victims(o, live, now, _GRACE))[0].select("oid")


@query(_sales(_GC + [_DEAD], "SELECT parent, child, kind FROM edge WHERE parent IN (SELECT oid FROM obj) AND parent NOT IN (SELECT oid FROM dead)"))
def gc_edge_orphans(spark, sf_dir):
    """The edges that stay; those of parents that are gone do not."""
    o, e, live, now = _collection(spark, sf_dir)
    return collect.sweep(o, e, collect.victims(o, live, now, _GRACE))[1].select("parent", "child", F.col("kind").cast("int").alias("kind"))


@query(_sales(_GC, "SELECT g AS grace, count(obj.oid) AS victims FROM (VALUES (0), (86400), (31536000), (2000000000)) t(g) LEFT JOIN obj ON created_at < (SELECT max(o_orderdate) FROM orders) - to_seconds(g) AND oid NOT IN (SELECT oid FROM live) GROUP BY g"))
def gc_grace_boundary(spark, sf_dir):
    """The newest order's time is now, so it is not older than a window of 0 seconds."""
    o, _, live, _ = _collection(spark, sf_dir)
    top = F.lit(C.table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0]).cast("timestamp")
    graces = (0, 86_400, 31_536_000, 2_000_000_000)
    # the shortest window's victims are all windows', so objects meet the live set once
    n = collect.victims(o, live, top, min(graces)).agg(*[F.count_if(collect.expired(top, g)).alias(f"g{g}") for g in graces])
    return n.select(F.inline(F.array(*[F.struct(F.lit(g).alias("grace"), F.col(f"g{g}").alias("victims")) for g in graces])))


_ACTIVITY = "WITH a AS (SELECT user_id AS repo_id, max(ts) FILTER (WHERE event_type = 'purchase') AS last_pushed_at, max(ts) FILTER (WHERE event_type = 'view') AS last_gc_at FROM events GROUP BY user_id), due AS (SELECT * FROM a WHERE last_pushed_at IS NOT NULL AND (last_gc_at IS NULL OR last_pushed_at > last_gc_at))"


@query(_ACTIVITY + " SELECT repo_id FROM due")
def drain_eligible(spark, sf_dir):
    return collect.due(activity(C.table(spark, sf_dir, "events"))).select("repo_id")


@query(_ACTIVITY + """, o AS (SELECT user_id AS repo_id, event_id, ts AS created_at, event_type IN ('signup', 'click') AS live FROM events),
dead AS (SELECT repo_id, count(*) AS n FROM o JOIN due USING (repo_id) WHERE NOT live AND created_at < TIMESTAMP '2024-01-20' GROUP BY repo_id),
orphans AS (SELECT repo_id, count(*) AS m FROM o WHERE event_id % 3 = 0 GROUP BY repo_id)
SELECT due.repo_id, coalesce(n, 0)::BIGINT AS deleted_objects, (coalesce(n, 0) + coalesce(m, 0))::BIGINT AS deleted_edges FROM due LEFT JOIN dead USING (repo_id) LEFT JOIN orphans USING (repo_id)""")  # fmt: skip
def drain_summary(spark, sf_dir):
    """Events as objects, of which sign-ups and clicks are referenced; one pass over all users who are due.

    Every event has an edge to its user, and every third one an orphan edge whose parent is gone."""
    e = C.table(spark, sf_dir, "events")
    name, none = F.col("event_id").cast("string"), F.lit(None).cast("string")
    o = e.select(F.col("user_id").alias("repo_id"), name.alias("oid"), F.col("ts").cast("timestamp").alias("created_at"))
    refs = e.where("event_type in ('signup', 'click')").select(F.col("user_id").alias("repo_id"), name.alias("name"), name.alias("oid"), none.alias("peeled_oid"), none.alias("symref_target"))
    child = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    edges = e.select(F.col("user_id").alias("repo_id"), name.alias("parent"), child.alias("child"), F.lit(5).cast("short").alias("kind"))
    edges = edges.unionByName(e.where("event_id % 3 = 0").select(F.col("user_id").alias("repo_id"), F.concat(F.lit("gone:"), name).alias("parent"), child.alias("child"), F.lit(5).cast("short").alias("kind")))
    repos = activity(e).select(F.col("repo_id").alias("id"), F.col("repo_id").cast("string").alias("name"), F.col("last_pushed_at").cast("timestamp").alias("last_pushed_at"), F.col("last_gc_at").cast("timestamp").alias("last_gc_at"))
    state = {"repos": repos, "git_object": o, "git_edge": edges, "git_ref": refs}
    blobs = spark.createDataFrame([], "repo_id long, tree string, oid string")
    return collect.drain(state, blobs, F.lit("2024-01-20 00:00:00").cast("timestamp"), 0)[1].select("repo_id", "deleted_objects", "deleted_edges")


# ---- values and folds


@query("SELECT doc_id, part::INTEGER AS part, md5(unhex(substr(hex(coalesce(text, '')), part * 2000 + 1, 2000))) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (strlen(coalesce(text, '')) + 999) // 1000)::BIGINT)) AS part FROM documents)")
def chunked_read(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("repo_id"), F.lit("").alias("oid"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return tables.content_chunks(d, 1000).select(F.col("repo_id").alias("doc_id"), "part", F.md5("bytes").alias("digest"))


@query("SELECT doc_id, CASE WHEN strlen(text) < 2000 THEN md5(text) END AS digest FROM documents")
def size_guard(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return tables.guarded(d, 2000).select("doc_id", F.md5("content").alias("digest"))


@query("""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, coalesce(role, '') || chr(10) || coalesce(text, '') AS body FROM conversations),
c AS (SELECT conv_id, n, sha1('parent ' || repeat('0', 40) || chr(10) || body) AS oid FROM t WHERE n = 1 UNION ALL SELECT t.conv_id, t.n, sha1('parent ' || c.oid || chr(10) || t.body) FROM c JOIN t ON t.conv_id = c.conv_id AND t.n = c.n + 1)
SELECT conv_id, max_by(oid, n) AS head, max(n) AS length FROM c GROUP BY conv_id""")  # fmt: skip
def chain_hash(spark, sf_dir):
    """Each turn hashes its parent's hash and itself, as commits do; a conversation's turns are one array."""
    t = C.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    step = lambda a, x: F.sha1(F.concat(F.lit("parent "), a, F.lit("\n"), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit(""))).cast("binary"))
    return t.select("conv_id", F.aggregate("t", F.lit(S.ZERO), step).alias("head"), F.size("t").cast("long").alias("length"))


@query("SELECT event_type AS phase, count(*) AS calls, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, max(value) AS top FROM events WHERE value IS NOT NULL GROUP BY event_type")
def phase_percentiles(spark, sf_dir):
    e = C.table(spark, sf_dir, "events").where("value is not null")
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")
    return e.groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("calls"), p(0.5).alias("p50"), p(0.99).alias("p99"), F.max("value").alias("top"))


@query("SELECT page_id, lower(hex(format('{:04x}', strlen(coalesce(url, '')) + 4) || coalesce(url, ''))) AS packet FROM pages")
def packet_lines(spark, sf_dir):
    p = C.table(spark, sf_dir, "pages")
    return p.select("page_id", O.to_hex(wire.line_column(F.coalesce("url", F.lit("")).cast("binary"))).alias("packet"))


@query(_corpus("SELECT CASE type WHEN 1 THEN 'commit' WHEN 2 THEN 'tree' WHEN 3 THEN 'blob' ELSE 'tag' END AS kind, count(*) AS objects FROM git_object GROUP BY ALL"))
def type_names(spark, sf_dir):
    return C.objects(spark, sf_dir).groupBy(O.type_name("type").alias("kind")).agg(F.count("*").alias("objects"))


@query(_corpus("SELECT repo_id, 'commit' AS type, 1::BIGINT AS objects FROM commits UNION ALL SELECT repo_id, 'tree', count(DISTINCT oid) FROM (SELECT repo_id, oid FROM leaf UNION SELECT repo_id, oid FROM langs UNION SELECT repo_id, oid FROM root) GROUP BY repo_id UNION ALL SELECT repo_id, 'tag', 1 FROM tags"))
def pack_round_trip(spark, sf_dir):
    """All objects of every repository written as packs and read again; the SQL counts trees, commits and tags (and errors)."""
    from objgrove.sources import packs

    back = packs.parsed(packs.packed_in_parts(C.objects(spark, sf_dir)))
    return back.where(~F.col("type").eqNullSafe(S.BLOB)).groupBy("repo_id", O.type_name("type").alias("type")).agg(F.count_distinct("oid").alias("objects"))


@query(_sales([_walk("c", _values(["region:1"]))], "SELECT oid FROM c"))
def closure_frontier(spark, sf_dir):
    """The walk that large repositories take, a join a level, whatever this one's size."""
    return graph.closure(C.sales_edges(spark, sf_dir), _nodes(spark, ["region:1"]), strategy="frontier").select("oid")


@query("SELECT doc_id, greatest(0, ceil(strlen(coalesce(text, '')) / 65514.0))::BIGINT AS packets, md5(coalesce(text, '')) AS digest FROM documents")
def side_band_round_trip(spark, sf_dir):
    """Every text in side-band packets, decoded again and joined."""
    d = C.table(spark, sf_dir, "documents")
    d = d.select("doc_id", wire.packets_column(wire.band_column(F.coalesce("text", F.lit("")).cast("binary"), 1)).alias("p"))
    parts = F.transform("p.packets", lambda x: F.hex(F.substring(x["payload"], F.lit(2), F.octet_length(x["payload"]) - 1)))
    return d.select("doc_id", F.size("p.packets").cast("long").alias("packets"), F.md5(F.unhex(F.array_join(parts, ""))).alias("digest"))


@query("SELECT doc_id, md5(coalesce(text, '') || '!' || coalesce(text, '')) AS digest FROM documents")
def delta_apply(spark, sf_dir):
    """A delta that copies its base twice, with a byte between; copies are of 65,535 bytes at most."""
    from objgrove.functions.register import register

    register(spark)
    d = C.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("base")).withColumn("n", F.octet_length("base"))
    low = lambda x, at: F.lpad(F.hex(F.shiftright(x, at).bitwiseAND(255)), 2, "0")
    # a size, seven bits at a time, in five bytes; a copy with three bytes of its start and two of its length
    size = lambda x: F.concat(*[F.lpad(F.hex(F.shiftright(x, 7 * i).bitwiseAND(127).bitwiseOR(128 if i < 4 else 0)), 2, "0") for i in range(5)])
    step = 65_535
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    one = lambda a: F.concat(F.lit("B7"), low(a, 0), low(a, 8), low(a, 16), low(F.least(F.lit(step), F.col("n") - a), 0), low(F.least(F.lit(step), F.col("n") - a), 8))
    copies = F.array_join(F.transform(starts, one), "")
    delta = F.unhex(F.concat(size(F.col("n")), size(2 * F.col("n") + 1), copies, F.lit("0121"), copies))
    return d.select("doc_id", F.md5(F.call_function("apply_delta", "base", delta)).alias("digest"))


@query("SELECT row_number() OVER (ORDER BY name) + 2 AS id, name FROM (SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL AND source NOT IN ('known', 'other')) UNION ALL VALUES (1, 'known'), (2, 'other')")
def ensure_repo_ids(spark, sf_dir):
    """Every source as a repository beside two that are there; new ids follow the largest one."""
    known = spark.createDataFrame([(1, "known", None, None), (2, "other", None, None)], S.REPOS)
    names = C.table(spark, sf_dir, "documents").select(F.col("source").alias("name")).unionByName(known.select("name"))
    return tables.ensure_repos(known, names).select("id", "name")


_BODIES = [
    ("listing", True, lambda: wire.line("command=ls-refs\n") + wire.DELIM + wire.line("peel\n") + wire.FLUSH),
    ("capability first", True, lambda: wire.line("agent=x") + wire.line("command=ls-refs") + wire.FLUSH),
    ("sha256 first", False, lambda: wire.line("object-format=sha256") + wire.line("command=ls-refs") + wire.FLUSH),
    ("sha256 last", False, lambda: wire.line("command=ls-refs") + wire.line("object-format=sha256") + wire.FLUSH),
    ("no command", False, lambda: wire.line("agent=x") + wire.FLUSH),
    ("ends inside a packet", False, lambda: wire.line("command=ls-refs") + wire.FLUSH + b"00"),
    ("ends inside a payload", False, lambda: wire.line("command=ls-refs") + b"0010peel"),
    ("length is not a number", False, lambda: b"zzzz"),
    ("length of three", False, lambda: b"0003"),
]


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, {ok} AS accepted" for name, ok, _ in _BODIES))
def request_guards(spark, sf_dir):
    """Well-formed and malformed requests, and which the parser takes."""
    from pyspark.sql.types import BooleanType

    def taken(body) -> bool:
        try:
            wire.parse_request(bytes(body))
        except S.ProtocolError:
            return False
        return True

    rows = spark.createDataFrame([(name, bytearray(body())) for name, _, body in _BODIES], "name string, body binary")
    return rows.select("name", F.udf(taken, BooleanType())("body").alias("accepted"))
