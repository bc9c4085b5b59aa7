"""The test tables as stores: documents as repositories, and the sales schema as a graph.

Documents: a repository a source, a blob a text, trees lang/bucket/name, one commit on refs/heads/main and one annotated
tag. A leaf tree holds the documents of one thousand ids, so no tree's content grows with the corpus. Null texts are
empty, null sources and languages empty names.

Sales: regions, nations, customers, orders and parts are nodes, with edge kinds 1, 2, 3 and 5 between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from objgrove import schema as S
from objgrove.functions.objects import object_id
from objgrove.lineage import cut, dealt

WHO = "Grove <grove@example.org> 1700000000 +0000"
CREATED = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a source; the window is over sources."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("name")).distinct()
    none = F.lit(None).cast("timestamp")
    return d.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("id"), "name", none.alias("last_pushed_at"), none.alias("last_gc_at"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, lang, dir, name, oid, content), a row a document."""
    d = table(spark, sf_dir, "documents").select(
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.lpad(F.floor(F.col("doc_id") / 1000).cast("string"), 5, "0").alias("dir"),
        F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"),
    )
    r = repos(spark, sf_dir).select(F.col("id").alias("repo_id"), F.col("name").alias("source"))
    # a row a source, so that texts stay where they are read
    return d.join(F.broadcast(r), "source").select("repo_id", "lang", "dir", "name", object_id(F.lit("blob"), "content").alias("oid"), "content")


def _trees(entries: DataFrame, keys: list[str], mode: str, name: str) -> DataFrame:
    """Tree contents of (keys, name, oid) entries."""
    entry = lambda e: F.concat(F.hex(F.concat(F.lit(f"{mode} "), e[name]).cast("binary")), F.lit("00"), e["oid"])
    rows = entries.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(name, "oid"))).alias("e"))
    rows = rows.select(*keys, F.unhex(F.array_join(F.transform("e", entry), "")).alias("content"))
    return rows.withColumn("oid", object_id(F.lit("tree"), "content"))


def levels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    b = blobs(spark, sf_dir)
    # all higher levels and their unions read the leaves, so texts are hashed for them once
    leaf = cut(_trees(b.select("repo_id", "lang", "dir", "name", "oid"), ["repo_id", "lang", "dir"], "100644", "name"))
    lang = _trees(leaf, ["repo_id", "lang"], S.SUBTREE_MODE, "dir")
    root = _trees(lang, ["repo_id"], S.SUBTREE_MODE, "lang")
    r = repos(spark, sf_dir).select(F.col("id").alias("repo_id"), F.col("name").alias("source"))
    text = F.concat(F.lit("tree "), "oid", F.lit(f"\nauthor {WHO}\ncommitter {WHO}\n\nsource "), "source", F.lit("\n"))
    commit = root.join(r, "repo_id").select("repo_id", text.cast("binary").alias("content")).withColumn("oid", object_id(F.lit("commit"), "content"))
    commit = cut(commit)
    text = F.concat(F.lit("object "), "oid", F.lit(f"\ntype commit\ntag v1\ntagger {WHO}\n\nv1\n"))
    tag = commit.select("repo_id", text.cast("binary").alias("content")).withColumn("oid", object_id(F.lit("tag"), "content"))
    return {"blob": b, "leaf": leaf, "lang": lang, "root": root, "commit": commit, "tag": tag}


def objects(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    parts = levels(spark, sf_dir)
    out = None
    for name, code in (("blob", S.BLOB), ("leaf", S.TREE), ("lang", S.TREE), ("root", S.TREE), ("commit", S.COMMIT), ("tag", S.TAG)):
        if code == S.BLOB and not texts:
            continue
        p = parts[name].select("repo_id", "oid", F.lit(code).cast("short").alias("type"), F.octet_length("content").alias("size"), "content", F.lit(CREATED).cast("timestamp").alias("created_at"))
        p = p.dropDuplicates(["repo_id", "oid"])
        out = p if out is None else out.unionByName(p)
    return out


def without_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees, commits and tags."""
    return objects(spark, sf_dir, texts=False)  # a filter would come after the deduplication, which shuffles texts


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, none = levels(spark, sf_dir), F.lit(None).cast("string")
    commit, tag = (parts[k].select("repo_id", "oid") for k in ("commit", "tag"))
    main = commit.select("repo_id", F.lit("refs/heads/main").alias("name"), "oid", none.alias("peeled_oid"), none.alias("symref_target"))
    tags = tag.join(commit.withColumnsRenamed({"oid": "peeled_oid"}), "repo_id").select("repo_id", F.lit("refs/tags/v1").alias("name"), "oid", "peeled_oid", none.alias("symref_target"))
    head = commit.select("repo_id", F.lit("HEAD").alias("name"), none.alias("oid"), none.alias("peeled_oid"), F.lit("refs/heads/main").alias("symref_target"))
    return main.unionByName(tags).unionByName(head)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blobs(spark, sf_dir)
    return b.select("repo_id", F.lit("refs/heads/main").alias("ref_name"), F.concat_ws("/", "lang", "dir", "name").alias("path"), F.lit("100644").alias("mode"), F.col("oid").alias("blob_oid"))


def node(kind: str, key) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def sales_edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """(repo_id, parent, child, kind); an order that names a part twice has one edge, or two where a walk does not mind."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey")
    if once:
        lines = dealt(lines, lines.count(), *lines.columns).distinct()
    edge = lambda df, p, c, k: df.select(F.lit(1).cast("long").alias("repo_id"), p.alias("parent"), c.alias("child"), F.lit(k).cast("short").alias("kind"))
    return (
        edge(t("nation"), node("region", "n_regionkey"), node("nation", "n_nationkey"), 1)
        .unionByName(edge(t("customer"), node("nation", "c_nationkey"), node("cust", "c_custkey"), 2))
        .unionByName(edge(t("orders"), node("cust", "o_custkey"), node("order", "o_orderkey"), 3))
        .unionByName(edge(lines, node("order", "l_orderkey"), node("part", "l_partkey"), 5))
    )


def sales_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, oid, created_at): every node but parts whose key is a multiple of seven, which are missing."""
    t = lambda n: table(spark, sf_dir, n)
    old = F.lit("1990-01-01 00:00:00").cast("timestamp")
    row = lambda df, oid, at: df.select(F.lit(1).cast("long").alias("repo_id"), oid.alias("oid"), at.cast("timestamp").alias("created_at"))
    return (
        row(t("region"), node("region", "r_regionkey"), old).unionByName(row(t("nation"), node("nation", "n_nationkey"), old)).unionByName(row(t("customer"), node("cust", "c_custkey"), old))
        .unionByName(row(t("orders"), node("order", "o_orderkey"), F.col("o_orderdate"))).unionByName(row(t("part").where("p_partkey % 7 <> 0"), node("part", "p_partkey"), old))
    )


#: The same in SQL, as common table expressions.
SQL = f"""
d AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, doc_id, coalesce(text, '') AS text FROM documents),
repos AS (SELECT row_number() OVER (ORDER BY source) AS id, source AS name FROM (SELECT DISTINCT source FROM d)),
blob AS (SELECT id AS repo_id, lang, lpad((doc_id // 1000)::VARCHAR, 5, '0') AS dir, lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS name, text,
                hex(text) AS body, sha1(unhex(hex('blob ' || strlen(text)) || '00' || hex(text))) AS oid FROM d JOIN repos ON d.source = repos.name),
leaf0 AS (SELECT repo_id, lang, dir, string_agg(hex('100644 ' || name) || '00' || upper(oid), '' ORDER BY name, oid) AS body FROM blob GROUP BY ALL),
leaf AS (SELECT *, sha1(unhex(hex('tree ' || (length(body) // 2)) || '00' || body)) AS oid FROM leaf0),
lang0 AS (SELECT repo_id, lang, string_agg(hex('40000 ' || dir) || '00' || upper(oid), '' ORDER BY dir) AS body FROM leaf GROUP BY ALL),
langs AS (SELECT *, sha1(unhex(hex('tree ' || (length(body) // 2)) || '00' || body)) AS oid FROM lang0),
root0 AS (SELECT repo_id, string_agg(hex('40000 ' || lang) || '00' || upper(oid), '' ORDER BY lang) AS body FROM langs GROUP BY ALL),
root AS (SELECT *, sha1(unhex(hex('tree ' || (length(body) // 2)) || '00' || body)) AS oid FROM root0),
commit0 AS (SELECT repo_id, oid AS tree, hex('tree ' || oid || chr(10) || 'author {WHO}' || chr(10) || 'committer {WHO}' || chr(10) || chr(10) || 'source ' || name || chr(10)) AS body FROM root JOIN repos ON repo_id = id),
commits AS (SELECT *, sha1(unhex(hex('commit ' || (length(body) // 2)) || '00' || body)) AS oid FROM commit0),
tag0 AS (SELECT repo_id, oid AS target, hex('object ' || oid || chr(10) || 'type commit' || chr(10) || 'tag v1' || chr(10) || 'tagger {WHO}' || chr(10) || chr(10) || 'v1' || chr(10)) AS body FROM commits),
tags AS (SELECT *, sha1(unhex(hex('tag ' || (length(body) // 2)) || '00' || body)) AS oid FROM tag0),
git_object AS (SELECT DISTINCT repo_id, oid, 3 AS type, length(body) // 2 AS size FROM blob
  UNION ALL SELECT DISTINCT repo_id, oid, 2, length(body) // 2 FROM (SELECT repo_id, oid, body FROM leaf UNION SELECT repo_id, oid, body FROM langs UNION SELECT repo_id, oid, body FROM root)
  UNION ALL SELECT repo_id, oid, 1, length(body) // 2 FROM commits UNION ALL SELECT repo_id, oid, 4, length(body) // 2 FROM tags),
git_edge AS (SELECT repo_id, oid AS parent, tree AS child, 1 AS kind FROM commits
  UNION SELECT r.repo_id, r.oid, l.oid, 3 FROM root r JOIN langs l USING (repo_id)
  UNION SELECT l.repo_id, l.oid, f.oid, 3 FROM langs l JOIN leaf f USING (repo_id, lang)
  UNION SELECT repo_id, oid, target, 5 FROM tags),
git_ref AS (SELECT repo_id, 'refs/heads/main' AS name, oid, NULL::VARCHAR AS peeled_oid, NULL::VARCHAR AS symref_target FROM commits
  UNION ALL SELECT repo_id, 'refs/tags/v1', oid, target, NULL FROM tags UNION ALL SELECT repo_id, 'HEAD', NULL, NULL, 'refs/heads/main' FROM commits),
repo_file AS (SELECT repo_id, 'refs/heads/main' AS ref_name, lang || '/' || dir || '/' || name AS path, '100644' AS mode, oid AS blob_oid FROM blob)
"""

SALES_SQL = """
edge AS (SELECT 'region:' || n_regionkey AS parent, 'nation:' || n_nationkey AS child, 1 AS kind FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'cust:' || c_custkey, 2 FROM customer
  UNION ALL SELECT 'cust:' || o_custkey, 'order:' || o_orderkey, 3 FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 5 FROM lineitem),
obj AS (SELECT 'region:' || r_regionkey AS oid, TIMESTAMP '1990-01-01' AS created_at FROM region UNION ALL SELECT 'nation:' || n_nationkey, TIMESTAMP '1990-01-01' FROM nation
  UNION ALL SELECT 'cust:' || c_custkey, TIMESTAMP '1990-01-01' FROM customer UNION ALL SELECT 'order:' || o_orderkey, o_orderdate FROM orders
  UNION ALL SELECT 'part:' || p_partkey, TIMESTAMP '1990-01-01' FROM part WHERE p_partkey % 7 <> 0)
"""
