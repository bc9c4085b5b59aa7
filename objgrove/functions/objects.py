"""Object ids, header parsing, tree parsing and validation, as column expressions.

Headers and trees are parsed as ISO-8859-1 text, which maps bytes to characters one to one, so regular expressions
work on binary content inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objgrove import schema as S

HEX = "^[0-9a-f]{40}$"
_ENTRY = r"(?s)\G([^ \x00]+) ([^\x00]+)\x00(.{20})"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def object_id(type_name, content) -> Column:
    """The lowercase hex SHA-1 of "<type> <length> NUL" and the content."""
    content = _col(content)
    head = F.concat(_col(type_name), F.lit(" "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.lit(bytearray(1)), content))


def type_name(code) -> Column:
    return F.create_map(*[F.lit(x) for k, v in S.TYPE_NAMES.items() for x in (k, v)])[_col(code).cast("int")]


def is_zero(oid) -> Column:
    return _col(oid).rlike("^0{40}$")


def well_formed(oid) -> Column:
    return F.coalesce(_col(oid).rlike(HEX), F.lit(False))


def to_hex(data) -> Column:
    return F.lower(F.hex(_col(data)))


def _latin(content) -> Column:
    return F.decode(_col(content), "ISO-8859-1")


def header(content) -> Column:
    """The lines before the first empty line."""
    return F.split_part(_latin(content), F.lit("\n\n"), F.lit(1))


def header_values(content, name: str) -> Column:
    return F.regexp_extract_all(header(content), F.lit(rf"(?m)^{name} (.*)$"), F.lit(1))


def commit_tree(content) -> Column:
    return F.get(header_values(content, "tree"), F.lit(0))


def commit_parents(content) -> Column:
    return header_values(content, "parent")


def tag_target(content) -> Column:
    return F.get(header_values(content, "object"), F.lit(0))


def tree_entries(content) -> Column:
    """array<struct<mode, name, oid>>; null where the content is no tree. Names are decoded with replacement."""
    text = _latin(content)
    part = lambda i: F.regexp_extract_all(text, F.lit(_ENTRY), F.lit(i))
    raw = lambda x: F.encode(x, "ISO-8859-1")
    entries = F.transform(
        F.arrays_zip(part(1).alias("mode"), part(2).alias("name"), part(3).alias("oid")),
        lambda e: F.struct(e["mode"].alias("mode"), F.make_valid_utf8(raw(e["name"]).cast("string")).alias("name"), F.lower(F.hex(raw(e["oid"]))).alias("oid")),
    )
    whole = F.aggregate(part(0), F.lit(0), lambda n, e: n + F.length(e)) == F.length(text)
    return F.when(whole, entries)


def is_subtree(mode) -> Column:
    return _col(mode) == S.SUBTREE_MODE


def is_blob(mode) -> Column:
    return ~_col(mode).isin(S.SUBTREE_MODE, S.GITLINK_MODE)


def validation_code(type_code, content) -> Column:
    """The stable code of what is wrong with an object, else null."""
    t = _col(type_code)
    trees, objects = header_values(content, "tree"), header_values(content, "object")
    bad = lambda a: F.exists(a, lambda x: ~x.rlike(HEX))
    commit = F.when(F.size(trees) == 0, "missing-tree-header").when(F.size(trees) > 1, "multiple-tree-headers").when(bad(trees) | bad(commit_parents(content)), "malformed-oid")
    tag = F.when(F.size(objects) == 0, "missing-tag-object").when(F.size(objects) > 1, "multiple-tag-objects").when(bad(objects), "malformed-oid")
    return F.when(t == S.COMMIT, commit).when(t == S.TAG, tag).when((t == S.TREE) & tree_entries(content).isNull(), "malformed-tree")


def checked(objects: DataFrame) -> DataFrame:
    """The objects; reading a malformed one fails with its code."""
    code = validation_code("type", "content")
    return objects.withColumn("content", F.when(code.isNull(), F.col("content")).otherwise(F.raise_error(code).cast("binary")))


def edges(objects: DataFrame) -> DataFrame:
    """(repo_id, parent, child, kind) of the objects: commits to trees and parents, trees to subtrees, tags to targets.

    A parent and a child have one edge, of the first kind that names it.
    """
    edge = lambda kind: lambda c: F.struct(c.alias("child"), F.lit(kind).cast("short").alias("kind"))
    commit = F.concat(F.transform(F.slice(header_values("content", "tree"), 1, 1), edge(S.COMMIT_TREE)), F.transform(commit_parents("content"), edge(S.COMMIT_PARENT)))
    tree = F.transform(F.filter(tree_entries("content"), lambda e: is_subtree(e["mode"])), lambda e: edge(S.TREE_SUBTREE)(e["oid"]))
    tag = F.transform(F.slice(header_values("content", "object"), 1, 1), edge(S.TAG_TARGET))
    found = F.when(F.col("type") == S.COMMIT, commit).when(F.col("type") == S.TREE, tree).when(F.col("type") == S.TAG, tag)
    rows = objects.where(F.col("type") != S.BLOB).select("repo_id", F.col("oid").alias("parent"), F.explode(found).alias("e"))
    return first_edges(rows.select("repo_id", "parent", "e.child", "e.kind"))


def first_edges(rows: DataFrame) -> DataFrame:
    """One edge for each repository, parent and child: that of the lowest kind, as kinds are derived in that order."""
    return rows.groupBy("repo_id", "parent", "child").agg(F.min("kind").alias("kind"))


def tree_rows(objects: DataFrame) -> DataFrame:
    """(repo_id, tree, mode, name, oid), a row an entry."""
    rows = objects.where(F.col("type") == S.TREE).select("repo_id", F.col("oid").alias("tree"), F.explode(tree_entries("content")).alias("e"))
    return rows.select("repo_id", "tree", "e.mode", "e.name", "e.oid")


def tree_blobs(objects: DataFrame) -> DataFrame:
    """(repo_id, tree, oid) of the blobs that trees name."""
    return tree_rows(objects).where(is_blob("mode")).select("repo_id", "tree", "oid")


def repo_path(path) -> Column:
    """The repository's name in a request's path, else an empty string."""
    return F.regexp_extract(_col(path), r"^/(.+)/(?:info/refs|git-upload-pack|git-receive-pack)$", 1)
