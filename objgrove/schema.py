"""Tables and constants of the object store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPOS = "id long, name string, last_pushed_at timestamp, last_gc_at timestamp"
OBJECTS = "repo_id long, oid string, type short, size int, content binary, created_at timestamp"
REFS = "repo_id long, name string, oid string, peeled_oid string, symref_target string"
EDGES = "repo_id long, parent string, child string, kind short"
FILES = "repo_id long, ref_name string, path string, mode string, blob_oid string"
TABLES = {"repos": REPOS, "git_object": OBJECTS, "git_ref": REFS, "git_edge": EDGES, "repo_file": FILES}
KEYS = {"repos": ["name"], "git_object": ["repo_id", "oid"], "git_ref": ["repo_id", "name"], "git_edge": ["repo_id", "parent", "child"], "repo_file": ["repo_id", "ref_name", "path"]}

#: The version of the stored layout, and what takes a manifest of each older one a version on.
VERSION = 2
MIGRATIONS = {1: lambda old: {"schema": 2, "tables": {name: [path] if isinstance(path, str) else list(path) for name, path in old.get("tables", old).items() if name != "schema"}}}


def migrated(manifest: dict) -> dict:
    """A manifest as this version writes it; one of a newer version is refused."""
    while (at := manifest.get("schema", 1)) != VERSION:
        if at not in MIGRATIONS:
            raise ValueError(f"the store has layout {at}, this is {VERSION}")
        manifest = MIGRATIONS[at](manifest)
    return manifest


# fixed values: type codes, edge kinds and modes of the stored format
COMMIT, TREE, BLOB, TAG = 1, 2, 3, 4
OFS_DELTA, REF_DELTA = 6, 7
TYPE_NAMES = {COMMIT: "commit", TREE: "tree", BLOB: "blob", TAG: "tag"}
TYPE_CODES = {v: k for k, v in TYPE_NAMES.items()}
COMMIT_TREE, COMMIT_PARENT, TREE_SUBTREE, TAG_TARGET = 1, 2, 3, 5
SUBTREE_MODE, GITLINK_MODE = "40000", "160000"
ZERO = "0" * 40
BRANCHES = "refs/heads/"
DEFAULT_HEAD = ("HEAD", "refs/heads/main")
MAX_REF_NAME_BYTES = 2000

# fixed values: what a report says of a command that failed
LONG_REF = "funny refname (too long to store)"
STALE_REF = "stale ref (compare-and-swap failed)"
ATOMIC_FAILED = "atomic transaction failed"
MISSING_OBJECTS = "missing necessary objects"
UNPACKER_ERROR = "unpacker error"

# fixed values: the error codes of malformed data
CODES = (
    "bad-magic", "unsupported-version", "trailer-mismatch", "unknown-object-type", "size-mismatch", "trailing-bytes", "unresolved-base", "inflate-failed",
    "delta-base-size-mismatch", "delta-reserved-opcode", "delta-target-size-mismatch",
    "malformed-tree", "malformed-oid", "missing-tree-header", "multiple-tree-headers", "missing-tag-object", "multiple-tag-objects",
)


class FormatError(ValueError):
    """Malformed data; `code` is stable."""

    def __init__(self, code: str, message: str = ""):
        if code not in CODES:
            raise KeyError(code)
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


class ProtocolError(ValueError):
    """A malformed request."""


class WantNotFound(LookupError):
    """Wanted objects that the store does not hold."""

    def __init__(self, oids):
        self.oids = sorted(oids)
        super().__init__(f"upload-pack: not our ref {' '.join(self.oids)}")


def constraint_errors(table: str) -> Column:
    """The first violated constraint of a row, else null."""
    hex40 = lambda c: F.col(c).rlike("^[0-9a-f]{40}$")
    rules = {
        "git_object": [("oid", hex40("oid")), ("type", F.col("type").isin(COMMIT, TREE, BLOB, TAG))],
        "git_edge": [("parent", hex40("parent")), ("child", hex40("child")), ("kind", F.col("kind").isin(COMMIT_TREE, COMMIT_PARENT, TREE_SUBTREE, TAG_TARGET))],
        "git_ref": [("oid xor symref_target", F.col("oid").isNull() != F.col("symref_target").isNull()), ("oid", F.col("oid").isNull() | hex40("oid"))],
        "repo_file": [("blob_oid", hex40("blob_oid"))],
        "repos": [("name", F.col("name").isNotNull())],
    }[table]
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])
