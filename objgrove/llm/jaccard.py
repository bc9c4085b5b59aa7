"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles. Equal sets are joined at once by their digest; the rest of the join is over
distinct sets. Every set has a root in each of RUNS runs (its smallest shingle under the run's order) and SIGNATURE sampled
tokens. A run's root is a node: all sets that share it. A node is split, again and again, by the value at a token that the
node chooses, and with a chance by a second one (BRANCH tokens on average); a node of few pairs is compared by brute
force. A node first compares its sets with one of them, its pivot; what is alike enough is linked into candidate clusters,
and pairs within a cluster need no comparison. A node of up to GROUP sets is split inside one task. Larger ones are
split by joins, a level at a time, until none is left; there, sets that are like the pivot by DROP leave the node, since
whatever is like them by 1 + LIKELY - DROP in the samples is like the pivot by LIKELY and linked to it as well.

Runs repeat until the target: two sets at the threshold share a root with that chance, and stay together in some branch with
the branching process' chance of survival, however deep a node is split, so RUNS follows from RECALL.

An exact check follows: within a cluster every two sets are compared by their shingles, in blocks of BLOCK sets or
BLOCK_SHINGLES shingles, so a pair that no run has met counts as well if its cluster has other links. Blocks return numbers
of links and a spanning forest, never pairs. Classes are the components of the exact links.

The documents are stored once, in files (units); a text is read again from its unit when its cluster is checked, so texts
of documents that are like no other are never shuffled.

Defined cases: a null text is empty; texts without words are copies of each other; texts of under five words are one
shingle; ties go to the smaller id; a null id is -2**63 inside and null in the result; repeated rows are copies, which
link to each other; an empty table gives an empty result; other columns are ignored, and kept by one_of_each().
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objgrove.llm.common import Files, cut, new_folder, quoted, removed, stored, trimmed
from objgrove.llm.components import components
from objgrove.llm.words import mix, shingles, words_of

K = 5
#: The similarity as a fraction, so that it is compared in whole numbers.
OVER, UNDER = 4, 5
SIGNATURE = 64
#: Estimated similarity from which two sets become candidates: four deviations under the threshold.
LIKELY = 0.6
#: Tokens that a node is split by, on average: less alike sets are parted faster than nodes multiply.
BRANCH = 1 / LIKELY
#: The least chance that two sets at the threshold meet.
RECALL = 0.9995
#: Pairs of a node that are compared by brute force, and sets of a node that one task splits.
PAIRS, GROUP = 1 << 16, 1 << 15
#: How alike a pivot a set of a larger node must be to leave it.
DROP = 0.85
#: Sets and shingles of a block of the exact check.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
NULL_ID = -(2**63)


def survival(similarity: float, branch: float = BRANCH) -> float:
    """The chance that two sets of a node still share one of its descendants, at any depth."""
    lost = 0.0
    for _ in range(1000):
        kept = similarity * (1 - lost)
        lost = (1 - kept) * (1 - (branch - 1) * kept)
    return 1 - lost


def runs_for(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - OVER / UNDER * survival(OVER / UNDER)))


RUNS = runs_for(RECALL)

_rng = np.random.default_rng(20_240_101)
_A = _rng.integers(1, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64)


def signature(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(roots, tokens): 64 bits of the smallest shingle under each run's order, 16 bits under every order; zeros if empty."""
    roots, tokens = np.zeros((len(sets), RUNS), np.uint64), np.zeros((len(sets), SIGNATURE), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *[len(sets[i]) for i in full[:-1]]])
        for j in range(SIGNATURE):
            least = mix(np.minimum.reduceat((x ^ _B[j]) * _A[j], starts))
            tokens[full, j] = (least >> np.uint64(48)).astype(np.uint16)
            if j < RUNS:
                roots[full, j] = mix(least ^ np.uint64(j + 1))
    return roots, tokens


def _texts(column) -> list[bytes]:
    return [(s.as_py() or "").encode("utf-8", "surrogatepass") for s in column]


def sets_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    for _, hashes, bounds in words_of(texts):
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield shingles(hashes[a:b], K)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys (numbers), which come one after another, as a table each."""
    held = None
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            change = np.zeros(t.num_rows - 1, bool)
            for k in keys:
                v = t.column(k).to_numpy()
                change |= v[1:] != v[:-1]
            at = [0, *(np.flatnonzero(change) + 1).tolist()]
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                yield t.slice(lo, hi - lo)
            held = t.slice(at[-1])
    if held is not None:
        yield held


class Units:
    """The stored documents: a unit is the file that one task wrote."""

    def __init__(self, docs: DataFrame, key: str, text: str, folder: str, rest: bool):
        d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("__id"), F.col(text).cast("string").alias("__text"), *([F.struct(*[F.col(quoted(c)) for c in docs.columns if c != text]).alias("__rest")] if rest else []))
        own = {"__unit": F.lit(0), "__at": F.lit(0).cast("long"), "__set": F.lit(b""), "__n": F.lit(0).cast("long"), "__sig": F.lit(b""), "__roots": F.array().cast("array<bigint>")}
        added = list(own)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            unit, at = TaskContext.get().partitionId(), 0
            for whole in batches:
                for lo in range(0, whole.num_rows, 500):
                    b = whole.slice(lo, 500)
                    sets = list(sets_of(_texts(b.column(1))))
                    roots, tokens = signature(sets)
                    roots = pa.ListArray.from_arrays(pa.array(np.arange(0, RUNS * len(sets) + 1, RUNS), pa.int32()), pa.array(roots.view(np.int64).ravel()))
                    columns = [
                        pa.array(np.full(len(sets), unit, np.int32)), pa.array(np.arange(at, at + len(sets))), pa.array([digest(s) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()), pa.array([x.tobytes() for x in tokens], pa.binary()), roots,
                    ]
                    at += len(sets)
                    yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *added])
            trimmed()

        self.schema = d.schema
        self.rows = stored(d.mapInArrow(read, d.withColumns(own).schema), f"{folder}/units")
        self.files = Files(f"{folder}/units")

    def told(self, wanted: DataFrame, read, schema) -> DataFrame:
        """read(unit, rows of wanted with this __unit, by __at) for each unit that wanted names."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in grouped(batches, ["__unit"]):
                yield from read(t.column("__unit")[0].as_py(), t)

        return wanted.repartition("__unit").sortWithinPartitions("__unit", "__at").mapInArrow(each, schema)


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SIGNATURE)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many sampled tokens each of a has in common with each of b."""
    if len(a) * len(b) <= 4096:
        return (a[:, None, :] == b[None, :, :]).sum(axis=2)
    out, at, bt = np.zeros((len(a), len(b)), np.uint8), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for x, y in zip(at, bt, strict=True):
        out += x[:, None] == y
    return out


def _choice(nodes: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(the i-th token that each node chooses, whether it is used)."""
    h = mix(nodes + np.uint64(0x632BE59BD9B4E019) * np.uint64(i + 1))
    return (h % np.uint64(SIGNATURE)).astype(np.int64), (h >> np.uint64(32)) < np.uint64(int(2**32 * (BRANCH - 1)) if i else 2**32)


def _child(nodes: np.ndarray, token: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(nodes ^ mix(token.astype(np.uint64) + np.uint64(1))) ^ value.astype(np.uint64))


def _joined(label: np.ndarray, groups: list[np.ndarray]) -> None:
    """Gives the labels of each group one label, the smallest, everywhere."""
    up: dict[int, int] = {}

    def find(a: int) -> int:
        while up.get(a, a) != a:
            up[a] = a = up.get(up[a], up[a])
        return a

    for g in groups:
        roots = sorted({find(a) for a in g.tolist()})
        for r in roots[1:]:
            up[r] = roots[0]
    if up:
        old = np.array(sorted(up))
        new = np.array([find(a) for a in old.tolist()])
        at = np.minimum(np.searchsorted(old, label), len(old) - 1)
        label[:] = np.where(old[at] == label, new[at], label)


def linked(sigs: np.ndarray, node: int) -> np.ndarray:
    """A node's sets' labels: those that chosen paths link have the same one, the index of their first set."""
    label, need = np.arange(len(sigs)), LIKELY * SIGNATURE
    todo = [(np.arange(len(sigs)), np.array([node], np.uint64))]
    while todo:
        at, node = todo.pop()
        for step in ("pivot", "pairs"):
            kinds, which, count = np.unique(label[at], return_inverse=True, return_counts=True)
            crossing = (len(at) ** 2 - (count**2).sum()) // 2
            if step == "pivot" and crossing > PAIRS:
                pivot = int(mix(node)[0] % np.uint64(len(at)))
                like = _agree(sigs[at[pivot : pivot + 1]], sigs[at])[0] >= need
                _joined(label, [np.unique(label[at[like]])])
        if not crossing:
            continue
        if crossing <= PAIRS:  # pairs within the largest cluster need no comparison
            rest, groups = np.flatnonzero(which != count.argmax()), []
            for lo in range(0, len(rest), 128):
                part = rest[lo : lo + 128]
                a, b = np.nonzero(_agree(sigs[at[part]], sigs[at]) >= need)
                pairs = np.unique(np.sort(np.column_stack([label[at[part[a]]], label[at[b]]]), axis=1), axis=0)
                groups += list(pairs[pairs[:, 0] != pairs[:, 1]])
            _joined(label, groups)
            continue
        for i in (0, 1):
            (token,), (used,) = _choice(node, i)
            if used:
                order = np.argsort(sigs[at, token], kind="stable")
                value = sigs[at[order], token]
                for g in np.split(at[order], np.flatnonzero(value[1:] != value[:-1]) + 1):
                    if len(g) > 1:
                        todo.append((np.sort(g), _child(node, np.array([token]), sigs[g[:1], token])))
    return label


def _split(nodes: DataFrame) -> DataFrame:
    """(node, handle, __sig), whole nodes of up to GROUP sets each to one task, to edges (a, b): stars of a task's clusters."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(a: int) -> int:
            while up.setdefault(a, a) != a:
                up[a] = a = up[up[a]]
            return a

        for t in grouped(batches, ["node"]):
            sigs = _sigs(t.column("__sig"))
            if len(sigs) == 2:
                if (sigs[0] == sigs[1]).sum() < LIKELY * SIGNATURE:
                    continue
                label = np.zeros(2, int)
            else:
                label = linked(sigs, t.column("node")[0].as_py() & 0xFFFFFFFFFFFFFFFF)
            names = t.column("handle").to_numpy()
            for i in np.flatnonzero(label != np.arange(len(label))).tolist():
                a, b = find(int(names[i])), find(int(names[label[i]]))
                up[max(a, b)] = min(a, b)
        stars = [(a, find(a)) for a in list(up) if find(a) != a]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in stars], pa.int64()), pa.array([x[1] for x in stars], pa.int64())], ["a", "b"])

    return nodes.select("node", "handle", "__sig").repartition("node").sortWithinPartitions("node").mapInArrow(read, "a long, b long")


def _level(big: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, handle) of nodes beyond GROUP to (links to their pivots, their children's (node, handle))."""
    pivot = big.groupBy("node").agg(F.min_by("handle", F.xxhash64("handle", "node")).alias("pivot"))
    pivot = pivot.join(sets.select(F.col("handle").alias("pivot"), F.col("__sig").alias("pivot_sig")), "pivot")
    rows = big.join(sets.select("handle", "__sig"), "handle").join(pivot, "node").select("node", "handle", "__sig", "pivot", "pivot_sig")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, nodes, names = _sigs(b.column("__sig")), b.column("node").to_numpy().view(np.uint64), b.column("handle")
            like = (sigs == _sigs(b.column("pivot_sig"))).sum(axis=1)
            link = np.flatnonzero(like >= LIKELY * SIGNATURE)
            yield pa.RecordBatch.from_arrays([b.column("pivot").take(pa.array(link)), names.take(pa.array(link)), pa.array(np.ones(len(link), bool))], ["node", "handle", "link"])
            stay = np.flatnonzero(like < DROP * SIGNATURE)
            for i in (0, 1):
                token, used = _choice(nodes[stay], i)
                at = stay[used]
                child = _child(nodes[at], token[used], sigs[at, token[used]])
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), names.take(pa.array(at)), pa.array(np.zeros(len(at), bool))], ["node", "handle", "link"])

    out = cut(rows.mapInArrow(read, "node long, handle long, link boolean"))
    return out.where("link and node <> handle").select(F.col("node").alias("a"), F.col("handle").alias("b")), out.where("not link").select("node", "handle")


def candidates(sets: DataFrame) -> DataFrame:
    """Distinct sets (handle, __sig, __roots) to edges (a, b) that span the candidate clusters."""
    level, small, edges = sets.select("handle", F.explode("__roots").alias("node")), None, None
    while True:
        size = level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        rows = cut(level.join(size, "node").select("node", "handle", "size"))
        part = rows.where(F.col("size") <= GROUP).select("node", "handle")
        small = part if small is None else small.unionByName(part)
        big = rows.where(F.col("size") > GROUP).select("node", "handle")
        if big.isEmpty():
            break
        links, level = _level(big, sets)
        edges = links if edges is None else edges.unionByName(links)
    out = _split(small.join(sets.select("handle", "__sig"), "handle"))
    return out if edges is None else out.unionByName(edges)


def _similar(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Which sets of x have 4/5 of the shingles of both in common with which of y, exactly."""
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    if len(x) * len(y) <= 16:
        inter = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in y] for a in x])
        return UNDER * inter >= OVER * (nx[:, None] + ny[None, :] - inter)
    allx, ally = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(allx, ally)
    shared = np.zeros((len(x), len(y)), np.float32)
    rows = [np.repeat(np.arange(len(n)), n) for n in (nx, ny)]
    at = [np.minimum(np.searchsorted(common, v), max(0, len(common) - 1)) for v in (allx, ally)]
    hit = [common[a] == v if len(common) else np.zeros(len(v), bool) for a, v in zip(at, (allx, ally), strict=True)]
    for lo in range(0, len(common), 4096):
        parts = []
        for r, a, h, n in zip(rows, at, hit, (len(x), len(y)), strict=True):
            use = h & (a >= lo) & (a < lo + 4096)
            m = np.zeros((n, min(4096, len(common) - lo)), np.float32)
            m[r[use], a[use] - lo] = 1
            parts.append(m)
        shared += parts[0] @ parts[1].T
    inter = np.rint(shared).astype(np.int64)
    return UNDER * inter >= OVER * (nx[:, None] + ny[None, :] - inter)


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    """(each one's smallest fellow, spanning edges) of the components of links between n things."""
    up, edges = list(range(n)), []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            up[max(x, y)] = min(x, y)
            edges.append((i, j))
    return [find(i) for i in range(n)], edges


def _check(blocks: DataFrame) -> DataFrame:
    """Texts of pairs of blocks to (a, b, links): a set's number of linked documents, or a set with its class or a link.

    `whole` says that the cluster is one block, so b is a's class, the smallest set; otherwise a and b are an edge.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["cluster", "i", "j"]):
            sets = list(sets_of(_texts(t.column("text"))))
            names, copies, side = t.column("__set").to_pylist(), t.column("copies").to_numpy(), t.column("side").to_numpy()
            whole = t.column("blocks")[0].as_py() == 1
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if (side == 1).any() else left
            links = np.zeros(len(names), np.int64)
            if len(left):
                like = _similar([sets[i] for i in left], [sets[i] for i in right])
                if right is left:
                    np.fill_diagonal(like, False)
                links[left] += like @ copies[right]
                if right is not left:
                    links[right] += like.T @ copies[left]
                a, b = np.nonzero(like)
                root, edges = _spanning(len(names), left[a], right[b])
            else:
                root, edges = list(range(len(names))), []
            out = [(names[i], names[r], int(n)) for i, (r, n) in enumerate(zip(root, links, strict=True))] if whole else [(names[i], None, int(n)) for i, n in enumerate(links) if n] + [(names[i], names[j], 0) for i, j in edges]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64()), pa.array([whole] * len(out), pa.bool_())], ["a", "b", "links", "whole"])

    dealt = blocks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "__set")
    return dealt.mapInArrow(read, "a binary, b binary, links long, whole boolean")


def _classified(units: Units, folder: str) -> DataFrame:
    """__unit, __at, __id, n_links and keep (the class's first document: id, unit, at) of every row."""
    spark = units.rows.sparkSession
    sets = units.rows.groupBy("__set").agg(F.min(F.struct("__id", "__unit", "__at")).alias("first"), F.count("*").alias("copies"), F.first("__n").alias("__n"), F.first("__sig").alias("__sig"), F.first("__roots").alias("__roots"))
    # a number of 64 bits stands for a set among candidates; two sets that share one would only be checked in vain
    handle = F.conv(F.substring(F.hex("__set"), 1, 15), 16, 10).cast("long")
    sets = stored(sets.withColumn("handle", handle), f"{folder}/sets")
    clusters = components(candidates(sets.where("`__n` > 0")))
    clusters = clusters.withColumnsRenamed({"node": "handle", "component": "cluster"})
    members = clusters.join(sets.select("handle", "__set", "first", "copies", "__n"), "handle")
    members = stored(members, f"{folder}/members")
    # a cluster's sets in blocks, by digest; a set goes to the pairs of its block with every block
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("__n") / BLOCK_SHINGLES)).cast("int")
    wanted = members.join(members.groupBy("cluster").agg(blocks.alias("blocks"), F.count("*").alias("size")).where("size > 1"), "cluster")
    wanted = wanted.select(F.col("first.__unit").alias("__unit"), F.col("first.__at").alias("__at"), "cluster", "blocks", "__set", "copies")
    schema = wanted.drop("__unit", "__at").withColumn("text", F.lit("").cast("string")).schema
    names = schema.names[:-1]

    files = units.files

    def texts(unit: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        at, lo = rows.column("__at").to_numpy(), 0
        for b in files.batches(unit, ["__at", "__text"]):
            here = b.column(0).to_numpy()
            hi = int(np.searchsorted(at, here[-1], side="right"))
            if hi > lo:
                found = b.column(1).take(pa.array(at[lo:hi] - here[0]))
                own = rows.slice(lo, hi - lo).select(names).append_column("text", found)
                yield from own.combine_chunks().to_batches()
                lo = hi

    block = F.pmod(F.xxhash64("__set"), F.col("blocks")).cast("int")
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), F.when(F.col("block") > o, 1).otherwise(0).alias("side")))
    sent = units.told(wanted, texts, schema).withColumn("block", block)
    sent = sent.select("cluster", "blocks", "__set", "copies", "text", F.explode(to).alias("to")).select("cluster", "blocks", "to.i", "to.j", "to.side", "__set", "copies", "text")
    found = stored(_check(sent), f"{folder}/found")
    facts = found.select(F.col("a").alias("__set"), "links", F.when(F.col("whole"), F.col("b")).alias("class_set"))
    edges = found.where("not whole and b is not null").select("a", "b")
    if not edges.isEmpty():
        classes = components(edges)
        facts = facts.unionByName(classes.select(F.col("node").alias("__set"), F.lit(0).cast("long").alias("links"), F.col("component").alias("class_set")))
    facts = facts.groupBy("__set").agg(F.sum("links").alias("linked"), F.min("class_set").alias("class_set"))
    facts = facts.join(members.select("__set", "first"), "__set").withColumn("class_set", F.coalesce("class_set", "__set"))
    firsts = facts.groupBy("class_set").agg(F.min("first").alias("class_first"))
    facts = stored(facts.join(firsts, "class_set").select("__set", "linked", "class_first"), f"{folder}/facts")
    per_set = sets.select("__set", "first", "copies").join(facts, "__set", "left")
    per_set = per_set.select("__set", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("class_first", "first").alias("keep"))
    out = units.rows.select("__unit", "__at", "__id", "__set").join(per_set, "__set").drop("__set")
    return stored(out, new_folder(spark, "classified"))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the class's smallest id) and n_links (documents of 0.8 or more) of every row."""
    folder = new_folder(docs.sparkSession, "jaccard")
    rows = _classified(Units(docs, key, text, folder, False), folder)
    removed(docs.sparkSession, folder)
    shown = lambda c: F.when(c != NULL_ID, c)
    return rows.select(shown(F.col("__id")).alias("doc_id"), shown(F.col("keep.__id")).alias("class_id"), "n_links")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row for each class, that of the smallest id, with their own columns."""
    folder = new_folder(docs.sparkSession, "jaccard")
    units = Units(docs, key, text, folder, True)
    rows = _classified(units, folder)
    gone = rows.where((F.col("__unit") != F.col("keep.__unit")) | (F.col("__at") != F.col("keep.__at"))).select("__unit", "__at")
    every = docs.sparkSession.createDataFrame([(u, -1) for u in sorted(units.files.paths)], "`__unit` int, `__at` long")
    kept, names, files = units.schema, units.schema.names, units.files

    def read(unit: int, told: pa.Table) -> Iterator[pa.RecordBatch]:
        drop = told.column("__at").to_numpy()
        for b in files.batches(unit, ["__at", *names]):
            stay = pa.array(~np.isin(b.column(0).to_numpy(), drop))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(stay) for c in names], names)

    d = units.told(every.unionByName(gone), read, kept)
    return d.select(*[(F.col("__text") if c == text else F.col(f"__rest.{quoted(c)}")).alias(c) for c in docs.columns])
