"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, their shapes (runs of letters and digits collapsed, other characters kept) and a few terms for
how long and how repetitive it is, hashed to TERMS columns. A labelled sample's weighted counts are factorised; the
texts' coordinates are unit vectors, broadcast with their labels (2 * PER_CLASS rows of RANK numbers, whatever the
corpus). Every document's cosines to all of them are computed, block by block as a matrix product, and its NEIGHBOURS
nearest vote with their similarities' powers, each class by its share among the labels.

Learning uses the sample alone, its inverse document frequencies included; scoring reads whole texts. Defined cases: null
and empty texts have terms of their own, so they get a score; equal texts get equal scores; repeated rows are scored
each for itself; without labels the score is 0.5; labels, language, source and id are never inputs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objgrove.llm.labelled import held_out, training_rows

PER_CLASS = 1500
MAX_BYTES = 65_536
TERMS = 4096
RANK = 48
NEIGHBOURS = 25
POWER = 4
THRESHOLD = 0.3
BLOCK = 512

_KINDS = bytes.maketrans(bytes(range(256)), bytes(97 if 97 <= i < 123 or i >= 128 else 65 if 65 <= i < 91 else 48 if 48 <= i < 58 else i for i in range(256)))
_RUNS = [(re.compile(c + rb"+"), c) for c in (b"a", b"A", b"0")]


def terms(raw: bytes) -> Counter:
    shapes = raw.translate(_KINDS)
    for run, c in _RUNS:
        shapes = run.sub(c, shapes)
    out, words, lines = Counter(shapes.split()), raw.split(), raw.split(b"\n")
    n = len(words)
    out.update(b"\x01" + w for w in words)
    level = lambda part, whole: int(round(10 * part / max(1, whole)))
    weight = max(3, int(n**0.5))
    out[b"\x00length %d" % n.bit_length()] = weight
    out[b"\x00same as before %d" % level(sum(a == b for a, b in zip(words, words[1:])), n)] = weight
    out[b"\x00distinct words %d" % level(len(set(words)), n)] = weight
    out[b"\x00distinct lines %d" % level(len(set(lines)), len(lines))] = weight
    out[b"\x00word length %d" % (len(raw) // max(1, n)).bit_length()] = weight
    return out


class Hashed:
    """Rows of hashed counts; the cache of terms is emptied when it grows large."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def rows(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), TERMS), np.float32)
        for i, t in enumerate(texts):
            for term, n in terms(t).items():
                at = self.known.get(term)
                if at is None:
                    if len(self.known) > 200_000:
                        self.known.clear()
                    at = self.known[term] = zlib.crc32(term) % TERMS
                out[i, at] += n
        return np.log1p(out)


class Model:
    def __init__(self, counts: np.ndarray, labels: np.ndarray, prior: float):
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
        x = self._unit(counts * self.idf)
        rng, k = np.random.default_rng(0), min(RANK, *x.shape)
        q = x @ rng.standard_normal((x.shape[1], k + 16), dtype=np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(q)
            q, _ = np.linalg.qr(x.T @ q)
            q = x @ q
        q, _ = np.linalg.qr(q)
        self.axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:k].T.astype(np.float32)
        self.vectors, self.labels = self._unit(x @ self.axes), labels.astype(np.float32)
        mean = float(labels.mean())
        self.weight = np.where(labels > 0, prior / max(mean, 1e-9), (1 - prior) / max(1 - mean, 1e-9)).astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        near = self._unit(self._unit(counts * self.idf) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
        w = np.maximum(np.take_along_axis(near, at, axis=1), 1e-6) ** POWER * self.weight[at]
        return np.clip((w * self.labels[at]).sum(axis=1) / w.sum(axis=1), 0, 1)


def learned(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model | None:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for b in batches:
            rows = hashed.rows([t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("h"), b.column("id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["label", "h", "id", "counts"])

    rows = training_rows(docs, labels, "quality", per_class, max_bytes).mapInArrow(count, "label int, h long, id long, counts binary").orderBy("h", "id").collect()
    if not rows:
        return None
    shares = labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id"))).agg(F.avg("quality")).first()[0]
    return Model(np.array([np.frombuffer(r["counts"], np.float32) for r in rows]), np.array([r["label"] for r in rows]), shares)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learned(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, m = Hashed(), model.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                texts = [(s.as_py() or "").encode("utf-8", "surrogatepass") for s in part.column(1)]
                s = m.score(hashed.rows(texts)) if m else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
