"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models, of a target text collection and of the whole corpus as background. Their smoothing is the
same, a uniform part of 1 / VOCABULARY included, so a token's two losses are comparable; a document's score is the mean of
its tokens' differences, target less background (below 0: more like the target).

Words, words before a word, and pairs of words in a row are counted by their 64-bit hashes, each for itself, so counts are
exact whatever the corpus. Documents are dealt into chunks of about CHUNK words, which are stored as numbers of words in a
vocabulary of their own. A chunk sends each of its n-grams once, with its count there, to the bucket of the n-gram's hash;
the bucket adds up what all chunks sent and answers each with the totals of what it asked for. Buckets follow the measured
number of words, ENTRIES each at most on average, and each is a task's. So the table of counts grows with the corpus and
stays distributed, no task holds more than a bucket or a chunk, and a frequent n-gram is one entry a chunk. Answers meet
their chunks where these are stored, so texts and their words are never shuffled.

Defined cases: null, empty and blank texts have 0 tokens and losses of 0; equal texts get equal scores; repeated rows
count and are scored each for itself; an empty target or corpus leaves the uniform part of a model; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objgrove.llm.common import Files, new_folder, removed, stored, trimmed
from objgrove.llm.words import BASE, mix, words_of

#: The uniform part is one in so many.
VOCABULARY = 1 << 18
#: Words (and rows) of a chunk, and n-grams that a bucket is sent.
CHUNK = 1 << 20
ENTRIES = 1 << 21
#: Weights of the pair, the single word and the uniform part.
SHARES = (0.6, 0.35, 0.05)
#: A text's first word comes after START; salts keep words and words before a word apart.
START, WORD, BEFORE = np.uint64(0x51A7), np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1)

_zstd = pa.Codec("zstd", compression_level=1)
CHUNKS = "chunk long, ids array<long>, ns array<long>, size long, vocabulary binary, tokens binary"


def _packed(x: np.ndarray) -> bytes:
    """64-bit numbers by bytes of one place at a time, compressed."""
    return _zstd.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T), asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_zstd.decompress(data, decompressed_size=8 * n), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def chunked(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, text) to stored chunks: ids and numbers of words of its rows, and their words in a row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, names = TaskContext.get().partitionId() << 32, [x.split()[0] for x in CHUNKS.split(", ")]
        ids: list = []
        ns: list[np.ndarray] = []
        waiting: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            vocabulary, tokens, often = np.unique(np.concatenate(waiting), return_inverse=True, return_counts=True)
            order = np.argsort(-often)  # small numbers for frequent words
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            vocabulary, data = vocabulary[order], _packed(rank[tokens])
            n = pa.array([np.concatenate(ns)], pa.list_(pa.int64()))
            whole = len(tokens) + 2 * len(vocabulary) + 1
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), n, pa.array([whole], pa.int64()), pa.array([vocabulary.tobytes()], pa.binary()), pa.array([data], pa.binary())], names)

        for b in batches:
            keys = b.column(0).to_pylist()
            texts = [(s.as_py() or "").encode("utf-8", "surrogatepass") for s in b.column(1)]
            for first, hashes, bounds in words_of(texts):
                ids += keys[first : first + len(bounds) - 1]
                ns.append(np.diff(bounds))
                waiting.append(hashes)
                size += len(hashes) + len(bounds) - 1
                if size >= CHUNK:
                    yield row()
                    chunk, ids, size = chunk + 1, [], 0
                    ns.clear()
                    waiting.clear()
        if ids:
            yield row()

    return stored(docs.mapInArrow(read, CHUNKS), folder)


def ngrams(vocabulary: np.ndarray, tokens: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts) of a chunk's words, words before and pairs, in this order; its pairs' (before, word), and each token's pair."""
    v = len(vocabulary)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[(np.cumsum(ns) - ns)[ns > 0]] = v
    pairs, which, n = np.unique(before * (v + 1) + tokens, return_inverse=True, return_counts=True)
    b, w = np.divmod(pairs, v + 1)
    first = np.append(vocabulary, START)
    keys = np.concatenate([mix(vocabulary ^ WORD), mix(first ^ BEFORE), mix(first[b] * BASE + vocabulary[w])])
    counts = np.concatenate([np.bincount(tokens, minlength=v), np.bincount(before, minlength=v + 1), n])
    return keys, counts, b, w, which


def _sent(chunks: DataFrame, target: bool, buckets: int) -> DataFrame:
    """A chunk's sorted keys and their counts, by buckets."""
    edges = np.array([i * 2**64 // buckets for i in range(1, buckets)], np.uint64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, ns, words, data in zip(*(b.column(i) for i in range(4)), strict=True):
                ns = ns.values.to_numpy()
                keys, counts, *_ = ngrams(np.frombuffer(words.as_py(), np.uint64), _unpacked(data.as_py(), int(ns.sum())).astype(np.int64), ns)
                order = np.argsort(keys)
                keys, counts = keys[order], counts[order]
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                at = [i for i in range(buckets) if cuts[i] < cuts[i + 1]]
                steps = [_packed(np.diff(keys[cuts[i] : cuts[i + 1]], prepend=np.uint64(0))) for i in at]
                n = [cuts[i + 1] - cuts[i] for i in at]
                parts = [pa.array(n, pa.int64()), pa.array(steps, pa.binary()), pa.array([_packed(counts[cuts[i] : cuts[i + 1]]) for i in at], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([target] * len(at)), pa.array([chunk.as_py()] * len(at), pa.int64()), pa.array(at, pa.int32()), *parts], ["target", "chunk", "bucket", "n", "steps", "counts"])

    return chunks.select("chunk", "ns", "vocabulary", "tokens").mapInArrow(read, "target boolean, chunk long, bucket int, n long, steps binary, counts binary")


def _totals(sent: DataFrame, buckets: int) -> DataFrame:
    """What the documents' chunks sent to a bucket, answered by the target's and the corpus' totals in the order of the keys."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        parts = [np.cumsum(_unpacked(r[4], r[3]), dtype=np.uint64) for r in rows]
        ends = np.cumsum([0, *map(len, parts)])
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        n, sums = int(at.max()) + 1, []
        for side in (True, False):
            own = [i for i, r in enumerate(rows) if r[0] == side]
            total = np.zeros(n, np.int64)
            for i in own:  # a chunk has a key once
                total[at[ends[i] : ends[i + 1]]] += _unpacked(rows[i][5], rows[i][3]).astype(np.int64)
            sums.append(total)
        asked = [i for i, r in enumerate(rows) if not r[0]]
        out = [[_packed(s[at[ends[i] : ends[i + 1]]]) for i in asked] for s in sums]
        ids = [pa.array([rows[i][1] for i in asked], pa.int64()), pa.array([rows[i][2] for i in asked], pa.int32()), pa.array([len(parts[i]) for i in asked], pa.int64())]
        return pa.RecordBatch.from_arrays([*ids, *[pa.array(x, pa.binary()) for x in out]], ["chunk", "bucket", "n", "of_target", "of_corpus"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][2] != r[2]:
                    yield settle(held)
                    held = []
                    trimmed()
                held.append(r)
        if held:
            yield settle(held)
        trimmed()

    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    return dealt.mapInArrow(read, "chunk long, bucket int, n long, of_target binary, of_corpus binary")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a token), score."""
    folder = new_folder(docs.sparkSession, "entropy")
    d = chunked(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), f"{folder}/docs")
    t = chunked(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), f"{folder}/target")
    sizes = [x.agg(F.sum("size"), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n))).first() for x in (t, d)]
    buckets = max(1, -(-sum(s[0] or 0 for s in sizes) // ENTRIES))
    words = [float(s[1] or 0) for s in sizes]
    totals = _totals(_sent(d, False, buckets).unionByName(_sent(t, True, buckets)), buckets)
    files = Files(f"{folder}/docs")

    def scored(chunk: dict, told: list[tuple]) -> pa.RecordBatch:
        ns, vocabulary = np.array(chunk["ns"], np.int64), np.frombuffer(chunk["vocabulary"], np.uint64)
        keys, _, b, w, which = ngrams(vocabulary, _unpacked(chunk["tokens"], int(ns.sum())).astype(np.int64), ns)
        order, v, at, mean = np.argsort(keys), len(vocabulary), np.repeat(np.arange(len(ns)), ns), []
        for i in (0, 1):
            n = np.empty(len(keys))
            n[order] = np.concatenate([_unpacked(r[4 + i], r[3]) for r in told])
            p = SHARES[2] / VOCABULARY + SHARES[1] * n[:v][w] / max(words[i], 1.0) + SHARES[0] * n[2 * v + 1 :] / np.maximum(n[v : 2 * v + 1][b], 1)
            mean.append(np.bincount(at, -np.log(p)[which], len(ns)) / np.maximum(ns, 1))
        return pa.RecordBatch.from_arrays([pa.array(chunk["ids"], pa.int64()), pa.array(ns), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A unit's chunks and their answers, in the same order; every chunk has one, as it asks for START at least."""
        held: list[tuple] = []
        unit, chunks = -1, iter(())

        def settle() -> pa.RecordBatch:
            nonlocal unit, chunks
            if held[0][0] != unit:
                unit = held[0][0]
                chunks = (r for b in files.batches(unit, ["chunk", "ids", "ns", "vocabulary", "tokens"], 1) for r in b.to_pylist())
            return scored(next(r for r in chunks if r["chunk"] == held[0][1]), held)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][1] != r[1]:
                    yield settle()
                    held = []
                held.append(r)
        if held:
            yield settle()
        trimmed()

    told = totals.select(F.shiftright("chunk", 32).cast("int").alias("unit"), "chunk", "bucket", "n", "of_target", "of_corpus")
    told = told.repartition(max(1, len(files.paths)), "unit").sortWithinPartitions("unit", "chunk", "bucket")
    out = stored(told.mapInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double"), new_folder(docs.sparkSession, "entropy-scores"))
    removed(docs.sparkSession, folder)
    return out
