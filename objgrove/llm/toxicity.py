"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. Every window of a text is compressed with
both; a toxic passage is shorter with the toxic one. The largest differences of a document's windows become a score by
logistic thresholds, which are calibrated on labelled texts that the dictionaries have not seen.

Both are trained by zstandard's own trainer: the ordinary one on windows of ordinary texts, the toxic one on the toxic
passages of toxic texts, which are mostly ordinary prose otherwise: the runs of strings that are frequent there and rare
elsewhere. The trainer keeps what repeats most; toxic passages that it leaves out are put before its choice. The ordinary
dictionary follows in both, so what differs between the two lengths is due to toxic strings. Case is ignored.

Learning uses a bounded sample (PER_CLASS documents of each label, of up to MAX_BYTES); scoring reads every byte of every
text. Defined cases: null and empty texts have no window and get the score of differences of 0; equal texts get equal
scores; repeated rows are scored each for itself; without labels of both kinds every score is 0; labels, language, source
and id are never inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objgrove.llm.common import whole_row
from objgrove.llm.labelled import held_out, training_rows

PER_CLASS = 2500
MAX_BYTES = 65_536
WINDOW, STRIDE = 64, 48
DICT_BYTES = 8192
#: Ends the dictionaries and every window, so that no window is stored uncompressed, where its matches would not show.
TAIL = bytes(range(1, 32))
#: The three offsets that end the tables of a dictionary that zstandard trains.
FIRST_OFFSETS = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))
GRAM = 5
#: The toxic dictionary's own part, at most.
OWN_BYTES = 2048
#: The share of toxic texts that must have a passage.
SHARE = 0.02
#: How much more often toxic texts must have a string, by how many deviations, and how often a text counts one at most.
RATIO, DEVIATIONS, PER_TEXT = 6, 6, 3
TOP = 4
THRESHOLD = 0.5


class Model:
    """Plain bytes and numbers, so it is small (under 64 KB) and can be broadcast."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, None
        self.mean = self.scale = None

    def tools(self):
        import zstandard as z

        out = []
        # the dictionaries are a few KB, so a thorough search for matches of 5 bytes is cheap
        params = z.ZstdCompressionParameters(
            window_log=15, chain_log=13, hash_log=13, search_log=6, min_match=5, target_length=64, strategy=z.STRATEGY_LAZY2,
            format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        for data in (self.ordinary, self.toxic):
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            out.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)
        return out

    def differences(self, raw: bytes, tools) -> np.ndarray:
        """Of each window, how many bytes the toxic dictionary saves."""
        a, b = tools
        raw = raw.lower()
        return np.array([len(a(w)) - len(b(w)) for w in (raw[i : i + WINDOW] + TAIL for i in range(0, max(1, len(raw) - WINDOW + STRIDE), STRIDE))], dtype=np.float64)

    def features(self, raw: bytes, tools) -> np.ndarray:
        d = self.differences(raw, tools) if raw else np.zeros(1)
        top = np.zeros(TOP)
        k = min(TOP, len(d))
        top[:k] = np.sort(np.partition(d, len(d) - k)[len(d) - k :])[::-1]
        total = np.maximum(d, 0).sum()
        return np.array([*np.maximum(top, 0), np.log1p(total), np.log1p(100 * total / len(d)), np.log1p(len(d))])

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        x = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _grams(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw.lower(), np.uint8).astype(np.uint64)
    if len(b) < GRAM:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(b) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        out = out << np.uint64(8) | b[i : len(b) - GRAM + 1 + i]
    return out


def telling(toxic: list[bytes], ordinary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings of GRAM bytes that toxic texts have RATIO times as often as ordinary ones, and how often they do.

    A text counts a string PER_TEXT times at most.
    """
    sides = []
    for side in (toxic, ordinary):
        found = [np.unique(_grams(t), return_counts=True) for t in side]
        v, n = np.concatenate([x[0] for x in found]), np.concatenate([np.minimum(x[1], PER_TEXT) for x in found])
        values, at = np.unique(v, return_inverse=True)
        sides.append((values, np.bincount(at, n, len(values))))
    (v, n), (w, m) = sides
    other = np.zeros(len(v))
    if len(w):
        at = np.minimum(np.searchsorted(w, v), len(w) - 1)
        other = np.where(w[at] == v, m[at], 0)
    rate, base = (n + 0.5) / (len(toxic) + 1), (other + 0.5) / (len(ordinary) + 1)
    expected = base * (len(toxic) + 1)
    keep = (rate >= RATIO * base) & (n - expected >= DEVIATIONS * np.sqrt(expected + 1))
    return v[keep], n[keep]


def passages(raw: bytes, grams: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
    """The runs that telling strings cover, in lower case, without ends that are rare beside their middle."""
    g = _grams(raw)
    at = np.minimum(np.searchsorted(grams, g), len(grams) - 1) if len(grams) else np.zeros(0, int)
    n = np.where(grams[at] == g, counts[at], 0) if len(grams) else np.zeros(0)
    hit = np.flatnonzero(n)
    if len(hit):
        ends = np.flatnonzero(np.diff(hit) > 1)
        for a, b in zip(hit[np.r_[0, ends + 1]], hit[np.r_[ends, len(hit) - 1]], strict=True):
            core = np.flatnonzero(n[a : b + 1] >= 0.5 * n[a : b + 1].max())
            yield raw[a + core[0] : a + core[-1] + GRAM].lower()


def train(rows: list[tuple[int, bytes]]) -> Model | None:
    """rows: (label, text), in a fixed order. Every second row of a class trains, the others calibrate."""
    import zstandard as z

    by = {k: list(dict.fromkeys(t for label, t in rows if label == k)) for k in (0, 1)}
    if min(map(len, by.values())) < 4:
        return None
    learn, rest = {k: v[::2] for k, v in by.items()}, {k: v[1::2] for k, v in by.items()}
    windows = lambda texts: [w.lower() for t in texts for w in (t[i : i + 256] for i in range(0, len(t), 256)) if len(w) >= 32]

    def trained(samples: list[bytes], size: int) -> bytes:
        try:
            # what comes before the first offsets are entropy tables, no text
            return z.train_dictionary(size, samples, k=64, d=6).as_bytes().split(FIRST_OFFSETS, 1)[-1]
        except z.ZstdError:  # too few samples to train on
            return b"".join(samples)[-size:]

    grams, counts = telling(learn[1], learn[0])
    parts = [list(dict.fromkeys(passages(t, grams, counts))) for t in learn[1]]
    seen = Counter(p for own in parts for p in own)
    often = {p for p, n in seen.items() if n >= max(2, SHARE * len(learn[1]))}
    # each toxic text's own toxic passages are what the toxic dictionary is trained on; the trainer keeps what repeats
    # most, and what it leaves out goes before that, the most frequent last
    toxic = trained([p for own in parts for p in own if p in often], OWN_BYTES) if often else b""
    for p in sorted(often, key=lambda p: (-seen[p], p)):
        if p not in toxic and len(toxic) + len(p) <= OWN_BYTES:
            toxic = p + b"\x00" + toxic
    # windows that have a toxic passage by chance would hide it from the difference
    plain = [w for w in windows(learn[0]) if not any(p.strip() in w for p in often)]
    common = trained(plain[:: max(1, len(plain) // 20_000)], DICT_BYTES)
    # the shared part comes last in both, at the same distance from a window
    model = Model(common + TAIL, toxic + common + TAIL)
    tools = model.tools()
    x = np.array([model.features(t, tools) for k in (0, 1) for t in rest[k]])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    model.weights = logistic((x - model.mean) / model.scale, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, intercept first; the classes weigh 2 to 1, as a lost ordinary document is the worse error."""
    x1 = np.column_stack([np.ones(len(x)), x])
    c = np.where(y > 0, 1 / 3 / max(1, y.sum()), 2 / 3 / max(1, (1 - y).sum())) * len(y)
    w, r = np.zeros(x1.shape[1]), np.diag([0.0, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (c * p * (1 - p))[:, None]).T @ x1 + r + 1e-9 * np.eye(len(w)), x1.T @ (c * (y - p)) - r @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learned(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model | None:
    rows = training_rows(docs, labels, "toxic", per_class, max_bytes).orderBy("h", "id").collect()  # bounded: 2 * per_class rows of max_bytes
    return train([(r["label"], r["text"].encode("utf-8", "surrogatepass")) for r in rows])


def scored(docs: DataFrame, model: Model | None, text) -> DataFrame:
    """docs with the column __score; text takes a batch's texts from it, so that they are handed to Python once."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.tools() if model else None
        for b in batches:
            texts = [str(s.as_py() or "") for s in text(b)]
            x = np.array([model.features(t.encode("utf-8", "surrogatepass"), tools) for t in texts]).reshape(len(texts), TOP + 3) if model else None
            s = model.score(x) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], [b.schema.names[0], "__score"])

    return docs.mapInArrow(score, docs.select(docs.columns[0]).withColumn("__score", F.lit(0.0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = learned(docs, labels)
    d = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, lambda b: b.column(1))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    at = docs.columns.index("text")
    d = scored(docs.select(whole_row(docs).alias("__row")), learned(docs, labels), lambda b: b.column(0).field(at)).where(F.col("__score") < THRESHOLD)
    return d.select("__row.*")
