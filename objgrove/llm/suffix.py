"""Suffix-array dedup: bytes covered by a string of MATCH bytes that also starts in a document with a smaller id.

A run-length index over the whole corpus would be one machine's, so the corpus is cut so that no match is lost. Every
window of MATCH bytes has a minimizer, the smallest hash of its GRAM-byte strings; equal windows have equal minimizers, and
windows in a row that share one are a segment. Steps, each a job over the units (successive rows of a file, bounded in
number and in bytes of text, whatever these take when stored) of a stored copy of the corpus:

1. The minimizers' hashes are dealt by value, five bytes each, and those of two documents or more are told back to the
   units that have them. Segments whose minimizer is in one document only have no match.
2. The other segments, once a unit, go to buckets by minimizer. A bucket builds a run-length index of its segments, streams
   them through it, and gets for each window the smallest id that has it; bits say which windows an earlier id has.
3. The units mark the bytes of those windows in their documents.

A segment repeated within a unit is sent once, so a passage that a third of all documents share costs a row a unit. A
minimizer with many documents in a unit is hot: its windows are sent one by one, dealt by their own hash. Ids are compared,
never texts collected; the units and what they are told are in the shared folder, so a lost executor costs its own tasks.

Defined cases: a null text is empty; texts of under MATCH bytes are kept; a null id is smaller than all others; rows with
equal ids do not remove each other's bytes; an empty table gives an empty result; other columns are kept by deduplicated().
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objgrove.llm.common import cut, new_folder, open_fs, quoted, removed, trimmed, whole_row
from objgrove.llm.run_index import MATCH, RunIndex
from objgrove.llm.words import mix, prefix

GRAM = 20
SPAN = MATCH - GRAM + 1
#: Rows of a file; bytes of a unit's text, more only for a single text, and of a row group as stored; rows that are read at a time.
UNIT_ROWS, UNIT_BYTES, READ_ROWS = 20_000, 16 << 20, 200
#: Text bytes for a bucket of hashes and for one of segments; buckets are as many as the corpus needs.
HASH_BUCKET, SEGMENT_BUCKET = 24 << 20, 2 << 20
#: Documents of a unit that make a minimizer hot.
HOT = 64
ROW_BYTES = 4 << 20
NULL_ID = -(2**63)
REST_BITS = 38
#: A unit's number has its file's above its own in the file; a file has UNIT_ROWS units at most.
PART_BITS = 16


def segments(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer) of the runs of windows that share a minimizer."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, size = _grams(b, GRAM), 1
    while size < SPAN:
        step = min(size, SPAN - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    size = np.diff(np.r_[start, len(least)])
    if (size > SPAN).any():  # a repeated string can share its minimizer for longer than one string allows
        parts = -(-size // SPAN)
        shift = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * SPAN
        start, size = np.repeat(start, parts) + shift, np.minimum(np.repeat(size, parts) - shift, SPAN)
    return start, size, least[start]


def _grams(b: np.ndarray, k: int) -> np.ndarray:
    sums, down = prefix(b)
    n = len(b) - k + 1
    return mix((sums[k:] - sums[:n]) * down[:n])


def documents(rows: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for b in rows:
        for doc, text in zip(b.column("__id").to_pylist(), b.column("__text"), strict=True):
            yield doc, text.as_py().encode("utf-8", "surrogatepass")


def _parts(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number of its unit in the file, rows); a text that would take a unit over so many bytes begins the next one.

    Only rows and their order count, so that every job cuts a file at the same places.
    """
    import pyarrow.compute as pc

    unit = size = 0
    for b in batches:
        lo = 0
        for i, n in enumerate(pc.binary_length(b.column("__text")).to_pylist()):
            if size and size + n > most:
                if i > lo:
                    yield unit, b.slice(lo, i - lo)
                unit, size, lo = unit + 1, 0, i
            size += n
        yield unit, b.slice(lo)


class Corpus:
    """The stored copy: what every job needs to read its unit."""

    def __init__(self, folder: str, paths: list[str], size: int):
        self.folder, self.paths, self.unit_bytes = folder, paths, UNIT_BYTES
        buckets = lambda each: int(max(1, size // each))
        self.hash_buckets, self.segment_buckets = buckets(HASH_BUCKET), buckets(SEGMENT_BUCKET)

    @staticmethod
    def store(docs: DataFrame) -> Corpus:
        spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "suffix")
        docs.write.option("compression", "zstd").option("maxRecordsPerFile", UNIT_ROWS).option("parquet.block.size", UNIT_BYTES).parquet(f"{folder}/rows")
        size = spark.read.parquet(f"{folder}/rows").agg(F.sum(F.octet_length("__text"))).first()[0] or 0
        from pyarrow import fs

        system, path = open_fs(f"{folder}/rows")
        return Corpus(folder, sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")), size)

    def files(self, spark) -> DataFrame:
        n = max(1, len(self.paths))
        return spark.range(0, len(self.paths), 1, n)

    def units(self, batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ("__id", "__text")) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
        """The units of a task's files, one after another, each with its rows, which are to be read before the next unit's."""
        import pyarrow.parquet as pq

        system, _ = open_fs(self.folder)
        for b in batches:
            for file in b.column(0).to_pylist():
                with system.open_input_file(self.paths[file]) as f:
                    rows = pq.ParquetFile(f).iter_batches(batch_size=READ_ROWS, columns=list(columns))
                    for part, own in groupby(_parts(rows, self.unit_bytes), lambda x: x[0]):
                        yield file << PART_BITS | part, (r for _, r in own)
                        trimmed()

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Hashes as bucket and REST_BITS of the rest; two that share a code are only sent in vain."""
        n = np.uint64(self.hash_buckets)
        return (h % n) << np.uint64(REST_BITS) | (h // n) & np.uint64((1 << REST_BITS) - 1)

    def hashes(self, rows: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        """(distinct codes of a unit's minimizers, 1: of two ids or more, 2: in HOT texts or more)."""
        ids, values = [], []
        for doc, raw in documents(rows):
            values.append(np.unique(self.codes(segments(raw)[2])))
            ids.append(doc)
        if not sum(map(len, values)):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        h, d = np.concatenate(values), np.repeat(np.array(ids, np.int64), [len(v) for v in values])
        del values
        order = np.argsort(h)
        h, d = h[order], d[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        return h[first], several.astype(np.uint64) | (np.diff(np.r_[first, len(h)]) >= HOT).astype(np.uint64) << np.uint64(1)

    def table(self, name: str, unit: int) -> list[dict]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, path = open_fs(f"{self.folder}/{name}/unit={unit}")
        out = []
        for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if x.path.endswith(".parquet"):
                with system.open_input_file(x.path) as f:
                    out += pq.ParquetFile(f).read().to_pylist()
        return out

    def told(self, unit: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes of repeated minimizers, of hot ones), both sorted."""
        rows = self.table("told", unit)
        return tuple(np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r[c], np.uint64) for r in rows]])) for c in ("repeated", "hot"))

    def repeated(self, raw: bytes, told) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, bucket) of the segments whose minimizer is repeated."""
        start, size, least = segments(raw)
        codes = self.codes(least)
        use = _among(codes, told[0])
        start, size, least, codes = start[use], size[use], least[use], codes[use]
        hot = _among(codes, told[1])
        if hot.any():
            n = np.where(hot, size, 1)
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            alone = np.repeat(hot, n)
            start, size, least = np.repeat(start, n) + shift, np.where(alone, 1, np.repeat(size, n)), np.repeat(least, n)
            own = _grams(np.frombuffer(raw, np.uint8), MATCH)
            least = np.where(alone, own[start], least)
        return start, size, (mix(least) % np.uint64(self.segment_buckets)).astype(np.int64)


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _alike(distinct: list[bytes]) -> np.ndarray:
    """Which segments share their minimizer, the smallest hash of their GRAM-byte strings, with another one."""
    sizes = np.array([len(s) for s in distinct], np.int64)
    ends = np.cumsum(sizes)
    grams = np.concatenate([_grams(np.frombuffer(b"".join(distinct), np.uint8), GRAM), np.zeros(GRAM - 1, np.uint64)])
    at = (ends[:, None] - np.arange(1, GRAM)).ravel()
    grams[at] = np.iinfo(np.uint64).max  # they would run into the next segment
    _, which, count = np.unique(np.minimum.reduceat(grams, ends - sizes), return_inverse=True, return_counts=True)
    return count[which] > 1


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of the runs of equal values."""
    if len(values):
        at = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        yield from ((int(values[a]), a, b) for a, b in zip(at[:-1], at[1:], strict=True))


def _row(names: str, *values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], [n for n, _ in fields])


def _repeated_hashes(spark, corpus: Corpus) -> None:
    """Step 1: writes which of its minimizers are repeated, and which are hot, for each unit."""
    shape = "p int, unit long, blob binary"

    def deal(batches):
        for unit, rows in corpus.units(batches):
            h, flags = corpus.hashes(rows)
            packed = (h & np.uint64((1 << REST_BITS) - 1)) << np.uint64(2) | flags
            five = packed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            for p, lo, hi in _runs(h >> np.uint64(REST_BITS)):
                yield _row(shape, p, unit, five[lo:hi].tobytes())

    def tell(pdf):
        import pandas as pd

        parts = []
        for blob in pdf["blob"]:
            wide = np.zeros((len(blob) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
            parts.append(wide.view("<u8").ravel())
        x = np.concatenate(parts)
        rest = x >> np.uint64(2)
        order = np.argsort(rest)
        r = rest[order]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        flags = np.bitwise_or.reduceat(x[order] & np.uint64(3), first)
        repeated = r[first][(np.diff(np.r_[first, len(r)]) > 1) | (flags & np.uint64(1) > 0)]
        hot = r[first][flags >= np.uint64(2)]
        rows = []
        for unit, p, own in zip(pdf["unit"], pdf["p"], parts, strict=True):
            own = own >> np.uint64(2)
            code = own | np.uint64(p) << np.uint64(REST_BITS)
            use = _among(own, repeated)
            rows.append((unit, code[use].tobytes(), code[use & _among(own, hot)].tobytes()))
        return pd.DataFrame(rows, columns=["unit", "repeated", "hot"])

    dealt = corpus.files(spark).mapInArrow(deal, shape)
    told = dealt.groupBy("p").applyInPandas(tell, "unit long, repeated binary, hot binary")
    told.repartition("unit").write.option("compression", "zstd").partitionBy("unit").parquet(f"{corpus.folder}/told")


def _matches(spark, corpus: Corpus) -> None:
    """Step 2: writes, for each unit and bucket, a bit for each window of each segment that was sent."""
    shape = "q int, unit long, part int, ids binary, lengths binary, bytes binary"

    def send(batches):
        for unit, rows in corpus.units(batches):
            whole = Sent(corpus, unit, rows)
            whole.keep()
            for q, part, ids, sent in whole.parts():
                yield _row(shape, q, unit, part, ids.tobytes(), np.array([len(s) for s in sent], np.uint8).tobytes(), b"".join(sent))

    def match(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["unit", "part"], kind="stable")
        ids, names = [np.frombuffer(x, np.int64) for x in pdf["ids"]], []
        for sizes, data in zip(pdf["lengths"], pdf["bytes"], strict=True):
            ends = np.cumsum(np.frombuffer(sizes, np.uint8).astype(np.int64))
            names += [data[e - n : e] for e, n in zip(ends.tolist(), sizes, strict=True)]
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(s, len(known)) for s in names], np.int64)
        doc = np.concatenate(ids)
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        distinct = list(known)
        windows = np.array([len(s) - MATCH + 1 for s in distinct], np.int64)
        first = np.cumsum(windows) - windows
        smallest = np.repeat(least, windows)
        # a segment that is alone with its minimizer shares no window with another; the index has all others
        several = _alike(distinct)
        if several.any():
            some = [s for s, use in zip(distinct, several.tolist(), strict=True) if use]
            smallest[np.repeat(several, windows)] = RunIndex(some, least[several]).smallest(some, np.iinfo(np.int64).max)
        n = windows[which]
        row = np.repeat(np.arange(len(which)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        earlier = smallest[first[which[row]] + j] < doc[row]
        masks = np.bincount(row, np.where(earlier, 1 << j, 0), len(which)).astype(np.uint32)
        ends = np.cumsum([len(x) for x in ids])
        out = [(u, q, p, masks[e - len(x) : e].tobytes()) for u, q, p, x, e in zip(pdf["unit"], pdf["q"], pdf["part"], ids, ends, strict=True)]
        trimmed()
        return pd.DataFrame(out, columns=["unit", "q", "part", "masks"])

    sent = corpus.files(spark).mapInArrow(send, shape)
    found = sent.groupBy("q").applyInPandas(match, "unit long, q int, part int, masks binary")
    found.repartition("unit").write.option("compression", "zstd").partitionBy("unit").parquet(f"{corpus.folder}/masks")


class Sent:
    """A unit's distinct repeated segments by bucket, with the smallest id that each has in the unit.

    `found` keeps, of each document in turn, its segments' first windows and sizes, and which segments they are.
    """

    def __init__(self, corpus: Corpus, unit: int, rows: Iterable[pa.RecordBatch]):
        self.corpus, self.unit = corpus, unit
        told, known, ids, buckets = corpus.told(unit), {}, [], []
        self.found: list[tuple[np.ndarray, ...]] = []
        for doc, raw in documents(rows):
            start, size, bucket = corpus.repeated(raw, told)
            places = []
            for a, z, q in zip(start.tolist(), (start + size + MATCH - 1).tolist(), bucket.tolist(), strict=True):
                at = known.setdefault(raw[a:z], len(ids))
                if at == len(ids):
                    ids.append(doc)
                    buckets.append(q)
                elif doc < ids[at]:
                    ids[at] = doc
                places.append(at)
            self.found.append((start.astype(np.int32), size.astype(np.int8), np.array(places, np.int32)))
        self.buckets = np.array(buckets, np.int64)
        self.order = np.argsort(self.buckets, kind="stable")
        self.least, self.segments = np.array(ids, np.int64)[self.order], list(known)

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, list[bytes]]]:
        step = max(1, ROW_BYTES // (MATCH + SPAN))
        for q, lo, hi in _runs(self.buckets[self.order]):
            for k in range(lo, hi, step):
                end = min(hi, k + step)
                yield q, (k - lo) // step, self.least[k:end], [self.segments[i] for i in self.order[k:end].tolist()]

    def keep(self) -> None:
        """Writes what the last step needs to know of the segments; renamed when whole, so that attempts do not mix."""
        n = np.array([len(f[0]) for f in self.found], np.int64)
        start, size, place = (np.concatenate([np.zeros(0, kind), *[f[i] for f in self.found]]) for i, kind in enumerate((np.int32, np.int8, np.int32)))
        rank = np.empty(len(self.order), np.int32)
        rank[self.order] = np.arange(len(self.order), dtype=np.int32)
        columns = {"rows": n, "start": start, "size": size, "place": rank[place], "least": self.least}
        table = pa.table({"name": list(columns), "data": [x.tobytes() for x in columns.values()]})
        import pyarrow.parquet as pq

        system, path = open_fs(f"{self.corpus.folder}/found")
        system.create_dir(path, recursive=True)
        own = f"{path}/_{self.unit}-{uuid.uuid4().hex}"
        with system.open_output_stream(own) as f:
            pq.write_table(table, f, compression="zstd")
        system.move(own, f"{path}/{self.unit}.parquet")


class Found:
    """What keep() wrote of a unit, with the answers of step 2."""

    def __init__(self, corpus: Corpus, unit: int):
        import pyarrow.parquet as pq

        system, path = open_fs(f"{corpus.folder}/found/{unit}.parquet")
        with system.open_input_file(path) as f:
            data = dict(zip(*[c.to_pylist() for c in pq.ParquetFile(f).read().columns], strict=True))
        read = lambda name, kind: np.frombuffer(data[name], kind)
        self.least = read("least", np.int64)
        self.first = np.r_[0, np.cumsum(read("rows", np.int64))]
        self.start, self.size = read("start", np.int32), read("size", np.int8)
        self.at = read("place", np.int32)
        by: dict[int, list] = {}
        for r in corpus.table("masks", unit):
            by.setdefault(r["q"], []).append((r["part"], np.frombuffer(r["masks"], np.uint32)))
        masks = [np.concatenate([m for _, m in sorted(by[q], key=lambda x: x[0])]) for q in sorted(by)]
        self.bits = np.concatenate([np.zeros(0, np.uint32), *masks]).astype(np.int64)

    def mark(self, row: int, doc: int, length: int) -> np.ndarray:
        """Which bytes of the unit's row go."""
        part = slice(self.first[row], self.first[row + 1])
        start, size, at = self.start[part].astype(np.int64), self.size[part].astype(np.int64), self.at[part]
        # where an earlier document of the unit has the whole segment, all its windows go
        hits = np.where(self.least[at] < doc, (1 << size) - 1, self.bits[at])
        use = hits > 0
        if not use.any():
            return np.zeros(length, bool)
        start, size, hits = start[use], size[use], hits[use]
        j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        window = np.zeros(length + 1, np.int32)
        window[(np.repeat(start, size) + j)[(np.repeat(hits, size) >> j) & 1 > 0] + 1] = 1
        before = np.cumsum(window)  # of the windows that start before each byte
        out = before[1:].copy()
        out[MATCH:] -= before[1 : length - MATCH + 1]
        return out > 0


def _indexed(docs: DataFrame, key: str, text: str, extra: list) -> Corpus:
    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"), *extra)
    corpus = Corpus.store(d)
    _repeated_hashes(docs.sparkSession, corpus)
    _matches(docs.sparkSession, corpus)
    return corpus


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spark, corpus = docs.sparkSession, _indexed(docs, key, text, [])

    def read(batches):
        for unit, texts in corpus.units(batches):
            mark, rows = Found(corpus, unit).mark, []
            for i, (doc, raw) in enumerate(documents(texts)):
                gone = mark(i, doc, len(raw))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((None if doc == NULL_ID else doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = cut(corpus.files(spark).mapInArrow(read, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    removed(spark, corpus.folder)
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The documents with their own columns, without the removed bytes; a character that lost a byte goes as well.

    The column of character counts, where there is one, follows the text.
    """
    spark = docs.sparkSession
    corpus = _indexed(docs, key, text, [whole_row(docs).alias("__row")])
    kept = docs.select(whole_row(docs).alias("__row"), F.lit("").alias("__kept"))

    def read(batches):
        for unit, parts in corpus.units(batches, ("__id", "__text", "__row")):
            mark, row = Found(corpus, unit).mark, 0
            for rows in parts:
                out = []
                for doc, t in zip(rows.column("__id").to_pylist(), rows.column("__text"), strict=True):
                    raw = t.as_py().encode("utf-8", "surrogatepass")
                    gone = mark(row, doc, len(raw))
                    row += 1
                    out.append(np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") if gone.any() else t.as_py())
                yield pa.RecordBatch.from_arrays([rows.column("__row"), pa.array(out, pa.string())], ["__row", "__kept"])

    d = corpus.files(spark).mapInArrow(read, kept.schema)
    new = F.when(F.col(f"__row.{text}").isNotNull(), F.col("__kept"))
    values = {text: new} | ({chars: F.when(F.col("__kept") == F.col(f"__row.{text}"), F.col(f"__row.{chars}")).otherwise(F.char_length(new).cast(docs.schema[chars].dataType))} if chars in docs.columns else {})
    return d.select(*[values.get(c, F.col(f"__row.{quoted(c)}")).alias(c) for c in docs.columns])
