"""Media columns: content-addressed payloads in tar shards.

Each task writes its payloads as lossless 8-bit greyscale PNG members of tar shards in the shared folder, a payload once
a shard, named by the SHA-256 of its samples. Rows keep a digest, a shard, an offset and a length in place of the bytes.
Metadata columns come from range reads of a member's first 33 bytes alone. Shards are named by the writing attempt, and
only rows of attempts that succeeded are in the index, so a lost executor leaves an unreferenced file at worst.

Defined cases: a null text is an empty payload, which is stored as one row of padding; equal texts share digests and
stored bytes; texts of any length are stored whole; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objgrove.llm.common import new_folder, open_fs, stored

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
SHARD_BYTES = 256 << 20
LEVEL = 6
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def payload(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 bytes' count, and the bytes filled up with spaces to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from a member's first HEADER_BYTES bytes."""
    if len(first) < HEADER_BYTES or first[:8] != SIGNATURE or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", first[16:25])


def decode_png(data: bytes) -> bytes:
    """The samples of a file that encode_png made; every chunk's checksum is verified."""
    width, height, bits = png_header(data[:HEADER_BYTES])
    at, packed = 8, b""
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit grey images are read")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and a 64-bit average hash over 64 equal parts."""
    x = np.frombuffer(samples, np.uint8)
    parts = x.reshape(64, -1).mean(axis=1)
    bits = int("".join("1" if b else "0" for b in parts > x.mean()), 2)
    return f"mean={x.mean():.4f};std={x.std():.4f};ahash={bits:016x}"


class ShardWriter:
    """Tar shards under a folder; add() returns where a member's bytes are, once for each digest of a shard."""

    def __init__(self, folder: str, task: int, shard_bytes: int = SHARD_BYTES):
        self.folder, self.task, self.limit, self.n, self.file = folder, task, shard_bytes, 0, None

    def add(self, digest: str, make) -> tuple[str, int, int]:
        if self.file is None or self.at > self.limit:
            self.close()
            fs, path = open_fs(self.folder)
            fs.create_dir(path, recursive=True)
            name = f"shard-{self.task:06d}-{self.n:04d}-{uuid.uuid4().hex}.tar"
            self.n, self.name, self.file, self.at, self.seen = self.n + 1, f"{self.folder}/{name}", fs.open_output_stream(f"{path}/{name}"), 0, {}
        if digest not in self.seen:
            data = make()
            info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.file.write(head + data + bytes(-len(data) % 512))
            self.seen[digest] = (self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        return (self.name, *self.seen[digest])

    def close(self) -> None:
        if self.file is not None:
            self.file.write(bytes(1024))
            self.file.close()
            self.file = None


def store(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shards and their index under the folder; the index, one row a document, is read from its table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = ShardWriter(f"{folder}/shards", TaskContext.get().partitionId(), shard_bytes)
        try:
            for b in batches:
                rows = []
                for doc, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    n, data = payload(s.as_py())
                    digest = hashlib.sha256(data).hexdigest()
                    rows.append((doc, n, digest, *out.add(digest, lambda data=data: encode_png(data))))
                yield _batch(rows, INDEX)
        finally:
            out.close()

    index = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(write, INDEX)
    return stored(index, f"{folder}/index")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _ranges(index: DataFrame, added: str, need, of) -> DataFrame:
    """Adds columns that of() makes from range reads; a member's range is read once in a row batch."""
    names = index.columns
    schema = ", ".join([*[f"{c} {kind.replace('bigint', 'long')}" for c, kind in index.dtypes], added])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            rows, known, done = b.to_pylist(), {}, []
            for i in sorted(range(len(rows)), key=lambda i: (rows[i]["shard"], rows[i]["offset"])):
                r = rows[i]
                at = (r["shard"], r["offset"])
                if at not in known:
                    if r["shard"] != name:
                        if file is not None:
                            file.close()
                        fs, path = open_fs(r["shard"])
                        name, file = r["shard"], fs.open_input_file(path)
                    known[at] = of(file.read_at(need(r), r["offset"]))
                done.append((*[r[c] for c in names], *known[at]))
            yield _batch(done, schema)
        if file is not None:
            file.close()

    return index.mapInArrow(read, schema)


def with_metadata(index: DataFrame) -> DataFrame:
    """The index with width, height and bits, from header-only range reads."""
    return _ranges(index, "width int, height int, bits int", lambda r: HEADER_BYTES, png_header)


def with_content(index: DataFrame) -> DataFrame:
    """The index with what the stored bytes give when they are read back."""

    def of(data: bytes) -> tuple:
        samples = decode_png(data)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)

    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _ranges(index, added, lambda r: r["length"], of)


def media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Metadata columns are filled from headers alone; content columns take the whole member."""
    index = store(docs, new_folder(docs.sparkSession, "media"), key, text)
    return with_content(with_metadata(index)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits")
