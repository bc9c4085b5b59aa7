"""Packs: varints, deltas, reading and writing, as bytes and as Spark sources and sinks."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objgrove import schema as S
from objgrove.lineage import cut
from objgrove.schema import FormatError


def object_id(kind: str, content: bytes) -> str:
    return hashlib.sha1(b"%s %d\0%s" % (kind.encode(), len(content), content)).hexdigest()


def write_header(code: int, size: int) -> bytes:
    """Type and size: four size bits in the first byte, seven in each that follows."""
    out, size = [code << 4 | size & 15], size >> 4
    while size:
        out[-1] |= 128
        out.append(size & 127)
        size >>= 7
    return bytes(out)


def read_header(data: bytes, at: int) -> tuple[int, int, int]:
    """(code, size, next position)."""
    b = data[at]
    code, size, shift, at = b >> 4 & 7, b & 15, 4, at + 1
    while b & 128:
        b = data[at]
        size |= (b & 127) << shift
        shift, at = shift + 7, at + 1
    return code, size, at


def read_offset(data: bytes, at: int) -> tuple[int, int]:
    """The distance back to an offset delta's base, and the next position."""
    b, at = data[at], at + 1
    value = b & 127
    while b & 128:
        b, at = data[at], at + 1
        value = (value + 1 << 7) | b & 127
    return value, at


def write_offset(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        value -= 1
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def _size(delta: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b, at = delta[at], at + 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def apply_delta(base: bytes, delta: bytes) -> bytes:
    try:
        return _applied(base, delta)
    except IndexError:
        raise FormatError("delta-target-size-mismatch", "the delta ends early") from None


def _applied(base: bytes, delta: bytes) -> bytes:
    source, at = _size(delta, 0)
    target, at = _size(delta, at)
    if source != len(base):
        raise FormatError("delta-base-size-mismatch", f"{source} for {len(base)}")
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 128:
            fields = [0] * 7
            for i in range(7):
                if op >> i & 1:
                    fields[i], at = delta[at], at + 1
            start, n = int.from_bytes(bytes(fields[:4]), "little"), int.from_bytes(bytes(fields[4:]), "little") or 0x10000
            out += base[start : start + n]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise FormatError("delta-reserved-opcode")
    if len(out) != target:
        raise FormatError("delta-target-size-mismatch", f"{len(out)} for {target}")
    return bytes(out)


def write_pack(objects: list[tuple[str, bytes]]) -> bytes:
    """A version 2 pack of whole objects."""
    body = [b"PACK", struct.pack(">II", 2, len(objects))]
    body += [write_header(S.TYPE_CODES[kind], len(content)) + zlib.compress(content) for kind, content in objects]
    data = b"".join(body)
    return data + hashlib.sha1(data).digest()


def _inflated(pack: bytes, at: int, end: int, size: int = 0) -> tuple[bytes, int]:
    """(content, where the next entry starts). Slices go in one by one, so that no entry copies the rest of the pack."""
    d, view, out, step = zlib.decompressobj(), memoryview(pack), [], min(size + 64, SLICE)
    try:
        while not d.eof and at < end:
            part = view[at : min(end, at + step)]
            out.append(d.decompress(part))
            at, step = at + len(part), SLICE
    except zlib.error as e:
        raise FormatError("inflate-failed", str(e)) from None
    if not d.eof:
        raise FormatError("inflate-failed", "the stream ends early")
    return b"".join(out), at - len(d.unused_data)


def read_pack(pack: bytes, external: Callable[[str], tuple[str, bytes] | None] = lambda oid: None) -> list[tuple[str, bytes]]:
    """(type, content) of a pack's objects, in its order.

    Deltas are resolved against entries by offset, against entries by id wherever they stand, also such that are deltas
    themselves, and against `external` objects.
    """
    if pack[:4] != b"PACK" or len(pack) < 32:
        raise FormatError("bad-magic")
    version, count = struct.unpack(">II", pack[4:12])
    if version != 2:
        raise FormatError("unsupported-version", str(version))
    end = len(pack) - 20
    if hashlib.sha1(pack[:end]).digest() != pack[end:]:
        raise FormatError("trailer-mismatch")
    entries, by_offset, at = [], {}, 12
    for i in range(count):
        start = at
        try:
            code, size, at = read_header(pack, at)
            base: object = None
            if code == S.OFS_DELTA:
                back, at = read_offset(pack, at)
                base = start - back
            elif code == S.REF_DELTA:
                base, at = pack[at : at + 20].hex(), at + 20
            elif code not in S.TYPE_NAMES:
                raise FormatError("unknown-object-type", str(code))
        except IndexError:
            raise FormatError("inflate-failed", "the pack ends early") from None
        data, at = _inflated(pack, at, end, size)
        if base is None and len(data) != size:
            raise FormatError("size-mismatch", f"{len(data)} for {size}")
        entries.append((code, base, data))
        by_offset[start] = i
    if at != end:
        raise FormatError("trailing-bytes", str(end - at))
    done: list = [(S.TYPE_NAMES[code], data) if base is None else None for code, base, data in entries]
    by_id = {object_id(*x): i for i, x in enumerate(done) if x}
    todo = [i for i, x in enumerate(done) if x is None]
    while todo:
        left = []
        for i in todo:
            _, base, delta = entries[i]
            if isinstance(base, int):
                if base not in by_offset:
                    raise FormatError("unresolved-base", str(base))
                found = done[by_offset[base]]
            else:
                found = done[by_id[base]] if base in by_id else None
            if found is None:
                left.append(i)
                continue
            done[i] = (found[0], apply_delta(found[1], delta))
            by_id.setdefault(object_id(*done[i]), i)
        if len(left) == len(todo):  # nothing inside the pack helps on
            moved = False
            for i in left:
                base = entries[i][1]
                if isinstance(base, str) and base not in by_id and (found := external(base)):
                    done[i], moved = (found[0], apply_delta(found[1], entries[i][2])), True
                    by_id.setdefault(object_id(*done[i]), i)
            if not moved:
                raise FormatError("unresolved-base", str(entries[left[0]][1]))
            left = [i for i in left if done[i] is None]
        todo = left
    return done


def external_bases(pack: bytes) -> list[str]:
    """The ids that a pack's deltas name and that no undeltified entry of it has."""
    bases, own, at, end = [], set(), 12, len(pack) - 20
    for _ in range(struct.unpack(">I", pack[8:12])[0]):
        code, size, at = read_header(pack, at)
        base = None
        if code == S.OFS_DELTA:
            base, at = read_offset(pack, at)
        elif code == S.REF_DELTA:
            base, at = pack[at : at + 20].hex(), at + 20
            bases.append(base)
        data, at = _inflated(pack, at, end, size)
        if base is None:
            own.add(object_id(S.TYPE_NAMES[code], data))
    return sorted(set(bases) - own)


#: Bytes of one of a repository's several packs.
PACK_BYTES = 16 << 20
#: A pack is closed at so many times its limit of contents, since text that repeats deflates to little.
INFLATED = 4
#: Bytes that are inflated at a time.
SLICE = 1 << 16
#: Bytes of contents in a batch of parsed objects, or one object's where that is larger.
BATCH_BYTES = 4 << 20
PARSED = "repo_id long, ordinal long, type short, oid string, size int, content binary, error string"


def parsed(packs: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """(repo_id, pack binary) to one row an object, or one row with the error's code for a malformed pack.

    `objects` are the store's, for thin packs: the bases that packs name are joined to them first, so each pack comes
    with its own bases and no task looks anything up.
    """
    p = packs.select("repo_id", "pack", F.xxhash64("pack").alias("key"))
    if objects is not None:
        need = p.select("repo_id", "key", F.explode(F.udf(_safe_bases, "array<string>")("pack")).alias("oid"))
        bases = need.join(objects.select("repo_id", "oid", "type", "content"), ["repo_id", "oid"]).groupBy("repo_id", "key").agg(F.collect_list(F.struct("oid", "type", "content")).alias("bases"))
        p = p.join(bases, ["repo_id", "key"], "left")
    else:
        p = p.withColumn("bases", F.lit(None).cast("array<struct<oid:string,type:smallint,content:binary>>"))

    return p.select("repo_id", "pack", "bases").mapInArrow(_read, PARSED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch may have many packs, so they are taken one by one, and each one's objects leave in small batches."""
    names = [x.split()[0] for x in PARSED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int16(), pa.string(), pa.int32(), pa.binary(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for at in range(b.num_rows):
            repo, data, given = (c[0].as_py() for c in b.slice(at, 1).columns)
            bases = {x["oid"]: (S.TYPE_NAMES[x["type"]], x["content"]) for x in given or ()}
            try:
                objects = read_pack(data, bases.get)
            except FormatError as e:
                yield batch([(repo, 0, None, None, None, None, e.code)])
                continue
            del data
            rows, size = [], 0
            for i, (kind, content) in enumerate(objects):
                objects[i] = None
                if rows and size + len(content) > BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
                rows.append((repo, i, S.TYPE_CODES[kind], object_id(kind, content), len(content), content, None))
                size += len(content)
            if rows:
                yield batch(rows)


def _safe_bases(pack: bytes) -> list[str]:
    try:
        return external_bases(bytes(pack))
    except Exception:  # reading it reports what is wrong
        return []


def packed(objects: DataFrame) -> DataFrame:
    """(repo_id, oid, type, content) to one pack a repository (repo_id, pack), objects by id. A pack is one cell, of 2 GB at most."""
    return _written(objects.select("repo_id", "oid", "type", "content").repartition("repo_id").sortWithinPartitions("repo_id", "oid"), None)


def streamed(objects: DataFrame) -> Iterator[bytes]:
    """One pack of (repo_id, oid, type, content) in pieces: tasks deflate, and the driver holds a partition of entries at a time."""

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entries = [write_header(t, len(c)) + zlib.compress(c) for t, c in zip(b.column("type").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.binary())], ["entry"])

    chosen = cut(objects.select("oid", "type", "content"))
    digest, head = hashlib.sha1(), b"PACK" + struct.pack(">II", 2, chosen.count())
    digest.update(head)
    yield head
    for r in chosen.orderBy("oid").select("type", "content").mapInArrow(deflate, "entry binary").toLocalIterator():
        digest.update(r[0])
        yield bytes(r[0])
    yield digest.digest()


def packed_in_parts(objects: DataFrame, limit: int = PACK_BYTES) -> DataFrame:
    """(repo_id, oid, type, content) to packs (repo_id, pack) of about `limit` bytes and INFLATED times as many of contents, or
    of one object where that is larger.

    Tasks take ranges of (repository, id) and close a pack at the limit or the repository's end, so a repository of any
    size is whole in several packs, and a task holds one at a time.
    """
    return _written(objects.select("repo_id", "oid", "type", "content").repartitionByRange("repo_id", "oid").sortWithinPartitions("repo_id", "oid"), limit)


def _written(dealt: DataFrame, limit: int | None) -> DataFrame:
    """Rows by repository to packs of up to a limit."""

    def pack(entries: list[bytes]) -> bytes:
        data = b"".join([b"PACK", struct.pack(">II", 2, len(entries)), *entries])
        return data + hashlib.sha1(data).digest()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, entries, size, inflated = None, [], 0, 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([repo], pa.int64()), pa.array([pack(entries)], pa.binary())], ["repo_id", "pack"])

        for b in batches:
            for r, code, content in zip(b.column("repo_id").to_pylist(), b.column("type").to_pylist(), b.column("content"), strict=True):
                content = content.as_py()
                entry = write_header(code, len(content)) + zlib.compress(content)
                if entries and (r != repo or limit and (size + len(entry) > limit or inflated + len(content) > INFLATED * limit)):
                    yield closed()
                    entries, size, inflated = [], 0, 0
                repo, size, inflated = r, size + len(entry), inflated + len(content)
                entries.append(entry)
        if entries:
            yield closed()

    return dealt.mapInArrow(write, "repo_id long, pack binary")
