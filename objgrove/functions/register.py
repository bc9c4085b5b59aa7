"""The codecs as SQL functions: git_oid, apply_delta; and as table functions: tree_entries, read_pack, pkt_lines."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from objgrove import schema as S
from objgrove.sources import packs, wire


def git_oid(kind: str | None, content: bytes | None) -> str | None:
    return None if kind is None or content is None else packs.object_id(kind, bytes(content))


def apply_delta(base: bytes | None, delta: bytes | None) -> bytes | None:
    """Null for a null or malformed argument, so that one bad delta does not end a query."""
    if base is None or delta is None:
        return None
    try:
        return packs.apply_delta(bytes(base), bytes(delta))
    except S.FormatError:
        return None


class TreeEntries:
    def eval(self, content: bytes):
        data, at = bytes(content or b""), 0
        while at < len(data):
            space = data.find(b" ", at)
            end = data.find(b"\0", space)
            if space < 0 or end < 0 or end + 21 > len(data):
                raise S.FormatError("malformed-tree")
            yield data[at:space].decode("ascii", "replace"), data[space + 1 : end].decode("utf-8", "replace"), data[end + 1 : end + 21].hex()
            at = end + 21


class ReadPack:
    """A malformed pack is one row with its error's code."""

    def eval(self, pack: bytes):
        try:
            rows = packs.read_pack(bytes(pack or b""))
        except S.FormatError as e:
            yield None, None, None, None, e.code
            return
        for i, (kind, content) in enumerate(rows):
            yield i, kind, packs.object_id(kind, content), content, None


class PacketLines:
    """What is left over comes last, as kind `rest`."""

    def eval(self, data: bytes):
        found, rest = wire.decode(bytes(data or b""))
        yield from found
        if rest:
            yield "rest", rest


def register(spark: SparkSession) -> None:
    spark.udf.register("git_oid", git_oid, "string")
    spark.udf.register("apply_delta", apply_delta, "binary")
    spark.udtf.register("tree_entries", udtf(TreeEntries, returnType="mode string, name string, oid string"))
    spark.udtf.register("read_pack", udtf(ReadPack, returnType="ordinal int, type string, oid string, content binary, error string"))
    spark.udtf.register("pkt_lines", udtf(PacketLines, returnType="kind string, payload binary"))
