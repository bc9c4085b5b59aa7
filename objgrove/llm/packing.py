"""Vector bin packing by the dot-product heuristic, under limits on tokens, segments and loss-bearing tokens.

An item is a vector (tokens, 1 segment, loss-bearing tokens), a bin has a limit for each of the three. An open bin takes
the waiting item whose vector has the largest dot product with what is left of the bin, both in shares of the limits,
until none fits. Where items may be cut, the item with the largest product is then cut at the tokens that are left, so
bins end full, unless their segments run out.

Items stream through each task with a bounded number waiting, so memory does not follow the partition's size, nothing
is shuffled, and a lost task packs its own rows again in the same way. A sequence's id has the task's number above
its own.

Defined cases of pack_documents: a null text is empty, and an empty text is the single id 0; repeated rows are packed
each for itself; a text of any length is cut; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
MAX_SEGMENTS = 64
#: Items that wait for a bin, at most.
WAITING = 512
TASK_SHIFT = 36


class Packer:
    """Places vectors into bins; place() and finish() yield bins as lists of (item, start, length)."""

    def __init__(self, limits=(CAPACITY, MAX_SEGMENTS, CAPACITY), cut: bool = True, waiting: int = WAITING):
        self.limits, self.cutting, self.waiting = np.array(limits, dtype=np.float64), cut, waiting
        self.vec = np.zeros((2 * waiting, 3))
        self.items: list = [None] * (2 * waiting)
        self.n = 0

    def place(self, item, tokens: int, loss: int) -> Iterator[list]:
        """Loss-bearing tokens are taken as spread evenly where an item is cut."""
        start, cap, ratio = 0, int(min(self.limits[0], self.limits[2] if loss else self.limits[0])), loss / tokens
        if not self.cutting and (tokens > self.limits[0] or loss > self.limits[2]):
            raise ValueError("an item exceeds the limits and may not be cut")
        while tokens - start >= cap and self.cutting:
            yield [(item, start, cap)]
            start += cap
        if tokens > start:
            self._wait(item, start, tokens - start, ratio)
        while self.n >= self.waiting:
            yield self._bin()

    def finish(self) -> Iterator[list]:
        while self.n:
            yield self._bin()

    def _wait(self, item, start: int, length: int, ratio: float) -> None:
        self.vec[self.n] = length, 1, length * ratio
        self.items[self.n] = (item, start, length, ratio)
        self.n += 1

    def _take(self, k: int):
        out = self.items[k]
        self.n -= 1
        self.items[k], self.vec[k] = self.items[self.n], self.vec[self.n]
        return out

    def _bin(self) -> list:
        left, out = self.limits.copy(), []
        while self.n:
            v = self.vec[: self.n]
            scores = v @ (left / self.limits**2)
            fits = (v <= left + 1e-9).all(axis=1)
            if fits.any():
                k = int(np.where(fits, scores, -1).argmax())
                used = self.vec[k].copy()
                item, start, length, _ = self._take(k)
                out.append((item, start, length))
                left -= used
                if left[0] < 1 or left[1] < 1:
                    break
                continue
            if not self.cutting or left[1] < 1:
                break
            k = int(scores.argmax())
            item, start, length, ratio = self.items[k]
            head = int(min(left[0], left[2] / ratio if ratio else left[0]))
            if head < 1:
                break
            self._take(k)
            out.append((item, start, head))
            if length > head:
                self._wait(item, start + head, length - head, ratio)
            break
        return out


def powers(pieces: list) -> Iterator[list]:
    """Cuts a bin into bins whose lengths are powers of two, the largest first."""
    total, at = sum(p[2] for p in pieces), 0
    rest = list(pieces)
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            want, out = 1 << bit, []
            while want:
                item, start, length = rest.pop(0)
                take = min(want, length)
                out.append((item, start, take))
                want -= take
                if take < length:
                    rest.insert(0, (item, start + take, length - take))
            yield out
            at += 1 << bit


def tokenizer():
    """ids of a text, as the byte-level BPE of 50,257 entries gives them without special tokens added."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = []

    def encode(text: str) -> list[int]:
        if "<|endoftext|>" in text:  # only the other library's file has this special token
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
            return slow[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", limits=(CAPACITY, MAX_SEGMENTS, CAPACITY), waiting: int = WAITING) -> DataFrame:
    """One row for each piece of each document: where it starts there, and its sequence and place in it.

    All of a document's tokens bear loss. A bin that does not end full is cut at powers of two, which need no padding.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = tokenizer(), Packer(limits, waiting=waiting)
        sequence = TaskContext.get().partitionId() << TASK_SHIFT
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rows: list[tuple] = []

        def put(bins) -> None:
            nonlocal sequence
            # a bin that ends early, for its segments or as the last one, goes on as bins of powers of two
            for pieces in (part for b in bins for part in ([b] if sum(p[2] for p in b) >= limits[0] else powers(b))):
                offset = 0
                for (doc, ids), start, length in pieces:
                    rows.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), sequence, offset))
                    offset += length
                sequence += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for doc, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(s.as_py() or ""), 0], dtype="<u4")
                put(packer.place((doc, ids), len(ids), len(ids)))
                if len(rows) >= 50_000:
                    yield out()
            yield out()
        put(packer.finish())
        yield out()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(pack, SCHEMA)


def pack_conversations(turns: DataFrame, max_tokens: int = CAPACITY, max_segments: int = 16, max_loss: int = 512, waiting: int = WAITING) -> DataFrame:
    """Conversations into bins: conv_id, part, tokens, loss_tokens, sequence_id, offset.

    Only an assistant's turns bear loss. A conversation that exceeds a limit alone is cut into the fewest equal parts that
    do not, with its loss-bearing tokens taken as spread evenly; others are one part. Turns are gathered by conversation,
    with null ids as one.
    """
    t = turns.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def count(batches):
        encode = tokenizer()
        for b in batches:
            n = [len(encode(x)) + 1 for x in b.column("text").to_pylist()]
            loss = [k if r == "assistant" else 0 for k, r in zip(n, b.column("role").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(loss, pa.int64())], ["conv_id", "tokens", "loss_tokens"])

    sizes = t.mapInArrow(count, "conv_id long, tokens long, loss_tokens long").groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))

    def pack(batches):
        from pyspark import TaskContext

        packer, sequence = Packer((max_tokens, max_segments, max_loss), cut=False, waiting=waiting), TaskContext.get().partitionId() << TASK_SHIFT
        rows: list[tuple] = []

        def put(bins):
            nonlocal sequence
            for pieces in bins:
                offset = 0
                for (conv, part, tokens, loss), _, length in pieces:
                    rows.append((conv, part, tokens, loss, sequence, offset))
                    offset += length
                sequence += 1

        names = ["conv_id", "part", "tokens", "loss_tokens", "sequence_id", "offset"]
        for b in batches:
            for conv, tokens, loss in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                n = max(1, -(-tokens // max_tokens), -(-loss // max_loss))
                for k in range(n):
                    t, bearing = (x * (k + 1) // n - x * k // n for x in (tokens, loss))
                    put(packer.place((conv, k, t, bearing), t, bearing))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                rows.clear()
        put(packer.finish())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return sizes.mapInArrow(pack, "conv_id long, part long, tokens long, loss_tokens long, sequence_id long, offset long")
