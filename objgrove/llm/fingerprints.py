"""Document fingerprints by winnowing, in DataFrame functions alone.

A text's words are hashed, every K words in a row give a rolling gram hash, and of every WINDOW grams in a row the
smallest hash is kept, the rightmost one among ties, with its position. Two texts that share K + WINDOW - 1 words in a
row therefore share a kept hash, and positions say where. A hash and its position are one long (hash above, position
counted down below), so a running minimum also breaks ties; minima over WINDOW grams come from doubling steps.

Defined cases: a null text is empty; a text without words has an empty fingerprint; a text of under K words is one gram;
two empty fingerprints are alike (1.0), an empty and another one are not (0.0); a null id sorts before all others; rows with
equal ids are ordered by text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objgrove.llm.common import WORD, let, text_or_empty

K = 5
WINDOW = 8
POSITION_BITS = 27
#: Rows of a bucket of neighbouring ids, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 1000, 20_000


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The kept (hash, position) longs, by position."""
    top = (1 << POSITION_BITS) - 1

    def grams(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))
        gram = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
        pack = lambda i: F.shiftleft(F.shiftrightunsigned(gram(i), POSITION_BITS + 1), POSITION_BITS) + (top - i)
        return F.when(F.size(words) > 0, F.transform(at, pack)).otherwise(F.array().cast("array<bigint>"))

    def step(a: Column, s: int) -> Column:
        """Minima of a's windows and of those s further on; the last ones, cut short, are dropped if there are others."""
        later = F.slice(a, s + 1, F.greatest(F.size(a) - s, F.lit(0)))
        return F.when(F.size(a) > s, let(later, lambda b: F.transform(b, lambda x, i: F.least(x, F.get(a, i))))).otherwise(F.array(F.array_min(a)))

    def stepping(s: int):
        return lambda a: step(a, s)  # a second parameter, even with a default, would be taken for an index

    out, size = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), grams)), 1
    while size < window:
        out = let(out, stepping(min(size, window - size)))
        size += min(size, window - size)
    return F.array_distinct(F.filter(out, lambda x: x.isNotNull()))


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, POSITION_BITS)))


def positions(fingerprint: Column) -> Column:
    return F.transform(fingerprint, lambda v: ((1 << POSITION_BITS) - 1) - v.bitwiseAND((1 << POSITION_BITS) - 1))


def as_text(fingerprint: Column) -> Column:
    """hash@position in hexadecimal, by position."""
    one = lambda v: F.concat(F.lower(F.hex(F.shiftright(v, POSITION_BITS))), F.lit("@"), F.lower(F.hex(((1 << POSITION_BITS) - 1) - v.bitwiseAND((1 << POSITION_BITS) - 1))))
    return F.array_join(F.transform(fingerprint, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes."""

    def of(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(n / (F.size(x) + F.size(y) - n)))

    return let(hashes(a), lambda x: let(hashes(b), lambda y: of(x, y)))


def with_next(docs: DataFrame, key: str, columns, bucket_rows: int = BUCKET_ROWS):
    """(bucketed rows, window): the next document in descending ids is the row before, over the window.

    Ids are dealt to buckets of neighbours by quantiles of the ids themselves. A bucket's largest id also goes, as a
    ghost, to the bucket above it, and the largest of all to the lowest, so every row's predecessor is in its bucket.
    """
    n = docs.count()
    buckets = max(1, min(MAX_BUCKETS, n // bucket_rows))
    parts = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.max(key), F.percentile_approx(key, parts or [0.5], 20 * max(buckets, 500))).first()
    top, bounds = found[0], sorted({x for x in (found[1] or []) if x != found[0]}) if parts else []
    limits = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, len(bounds).bit_length())))])
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(limits, at + s - 1) < F.col(key), at + s).otherwise(at))
    here = F.struct(F.col("__b").alias("b"), F.lit(0).alias("ghost"))
    up = F.when(F.get(limits, F.col("__b")) == F.col(key), F.struct((F.col("__b") + 1).alias("b"), F.lit(1).alias("ghost")))
    wrap = F.when(F.col(key).eqNullSafe(F.lit(top).cast("long")), F.struct(F.lit(0).alias("b"), F.lit(1).alias("ghost")))
    rows = docs.select(F.col(key), *columns).withColumn("__b", below)
    rows = rows.withColumn("__at", F.explode(F.filter(F.array(here, up, wrap), lambda x: x.isNotNull())))
    rows = rows.select(F.col("__at.b").alias("__b"), F.col("__at.ghost").alias("__ghost"), key, *[c for c in rows.columns if c not in ("__b", "__at", key)])
    return rows, Window.partitionBy("__b").orderBy(F.col("__ghost").desc(), F.col(key).asc_nulls_first(), F.col("__text"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    rows, order = with_next(docs.withColumn(key, F.col(key).cast("long")), key, [text_or_empty(text).alias("__text")])
    d = rows.withColumns({"__next": F.lag("__text").over(order), "__n": F.char_length("__text").cast("long")})
    half = F.floor(F.col("__n") / 2).cast("int")
    edited = F.concat(F.left("__text", F.char_length("__text") - half), F.left("__next", half))
    d = d.withColumn("__edited", edited).withColumn("__fp", winnow(F.col("__text")))
    d = d.withColumn("__next_fp", F.lag("__fp").over(order)).where("__ghost = 0")
    d = d.withColumn("__edited_fp", winnow(F.col("__edited")))
    return d.select(
        F.col(key).alias("doc_id"), F.col("__n").alias("n_chars"), F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("__fp")).alias("fingerprint"),
        as_text(F.col("__edited_fp")).alias("edited_fingerprint"), likeness(F.col("__fp"), F.col("__edited_fp")).alias("near_edited"), likeness(F.col("__fp"), F.col("__next_fp")).alias("near_next"),
    )
