"""Mixing sources to target weights by hash-threshold histograms.

A document's words are counted once into a small table (source, size, hash). Sizes are summed by source and hash
bucket; the running sum finds the bucket in which a source's budget runs out; only that bucket's rows are summed again
by finer buckets, and last by single hashes. The outcome is a few numbers for each source, so documents are chosen by
comparing their hash with a threshold: nothing is sorted, and no row is collected.

What a first threshold leaves of a budget (less than one document) goes to a second and a third threshold, over the
documents that still fit into the rest.

Defined cases: a null text has no words; null sources are one source, sorted last; a null id hashes like "null";
rows with equal ids and sources go together; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objgrove.llm.common import WORD, cut, whole_row

CAP = 3
WEIGHTS = (1, 2, 3)
HASH_BITS = 60
#: The histograms' bits, from the top; single hashes come after them.
BITS = (12, 12)
ROUNDS = 3
#: Up to so many sources, their numbers are broadcast; beyond it the join is left to Spark.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(key: Column) -> Column:
    """60 bits of MD5, which DuckDB can compute as well."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target): total shared by weight, at most cap times a source's size.

    Sorted by size over weight, the capped sources are a prefix, so running sums find them without iterating. This
    window holds one row a source.
    """
    n, wide = len(weights), lambda c: c.cast("decimal(19,0)")
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(rank) - 1)
    s = s.withColumn("w", F.get(F.array(*map(F.lit, weights)), (F.col("rank") % n).cast("int")).cast("long"))
    lcm = F.lit(1)
    for w in set(weights):
        lcm = lcm * w
    order = Window.orderBy(F.col("source_size") * (lcm / F.col("w")).cast("long"), "rank")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({
        "total": F.sum("source_size").over(every), "all_w": F.sum("w").over(every),
        "c_before": F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    s = s.withColumn("capped", wide(F.col("total") - F.col("c_before")) * wide(F.col("w")) > wide(cap * F.col("source_size")) * wide(F.col("all_w") - F.col("w_before")))
    num = F.col("total") - F.sum(F.when(F.col("capped"), cap * F.col("source_size")).otherwise(0)).over(every)
    den = F.col("all_w") - F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(every)
    s = s.withColumns({"num": num, "den": den})
    share = (F.col("w") * F.col("num")).cast("double") / F.col("den").cast("double")
    return s.select("source", "source_size", F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def threshold(rows: DataFrame, budgets: DataFrame, join) -> DataFrame:
    """(source, size, h) and (source, rest) to (source, t, used): rows with h <= t sum to used, the most that rest allows.

    A source whose rows all fit gets the largest hash.
    """
    top = (1 << HASH_BITS) - 1
    out, edge, shift = None, budgets.select("source", F.lit(0).cast("long").alias("b"), "rest", F.lit(0).cast("long").alias("used")), HASH_BITS
    for bits in (*BITS, None):
        upper, shift = shift, 0 if bits is None else shift - bits
        r = rows.withColumns({"b": F.shiftright("h", upper), "b2": F.shiftright("h", shift)})
        r = join(r, edge, ["source", "b"])
        sums = r.groupBy("source", "b", "b2").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("used").alias("used"))
        run = Window.partitionBy("source", "b").orderBy("b2").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("sum", F.col("used") + F.sum("size").over(run))
        # of each source: what the buckets before the boundary hold, and the boundary, if there is one
        found = sums.groupBy("source").agg(
            F.first("rest").alias("rest"), F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum"))).alias("fit"), F.max(F.when(F.col("sum") <= F.col("rest"), F.col("b2"))).alias("last"),
            F.min(F.when(F.col("sum") > F.col("rest"), F.col("b2"))).alias("over"), F.first("used").alias("was"),
        )
        found = found.withColumn("used", F.coalesce("fit", "was"))
        t = F.when(F.col("over").isNull(), F.lit(top)).otherwise(F.shiftleft(F.col("over"), shift) - 1)
        done = found.where(F.col("over").isNull() if bits is not None else F.lit(True)).select("source", t.alias("t"), "used")
        out = done if out is None else out.unionByName(done)
        edge = found.where(F.col("over").isNotNull()).select("source", F.col("over").alias("b"), "rest", "used")
    return out


def picked(size: Column, h: Column) -> Column:
    """Whether a row gets one copy more than its source's base, given its source's plan."""
    out = F.lit(False)
    for i in range(ROUNDS):
        out = out | (h <= F.col(f"t{i}")) & (size <= F.col(f"rest{i}"))
    return F.coalesce(out & (F.col("base") < CAP), F.lit(False))


def null_safe(broadcast: bool):
    def join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        right = right.withColumnsRenamed({c: f"__{c}" for c in on})
        right = F.broadcast(right) if broadcast else right
        same = [left[c].eqNullSafe(right[f"__{c}"]) for c in on]
        return left.join(right, same).drop(*[f"__{c}" for c in on])

    return join


def table(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_hash(F.col(key)).alias("h"))


def plan(rows: DataFrame, weights=WEIGHTS, cap: int = CAP) -> tuple[DataFrame, object]:
    """(doc_id, source, size, h), read several times, to one row a source: target, base copies, thresholds and rests."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    p = cut(targets(sizes, weights, cap))
    join = null_safe(p.count() <= BROADCAST_SOURCES)
    p = p.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    p = p.withColumn("rest0", F.floor(F.col("target") - F.col("base") * F.col("source_size")).cast("long"))
    for i in range(ROUNDS):
        free = join(rows, p, ["source"]).where(F.col("size") <= F.col(f"rest{i}"))
        for j in range(i):
            free = free.where((F.col("h") > F.col(f"t{j}")) | (F.col("size") > F.col(f"rest{j}")))
        t = threshold(free.select("source", "size", "h"), p.select("source", F.col(f"rest{i}").alias("rest")), join)
        t = t.withColumnsRenamed({"source": "__s", "t": f"t{i}"})
        p = p.join(t, p["source"].eqNullSafe(t["__s"]), "left").drop("__s")
        p = p.withColumns({f"t{i}": F.coalesce(f"t{i}", F.lit(-1)), f"rest{i + 1}": F.col(f"rest{i}") - F.coalesce("used", F.lit(0))}).drop("used")
        p = cut(p)
    return p, join


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken, and copies, of every row."""
    rows = cut(table(docs, key, source, text))
    p, join = plan(rows)
    copies = F.col("base") + picked(F.col("size"), F.col("h")).cast("long")
    return join(rows, p, ["source"]).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns."""
    rows = cut(table(docs, key, source, text))
    p, join = plan(rows)
    d = docs.select(whole_row(docs).alias("row"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_hash(F.col(key)).alias("h"))
    d = join(d, p, ["source"])
    copies = F.col("base") + picked(F.col("size"), F.col("h")).cast("long")
    return d.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
c AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS all_w,
             coalesce(sum(3 * source_size) OVER o, 0)::BIGINT AS c_before, coalesce(sum(w) OVER o, 0)::BIGINT AS w_before
      FROM r WINDOW o AS (ORDER BY source_size * (6 // w), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, (total - c_before)::HUGEINT * w > (3 * source_size)::HUGEINT * (all_w - w_before) AS capped FROM c),
n AS (SELECT *, total - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER () AS num, all_w - sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS den FROM k),
t AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (w * num)::DOUBLE / den::DOUBLE END AS target FROM n),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
q AS (SELECT *, floor(target - base * source_size)::BIGINT AS rest0 FROM p),
d0 AS (SELECT d.*, source_size, target, base, rest0 FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
c0 AS (SELECT *, size <= rest0 AND sum(CASE WHEN size <= rest0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= rest0 AS p0 FROM d0),
d1 AS (SELECT *, rest0 - sum(CASE WHEN p0 THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest1 FROM c0),
c1 AS (SELECT *, NOT p0 AND size <= rest1 AND sum(CASE WHEN NOT p0 AND size <= rest1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= rest1 AS p1 FROM d1),
d2 AS (SELECT *, rest1 - sum(CASE WHEN p1 THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest2 FROM c1),
c2 AS (SELECT *, NOT p0 AND NOT p1 AND size <= rest2 AND sum(CASE WHEN NOT p0 AND NOT p1 AND size <= rest2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= rest2 AS p2 FROM d2)
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN base < 3 AND (p0 OR p1 OR p2) THEN 1 ELSE 0 END))::BIGINT AS taken,
       (base + CASE WHEN base < 3 AND (p0 OR p1 OR p2) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c2
"""
