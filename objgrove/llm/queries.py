"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from objgrove.llm.fingerprints import fingerprints

    return fingerprints(documents(spark, sf_dir))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from objgrove.llm.media import media

    return media(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from objgrove.llm.mixing import mix

    return mix(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from objgrove.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir))


def op5_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from objgrove.llm.quality import quality

    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from objgrove.llm.suffix import removals

    return removals(documents(spark, sf_dir))


def op7_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, and the one it would have were the last shard gone."""
    from objgrove.llm.sharding import SHARDS, place

    d = documents(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return place(place(d, "doc_id"), "doc_id", SHARDS[:-1], to="shard_without_last")


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from objgrove.llm.toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from objgrove.llm.jaccard import similar_documents

    return similar_documents(documents(spark, sf_dir))


def op10_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts are the target, all documents the background."""
    from objgrove.llm.lm_scoring import cross_entropy_difference

    return cross_entropy_difference(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_winnowing, op2_media, op3_mixing, op4_packing, op5_neighbour_quality, op6_run_index_dedup, op7_lookup_sharding, op8_compression_toxicity, op9_chosen_path_join, op10_entropy_difference)
}


#: Strings of 50 bytes by their hexadecimal text; spans are islands of matches.
REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
m AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first_id < doc_id),
e AS (SELECT *, CASE WHEN i <= lag(i) OVER o + 50 THEN 0 ELSE 1 END AS opens FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
spans AS (SELECT doc_id, span, min(i) AS lo, max(i) + 50 AS hi FROM g GROUP BY doc_id, span),
gaps AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM spans
         UNION ALL SELECT d.doc_id, coalesce(max(hi), 0), any_value(n) FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""

#: Shingles of five words, all pairs that share one, and a walk along the links.
NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * common >= 4 * (x.n + y.n - common)
          UNION ALL SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.doc_id <> y.doc_id WHERE len(x.w) = 0 AND len(y.w) = 0),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, links.b FROM r JOIN links ON links.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a)
SELECT c.doc_id, class_id, (SELECT count(*) FROM links WHERE links.a = c.doc_id) AS n_links FROM c
"""


def placement_sql() -> str:
    """The tables as lists: what SQL checks is the hash and the look-up; a test holds the tables against their definition."""
    from objgrove.llm.sharding import SHARDS, TABLE_SIZE, fill

    lists = [str(fill(names).tolist()) for names in (SHARDS, SHARDS[:-1])]
    name = lambda t: f"'shard-' || lpad(t.{t}[slot + 1]::VARCHAR, 3, '0')"
    return f"""WITH t AS (SELECT {lists[0]} AS a, {lists[1]} AS b),
d AS (SELECT doc_id, strlen(text)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, n_bytes, {name("a")} AS shard, {name("b")} AS shard_without_last FROM d, t"""


def oracle() -> dict[str, str]:
    from objgrove.llm import mixing

    return {"op3_mixing": mixing.SQL, "op6_run_index_dedup": REPEATS_SQL, "op7_lookup_sharding": placement_sql(), "op9_chosen_path_join": NEAR_SQL}
