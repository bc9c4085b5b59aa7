"""The background drain and packet decoding as streaming queries."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objgrove.operators.store import Store


def start_drain(spark: SparkSession, store: Store, checkpoint: str, interval: str = "30 seconds", grace_seconds: int = 60, on_summary=None, clock=lambda: datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)):
    """A poll loop: every interval one pass over the repositories that are due. Passes never overlap; stop() ends it.

    A failing pass is reported and leaves the store at its last version; the next one tries again.
    """

    def once(_: DataFrame, epoch: int) -> None:
        try:
            summary = store.gc(F.lit(clock()), grace_seconds)
        except Exception as e:
            print(f"drain {epoch}: {e}")
            return
        if on_summary:
            on_summary(summary)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(once).trigger(processingTime=interval).option("checkpointLocation", checkpoint).start()


def activity(events: DataFrame, pushed: str = "purchase", collected: str = "view") -> DataFrame:
    """(repo_id, last_pushed_at, last_gc_at) from an event table or stream, for the test of what is due."""
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    return events.groupBy(F.col("user_id").alias("repo_id")).agg(at(pushed).alias("last_pushed_at"), at(collected).alias("last_gc_at"))


def packets(chunks: DataFrame) -> DataFrame:
    """A stream of (connection, seq, data) chunks to (connection, kind, payload) packets.

    What a chunk leaves unfinished is a connection's state, so packets may span chunks and micro-batches.
    """
    from objgrove.sources.wire import decode

    def read(key, parts, state):
        import pandas as pd

        rest = state.get[0] if state.exists else b""
        rows = pd.concat(list(parts)).sort_values("seq")
        found, rest = decode(bytes(rest) + b"".join(rows["data"]))
        state.update((rest,))
        yield pd.DataFrame([(key[0], k, p) for k, p in found], columns=["connection", "kind", "payload"])

    return chunks.groupBy("connection").applyInPandasWithState(read, "connection string, kind string, payload binary", "rest binary", "append", "NoTimeout")
