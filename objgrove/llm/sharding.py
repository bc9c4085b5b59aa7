"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of a prime-sized table (an offset and a step from its name's hash). Shards take
turns claiming the next free slot of their permutation until the table is full, so their shares differ by one slot at
most, and a removed shard moves little beyond its own slots. The table has TABLE_SIZE rows whatever the data, so it is
broadcast, and a row's shard is one look-up of its key's hash.

Defined cases: a null key hashes like the word "null"; equal keys share a shard, repeated rows are placed each for itself;
other columns are kept, whatever their names, nulls and long texts in them too, but one of the new column's name is
replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objgrove.llm.common import quoted, whole_row

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def fill(shards, size: int = TABLE_SIZE) -> np.ndarray:
    """The table: the index of the shard that owns each slot."""
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime")
    if not 0 < len(shards) <= size or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and fit into the table")
    number = lambda name, salt: int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")
    at = [number(s, "offset") % size for s in shards]
    step = [number(s, "step") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                return np.array(table, dtype=np.int32)


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards=SHARDS, size: int = TABLE_SIZE, to: str = "shard") -> DataFrame:
    """df with the column `to`, the name of each row's shard, last; it takes the place of a column of that name."""
    owners = fill(shards, size)
    rows = [(i, shards[k]) for i, k in enumerate(owners.tolist())]
    table = df.sparkSession.createDataFrame(rows, "slot int, owner string")
    kept = [c for c in df.columns if c != to]
    own = df.select(whole_row(df).alias("row"), slot(F.col(quoted(key)), size).alias("at"))
    out = own.join(F.broadcast(table), F.col("at") == F.col("slot"), "left")
    return out.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in kept], F.col("owner").alias(to))
