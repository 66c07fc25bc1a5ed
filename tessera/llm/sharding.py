"""Sharding (operator 2): a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, from an offset and a skip that come from its name.
Shards take turns: each claims the first slot of its permutation that is still free, until none is. Shards then hold
equally many slots, give or take one, and adding or removing a shard moves few keys. The table has a fixed size, so it
is broadcast; a row's place is one hash and one lookup.

A null key is placed like an empty text. Equal keys share a shard; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots; a prime well above the number of shards.
SLOTS = 65_537
_HEX = 15  # digits of a key's MD5 that make its number


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_HEX], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's index for every slot."""
    if not shards or len(shards) > slots or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, and shards at least one and at most slots")
    at = [_number(f"offset {s}") % slots for s in shards]
    skip = [_number(f"skip {s}") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, _HEX), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, to: str = "shard") -> DataFrame:
    """df with its columns and the name of each row's shard; a column of that name is replaced."""
    table = df.sparkSession.createDataFrame([(k, shards[i]) for k, i in enumerate(fill(shards, slots))], "__slot long, __shard string")
    out = df.withColumn("__slot", slot(df[key], slots)).join(F.broadcast(table), "__slot")
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c != to), F.col("__shard").alias(to))


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS) -> None:
    """One folder of Parquet files for each shard. Rows aren't shuffled: every task writes a part of each shard."""
    place(df, key, shards, slots).write.partitionBy("shard").mode("overwrite").parquet(path)
