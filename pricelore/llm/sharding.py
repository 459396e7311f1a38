"""Placement of rows on shards through a lookup table that the shards fill in turns.

Each shard has an order of preference over the slots of a table of prime size: a starting slot and a step, both from a
digest of its name. Shards take turns, each claiming the first slot of its order that is still free, until all are taken; so
every shard owns an equal share, to one slot, and few slots change hands when a shard comes or goes. A row's key is hashed
to a slot, and the table gives its shard in constant time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
#: A larger table isn't broadcast but refused: at this size it takes some 16 MB.
MOST_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the index of its shard."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need names of their own, one at least")
    if not _is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"the number of slots must be a prime from the number of shards to {MOST_SLOTS}")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    owner, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its MD5, modulo the table's size (null: as the empty string)."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint") % F.lit(slots)).cast("int")


def place(df: DataFrame, shards: Sequence[str], key_col: str = "doc_id", slots: int = SLOTS, shard_col: str = "shard") -> DataFrame:
    """df with the name of each row's shard in shard_col, which replaces a column of that name.

    All rows are kept. Null keys share the slot of the empty string; equal keys share a shard, however many there are:
    write_shards() splits a large shard into several files. An empty table gives an empty one.
    """
    spark: SparkSession = df.sparkSession
    owner = lookup_table(shards, slots)
    lookup = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(owner)], "__slot int, __shard string")
    slotted = df.drop(shard_col).withColumn("__slot", slot_of(F.col(f"`{key_col}`"), slots))
    return slotted.join(F.broadcast(lookup), "__slot", "left").drop("__slot").withColumnRenamed("__shard", shard_col)


def write_shards(df: DataFrame, path: str, shards: Sequence[str], key_col: str = "doc_id", slots: int = SLOTS, shard_col: str = "shard", rows_per_file: int = 1_000_000) -> None:
    """Write df under path, a folder a shard. Rows go out as they are partitioned, so no shard passes through one task."""
    place(df, shards, key_col, slots, shard_col).write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard_col).parquet(path)


def oracle(shards: Sequence[str], slots: int = SLOTS) -> str:
    """DuckDB SQL for the placement of documents. A shard's claims are laid out from its start and step alone: the table
    as a list of its slots' shards."""
    def walk(name: str):
        digest = hashlib.md5(name.encode()).hexdigest()
        start, step = int(digest[:16], 16), int(digest[16:], 16) % (slots - 1) + 1
        return ((start + n * step) % slots for n in range(slots))

    free: list[int | None] = [None] * slots
    walks = [walk(name) for name in shards]
    for turn in range(slots):
        own = walks[turn % len(shards)]
        free[next(slot for slot in own if free[slot] is None)] = turn % len(shards)
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""
WITH t AS (SELECT [{", ".join(map(str, free))}] AS owner, [{names}] AS name),
d AS (SELECT doc_id, CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {slots} AS INT) AS slot FROM documents)
SELECT doc_id, slot, name[owner[slot + 1] + 1] AS shard FROM d, t
"""
