"""Placement of rows on shards by a permutation-filled lookup table, with DataFrame functions only.

Method. Each shard orders the slots of a table of prime size by its own permutation (offset + j * skip mod size, both from
a digest of the shard's name). The shards take turns, and at its turn a shard claims the first free slot of its order,
until the table is full; sizes of shards then differ by one slot at most, and a shard that joins or leaves moves few others.
The table has a fixed number of rows, a parameter, and is joined as a broadcast: a row's slot is a digest of its key modulo
the size, so placement takes constant time, and no row moves.

Defined results. A null key is placed like the text 'null'. Rows with equal keys share a shard, repeated rows too; ties do not
arise. Texts, very long ones too, go along and are not read. Other columns stay as they are; columns named like the two results are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.llm.common import packed, quoted, table

SHARDS, SLOTS = 32, 8191
#: The largest table that may be broadcast: a slot is two ints.
MOST_SLOTS = 1_000_003


def fill(names: list[str], slots: int) -> list[int]:
    """The shard of every slot."""
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("shards need distinct names, and no more than slots")
    if slots > MOST_SLOTS or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime of at most {MOST_SLOTS}")
    digest = [hashlib.md5(x.encode()).hexdigest() for x in names]
    at = [int(d[:15], 16) % slots for d in digest]
    skip = [int(d[15:30], 16) % (slots - 1) + 1 for d in digest]
    owner = [-1] * slots
    left = slots
    while True:
        for i in range(len(names)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, slots: int) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long") % slots


def shard(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with the slot and the shard of every row."""
    owners = ",".join(map(str, fill([f"shard-{i}" for i in range(shards)], slots)))
    lookup = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard"))
    lookup = lookup.select(F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"))
    placed = df.select(packed(df, *[c for c in df.columns if c not in (slot_col, shard_col)] or [key]), slot_of(quoted(key), slots).alias("slot"))
    return placed.join(F.broadcast(lookup), "slot", "left").select("row.*", F.col("slot").alias(slot_col), F.col("shard").alias(shard_col))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op1_sql() -> str:
    owners = ",".join(map(str, fill([f"shard-{i}" for i in range(SHARDS)], SLOTS)))
    return f"""SELECT * EXCLUDE (slot), slot, ([{owners}])[slot + 1]::INT AS shard FROM (
        SELECT *, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)"""
