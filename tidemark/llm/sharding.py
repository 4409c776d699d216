"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shards, and slots of the table: a prime, over a hundred for each shard, so that shares differ by a hundredth at most.
SHARDS, SLOTS = 64, 10007


def _number(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in `shards`) of each slot.

    Each shard prefers the slots in an order of its own: an offset and a step from two hashes of its name
    run through all slots, as their number is a prime. The shards take turns and claim the next slot they
    prefer that is free, so each has slots / shards of them, one more or less, and when a shard comes or
    goes few other slots change hands.
    """
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, and one for each shard at least")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need names of their own")
    at = [_number(f"offset|{s}") % slots for s in shards]
    step = [_number(f"step|{s}") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a string key: 32 bits of its hash, modulo the slots."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def names(count: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(count)]


def place(docs: DataFrame, shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """`docs` with slot and shard: by doc_id, or by the text where doc_id is null, or the empty key.

    The table has `slots` rows, a parameter, and is broadcast, so placement takes no shuffle and a look-up
    a row. Rows of a key share a shard. Every row stays; columns of docs by those names are replaced.
    """
    shards = shards or names()
    rows = [(s, shards[i]) for s, i in enumerate(lookup_table(shards, slots))]
    table = docs.sparkSession.createDataFrame(rows, "slot int, shard string")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")]
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.col("text"), F.lit(""))
    return docs.select(*kept, slot(key, slots).alias("slot")).join(F.broadcast(table), "slot", "left").select(*kept, "slot", "shard")


def write(docs: DataFrame, path: str, files: int = 4, shards: list[str] | None = None) -> None:
    """A folder for each shard, its rows dealt to so many tasks and files, so that a large shard is no large task."""
    placed = place(docs, shards)
    dealt = placed.repartition(F.col("shard"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(files)))
    dealt.drop("slot").write.mode("errorifexists").partitionBy("shard").parquet(path)
