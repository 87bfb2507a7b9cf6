"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table (offset and stride
from its name's hash). Shards take turns, each claiming its next free slot, until the table is full:
slot counts differ by at most one, and changing one shard moves few slots. A document's slot is a
hash of its id; the table has a fixed size, so it is broadcast and placement is one hash join probe.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 64
TABLE_SIZE = 8191
#: Upper bound of a table that may be broadcast (rows of two ints).
MAX_TABLE = 1 << 20


def _digest(text: str, seed: str) -> int:
    return int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """slot -> index of the shard that owns it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(size) or size < len(shards) or size > MAX_TABLE:
        raise ValueError("size must be a prime, at least the number of shards and at most MAX_TABLE")
    place = [_digest(s, "offset") % size for s in shards]
    stride = [_digest(s, "stride") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    claimed = 0
    while claimed < size:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + stride[i]) % size
            owner[place[i]] = i
            claimed += 1
            if claimed == size:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the leading 60 bits of its md5, modulo the table size. A null key takes the slot of the empty string."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return (F.conv(head, 16, 10).cast("long") % size).cast("int")


def assign_shards(docs: DataFrame, key: str = "doc_id", n_shards: int = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """docs with columns slot and shard added (existing columns of these names are replaced).

    Rows with equal keys share a shard; null keys share one shard; an empty table stays empty. No shuffle.
    """
    owner = lookup_table([f"shard-{i:05d}" for i in range(n_shards)], size)
    spark = docs.sparkSession
    kept = docs.drop(*(c for c in docs.columns if c.lower() in ("slot", "shard")))
    table = spark.createDataFrame(list(enumerate(owner)), "slot int, shard int")
    out = kept.withColumn("slot", slot_of(F.col(f"`{key}`"), size)).join(F.broadcast(table), "slot", "left")
    return out.select(*(F.col(f"`{c}`") for c in kept.columns), "slot", "shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", n_shards: int = SHARDS, files_per_shard: int = 8, size: int = TABLE_SIZE) -> None:
    """Write docs as one folder per shard. Rows are dealt by (shard, hash of key), so no shard has to fit in a task."""
    placed = assign_shards(docs, key, n_shards, size)
    salt = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("file")), F.lit(files_per_shard))
    placed.repartition(n_shards * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)
