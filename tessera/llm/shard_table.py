"""Placement of documents on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size, (offset + i * skip) mod size
with offset and skip from two hashes of its name. Shards take turns claiming the first slot of their order that is
still free, until no slot is; so every shard holds the same number of slots, to within one, and when a shard comes
or goes few slots change hands besides its own. A document goes to the shard at slot hash(id) mod size.

The table is built on the driver: its size is a parameter (65,537 slots; at most some 5 MB), not a matter of the
data, so it is broadcast, and placement is one look-up without a shuffle of documents, in DataFrame operations.

Defined results: a null doc_id is hashed as the text `null`. Equal ids go to one shard. Other columns are kept by
`place`, apart from columns named slot and shard, which are replaced. Shard names must be distinct, at least one
and at most as many as there are slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: tuple[str, ...] = SHARDS, size: int = SLOTS) -> list[int]:
    """The index of the shard at each slot."""
    if not is_prime(size):
        raise ValueError("the table's size must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shard names must be distinct, one or more, and no more than slots")
    offset = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    table, free, turn = [-1] * size, size, 0
    at = list(offset)
    while free:
        k = turn % len(shards)
        while table[at[k]] >= 0:
            at[k] = (at[k] + skip[k]) % size
        table[at[k]] = k
        free -= 1
        turn += 1
    return table


def slot_of(doc_id: Column, size: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), F.lit(size)).cast("int")


def lookup(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = SLOTS) -> DataFrame:
    return spark.createDataFrame([(i, shards[k]) for i, k in enumerate(fill(shards, size))], "slot int, shard string")


def place(docs: DataFrame, shards: tuple[str, ...] = SHARDS, size: int = SLOTS) -> DataFrame:
    """docs with slot and shard."""
    slotted = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col("doc_id"), size))
    return slotted.join(F.broadcast(lookup(docs.sparkSession, shards, size)), "slot").select(*slotted.columns, "shard")


def oracle(shards: tuple[str, ...] = SHARDS, size: int = SLOTS) -> str:
    """Placement in SQL; the table is a constant list of shard numbers."""
    numbers = ",".join(map(str, fill(shards, size)))
    names = ", ".join(f"'{s}'" for s in shards)
    return (
        f"WITH t AS (SELECT [{numbers}] AS slots, [{names}] AS names), "
        f"d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT % {size} AS INTEGER) AS slot FROM documents) "
        "SELECT doc_id, slot, names[slots[slot + 1] + 1] AS shard FROM d, t"
    )
