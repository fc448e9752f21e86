"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over a prime number of slots (an offset and a step, from hashes
of its name). The shards take turns, each claiming the next free slot of its order, until the table is full:
slot counts differ by one at most, and adding or removing a shard moves few slots. A row's key hashes to a slot,
and the slot names the shard: constant time per row, in built-in expressions.

The table has ``slots`` entries whatever the data, so it travels as a literal array. Only shard names pass
through the driver.

Rows: a null key gets the hash of the empty string, so null keys share one slot and nothing is dropped. Equal
keys always meet in one shard. Extra columns stay; columns named ``slot`` and ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 2039  # prime, over a hundred times the number of shards
DIGITS = 13  # hex digits of a hash that is read as a number


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Index of the owning shard of every slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be distinct, and one at least")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the table size must be prime and not below the number of shards")
    offset = np.array([_hash(f"{s}/offset") % slots for s in shards])
    step = np.array([_hash(f"{s}/step") % (slots - 1) + 1 for s in shards])
    owner = np.full(slots, -1)
    turn = np.zeros(len(shards), dtype=np.int64)  # how far each shard is in its order
    for claim in range(slots):
        shard = claim % len(shards)
        while True:
            slot = (offset[shard] + turn[shard] * step[shard]) % slots
            turn[shard] += 1
            if owner[slot] < 0:
                owner[slot] = shard
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with the slot and the shard of each key."""
    names = F.array(*(F.lit(shards[i]) for i in lookup_table(shards, slots)))
    return rows.withColumn("slot", slot_of(F.col(key), slots)).withColumn("shard", F.element_at(names, (F.col("slot") + 1).cast("int")))
