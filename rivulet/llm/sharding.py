"""Sharding by a permutation-filled lookup table (DataFrame functions only).

A table with a prime number of slots is filled by the shards taking turns:
each claims the next free slot of its own preference order, the permutation
offset, offset + skip, offset + 2 * skip ... modulo the prime.  Every shard gets the same
number of slots but for one, and taking a shard away moves few other slots.
A row's slot is a hash of its id modulo the prime; a broadcast join with the
table (fixed size, ``slots`` rows) finds the shard in constant time.  There is no shuffle.

Defined results: null ids share one slot; repeated rows and rows with the same
id share a shard; an empty table gives an empty result; columns of any names
are kept, and new columns whose names are taken get an underscore appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fresh

SLOTS = 65_537
SHARDS = 64


def _preference(name: str, slots: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard in each slot."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, one at least and no more than slots")
    table = [-1] * slots
    at, skip = map(list, zip(*(_preference(s, slots) for s in shards)))
    free = slots
    while True:
        for shard in range(len(shards)):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + skip[shard]) % slots
            table[slot] = shard
            at[shard] = (slot + skip[shard]) % slots
            free -= 1
            if not free:
                return table


def slot_of(id_col: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(id_col.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def shard(df: DataFrame, id_col: str = "doc_id", shards: Sequence[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with slot and shard (int, the index in ``shards``)."""
    shards = shards or [f"shard-{i:05d}" for i in range(SHARDS)]
    spark = df.sparkSession
    slot = fresh(df.columns, "slot")
    name = fresh([*df.columns, slot], "shard")
    key = fresh([*df.columns, slot, name], "key")
    # an Arrow table is a local relation; a list of rows would start plain Python workers on the executors, beside those of the Arrow stages
    rows = spark.createDataFrame(pa.table([pa.array(range(slots), pa.int32()), pa.array(lookup_table(shards, slots), pa.int32())], [key, name]))
    placed = df.select(*map(column, df.columns), slot_of(column(id_col), slots).alias(slot))
    out = placed.join(F.broadcast(rows), column(slot) == column(key), "left")
    return out.select(*map(column, df.columns), column(slot), column(name))
