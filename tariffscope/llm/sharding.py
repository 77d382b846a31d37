"""Placement of documents on shards by a permutation-filled lookup table, with built-in functions only.

Every shard has a preference order over the slots of a prime-sized table
(an offset and a step, both from a hash of its name). Shards take turns claiming
their next free slot until the table is full. A document's slot is a hash of its
id; the broadcast table gives its shard in constant time. Adding or removing a
shard moves few other slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table: prime, and far more than shards. It bounds what is broadcast.
SLOTS = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Number of the shard that owns each slot; bounded work on the driver."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shard names must be distinct, at least one and no more than slots")
    place = [_number(f"{name}/offset") % slots for name in shards]
    step = [_number(f"{name}/step") % (slots - 1) + 1 for name in shards]
    table, free = [-1] * slots, slots
    while free:
        for shard in range(len(shards)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % slots
            table[place[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key by the first 60 bits of its md5; a null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign(docs: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``row`` (the input row), ``slot`` and ``shard`` for every input row.

    Rows with equal keys, repeated rows included, go to one shard; null keys
    share one. Extra columns stay inside ``row``; texts are never read. An empty
    table gives an empty result. No shuffle.
    """
    spark = docs.sparkSession
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    table = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    table = table.select("slot", F.get(names, F.col("owner").cast("int")).alias("shard"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    return rows.join(F.broadcast(table), "slot").select("row", "slot", "shard")
