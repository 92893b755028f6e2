"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a table of prime size in an order of its own. Shards take turns and claim their next
free slot until the table is full: shares differ by one slot at most (with equal weights), and few slots change hands
when a shard comes or goes. Placing a row is one look into the table, which is broadcast: its size is fixed.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prime, and at least a hundred times the number of shards for shares within a per cent.
SLOTS = 65_537
#: Slots that the rows of one key are spread over.
WAYS = 1_024


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> np.ndarray:
    """For each slot the number of its shard. A shard takes as many turns in a row as its weight says.

    The order of preference starts at one hash of the shard's name and goes on in steps of another; as the size is
    prime, it visits every slot. The order of the names does not matter.
    """
    if not _is_prime(slots) or not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("wanted: distinct shards, and a prime number of slots that is no smaller than their number")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    turns = [(weights[i] if weights else 1) for i in order]
    if min(turns) < 1:
        raise ValueError("weights are at least 1")
    digests = [hashlib.md5(shards[i].encode()).digest() for i in order]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    table, free = np.full(slots, -1, np.int32), slots
    while free:
        for k, shard in enumerate(order):
            for _ in range(turns[k]):
                while free and table[at[k]] >= 0:
                    at[k] = (at[k] + step[k]) % slots
                if free:
                    table[at[k]] = shard
                    free -= 1
    return table


def placed(
    docs: DataFrame, shards: list[str], key: Column, slots: int = SLOTS, weights: list[int] | None = None,
    spread: Column | None = None, ways: int = WAYS, split: dict | None = None,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``slot`` and ``shard``, by a hash of ``key``; replaces columns so named.

    With ``spread``, a key's rows go to ``ways`` slots by a hash of ``spread``; ``split`` names keys with another number of
    ways (as text, 1 keeps a key together). Neither looks at the other rows: a row keeps its shard while the table grows,
    and a key of any size is spread as much as it will ever be.

    A null key is a key like any other; without ``spread`` all its rows go to one shard. Rows with equal keys and equal
    ``spread`` (or a null one) go to one shard. An empty table gives no rows.
    """
    if ways < 1 or min((split or {}).values(), default=1) < 1:
        raise ValueError("ways are at least 1")
    table = [(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots, weights).tolist())]
    lookup = F.broadcast(docs.sparkSession.createDataFrame(table, "slot int, shard string"))
    part = F.lit(0).cast("long")
    if spread is not None:
        number = F.lit(ways)
        if split:
            named = F.create_map(*[F.lit(x) for k, n in split.items() for x in (str(k), n)])
            number = F.coalesce(F.try_element_at(named, key.cast("string")), number)
        part = F.pmod(F.xxhash64(spread), number)
    slot = F.pmod(F.xxhash64(key, part), F.lit(slots)).cast("int")
    rest = docs.drop(*[c for c in docs.columns if c.lower() in ("slot", "shard")])
    return rest.withColumn("slot", slot).join(lookup, "slot").select(*rest.columns, "slot", "shard")
