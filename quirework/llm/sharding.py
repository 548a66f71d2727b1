"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: it starts at an offset and steps by a skip,
both drawn from a digest of its name. Shards take turns, each claiming the first slot on its list that is still free,
until the table is full. A key is placed by hashing it to a slot, so placement is one lookup, all shards hold
equally many slots (give or take one), and adding or removing a shard moves few keys besides its own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import table

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(name: str, what: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{what}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: tuple[str, ...], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard. Its length is ``size`` whatever the data; ``size`` must be prime."""
    if not is_prime(size):
        raise ValueError(f"{size} is not prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards need different names, at least one and no more than slots")
    offset = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    turn, owner, free = [0] * len(shards), [-1] * size, size
    while free:
        for i in range(len(shards)):
            if not free:
                break
            while owner[slot := (offset[i] + turn[i] * skip[i]) % size] >= 0:
                turn[i] += 1
            owner[slot], turn[i], free = i, turn[i] + 1, free - 1
    return owner


def assign_shards(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``. The table has ``size`` rows whatever the data, so it is broadcast; no row
    of ``df`` is shuffled, and no key, however frequent, meets others in one task. Equal keys get equal shards; a null
    key is a key of its own; an empty table stays empty. Columns named slot or shard are replaced, all others pass, whatever
    their names."""
    spark = df.sparkSession
    owner = lookup_table(tuple(shards), size)
    slots = F.broadcast(spark.createDataFrame([(s, shards[i]) for s, i in enumerate(owner)], "slot long, shard string"))
    hashed = F.pmod(F.xxhash64(F.coalesce(F.concat(F.lit("k"), F.col(f"`{key}`").cast("string")), F.lit(""))), F.lit(size))
    rest = df.drop("slot", "shard")
    if key in ("slot", "shard"):
        raise ValueError(f"the key column can't be named {key}")
    rows = rest.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row"), hashed.alias("slot"))
    return rows.join(slots, "slot").select("row.*", "slot", "shard")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
