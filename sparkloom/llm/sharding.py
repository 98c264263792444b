"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a table of prime size by its own permutation, ``(offset + k * skip) mod size`` with
offset and skip hashed from its name; shards take turns, each claiming the first slot of its order that is still free,
until the table is full. Placement is then one hash and one look into the table, which is broadcast: it has ``size``
small integers, a constant, whatever the number of rows. Shares differ by one slot at most, and adding or removing a
shard moves little beyond its own share.

Defined cases: a null key is a key like any other (all nulls lie together); repeated rows lie together; an empty table
gives an empty result; a key of any length costs one hash; no shards, repeated names or more shards than slots are
errors; other columns pass through, and the new one takes a free name.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read_table, row_hash

#: A prime; at 100 slots for a shard or more, shares differ by 1 % at most.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(256))


def _number(name: str, salt: bytes) -> int:
    return int.from_bytes(blake2b(name.encode(), digest_size=8, salt=salt).digest(), "big")


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct names, at least one and at most one for a slot")
    if size < 3 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be an odd prime")
    offset = [_number(s, b"offset") % size for s in shards]
    skip = [_number(s, b"skip") % (size - 1) + 1 for s in shards]
    table, place, left = np.full(size, -1, dtype=np.int32), list(offset), size
    while left:
        for shard in range(len(shards)):
            slot = place[shard]
            while table[slot] >= 0:
                slot = (slot + skip[shard]) % size
            table[slot], place[shard] = shard, (slot + skip[shard]) % size
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size)).cast("int")


def place(
    df: DataFrame, key: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE
) -> DataFrame:
    """``df`` with a struct column ``shard`` of slot, id and name."""
    slot, at, out = (free_name(df, x) for x in ("_slot", "_at", "shard"))
    table = df.sparkSession.createDataFrame(
        list(enumerate(lookup_table(shards, size).tolist())), f"`{at}` int, `{out}` int"
    )
    names = F.array(*[F.lit(s) for s in shards])
    placed = df.withColumn(slot, slot_of(F.col(f"`{key}`"), size)).join(
        F.broadcast(table), F.col(slot) == F.col(at), "left"
    )
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.struct(
            F.col(slot).alias("slot"), F.col(out).alias("id"), F.get(names, F.col(out)).alias("name")
        ).alias(out),
    )


def write_shards(df: DataFrame, key: str, path: str, shards: Sequence[str] = SHARDS, pieces: int = 1) -> str:
    """Write ``df`` as Parquet with a folder for each shard; ``pieces`` tasks share one shard's rows by their hash.

    Gives the name of the column that the folders carry, ``shard_name`` unless ``df`` has one already.
    """
    placed, out = place(df, key, shards), free_name(df, "shard_name")
    struct = placed.columns[-1]
    flat = placed.withColumn(out, F.col(f"`{struct}`")["name"]).drop(struct)
    piece = F.pmod(row_hash(df, "piece"), F.lit(pieces))
    flat.repartition(len(shards) * pieces, F.col(f"`{out}`"), piece).write.partitionBy(out).parquet(path)
    return out


def op1_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    placed = place(docs, "doc_id")
    return placed.select(
        "doc_id", "source", "n_chars", *[F.col("shard")[a].alias(b) for a, b in (("slot", "slot"), ("id", "shard_id"), ("name", "shard"))]
    )
