"""Deterministic splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unit_hash
from .ordered import numbered

SCALE = 1 << 20


def split_of(key: Column, ratio: float, seed: int) -> Column:
    return F.when(unit_hash(key, seed) < ratio, "train").otherwise("val")


def evenly_kept(k: str, keep: str, n: str, phase: str) -> Column:
    """Whether the k-th of n rows is one of the ``keep`` that stay: the running quota passes a whole number at it.

    Whole-number arithmetic throughout, in decimals of 38 digits, which strata of 10^15 rows don't exceed.
    """
    wide = lambda x: f"CAST({x} AS DECIMAL(16, 0))"
    quota = lambda x: f"(({wide(x)} * {wide(keep)} * {SCALE} + {wide(phase)} * {wide(n)}) div ({wide(n)} * {SCALE}))"
    return F.expr(f"{quota(f'({k} + 1)')} > {quota(k)}")


def systematic(df: DataFrame, strata: list[str], order: list[str], one_in: int, phase: int) -> DataFrame:
    """``n div one_in`` rows of each stratum of n (one at least), evenly spread in order from a phase in 2^20ths."""
    ranked = numbered(df, strata, order)
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    a, b = ranked.alias("a"), sizes.alias("b")
    joined = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in strata])
    kept = evenly_kept("k", f"greatest(1, _n div {one_in})", "_n", str(phase))
    return joined.where(kept).select(*[F.col(f"a.{c}") for c in df.columns])


def shard(pos: Column, rank: int, world: int) -> Column:
    """True for the rows of one of ``world`` round-robin shards."""
    return F.pmod(pos, F.lit(world)) == rank


def bounded_shuffle(df: DataFrame, pos: str, buffer: int, seed: int, name: str = "place") -> DataFrame:
    """``df`` with ``name``, a new order: a row moves behind at most ``buffer`` - 1 rows that follow it.

    Each row's delay is drawn from a hash of its whole-number position, so that a retry and another epoch's seed give the
    same and another order; sort or deal by it. Ties go by the position, which is unique.
    """
    if buffer < 1:
        raise ValueError("the buffer holds a row at least")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(pos).cast("string")))
    delay = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buffer))
    return df.withColumn(name, F.struct((F.col(pos) + delay).alias("at"), F.col(pos).alias("was")))
