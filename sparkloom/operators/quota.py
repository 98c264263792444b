"""Stratified downsampling: how many rows each stratum keeps, and which.

Large strata are thinned more than small ones: a stratum of n rows gets a share that grows as n to the power of alpha,
one row at least and n at most. Nothing of the size of the data or of the strata is gathered: the search for a group's
scale works on its distinct stratum sizes, which are at most the square root of twice its rows, and rows left over go
to strata by their rank over range partitions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered
from .sampling import SCALE, evenly_kept

#: Groups (not strata) are planned in the driver, a row for each; more than this many are refused.
MOST_GROUPS = 100_000


def _level(room: np.ndarray, amount: int) -> int:
    """The most rounds in which every place with room left takes one, and which use up ``amount`` at most."""
    room = np.sort(room)
    filled = np.concatenate(([0], np.cumsum(room)))  # by places with the least room
    # After so many rounds as the k-th place has room, it and the smaller ones are full and the others have as many.
    used = filled[1:] + room * (len(room) - 1 - np.arange(len(room)))
    k = int(np.searchsorted(used, amount, side="right"))
    if k == len(room):
        return int(room[-1]) if len(room) else 0
    return int((amount - filled[k]) // (len(room) - k))


def _spread(room: np.ndarray, amount: int, first: list[int]) -> np.ndarray:
    """How ``amount`` is spread: whole rounds for all with room, and what is left one by one in the order ``first``."""
    level = _level(room, amount)
    given = np.minimum(room, level)
    left = amount - int(given.sum())
    given[[k for k in first if room[k] > level][:left]] += 1
    return given


def group_targets(rows: list[tuple[str, int, int]], target: int) -> dict[str, int]:
    """Rows to keep of each group, from (group, rows, strata): largest remainders between bounds.

    A group's exact part of the target is rounded down and put between its bounds, one row for each stratum and all its
    rows. What is then missing goes to groups with room, the largest fractions first; what is too much comes from groups
    above their least, the smallest fractions first. Ties go by the room and then by the name.
    """
    total, least = sum(n for _, n, _ in rows), sum(k for _, _, k in rows)
    if target < least:
        raise ValueError(f"{least} strata need a row each, but the target is {target}")
    target = min(target, total)
    if not rows or not total:
        return {}
    high, low = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
    exact = [r[1] * target / total for r in rows]
    fraction = [x - int(x) for x in exact]
    kept = np.clip(np.array([int(x) for x in exact], np.int64), low, high)
    by = lambda room: sorted(range(len(rows)), key=lambda k: (fraction[k], int(room[k]), rows[k][0]))
    if (more := target - int(kept.sum())) >= 0:
        kept += _spread(high - kept, more, by(high - kept)[::-1])
    else:
        kept -= _spread(kept - low, -more, by(kept - low))
    return {r[0]: int(n) for r, n in zip(rows, kept, strict=True)}


def fitted_share(sizes: np.ndarray, times: np.ndarray, target: int, alpha: float) -> np.ndarray:
    """The real-valued share of strata of each size, of which there are so many: clip(s * size**alpha, 1, size).

    The sum grows with s and is straight between the break points at which a size leaves 1 or reaches itself. From the
    sorted break points' running sums the piece that holds the target is found, and s is solved for in it.
    """
    sizes, times = sizes.astype(float), times.astype(float)
    if target >= (sizes * times).sum():
        return sizes
    power = sizes**alpha
    points = np.concatenate([1 / power, sizes / power])
    order = np.argsort(points, kind="stable")
    # At its first point a size stops adding 1 a stratum and adds its power times s; at its second it adds its whole.
    slope = np.cumsum(np.concatenate([times * power, -times * power])[order])
    level = times.sum() + np.cumsum(np.concatenate([-times, times * sizes])[order])
    reached = level + slope * points[order]
    k = int(np.searchsorted(reached, target))
    if k == 0:
        return np.ones_like(sizes)
    scale = (target - level[k - 1]) / slope[k - 1] if slope[k - 1] > 1e-12 else points[order][k]
    return np.clip(scale * power, 1.0, sizes)


def _marked(name: str) -> Column:
    """A key that joins like any other: null is told apart by a mark in front, and the order of names stays."""
    return F.when(F.col(name).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(name)))


def _plain(name: str) -> Column:
    return F.when(F.col(name) != "0", F.substr(F.col(name), F.lit(2)))


def phases(group: pd.Series, bucket: pd.Series) -> pd.Series:
    """Where in its first interval a stratum's sampling starts, in 2^20ths; Spark has no blake2b of its own."""
    digests = (hashlib.blake2b(f"{g}␟{b}".encode(), digest_size=8).digest() for g, b in zip(group, bucket))
    return pd.Series([int.from_bytes(d, "big") % SCALE for d in digests], dtype="int64")


def downsample_plan(counts: DataFrame, group: str, bucket: str, keep_ratio: float, alpha: float = 0.5) -> DataFrame:
    """(group, bucket, n, keep, phase) from the (group, bucket, n) of strata; groups and buckets are strings.

    Null is a group or bucket of its own.
    """
    strata = counts.select(_marked(group).alias(group), _marked(bucket).alias(bucket), "n")
    summed = strata.groupBy(group).agg(F.sum("n").alias("rows"), F.count("*").alias("strata"))
    found = [tuple(r) for r in summed.limit(MOST_GROUPS + 1).collect()]
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    targets = group_targets(found, round(sum(n for _, n, _ in found) * keep_ratio))
    spark = counts.sparkSession
    of_group = spark.createDataFrame(list(targets.items()), f"`{group}` string, _target long")
    sizes = strata.groupBy(group, "n").agg(F.count("*").alias("_times")).join(of_group, group)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        share = fitted_share(part["n"].to_numpy(), part["_times"].to_numpy(), int(part["_target"].iloc[0]), alpha)
        return pd.DataFrame({group: part[group], "n": part["n"], "_share": share, "_target": part["_target"]})

    shares = sizes.groupBy(group).applyInPandas(fit, f"`{group}` string, n long, _share double, _target long")
    shared = strata.join(shares, [group, "n"]).withColumn("_base", F.greatest(F.lit(1), F.least("n", F.floor(F.col("_share") + 1e-9))))
    used = shared.groupBy(group).agg(F.sum("_base").alias("_used"))
    open_ = shared.where("_base < n").select(group, bucket, (F.col("_base") - F.col("_share")).alias("_part"), (-F.col("n")).alias("_less"))
    # Ties go to the last name, as descending order has it; descending strings are numbered from the end of the stratum.
    ranked = numbered(open_, [group], ["_part", "_less", bucket], "_k")
    tied = ranked.groupBy(group, "_part", "_less").agg(F.min("_k").alias("_from"), F.max("_k").alias("_to"))
    place = ranked.join(tied, [group, "_part", "_less"]).select(group, bucket, (F.col("_from") + F.col("_to") - F.col("_k")).alias("_place"))
    full = shared.join(used, group).join(place, [group, bucket], "left")
    more = F.coalesce((F.col("_place") < F.col("_target") - F.col("_used")).cast("long"), F.lit(0))
    phase = F.pandas_udf(phases, "long")
    g, b = _plain(group), _plain(bucket)
    named = phase(F.coalesce(g, F.lit("")), F.coalesce(b, F.lit("")))
    return full.select(g.alias(group), b.alias(bucket), "n", (F.col("_base") + more).cast("long").alias("keep"), named.alias("phase"))


def downsample(df: DataFrame, group: str, bucket: str, order: list[str], keep_ratio: float, alpha: float = 0.5) -> DataFrame:
    """The rows of ``df`` that a plan keeps: within each stratum evenly spread in ``order``, which is free of ties.

    Groups and buckets are strings; null is one of its own.
    """
    plan = downsample_plan(df.groupBy(group, bucket).agg(F.count("*").alias("n")), group, bucket, keep_ratio, alpha)
    a, b = numbered(df, [group, bucket], order, "_k").alias("a"), plan.withColumnRenamed("n", "_n").alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (group, bucket)]
    ranked = a.join(b, same).select("a.*", "b._n", "b.keep", "b.phase")
    return ranked.where(evenly_kept("_k", "keep", "_n", "phase")).select(*[F.col(f"`{c}`") for c in df.columns])
