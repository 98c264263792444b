"""Ordered analytics that don't gather a group in one task: numbering and running minima over ranges.

Rows are dealt out by ranges of (group, order), so that a large group spans partitions. What a partition must know of
the earlier ones is a row for each (partition, group), carried along by a window of at most as many rows as partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import checkpointed


def dealt_by_range(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_pid``, the range partition of each row, fixed by a checkpoint."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id()))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "k") -> DataFrame:
    """``df`` with the 0-based rank of each row in its group; ``order`` must be free of ties. Null groups are groups."""
    dealt = dealt_by_range(df, group, order)
    sizes = dealt.groupBy("_pid", *group).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = dealt.withColumn("_k", F.row_number().over(W.partitionBy("_pid", *group).orderBy(*order)) - 1)
    a, b = ranked.alias("a"), starts.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_pid", *group)]
    return a.join(b, on).select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_before") + F.col("_k")).alias(name))


def numbered_in_splits(lines: DataFrame, group: list[str], split: list[str], n: str, name: str) -> DataFrame:
    """``lines`` with the 0-based rank of each in its group by ``split`` and ``n``, which counts without gaps inside of a split.

    ``split`` begins with ``group``. Lines stay where they are: what is carried along is a row for each split of the files.
    """
    splits = lines.groupBy(*split).agg(F.min(n).alias("_first"), F.count("*").alias("_lines"))
    before = W.partitionBy(*group).orderBy(*split).rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select(*split, (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    found = lines.join(F.broadcast(starts), split)
    return found.select(*lines.columns, (F.col(n) + F.col("_offset")).alias(name))


def running_minimum(df: DataFrame, group: list[str], order: list[str], value: str, name: str = "best") -> DataFrame:
    """``df`` with the minimum of ``value`` over the earlier rows of the group; null for the first."""
    dealt = dealt_by_range(df, group, order)
    lows = dealt.groupBy("_pid", *group).agg(F.min(value).alias("_low"))
    before = W.partitionBy(*group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    starts = lows.withColumn("_before", F.min("_low").over(before)).drop("_low")
    here = W.partitionBy("_pid", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    a, b = dealt.withColumn("_here", F.min(value).over(here)).alias("a"), starts.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_pid", *group)]
    return a.join(b, on).select(*[F.col(f"a.{c}") for c in df.columns], F.least("_here", "_before").alias(name))


def running_sums(df: DataFrame, group: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """``df`` with sums over the earlier rows of the group, zero for the first: ``values`` names a column for each sum.

    ``order`` must be free of ties, but for rows that may change places.
    """
    dealt = dealt_by_range(df, group, order)
    before = W.partitionBy(*group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("_pid", *group).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    starts = sums.select("_pid", *group, *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in values])
    here = W.partitionBy("_pid", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = dealt.withColumns({f"_here_{n}": F.coalesce(F.sum(v).over(here), F.lit(0)) for n, v in values.items()})
    a, b = summed.alias("a"), starts.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_pid", *group)]
    return a.join(b, on).select(*[F.col(f"a.{c}") for c in df.columns], *[(F.col(f"_before_{n}") + F.col(f"_here_{n}")).alias(n) for n in values])
