"""Normalising, filtering with reasons, and first-wins de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import free_name, normal_protein
from .storage import stored


def first_of_each(df: DataFrame, key: Column, pos: str) -> DataFrame:
    """``df`` with ``first_pos``, the smallest ``pos`` among rows of equal key; null is a key like any other.

    The minimum is pre-aggregated in each task; the join has one row for each key on one side, so that Spark can split
    a key that many rows share.
    """
    k, other = free_name(df, "_key"), free_name(df, "_key_of_first")
    keyed = df.withColumn(k, key)
    firsts = keyed.groupBy(F.col(k).alias(other)).agg(F.min(pos).alias("first_pos"))
    return keyed.join(firsts, F.col(k).eqNullSafe(F.col(other))).drop(k, other)


def _with_reason(df: DataFrame, text: str, shortest: int, longest: int, most_unknown: float) -> DataFrame:
    """``df`` with ``sequence`` and the first rule that a row fails by itself, or null."""
    rows = df.withColumn("sequence", normal_protein(F.coalesce(F.col(text), F.lit(""))))
    n = F.length("sequence")
    unknown = n - F.length(F.translate("sequence", "X", ""))
    return rows.withColumn(
        "reason",
        F.when(n == 0, "invalid_sequence")
        .when(n < shortest, "too_short")
        .when(n > longest, "too_long")
        .when(unknown > n * F.lit(most_unknown), "too_ambiguous"),
    )


def reasons(df: DataFrame, text: str, pos: str, shortest: int, longest: int, most_unknown: float) -> DataFrame:
    """(pos, reason, duplicate_of): the first rule that each row fails, or null; ``pos`` is unique.

    Rules in order: invalid_sequence, too_short, too_long, too_ambiguous (share of X), duplicate_sequence (of an
    earlier row that passed the other rules, which ``duplicate_of`` names). Sequences are made once and stored as
    digests, from which the first rows are found and to which they are joined.
    """
    rows = _with_reason(df.select(pos, text), text, shortest, longest, most_unknown)
    digest = F.when(F.col("reason").isNull(), F.unhex(F.sha2("sequence", 256)))
    narrow = stored(rows.select(pos, "reason", digest.alias("digest")), "reasons")
    passed = first_of_each(narrow.where("digest IS NOT NULL"), F.col("digest"), pos)
    again = F.col("first_pos") < F.col(pos)
    marked = passed.select(pos, F.when(again, "duplicate_sequence").alias("reason"), F.when(again, F.col("first_pos")).alias("duplicate_of"))
    failed = narrow.where("digest IS NULL").select(pos, "reason", F.lit(None).cast(narrow.schema[pos].dataType).alias("duplicate_of"))
    return marked.unionByName(failed)


def normalised(df: DataFrame, text: str, pos: str, shortest: int, longest: int, most_unknown: float) -> DataFrame:
    """``df`` with ``sequence``, ``reason`` and ``duplicate_of`` as in ``reasons``."""
    found = reasons(df, text, pos, shortest, longest, most_unknown)
    rows = df.withColumn("sequence", normal_protein(F.coalesce(F.col(text), F.lit(""))))
    return rows.join(found, pos)


def best_of_each(df: DataFrame, keys: list[str], *preference: Column) -> DataFrame:
    """The row of each key that comes last by ``preference``, which must be free of ties; a pre-aggregated maximum."""
    rest, row = [c for c in df.columns if c not in keys], free_name(df, "_row")
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*preference)).alias(row))
    return best.select(*keys, f"{row}.*")
