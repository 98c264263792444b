"""Incremental preparation: requested keys, the raw index, its rebuild with reasons, and tests for staleness."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_accession
from .clean import best_of_each, reasons


def requested(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """(accession, alias, first_pos, times): each requested key in canonical form, with its first spelling; blank ones go."""
    plain = rows.select(F.trim(key).alias("given"), F.col(pos).alias("pos")).where("given <> ''")
    return plain.groupBy(canonical_accession(F.col("given")).alias("accession")).agg(
        F.min_by("given", "pos").alias("alias"), F.min("pos").alias("first_pos"), F.count("*").alias("times")
    )


def upserted(index: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """The index with fetched rows in place of those of the same key; keys that weren't fetched keep their rows.

    Both have the same columns; of fetched rows of one key the last in order of all columns counts.
    """
    rest = [F.col(c) for c in fetched.columns if c != key]
    last = best_of_each(fetched.select(index.columns), [key], F.struct(*rest))
    return index.join(last.select(key), key, "left_anti").unionByName(last)


def wanted_versions(index: DataFrame, asked: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Current versions, looked up for requested keys that the index has already."""
    return versions.join(asked.select(key), key, "left_semi").join(index.select(key), key, "left_semi")


def rebuilt(
    index: DataFrame, asked: DataFrame, key: str, text: str, shortest: int, longest: int, most_unknown: float
) -> DataFrame:
    """(key, included, reason, duplicate_of): the state of every row of the index, and of requested keys that it lacks.

    Reasons: not_requested, missing, and those of ``clean.reasons`` among the requested rows in order of the key.
    """
    mine = index.join(asked.select(key), key, "left_semi")
    judged = reasons(mine.select(key, text), text, key, shortest, longest, most_unknown)
    kept = judged.select(key, F.col("reason").isNull().alias("included"), "reason", "duplicate_of")
    none = F.lit(None).cast(index.schema[key].dataType)
    out = lambda rows, why: rows.select(key, F.lit(False).alias("included"), F.lit(why).alias("reason"), none.alias("duplicate_of"))
    others = index.join(asked.select(key), key, "left_anti")
    lacking = asked.join(index.select(key), key, "left_anti")
    return kept.unionByName(out(others, "not_requested")).unionByName(out(lacking, "missing"))


def signature(parameters: dict) -> str:
    """SHA-256 of the parameters as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def stale(manifest: dict, parameters: dict, plan: DataFrame) -> bool:
    """Whether a dataset must be made anew: other parameters than its manifest's, or a plan with new or updated keys."""
    if manifest.get("signature") != signature(parameters) or not manifest.get("complete"):
        return True
    return bool(plan.where(F.col("action").isin("new", "updated")).take(1))


def stale_reasons(spark: SparkSession, manifest: dict, index: DataFrame | None, asked: DataFrame, key: str, plan: DataFrame, wanted: dict) -> list[str]:
    """Why a dataset must be made anew; empty if it needn't.

    ``wanted`` has the values that its manifest should have: storage_mode, sequence_type, vocab_size, normalization and
    duplicate_accession_count. Besides these count: no manifest or index, an unfinished one, keys to fetch, other keys than
    those asked for, and artifacts (``manifest["artifacts"]``, paths) that aren't there.
    """
    if not manifest or index is None or index.isEmpty():
        return ["no_state"]
    reasons = [] if manifest.get("is_complete") else ["incomplete"]
    if plan.where(F.col("action").isin("new", "updated")).take(1):
        reasons.append("keys_to_fetch")
    found = dict(manifest) | {"duplicate_accession_count": int(manifest.get("duplicate_accession_count") or 0)}
    reasons += [name for name, value in wanted.items() if found.get(name) != value]
    if manifest.get("keys_digest") != keys_digest(asked, key):
        reasons.append("other_keys")
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in manifest.get("artifacts") or ()]
    if not paths or not all(p.getFileSystem(settings).exists(p) for p in paths):
        reasons.append("artifacts_missing")
    return reasons


def keys_digest(asked: DataFrame, key: str) -> str:
    """A digest of a set of keys, whatever their order: its size and sums of two hashes."""
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), key).cast("decimal(38,0)"))
    return signature({"keys": list(map(str, asked.agg(F.count(key), wide(1), wide(2)).first()))})
