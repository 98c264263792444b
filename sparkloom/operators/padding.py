"""Batches of rows of like length, padded to the longest of their own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import numbered
from .storage import stored, write_text


def padded_batches(rows: DataFrame, key: str, ids: str, size: int, pad: int = 0, seed: int = 0) -> DataFrame:
    """(batch, turn, key, length, width, input_ids, attention_mask): each row in a batch of ``size`` rows of like length.

    Rows are ranked by (length, key) over ranges, and each ``size`` ranks are a batch; rows are padded to ``width``, the
    longest of their batch. Between neighbouring batches widths don't shrink, so all batches together have fewer than
    ``size`` times the longest row's length of pad tokens, whatever the number of rows. ``turn`` is the batches' order in
    training, drawn by ``seed``. Null ids are an empty row; keys must tell rows apart.
    """
    if size < 1:
        raise ValueError("a batch has a row at least")
    sized = stored(rows.select(F.col(key), F.coalesce(F.col(ids), F.array().cast(rows.schema[ids].dataType)).alias("_ids")), "to-pad")
    ranked = numbered(sized.select(key, F.size("_ids").alias("length")), [], ["length", key], "rank")
    dealt = ranked.withColumn("batch", F.expr(f"rank div {size}"))
    widths = dealt.groupBy("batch").agg(F.max("length").alias("width"))
    at = dealt.join(widths, "batch").join(sized, key)
    filled = F.col("width") - F.col("length")
    kind = rows.schema[ids].dataType.elementType
    ones = lambda value, n: F.array_repeat(F.lit(value), n)
    return at.select(
        "batch", F.xxhash64(F.lit(seed), "batch").alias("turn"), key, "length", "width",
        F.concat("_ids", ones(pad, filled).cast(f"array<{kind.simpleString()}>")).alias("input_ids"),
        F.concat(ones(1, F.col("length")), ones(0, filled)).alias("attention_mask"),
    )


def manifest(batches: DataFrame, pad: int) -> dict:
    """Totals of ``padded_batches``: rows, batches, tokens, pad tokens and their share, and the widest batch."""
    n, tokens, cells, width, count = batches.agg(
        F.count("*"), F.sum(F.col("length").cast("long")), F.sum(F.col("width").cast("long")), F.max("width"), F.count_distinct("batch")
    ).first()
    tokens, cells = tokens or 0, cells or 0
    return {
        "rows": n, "batches": count, "tokens": tokens, "pad_tokens": cells - tokens, "pad_share": (cells - tokens) / cells if cells else 0.0,
        "widest": width or 0, "pad_id": pad,
    }


def write_batches(batches: DataFrame, path: str, pad: int, vocabularies: dict[str, DataFrame] | None = None, extra: dict | None = None) -> dict:
    """Write batches, vocabularies and then ``manifest.json``, which tells that all is there; give the manifest."""
    spark = batches.sparkSession
    batches.repartitionByRange("turn", "batch").sortWithinPartitions("turn", "batch", "length").write.parquet(f"{path}/batches")
    sizes = {}
    for name, vocabulary in (vocabularies or {}).items():
        vocabulary.write.parquet(f"{path}/vocabulary-{name}")
        sizes[name] = spark.read.parquet(f"{path}/vocabulary-{name}").count()
    made = manifest(spark.read.parquet(f"{path}/batches"), pad) | {"vocabularies": sizes} | (extra or {})
    write_text(spark, f"{path}/manifest.json", json.dumps(made, indent=2, sort_keys=True) + "\n")
    return made


def read_batches(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Batches and their manifest; a folder without a manifest isn't whole, and other rows than it says are an error."""
    from .storage import read_text

    said = read_text(spark, f"{path}/manifest.json")
    if said is None:
        raise FileNotFoundError(f"{path}/manifest.json")
    found, rows = json.loads(said), spark.read.parquet(f"{path}/batches")
    if rows.count() != found["rows"]:
        raise ValueError(f"{path} hasn't the {found['rows']} rows of its manifest")
    return rows, found
