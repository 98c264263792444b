"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import free_name, let
from ..operators.storage import checkpointed, stored

__all__ = ["WORD", "ascii_lower", "checkpointed", "free_name", "let", "read_table", "row_hash", "stored", "words_of"]

#: A word is a run of anything but ASCII white space; both Java and RE2 read this class alike.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_hash(df: DataFrame, salt: str) -> Column:
    """A 64-bit hash of all columns; those with maps, which Spark doesn't hash, by their JSON."""
    from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

    def unhashable(kind: DataType) -> bool:
        if isinstance(kind, StructType):
            return any(unhashable(f.dataType) for f in kind)
        return isinstance(kind, MapType | VariantType) or isinstance(kind, ArrayType) and unhashable(kind.elementType)

    parts = []
    for f in df.schema:
        column = F.col(f"`{f.name}`")
        # A null's place counts too: xxhash64 skips nulls.
        parts += [column.isNull(), F.to_json(F.struct(column)) if unhashable(f.dataType) else column]
    return F.xxhash64(F.lit(salt), *parts)
