"""Structured Streaming forms: splits and first-wins de-duplication of file streams."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.sampling import split_of


def file_stream(spark: SparkSession, path: str, schema: StructType, files: int = 8) -> DataFrame:
    """A stream over the files of a folder; ``path`` may also be one file, which is then picked out of its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    folder, name = path.rstrip("/").rsplit("/", 1)
    found = spark.read.schema(schema).parquet(path).inputFiles()
    if len(found) == 1 and found[0].rsplit("/", 1)[1] == name:
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def split_stream(rows: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """Each row with its split; stateless, so that late rows need no rule."""
    return rows.withColumn("split", split_of(rows[key].cast("string"), ratio, seed))


def first_seen(rows: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key. With a time column, keys are forgotten ``delay`` behind the latest time, and later
    rows of theirs are dropped as late; without one the state grows with the keys."""
    if time is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def first_seen_stored(rows: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """The first row of each key, kept in a table: what a batch adds are its keys that no earlier batch has.

    The state is that table and not the stream's memory, so that keys never need be forgotten. A batch that is done again
    replaces itself, and looks only at the batches before it.
    """
    spark, schema = rows.sparkSession, rows.schema
    kept = StructType([*schema.fields, StructField("batch", LongType())])

    def append(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(keys)
        if number:
            before = spark.read.schema(kept).parquet(out).where(F.col("batch") < number).select(*keys)
            a, b = fresh.alias("a"), before.alias("b")
            fresh = a.join(b, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(kept).parquet(out).drop("batch")


def run_to_end(rows: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Works through what there is and reads the result; a restart goes on from the checkpoint."""
    query = (
        rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def upsert_stream(rows: DataFrame, key: str, out: str, checkpoint: str, upto: int | None = None) -> None:
    """Append each batch to an index, with its number; a batch that is done again after a failure replaces itself.

    Later batches win when the index is read; the checkpoint tells a restart which files are done. With ``upto`` the
    stream breaks off inside the batch of that number, when its rows are written but the batch isn't done.
    """
    stop = f"stopped in batch {upto}"

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == upto:
            raise InterruptedError(stop)

    query = rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if upto is None or stop not in str(e):
            raise


def read_upserts(spark: SparkSession, out: str, schema: StructType, key: str) -> DataFrame:
    """The last row of each key over the batches of ``upsert_stream``; of rows of one batch the greatest."""
    names = [f.name for f in schema]
    found = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(out)
    rest = F.struct(*[n for n in names if n != key])
    last = found.groupBy(key).agg(F.max_by(rest, F.struct("batch", rest)).alias("_row"))
    return last.select(key, "_row.*").select(names)
