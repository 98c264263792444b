"""Datasets for training from record archives: compiled records, tagged text, JSON Lines, span rows, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import accession_version
from . import instructions, spans
from .annotations import inferred_labels, merged_records, profile_text
from .clean import best_of_each, first_of_each
from .matching import Rule
from .ordered import numbered

ORIGINS = ("right_only", "left_only", "paired")


def preference() -> list[Column]:
    """By what one of several records of an accession is preferred: origin, version, length of description, of metadata."""
    rank = F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin"))
    sizes = F.transform(F.map_entries("metadata"), lambda e: F.length(e["key"]) + F.length(F.coalesce(e["value"], F.lit(""))))
    # Of records that tie in all, the one that comes first by its text.
    return [
        rank, accession_version(F.col("accession_version")), F.col("accession_version"), F.length("description"),
        F.aggregate(sizes, F.lit(0), lambda a, n: a + n), -F.xxhash64("sequence", "description"),
    ]


def compiled(left: DataFrame, right: DataFrame, rules: list[Rule], source: str, kind: str = "protein", most: int | None = None) -> DataFrame:
    """One record for each accession of two archives, with labels, label_source, profile and duplicate.

    Records with an empty sequence go. ``duplicate`` marks those whose sequence an earlier accession has; ``most`` bounds
    the others in order of accessions.
    """
    one = lambda rows: best_of_each(
        rows.select("accession", "accession_version", "description", "organism", "sequence", "metadata").withColumn("origin", F.lit("left_only")),
        ["accession"], F.struct(*preference()),
    ).drop("origin")
    merged = merged_records(one(left), one(right)).where("sequence <> ''")
    labels = inferred_labels(F.col("description"), F.col("metadata"), F.lit(kind), rules)
    profile = profile_text(F.col("description"), F.col("organism"), F.col("metadata"), F.lit(kind), F.lit(source), rules)
    rows = merged.select("*", labels.alias("_l"), profile.alias("profile")).select("*", "_l.labels", "_l.label_source").drop("_l")
    marked = first_of_each(rows, F.sha2("sequence", 256), "accession")
    found = marked.withColumn("duplicate", F.col("first_pos") < F.col("accession")).drop("first_pos")
    if most is None:
        return found
    kept = numbered(found.where("NOT duplicate").select("accession", F.lit(0).alias("whole")), ["whole"], ["accession"], "k")
    return found.join(kept.where(F.col("k") < most).select("accession"), "accession", "left_semi")


def write_train_text(rows: DataFrame, path: str, parts: int, append: bool = False) -> None:
    """Tagged lines in order of accessions; records that can't be tagged fail the job.

    Each call writes a folder ``batch=00000000``, ``batch=00000001``, .. below ``path``; ``train_text`` reads them in order.
    A batch that a failure has left without ``_SUCCESS`` is written anew.
    """
    bad = F.raise_error(F.concat(F.lit("a field can't be tagged: "), F.col("accession").cast("string"))).cast("string")
    line = F.when(instructions.field_faults(F.col("profile")) | instructions.field_faults(F.col("sequence")), bad)
    made = rows.select("accession", line.otherwise(instructions.train_line(F.col("profile"), F.col("sequence"))).alias("line"))
    ordered = made.repartitionByRange(parts, "accession").sortWithinPartitions("accession")
    done = complete_batches(rows.sparkSession, path)
    if done and not append:
        raise FileExistsError(path)
    ordered.select("line").write.mode("overwrite").text(f"{path}/batch={len(done):08d}")


def complete_batches(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders of whole batches, in order."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(root)] if system.exists(root) else []
    whole = lambda n: system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(n for n in names if n.startswith("batch=") and whole(n))


def train_text(spark: SparkSession, path: str) -> DataFrame:
    """(line, pos) of what ``write_train_text`` wrote: ``pos`` orders the lines by batches, and by accessions within."""
    done = complete_batches(spark, path)
    if not done:
        return spark.createDataFrame([], "line string, pos struct<batch:string,file:string,block:bigint,n:bigint>")
    rows = spark.read.text([f"{path}/{n}" for n in done])
    file = F.col("_metadata.file_path")
    pos = F.struct(
        F.element_at(F.split(file, "/"), -2).alias("batch"), F.element_at(F.split(file, "/"), -1).alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"),
    )
    return rows.select(F.col("value").alias("line"), pos.alias("pos"))


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    """Records as instruction rows: the profile asks, the sequence answers."""
    line = F.to_json(F.struct(
        "accession", F.col("profile").alias("instruction"), F.lit("").alias("input"), F.col("sequence").alias("output"),
        F.lit("protein").alias("sequence_type"), "metadata",
    ))
    rows.select(line.alias("value")).write.mode("append" if append else "errorifexists").text(path)


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts over ``compiled``: records, by origin, mismatches, duplicates, and what is kept."""
    count = lambda c: F.count_if(c)
    return rows.agg(
        F.count("*").alias("records"), *[count(F.col("origin") == o).alias(o) for o in ORIGINS], count(F.col("sequence_mismatch")).alias("mismatches"),
        count(F.col("duplicate")).alias("duplicates"), count(~F.col("duplicate")).alias("kept"),
    )


def label_split(rows: DataFrame, least: int) -> DataFrame:
    """(frequent, rare): labels that keyword rules gave to ``least`` kept records or more, and to fewer."""
    labels = rows.where("NOT duplicate AND label_source = 'keyword rules'").select(F.explode("labels").alias("label"))
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    return counts.agg(F.count_if(F.col("n") >= least).alias("frequent"), F.count_if(F.col("n") < least).alias("rare"))


def span_json_lines(rows: DataFrame, key: str, sequence: str, instruction: str, path: str, **limits) -> DataFrame:
    """Write span examples as instruction rows, and give (mask_length, n) of what was written."""
    found = spans.span_examples(rows, key, sequence, **limits).join(rows.select(key, F.col(instruction).alias("_asked"), F.col(sequence).alias("_whole")), key)
    width = (F.col("mask_end") - F.col("mask_start")).cast("int")
    row = instructions.span_row(instructions.compact(F.col("_whole")), F.col("mask_start"), width, F.col("policy"), F.col("_asked"))
    made = found.select(key, width.alias("mask_length"), row.alias("s")).where("NOT s.leaks")
    line = F.to_json(F.struct(F.col(key).cast("string").alias("source"), "s.instruction", "s.input", "s.output", F.struct("mask_length").alias("metadata")))
    made.select(line.alias("value")).write.text(path)
    back = rows.sparkSession.read.text(path).select(F.get_json_object("value", "$.metadata.mask_length").cast("int").alias("mask_length"))
    return back.groupBy("mask_length").agg(F.count("*").alias("n"))


def pairs_dataset(pairs: DataFrame, path: str) -> DataFrame:
    """Write profile-sequence pairs as JSON Lines and Parquet, and give (label, n) of what was written."""
    pairs.write.parquet(f"{path}/pairs.parquet")
    stored = pairs.sparkSession.read.parquet(f"{path}/pairs.parquet")
    stored.select(F.to_json(F.struct(*stored.columns)).alias("value")).write.text(f"{path}/pairs.jsonl")
    return stored.groupBy("label").agg(F.count("*").alias("n"))
