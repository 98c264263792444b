"""Readers of sequence and annotation files, and of directory pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_accession, header_organism, join_segments, natural_key, upper_residues
from ..operators.storage import file_system
from .files import listing, numbered_lines, source_place


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, description, organism, sequence) of FASTA files, which Spark splits at record starts.

    Entries without sequence or without a header go.
    """
    blocks = spark.read.option("lineSep", "\n>").text(path)
    block = F.regexp_replace("value", "^>", "")
    header = F.trim(F.substring_index(block, "\n", 1))
    rest = F.when(F.instr(block, "\n") > 0, F.substr(block, F.instr(block, "\n") + 1)).otherwise("")
    rows = blocks.select(header.alias("header"), upper_residues(rest).alias("sequence"))
    accession = F.regexp_extract("header", r"^(\S+)", 1)
    described = F.trim(F.regexp_replace(F.regexp_replace("header", r"^\S+", ""), r"\[[^\[\]]+\]\s*$", ""))
    return rows.where("sequence <> '' AND header <> ''").select(
        accession.alias("accession"), described.alias("description"), header_organism(F.col("header")).alias("organism"), "sequence"
    )


def gff_attributes(raw: Column) -> Column:
    """``k=v1,v2;flag`` as a map of arrays, percent-decoded; a flag has the value ``true``; the last of equal keys wins."""
    def decoded(x: Column) -> Column:
        return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))

    parts = F.filter(F.split(raw, ";"), lambda p: F.trim(p) != "")
    keys = F.transform(parts, lambda p: F.trim(F.substring_index(p, "=", 1)))
    pairs = F.transform(
        parts,
        lambda p, i: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("key"),
            F.when(F.instr(p, "=") > 0, F.transform(F.split(F.substr(p, F.instr(p, "=") + 1), ","), decoded))
            .otherwise(F.array(F.lit("true"))).alias("value"),
            i.alias("i"),
        ),
    )
    last = F.filter(pairs, lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.greatest(F.size(keys), F.lit(1))), e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Features of GFF3 files: lines of nine columns with whole-number places; comments go."""
    cell = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(cell) == 9))
    rows = lines.where(F.trim(cell[3]).rlike(r"^\d+$") & F.trim(cell[4]).rlike(r"^\d+$"))
    return rows.select(
        F.trim(cell[0]).alias("seqid"), F.trim(cell[2]).alias("feature"), F.trim(cell[3]).cast("int").alias("start"),
        F.trim(cell[4]).cast("int").alias("end"), F.trim(cell[6]).alias("strand"), gff_attributes(cell[8]).alias("attributes"),
    )


def feature_sequences(features: DataFrame, sequences: DataFrame) -> DataFrame:
    """Features with the part of their sequence, turned on the minus strand; those without a sequence go."""
    keyed = sequences.select(canonical_accession(F.col("accession")).alias("_id"), F.col("sequence").alias("_whole"))
    joined = features.join(keyed, canonical_accession(F.col("seqid")) == F.col("_id"))
    part = F.array(F.struct("start", "end"))
    return joined.withColumn("sequence", join_segments(F.col("_whole"), part, F.col("strand"))).drop("_id", "_whole")


def read_json_lines(spark: SparkSession, path: str | list[str], numbered: bool = False) -> DataFrame:
    """(value, payload, status) of JSON Lines: payload is a variant; status is empty, invalid, not_object or valid.

    With ``numbered`` each row also has ``place``, its path and line number in one, and these as ``file`` and ``line_number``.
    """
    payload = F.try_parse_json("value")
    kind = F.schema_of_variant(payload)
    status = (
        F.when(F.trim("value") == "", "empty").when(payload.isNull(), "invalid").when(~kind.startswith("OBJECT"), "not_object")
    ).otherwise("valid")
    if not numbered:
        return spark.read.text(path).select("value", payload.alias("payload"), status.alias("status"))
    lines = numbered_lines(spark, path).select(F.col("line").alias("value"), source_place().alias("place"), "file", "line_number")
    return lines.select("value", payload.alias("payload"), status.alias("status"), "place", "file", "line_number")


def json_lines_paths(spark: SparkSession, paths: str | list[str], ending: str = ".jsonl") -> list[str]:
    """The files that paths name: a file itself, of a folder those directly in it with the ending, in order of their names.

    No file at all and a path that isn't there are errors.
    """
    found: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        where, system = file_system(spark, path)
        if not system.exists(where):
            raise FileNotFoundError(path)
        if not system.getFileStatus(where).isDirectory():
            found.append(path)
            continue
        names = [f.getPath().getName() for f in system.listStatus(where) if f.isFile()]
        found += [f"{path.rstrip('/')}/{n}" for n in sorted(names) if n.endswith(ending)]
    if not found:
        raise ValueError("no file of JSON Lines is named")
    return found


def json_lines_parts(spark: SparkSession, single: str, folder: str | None = None, pattern: str = "instruction_part_*.jsonl", prefer_parts: bool = True) -> list[str]:
    """The part files of a folder (that of the single file, if none is named) in natural order, or the single file.

    Parts count first if they are preferred and there are any, else only where the single file isn't there.
    """
    where, system = file_system(spark, single)
    inside = folder or single.rsplit("/", 1)[0]
    below, _ = file_system(spark, inside)
    parts: list[str] = []
    if system.exists(below):
        listed = listing(spark, inside, pattern).withColumn("name", F.element_at(F.split("path", "/"), -1))
        parts = [r["path"] for r in listed.orderBy(natural_key(F.col("name")), "path").select("path").collect()]  # a row for each part
    there = system.exists(where)
    return parts if parts and (prefer_parts or not there) else [single]


def hrefs(html: Column) -> Column:
    """Targets of links in double quotes, in order."""
    return F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))
