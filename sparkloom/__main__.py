"""Jobs from the command line: ``python -m sparkloom JOB ..`` or ``spark-submit``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import natural_key
from .operators import artifacts, instructions, quota
from .operators.clean import first_of_each
from .operators.matching import Rule
from .sources import files, flatfiles
from .sources.sequences import json_lines_paths, read_json_lines


def dedupe_lines(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The first of equal lines stays, in order; blank lines go."""
    lines = files.read_lines(spark, a.input).withColumn("line", F.trim("line")).where("line <> ''")
    marked = first_of_each(lines, F.sha2("line", 256), "pos")
    kept = marked.where(F.col("pos") == F.col("first_pos"))
    if not a.dry_run:
        files.write_in_order(kept, a.output, a.parts)
    return marked.agg(F.count("*").alias("before"), F.count_if(F.col("pos") == F.col("first_pos")).alias("after"))


def concat(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Text files one after the other, in natural order of their names."""
    lines = files.read_lines(spark, a.input)
    files.write_in_order(lines, a.output, a.parts)
    return files.text_totals(lines)


def downsample(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A share of JSON Lines, large strata of (group, bucket) thinned more; a line that is no JSON object fails the job."""
    found = read_json_lines(spark, json_lines_paths(spark, a.input), numbered=True)
    fault = F.concat(F.lit("a JSON object is expected at "), F.col("place"))
    good = F.when(F.col("status") == "valid", True).otherwise(F.raise_error(fault).cast("boolean"))
    group, bucket = instructions.stratum(F.col("payload"))
    rows = found.where("status <> 'empty'").where(good)
    strata = rows.select(F.struct(natural_key(F.col("file")).alias("name"), "file", "line_number").alias("pos"), "value", group.alias("group"), bucket.alias("bucket"))
    kept = quota.downsample(strata, "group", "bucket", ["pos"], a.keep)
    files.write_in_order(kept.select("pos", F.col("value").alias("line")), a.output, a.parts)
    return kept.groupBy("group").agg(F.count("*").alias("n"))


def audit(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Counts over instruction rows by status, key, type and format."""
    return instructions.audit(instructions.records(read_json_lines(spark, json_lines_paths(spark, a.input))))


def profiles(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Tagged text and JSON Lines from archives of protein records."""
    rules = [Rule(label, (label,)) for label in a.label]
    right = flatfiles.read_faa(spark, a.faa).withColumn("metadata", F.create_map().cast("map<string,string>"))
    rows = artifacts.compiled(flatfiles.read_genpept(spark, a.gpff), right, rules, a.source)
    kept = rows.where("NOT duplicate")
    artifacts.write_train_text(kept, f"{a.output}/train", a.parts)
    artifacts.write_json_lines(kept, f"{a.output}/instructions")
    return artifacts.summary(rows)


JOBS = {"dedupe-lines": dedupe_lines, "concat": concat, "downsample": downsample, "audit": audit, "profiles": profiles}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkloom")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        p = jobs.add_parser(name, help=job.__doc__)
        p.add_argument("--output")
        p.add_argument("--parts", type=int, default=64)
        if name == "profiles":
            p.add_argument("--gpff", required=True)
            p.add_argument("--faa", required=True)
            p.add_argument("--source", default="refseq")
            p.add_argument("--label", action="append", default=[])
        else:
            p.add_argument("input", nargs="+")
        if name == "dedupe-lines":
            p.add_argument("--dry-run", action="store_true")
        if name == "downsample":
            p.add_argument("--keep", type=float, default=0.5)
    a = parser.parse_args(args)
    if a.output is None and a.job not in ("audit",) and not getattr(a, "dry_run", False):
        parser.error("--output is required")
    JOBS[a.job](SparkSession.builder.appName("sparkloom").getOrCreate(), a).show(1000, truncate=False)


if __name__ == "__main__":
    main()
