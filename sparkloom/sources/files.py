"""Plain files: delimited tables, listings and bundles of archives, text parts in natural order, JSON objects, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..operators.ordered import numbered_in_splits


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A table with a header: all cells are trimmed strings, empty for null; columns without a name go."""
    rows = spark.read.csv(path, header=True, sep=separator, inferSchema=False)
    named = [c for c in rows.columns if c.strip() and not c.startswith("_c")]
    return rows.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c.strip()) for c in named])


def tolerant(spark: SparkSession) -> DataFrameReader:
    """A reader that takes the readable part of damaged files; the session's other reads still fail on them."""
    return spark.read.option("ignoreCorruptFiles", "true")


def listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, length, modified) of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def bundles(left: DataFrame, right: DataFrame, endings: tuple[str, str]) -> DataFrame:
    """(bundle, group, left_path, right_path): two listings paired by folder and stem; either path may be null."""

    def keyed(files: DataFrame, ending: str, name: str) -> DataFrame:
        return files.where(F.col("path").endswith(ending)).select(F.expr(f"substr(path, 1, length(path) - {len(ending)})").alias("bundle"), F.col("path").alias(name))

    both = keyed(left, endings[0], "left_path").join(keyed(right, endings[1], "right_path"), "bundle", "full")
    return both.select("bundle", F.element_at(F.split("bundle", "/"), -2).alias("group"), "left_path", "right_path")


def _placed_lines(spark: SparkSession, path: str | list[str], pattern: str | None) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    return reader.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
    )


def read_lines(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(line, file, pos): lines of text files; ``pos`` orders them by the files' natural order and their place."""
    key = lambda file: natural_key(F.element_at(F.split(file, "/"), -1))
    # Sort keys are made once a file, of a listing that doesn't read contents.
    reader = spark.read.format("binaryFile")
    names = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select(F.col("_metadata.file_path").alias("file"))
    names = names.select("file", key("file").alias("name"))
    named = _placed_lines(spark, path, pattern).join(F.broadcast(names), "file", "left")
    return named.select("line", "file", F.struct(F.coalesce("name", key("file")).alias("name"), "file", "block", "n").alias("pos"))


def numbered_lines(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(line, file, line_number): lines of text files with their numbers in their file, from 1, as editors count.

    A file may lie in many splits: a line's number in its split, plus the lines of the splits before. What is gathered
    is a row for each split.
    """
    lines = numbered_in_splits(_placed_lines(spark, path, pattern), ["file"], ["file", "block"], "n", "k")
    return lines.select("line", "file", (F.col("k") + 1).alias("line_number"))


def source_place() -> Column:
    """``path:line`` of ``numbered_lines``, without the scheme of local paths."""
    return F.concat(F.regexp_replace("file", "^file:/*/", "/"), F.lit(":"), F.col("line_number").cast("string"))


def train_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of ``train_part_*.txt`` in natural order, or of ``train.txt`` if there are none."""
    parts = listing(spark, folder, "train_part_*.txt")
    return read_lines(spark, folder, "train_part_*.txt" if parts.take(1) else "train.txt")


def checked_corpus(lines: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """The lines, all of which have all tags; any other line that isn't blank fails the job."""
    good = F.lit(True)
    for tag in tags:
        good = good & F.contains(F.col("line"), F.lit(tag))
    fault = F.raise_error(F.concat(F.lit("a line lacks its tags: "), F.substring("line", 1, 60))).cast("boolean")
    return lines.where("trim(line) <> ''").where(F.when(good, True).otherwise(fault))


def write_in_order(lines: DataFrame, path: str, parts: int) -> None:
    """Text files whose contents, in order of their names, are the lines in order of ``pos``: each task has a range."""
    lines.repartitionByRange(parts, "pos").sortWithinPartitions("pos").select("line").write.text(path)


def text_totals(lines: DataFrame) -> DataFrame:
    """(files, lines, bytes) with a line end for each line."""
    return lines.agg(F.count_distinct("file").alias("files"), F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).alias("bytes"))


def read_json_object(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the JSON object in each file, values as variants; values that aren't objects go."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.parse_json("value").alias("v"))
    entries = whole.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return entries.select("key", "value").where(F.schema_of_variant("value").startswith("OBJECT"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """(fields, body) of a text that begins with ``key: value`` lines between ``---`` lines; no fields without them.

    Of equal keys the last counts; line ends may be of either kind.
    """
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    head = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)", 1)
    body = F.regexp_replace(text, r"(?s)^---\s*\n.*?\n---\s*(?:\n|$)", "")
    # A value of ``|`` is the indented lines that follow, joined by line ends.
    block = F.regexp_extract_all(head, F.lit(r"(?m)^([A-Za-z_][\w-]*:[^\n]*(?:\n[ \t]+[^\n]*)*)"), F.lit(1))

    def entry(x: Column) -> Column:
        rest = F.trim(F.substr(x, F.instr(x, ":") + 1))
        inner = F.array_join(F.transform(F.slice(F.split(rest, "\n"), 2, F.greatest(F.size(F.split(rest, "\n")), F.lit(1))), lambda l: F.trim(l)), "\n")
        plain = F.regexp_replace(rest, "^[\"']|[\"']$", "")
        return F.struct(F.substring_index(x, ":", 1).alias("key"), F.when(rest.startswith("|"), inner).otherwise(plain).alias("value"))

    entries = F.transform(block, entry)
    later = lambda e, i: F.filter(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.size(later(e, i)) == 0)), F.regexp_replace(body, r"^\s+|\s+$", "")


def fasta_text(accession: Column, description: Column, sequence: Column, width: int = 80) -> Column:
    """A FASTA entry with lines of ``width`` residues."""
    header = F.trim(F.concat(F.lit(">"), accession, F.lit(" "), F.coalesce(description, F.lit(""))))
    return F.concat(header, F.lit("\n"), F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n"))


def json_line(*columns: str) -> Column:
    """The row's columns as one JSON object; nulls are left out."""
    return F.to_json(F.struct(*columns))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The fields of a JSON manifest of several lines as one row."""
    return spark.read.json(path, multiLine=True)


def scoped_root(spark: SparkSession, root: str, output: str) -> str:
    """``root/NAME`` if that folder exists, where NAME is the last part of the output path; else ``root``."""
    below = f"{root.rstrip('/')}/{output.rstrip('/').rsplit('/', 1)[-1]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(below)
    return below if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else root


def best_file(files: DataFrame, *preferred: str) -> str | None:
    """The path of the file whose name has most of the ``preferred`` parts, in order of their weight; then the newest."""
    name = F.element_at(F.split("path", "/"), -1)
    marks = [F.contains(F.lower("path"), F.lit(p.lower())) for p in preferred]
    found = files.agg(F.max_by("path", F.struct(*[m.alias(f"m{k}") for k, m in enumerate(marks)], "modified", name.alias("name"))).alias("path"))
    return found.first()["path"]


def missing_letters(rows: DataFrame, text: str, known: str) -> DataFrame:
    """(letter, n): characters of the texts that a vocabulary lacks, with their counts.

    Texts are reduced to what is not known before characters are taken apart.
    """
    rest = F.translate(F.coalesce(text, F.lit("")), known, "")
    letters = rows.select(F.explode(F.regexp_extract_all(rest, F.lit("(?s)(.)"), F.lit(1))).alias("letter"))
    return letters.groupBy("letter").agg(F.count("*").alias("n"))


def expected_rows(rows: DataFrame, n: int) -> DataFrame:
    """The rows, if there are as many as a manifest says; another number is an error."""
    found = rows.count()
    if found != n:
        raise ValueError(f"{found} rows, but {n} are expected")
    return rows


def append_metrics(rows: DataFrame, path: str) -> None:
    """Append metric rows as JSON Lines; numbers that aren't finite are left out."""
    kinds = dict(rows.dtypes)
    plain = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in rows.columns]
    rows.select(F.to_json(F.struct(*plain)).alias("value")).write.mode("append").text(path)
