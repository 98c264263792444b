"""Preparation sessions and training sets: records of a session in order, text with its vocabularies, and rows of ids.

A session is a folder with ``raw_index.json``, an object of entries by accession or a folder of files of such objects, and
maybe ``accessions.txt`` (a file or a folder of parts), the order that was asked for. A training set is a folder with the tagged text of records and ``tokenizer_map.json``, which names
the vocabularies, the layout of fused ids and how many records there are. Vocabularies are given, not learnt.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_accession, let
from ..sources.archives import read_objects
from ..sources.files import read_lines
from . import annotations, artifacts, fused, instructions
from .matching import Rule
from .ordered import numbered_in_splits
from .storage import file_system, read_text, stored, write_text
from .vocabulary import Vocabulary, decoded, encoded

FORMAT = "profile_sequence_v1"
ENTRY = (
    "included_in_current_dataset boolean, metadata map<string,string>, normalized_sequence string, sequence string, source_name string, "
    "description string, organism string"
)
KINDS = ("dna", "rna", "protein")


def read_session(spark: SparkSession, folder: str) -> DataFrame:
    """(accession, place, entry): the entries of a session, ``place`` in the order that was asked for.

    Accessions that ``accessions.txt`` names come first, in order of their first lines; then the others as they are found. A
    session without ``raw_index.json`` is an error.
    """
    where, system = file_system(spark, f"{folder}/raw_index.json")
    if not system.exists(where):
        raise FileNotFoundError(f"{folder}/raw_index.json")
    # Of equal keys the last counts, at the place of the first.
    at = F.struct("path", "n")
    found = read_objects(spark, f"{folder}/raw_index.json").groupBy("key").agg(F.max_by("value", at).alias("value"), F.min(at).alias("at"))
    index = found.select(F.col("key").alias("accession"), "at", F.from_json("value", ENTRY).alias("entry"))
    where, system = file_system(spark, f"{folder}/accessions.txt")
    if not system.exists(where):
        return index.select("accession", F.struct("at").alias("place"), "entry")
    lines = read_lines(spark, f"{folder}/accessions.txt").select(canonical_accession(F.col("line")).alias("accession"), "pos")
    first = lines.where("accession <> ''").groupBy("accession").agg(F.min("pos").alias("line"))
    joined = index.join(first, "accession", "left")
    return joined.select("accession", F.struct(F.col("line").isNull().alias("not_asked"), "line", "at").alias("place"), "entry")


def session_records(session: DataFrame, source: str, rules: list[Rule], kind: str = "protein") -> DataFrame:
    """(accession, place, profile, sequence, sequence_type, metadata) of the included entries that have a sequence.

    ``source`` and ``kind`` stand in for what an entry doesn't say; a kind that isn't known fails the job.
    """
    text = lambda c: F.coalesce(F.col(f"entry.{c}"), F.lit(""))
    given = lambda *cs: F.coalesce(*[F.nullif(text(c), F.lit("")) for c in cs], F.lit(""))
    empty = F.create_map().cast("map<string,string>")
    rows = session.where(F.col("entry.included_in_current_dataset")).select(
        "accession", "place", F.trim(given("normalized_sequence", "sequence")).alias("sequence"), text("description").alias("description"),
        text("organism").alias("organism"), F.coalesce(F.nullif(text("source_name"), F.lit("")), F.lit(source)).alias("source_name"),
        F.coalesce("entry.metadata", empty).alias("own"),
    ).where("sequence <> ''")
    said = F.lower(F.trim(F.coalesce(F.col("own")["sequence_type"], F.lit(kind))))
    fault = F.raise_error(F.concat(F.lit("a sequence type that isn't known: "), said)).cast("string")
    rows = rows.withColumn("sequence_type", F.when(said.isin(*KINDS), said).otherwise(fault))
    labels = annotations.inferred_labels(F.col("description"), F.col("own"), F.col("sequence_type"), rules)
    profile = annotations.profile_text(F.col("description"), F.col("organism"), F.col("own"), F.col("sequence_type"), F.col("source_name"), rules)
    rows = rows.select("*", labels.alias("l"), profile.alias("profile"))
    more = F.map_from_arrays(
        F.array(*map(F.lit, ("accession", "source_name", "description", "organism", "derived_labels", "derived_keywords", "derived_label_source"))),
        F.array("accession", "source_name", "description", "organism", F.to_json("l.labels"), F.to_json("l.keywords"), "l.label_source"),
    )
    # What the entry says itself counts.
    metadata = F.map_concat(F.map_filter(more, lambda k, _: ~F.map_contains_key(F.col("own"), k)), "own")
    return rows.select("accession", "place", "profile", "sequence", "sequence_type", metadata.alias("metadata"))


@dataclass(frozen=True)
class TrainingSet:
    """Tagged text of records with the vocabularies of profiles and sequences."""

    path: str
    records: int
    kind: str
    profiles: Vocabulary
    sequences: Vocabulary

    @property
    def layout(self) -> fused.Layout:
        return fused.Layout(len(self.sequences.ids), len(self.profiles.ids))

    def rows(self, spark: SparkSession, place: str | None = None) -> DataFrame:
        """(pos, profile, sequence) in order of ``pos``; other numbers of records than written are an error.

        With ``place``, a column of that name has the records' numbers in this order, from 0.
        """
        lines = artifacts.train_text(spark, self.path)
        if (n := lines.count()) != self.records:
            raise ValueError(f"{self.path} has {n} records, but its map says {self.records}")
        fault = F.raise_error(F.concat(F.lit("no tagged line: "), F.substring("line", 1, 60)))
        parsed = let(instructions.parsed_line(F.col("line")), lambda r: F.when(r.isNull(), fault.cast("struct<profile:string,sequence:string>")).otherwise(r))
        named = ["pos", *([place] if place else [])]
        if place:
            flat = lines.select("line", "pos", "pos.*")
            lines = numbered_in_splits(flat, [], ["batch", "file", "block"], "n", place).select("line", *named)
        return lines.select(*named, parsed.alias("r")).select(*named, "r.profile", "r.sequence")

    def encoded(self, records: DataFrame) -> DataFrame:
        """``records`` with ``profile_ids`` and ``sequence_ids``, each with its first and last id."""
        return records.withColumns({
            "profile_ids": encoded(F.col("profile"), self.profiles, bos=True, eos=True),
            "sequence_ids": encoded(F.col("sequence"), self.sequences, bos=True, eos=True),
        })

    def fused(self, records: DataFrame) -> DataFrame:
        """``records`` with ``fused``: one row of ids each, and with ``labels`` of what is to be learnt."""
        made = self.encoded(records).withColumn("fused", fused.fused(F.col("profile_ids"), F.col("sequence_ids"), self.layout))
        return made.withColumn("labels", fused.causal_labels(F.col("fused"))).drop("profile_ids", "sequence_ids")

    def profile_of(self, ids, skip_special: bool = True):
        return decoded(ids, self.profiles, skip_special)

    def sequence_of(self, ids, skip_special: bool = True):
        return decoded(ids, self.sequences, skip_special)


def save_training_set(records: DataFrame, path: str, profiles: Vocabulary, sequences: Vocabulary, parts: int = 8) -> TrainingSet:
    """Write records (accession, place, profile, sequence, sequence_type) in order of ``place``, then ``tokenizer_map.json``.

    Records must be of the sequences' one type; there must be one at least. The map is written last, so a folder with it
    is whole.
    """
    spark = records.sparkSession
    held = stored(records.select(F.col("place").alias("accession"), "profile", "sequence", "sequence_type"), "training-set")
    kinds = [r["sequence_type"] for r in held.select("sequence_type").distinct().limit(2).collect()]
    if kinds != [sequences.kind]:
        raise ValueError(f"records of the one type {sequences.kind} are expected, not of {kinds or 'none'}")
    artifacts.write_train_text(held.drop("sequence_type"), path, parts)
    n = held.count()
    made = TrainingSet(path, n, sequences.kind, profiles, sequences)
    layout = {"separator": made.layout.separator, "size": made.layout.size, "profile_offset": len(sequences.ids), "sequence_offset": 0}
    said = {
        "format": FORMAT, "record_count": n, "sequence_type": sequences.kind, "layout": layout,
        "profile_tokenizer": {"tokenizer": json.loads(profiles.to_json())}, "sequence_tokenizer": {"tokenizer": json.loads(sequences.to_json())},
    }
    write_text(spark, f"{path}/tokenizer_map.json", json.dumps(said, ensure_ascii=False, indent=2) + "\n")
    return made


def load_training_set(spark: SparkSession, path: str) -> TrainingSet:
    """What ``save_training_set`` wrote."""
    text = read_text(spark, f"{path}/tokenizer_map.json")
    if text is None:
        raise FileNotFoundError(f"{path}/tokenizer_map.json")
    said = json.loads(text)
    if said.get("format") != FORMAT:
        raise ValueError(f"the format {said.get('format')} isn't known")
    one = lambda name: Vocabulary.from_json(json.dumps(said[name]))
    return TrainingSet(path, int(said["record_count"]), said["sequence_type"], one("profile_tokenizer"), one("sequence_tokenizer"))
