"""Annotated features: their text, the rules that it matches, profile-sequence pairs, and the audit of labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_segments, let, normal_dna, normal_rna
from .matching import Rule, matched

# Qualifiers that make up a feature's text, in order.
TEXT_QUALIFIERS = (
    "name", "gene", "gene_synonym", "product", "product_synonym", "prot_desc", "note", "description", "function",
    "functional_annotation", "pathway", "ec_number", "go_process", "go_function", "go_component", "ontology_term",
    "experiment", "inference", "ncrna_class",
)
GO = ("go_process", "go_function", "go_component")
# Feature types that a profile calls a gene.
GENES = ("gene", "cds", "mrna", "transcript")


def go_label(value: Column) -> Column:
    """The label of a gene-ontology value: what stands before ``|``, or behind `` - `` if it begins with ``GO:``."""
    coded = F.upper(value).startswith("GO:") & (F.instr(value, " - ") > 0)
    return F.trim(
        F.when(F.instr(value, "|") > 0, F.substring_index(value, "|", 1))
        .when(coded, F.substr(value, F.instr(value, " - ") + 3))
        .otherwise(value)
    )


def feature_text(feature_type: Column, qualifiers: Column) -> Column:
    """The type and the values of the text qualifiers, whose names count without regard to case, in single spaces."""

    def text(lowered: Column) -> Column:
        values = [F.array(feature_type)]
        for key in TEXT_QUALIFIERS:
            trimmed = F.transform(F.coalesce(lowered[key], F.array().cast("array<string>")), lambda v: F.trim(v))
            values.append(F.transform(trimmed, go_label) if key in GO else trimmed)
        return F.array_join(F.filter(F.transform(F.concat(*values), lambda v: F.trim(v)), lambda v: v != ""), " ")

    # Of keys that differ in case alone, the last counts.
    entries = F.transform(F.map_entries(qualifiers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = let(entries, lambda es: F.filter(
        es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.greatest(F.size(es), F.lit(1))), lambda later: later["key"] == e["key"])
    ))
    return let(F.map_from_entries(last), text)


def rendered_profile(label: Column, feature_type: Column, organism: Column) -> Column:
    """``Label entity in organism``; the first letter alone is raised."""
    kind = F.lower(F.trim(feature_type))
    entity = F.when(kind.isin(*GENES), "gene").otherwise(F.coalesce(F.nullif(kind, F.lit("")), F.lit("feature")))
    raised = F.concat(F.upper(F.substring(label, 1, 1)), F.substr(label, F.lit(2)))
    return F.concat_ws(" ", raised, entity, F.when(organism != "", F.concat(F.lit("in "), organism)))


def fragments(features: DataFrame, sequences: DataFrame, kind: str = "dna") -> DataFrame:
    """``features`` with annotation_text, organism, has_sequence and fragment, the normalised part of the sequence.

    ``features`` has sequence_id, feature_type, start, end, strand, segments and qualifiers; ``sequences`` has a unique
    sequence_id, organism and sequence. A sequence with very many features meets them in a join that Spark splits.
    """
    if kind not in ("dna", "rna"):
        raise ValueError("kind must be dna or rna")
    whole = sequences.select("sequence_id", F.col("organism").alias("_organism"), F.col("sequence").alias("_whole"))
    joined = features.join(whole, "sequence_id", "left")
    normal = normal_dna if kind == "dna" else normal_rna
    # Complements are those of DNA; the letters of RNA come from them.
    part = normal(join_segments(normal_dna(F.col("_whole")), F.col("segments"), F.col("strand")))
    text = feature_text(F.coalesce("feature_type", F.lit("")), F.coalesce("qualifiers", F.create_map().cast("map<string,array<string>>")))
    return joined.select(
        *features.columns, text.alias("annotation_text"), F.coalesce("_organism", F.lit("")).alias("organism"),
        (F.coalesce(F.col("_whole"), F.lit("")) != "").alias("has_sequence"), F.coalesce(part, F.lit("")).alias("fragment"),
    )


def feature_pairs(features: DataFrame, sequences: DataFrame, rules: list[Rule], kind: str = "dna", pos: str = "pos") -> DataFrame:
    """A row for each feature and rule that matches its text, the first by ``pos`` for each place and label.

    Columns: profile, sequence, sequence_id, organism, feature_type, start, end, strand, label, keywords and
    annotation_text. Features without a sequence, or with an empty part of it, make no pair.
    """
    rows = fragments(features, sequences, kind).where("has_sequence AND fragment <> ''")
    hits = rows.withColumn("hit", F.explode(matched(F.col("annotation_text"), rules)))
    pair = F.struct(
        rendered_profile(F.col("hit.label"), F.col("feature_type"), F.col("organism")).alias("profile"),
        F.col("fragment").alias("sequence"), "organism", "feature_type", "strand", F.col("hit.keywords").alias("keywords"),
        "annotation_text",
    )
    keys = ["sequence_id", "start", "end", F.col("hit.label").alias("label")]
    first = hits.groupBy(*keys).agg(F.min_by(pair, pos).alias("pair"))
    return first.select("sequence_id", "start", "end", "label", "pair.*")


def label_audit(features: DataFrame, sequences: DataFrame, rules: list[Rule], kind: str = "dna") -> DataFrame:
    """Every feature with ``status``, fragment_length, labels and keywords; no feature goes.

    Status: missing_annotation, missing_sequence, empty_sequence_fragment, unmatched or matched.
    """
    rows = fragments(features, sequences, kind).withColumn("hits", matched(F.col("annotation_text"), rules))
    usable = (F.col("annotation_text") != "") & F.col("has_sequence") & (F.col("fragment") != "")
    status = (
        F.when(F.col("annotation_text") == "", "missing_annotation")
        .when(~F.col("has_sequence"), "missing_sequence")
        .when(F.col("fragment") == "", "empty_sequence_fragment")
        .when(F.size("hits") == 0, "unmatched")
        .otherwise("matched")
    )
    hits = F.when(usable, F.col("hits"))
    none = F.array().cast("array<string>")
    return rows.select(
        *features.columns, "organism", "annotation_text",
        F.when(usable, F.length("fragment")).otherwise(0).alias("fragment_length"),
        F.coalesce(F.transform(hits, lambda h: h["label"]), none).alias("labels"),
        F.coalesce(F.flatten(F.transform(hits, lambda h: h["keywords"])), none).alias("keywords"), status.alias("status"),
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    """One row of counts over an audit, with match_rate: the matched share of the eligible features, 0 if none is."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    eligible = F.col("status").isin("matched", "unmatched")
    sums = {s: count(F.col("status") == s) for s in ("matched", "unmatched", "missing_annotation", "missing_sequence", "empty_sequence_fragment")}
    row = audit.agg(
        F.count("*").alias("features"), count(eligible).alias("eligible"), *[v.alias(k) for k, v in sums.items()],
        count(F.size("labels") > 1).alias("multi_label"),
    )
    return row.withColumn("match_rate", F.when(F.col("eligible") > 0, F.col("matched") / F.col("eligible")).otherwise(F.lit(0.0)))


def audit_histograms(audit: DataFrame) -> DataFrame:
    """(kind, value, n): how often each label, keyword, feature type, and type of an unmatched feature occurs."""
    each = F.explode(F.concat(
        F.transform("labels", lambda x: F.struct(F.lit("label").alias("kind"), x.alias("value"))),
        F.transform("keywords", lambda x: F.struct(F.lit("keyword").alias("kind"), x.alias("value"))),
        F.array(F.struct(F.lit("feature_type").alias("kind"), F.col("feature_type").alias("value"))),
        F.when(F.col("status") == "unmatched", F.array(F.struct(F.lit("unmatched_feature_type").alias("kind"), F.col("feature_type").alias("value"))))
        .otherwise(F.array().cast("array<struct<kind:string,value:string>>")),
    )).alias("h")
    return audit.select(each).groupBy("h.kind", "h.value").agg(F.count("*").alias("n"))


def top_annotations(audit: DataFrame, status: Column, k: int, pos: str = "pos") -> DataFrame:
    """(annotation_text, n): the ``k`` most frequent texts among rows of ``status``, of equals the first by ``pos``."""
    counts = audit.where(status).groupBy("annotation_text").agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(k).drop("first")


# Fixed values: (parts of the field's text, label) of the structural labels, by field and in order.
GENOME_LABELS = (
    (("plasmid",), "plasmid sequence"), (("chromosome",), "chromosome sequence"), (("mitochond",), "mitochondrial sequence"),
    (("chloroplast", "plastid"), "plastid sequence"), (("segment",), "segmented genome sequence"),
)
OTHER_LABELS = (
    ("completeness", "complete", "complete sequence"), ("completeness", "partial", "partial sequence"),
    ("completeness", "draft", "draft sequence"), ("topology", "circular", "circular molecule"),
    ("topology", "linear", "linear molecule"),
)
MOLECULES = (("mrna", "mRNA sequence"), ("rrna", "rRNA sequence"), ("trna", "tRNA sequence"), ("cdna", "cDNA sequence"))
STRUCTURE = ("biomol", "moltype", "genome", "completeness", "topology")


def structural_labels(metadata: Column, kind: Column) -> Column:
    """Labels that follow from the fields of a record's structure, distinct and in order; ``kind`` names the last one."""
    value = {k: F.coalesce(F.lower(F.trim(metadata[k])), F.lit("")) for k in STRUCTURE}
    has = lambda text, *parts: reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])
    signal = F.array_join(F.filter(F.array(*value.values()), lambda v: v != ""), " ")

    def labels(s: Column) -> Column:
        genomic = has(value["genome"], "genome", "genomic") | has(value["biomol"], "genomic") | has(value["moltype"], "genomic")
        named = [F.when(has(value["genome"], *ps), label) for ps, label in GENOME_LABELS] + [F.when(genomic, "genomic sequence")]
        named += [F.when(has(value[field], p), label) for field, p, label in OTHER_LABELS]
        named += [F.when(has(s, p), label) for p, label in MOLECULES]
        named += [F.when(has(s, "genomic dna"), "genomic DNA sequence").when(has(s, "dna"), "DNA sequence")]
        plain_rna = has(s, "rna") & ~has(s, "mrna", "rrna", "trna")
        last = F.when(kind == "dna", "DNA sequence").when(kind == "rna", "RNA sequence").otherwise("protein sequence")
        return F.array_distinct(F.array_compact(F.array(*named, F.when(plain_rna, "RNA sequence"), last)))

    return let(signal, labels)


# Fields whose text can carry labels, and those that a profile lists.
SIGNAL_FIELDS = ("fasta_header", "description", "function", "pathway", "note", "product", "strain")
PROFILE_FIELDS = (
    "biomol", "moltype", "genome", "completeness", "topology", "tech", "assemblyacc", "biosample", "strain", "scientific_name",
)
RESERVED = ("<|profile|>", "<|sep|>", "<|protein|>", "<|endoftext|>")


def component(text: Column) -> Column:
    """A value as part of a profile: no reserved token, ``,`` for ``;``, single spaces."""
    for token in RESERVED:
        text = F.replace(text, F.lit(token), F.lit(" "))
    return F.trim(F.regexp_replace(F.replace(text, F.lit(";"), F.lit(",")), r"\s+", " "))


def inferred_labels(description: Column, metadata: Column, kind: Column, rules: list[Rule]) -> Column:
    """(labels, keywords, label_source): by keyword rules over the signal fields, else by the record's structure."""
    values = [component(F.coalesce(metadata[f], F.lit(""))) for f in SIGNAL_FIELDS]
    signal = F.trim(F.array_join(F.filter(F.array(F.coalesce(description, F.lit("")), *values), lambda v: v != ""), " "))

    def of(hits: Column) -> Column:
        by_rules = F.struct(
            F.array_distinct(F.transform(hits, lambda h: h["label"])).alias("labels"),
            F.array_distinct(F.flatten(F.transform(hits, lambda h: h["keywords"]))).alias("keywords"),
            F.lit("keyword rules").alias("label_source"),
        )
        by_structure = F.struct(
            structural_labels(metadata, kind).alias("labels"), F.array().cast("array<string>").alias("keywords"),
            F.lit("structural metadata").alias("label_source"),
        )
        return F.when(F.size(hits) > 0, by_rules).otherwise(by_structure)

    return let(matched(signal, rules), of)


def profile_text(
    description: Column, organism: Column, metadata: Column, kind: Column, source: Column, rules: list[Rule],
    task: str = "conditional sequence generation",
) -> Column:
    """``task ..; labels ..; label source ..; keywords ..; description ..``: the profile that a sequence is made from."""

    def of(found: Column) -> Column:
        part = lambda name, value: F.when(component(value) != "", F.concat(F.lit(f"{name} "), component(value)))
        parts = [
            F.lit(f"task {task}"), part("labels", F.array_join(found["labels"], ", ")), part("label source", found["label_source"]),
            part("keywords", F.array_join(found["keywords"], ", ")), part("description", description), part("organism", organism),
            part("sequence type", kind), part("source", source), *[part(f, metadata[f]) for f in PROFILE_FIELDS],
        ]
        return F.array_join(F.array_compact(F.array(*parts)), "; ")

    return let(inferred_labels(description, metadata, kind, rules), of)


def merged_records(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of two archives of one accession each, paired, with origin: paired, left_only or right_only.

    Metadata of the left side is kept and filled up from the right; ``sequence_mismatch`` marks pairs whose sequences
    differ. Sequence and version come from the right, description and organism from the left, each if it has them.
    """
    l, r = left.alias("l"), right.alias("r")
    joined = l.join(r, F.col("l.accession") == F.col("r.accession"), "full")
    given = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")), F.lit(""))
    both = F.col("l.accession").isNotNull() & F.col("r.accession").isNotNull()
    empty = F.create_map().cast("map<string,string>")
    mine, theirs = F.coalesce("l.metadata", empty), F.coalesce("r.metadata", empty)
    filled = F.map_concat(mine, F.map_filter(theirs, lambda k, _: ~F.map_contains_key(mine, k)))
    differ = both & (F.col("l.sequence") != "") & (F.col("r.sequence") != "") & (F.col("l.sequence") != F.col("r.sequence"))
    return joined.select(
        F.coalesce("l.accession", "r.accession").alias("accession"), given("r.accession_version", "l.accession_version").alias("accession_version"),
        given("l.description", "r.description").alias("description"), given("l.organism", "r.organism").alias("organism"),
        given("r.sequence", "l.sequence").alias("sequence"), filled.alias("metadata"),
        F.coalesce(differ, F.lit(False)).alias("sequence_mismatch"),
        F.when(both, "paired").when(F.col("l.accession").isNotNull(), "left_only").otherwise("right_only").alias("origin"),
    )
