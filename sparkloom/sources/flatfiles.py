"""Readers of ``//``-separated flat files (GenBank, GenPept, DDBJ, EMBL) and of FASTA variants, as column expressions.

Spark splits the files at record ends; a record is taken apart by expressions over its lines, without Python. Each
reader's rows have ``pos``, the place of the record, by which first and last of equal keys are told in order of files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_accession, header_organism, let, upper_residues
from ..operators.clean import best_of_each

# Features and qualifiers that a protein record's metadata takes over.
TRACKED_FEATURES = ("source", "protein", "cds")
TRACKED_QUALIFIERS = (
    "gene", "gene_synonym", "product", "note", "coded_by", "chromosome", "plasmid", "organelle", "segment", "host",
)
FEATURES = (
    "array<struct<feature_type:string,start:int,end:int,strand:string,segments:array<struct<start:int,end:int>>,"
    "qualifiers:map<string,array<string>>>>"
)
#: Where a feature begins: five spaces and a key in the next 16 columns.
FEATURE_START = r"\n(?= {5}(?! {16}).{16})"
QUALIFIER = " " * 21


def place() -> Column:
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n")).alias("pos")


def made_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are evaluated once a row: filters on them stay above, not copied to the source."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n//").text(path).select("value", place())


def _stripped(value: Column) -> Column:
    """Without carriage returns, leading blanks and line ends, and trailing white space."""

    def of(text: Column) -> Column:
        # ``$`` also stands before a last line end of any kind.
        loose = F.substring(text, -1, 1).rlike(r"[\s\u0085\u2028\u2029]")
        return F.when(loose, F.regexp_replace(text, r"(?<!\s)\s+$", "")).otherwise(text)

    return let(F.ltrim(F.ltrim(F.replace(value, F.lit("\r"), F.lit("")), F.lit(" \t")), F.lit("\n")), of)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return made_once(_pieces(spark, path), block=_stripped(F.col("value"))).select("block", "pos")


def flat_records(spark: SparkSession, path: str) -> DataFrame:
    """(block, pos) of the records that a ``//`` line ends or that end with the file; blank ones go."""
    return _blocks(spark, path).where("block <> ''")


def complete_records(spark: SparkSession, path: str) -> DataFrame:
    """As ``flat_records``, without the tail of a file that no ``//`` line ends, as a truncated archive leaves it.

    What follows a file's last ``//`` is its last block: blank where the file is whole. Of damaged archives
    ``archives.read_archives`` reads what can be read. Blocks stay where they are read; what is sent around is a row for
    each file.
    """
    ends = _pieces(spark, path).groupBy("pos.file_path", "pos.file_block_start").agg(F.max("pos.n").alias("n"))
    last = ends.groupBy(F.col("file_path").alias("file")).agg(F.max(F.struct("file_path", "file_block_start", "n")).alias("last"))
    joined = _blocks(spark, path).join(F.broadcast(last), F.col("pos.file_path") == F.col("file"))
    return joined.where((F.col("pos") < F.col("last")) & (F.col("block") != "")).select("block", "pos")


def field(block: Column, tag: str) -> Column:
    """A field's text with its continuation lines, in single spaces; empty if the record lacks it."""
    raw = F.regexp_extract(block, rf"(?m)^ {{0,2}}{tag} +(.*(?:\n {{12}}.*)*)", 1)
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def first_line(block: Column, tag: str) -> Column:
    """The text of a field's first line, from column 12 on; null if the record lacks it."""
    line = F.regexp_extract(block, rf"(?m)^( {{0,2}}{tag}.*)$", 1)
    return F.when(line != "", F.trim(F.substr(line, F.lit(13))))


def origin(block: Column) -> Column:
    at = F.instr(block, "ORIGIN")
    return F.when(at == 0, "").otherwise(F.upper(F.regexp_replace(F.substr(block, at + 6), "[^A-Za-z]+", "")))


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), '^"+|"+$', "")


def location(raw: Column) -> tuple[Column, Column]:
    """Strand and (start, end) segments of a location: ranges or single places under complement, join and order."""
    shape = r"^[<>]?(\d+)(?:\.\.[<>]?(\d+))?$"
    wrapped = lambda plain: F.regexp_extract(plain, r"^((?:(?:complement|join|order)\(\s*)*)", 1)

    def segment(part: Column) -> Column:
        start, end = F.regexp_extract(part, shape, 1), F.regexp_extract(part, shape, 2)
        return F.struct(start.cast("int").alias("start"), let(end, lambda e: F.when(e != "", e).otherwise(start)).cast("int").alias("end"))

    def segments(plain: Column, wrappers: Column, depth: Column) -> Column:
        closed = plain.endswith(F.repeat(F.lit(")"), depth))
        inner = F.when(closed, F.substr(plain, F.length(wrappers) + 1, F.length(plain) - F.length(wrappers) - depth)).otherwise("")
        parts = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda p: p.rlike(shape))
        return F.transform(parts, segment)

    def of(plain: Column) -> Column:
        depth = lambda w: F.length(w) - F.length(F.replace(w, F.lit("(")))
        return let(wrapped(plain), lambda w: let(depth(w), lambda d: segments(plain, w, d)))

    strand = F.when(F.contains(wrapped(F.trim(raw)), F.lit("complement(")), "-").otherwise("+")
    return strand, let(F.trim(raw), of)


def _qualifier(payload: Column) -> Column:
    """(key, value) of a qualifier's lines; a flag has the value ``true``; continuations follow after a space."""

    def of(lines: Column) -> Column:
        more = F.transform(
            F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: x.startswith(QUALIFIER)),
            lambda x: _unquoted(F.substr(x, F.lit(22))),
        )

        def made(head: Column) -> Column:
            first = F.when(F.instr(head, "=") > 0, _unquoted(F.substr(head, F.instr(head, "=") + 1))).otherwise("true")
            value = F.trim(F.array_join(F.concat(F.array(first), F.filter(more, lambda x: x != "")), " "))
            return F.struct(F.trim(F.substring_index(head, "=", 1)).alias("key"), value.alias("value"))

        return let(F.regexp_replace(F.trim(lines[0]), "^/+", ""), made)

    return let(F.split(payload, "\n"), of)


def grouped(pairs: Column) -> Column:
    """(key, value) pairs as a map of arrays, in order."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(
        keys,
        lambda k: F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]).alias("value")),
    ))


def features(block: Column, types: tuple[str, ...] = ()) -> Column:
    """The features of a GenBank record; those without a usable location go, and their qualifiers with them.

    With ``types``, in lower case, features of other types go before they are taken apart.
    """
    at = F.instr(block, "FEATURES")
    section = F.substring_index(F.when(at > 0, F.substr(block, at + 8)).otherwise(""), "ORIGIN", 1)

    first = lambda text: F.substring_index(text, "\n", 1)
    type_of = lambda line: F.trim(F.substring(line, 6, 16))

    def feature(text: Column) -> Column:
        def of(parts: Column) -> Column:
            line = first(parts[0])
            strand, segments = location(F.substr(line, F.lit(22)))
            pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), _qualifier)

            def made(s: Column) -> Column:
                return F.struct(
                    type_of(line).alias("feature_type"),
                    F.array_min(F.transform(s, lambda x: x["start"])).alias("start"),
                    F.array_max(F.transform(s, lambda x: x["end"])).alias("end"),
                    strand.alias("strand"), s.alias("segments"), let(pairs, grouped).alias("qualifiers"),
                )

            return let(segments, made)

        return let(F.split(text, rf"\n {{21}}(?=/)"), of)

    texts = let(F.split(section, FEATURE_START), lambda x: F.slice(x, 2, F.greatest(F.size(x), F.lit(1))))
    if types:
        texts = F.filter(texts, lambda text: F.lower(type_of(first(text))).isin(*types))
    found = F.transform(texts, feature)
    return F.filter(found, lambda f: F.size(f["segments"]) > 0)


#: Whence readers take (block, pos) of the records of a path.
Records = Callable[[SparkSession, str], DataFrame]


def read_genbank(spark: SparkSession, path: str, records: Records = flat_records) -> DataFrame:
    """(accession, organism, sequence, features, pos) of GenBank records; those without accession and version go.

    As in the other readers, ``records`` tells whether a tail that no ``//`` ends is a record: ``flat_records`` or
    ``complete_records``.
    """
    b = F.col("block")
    given = lambda tag: F.nullif(first_line(b, tag), F.lit(""))
    accession = F.regexp_extract(F.coalesce(given("ACCESSION"), given("VERSION")), r"^(\S+)", 1)
    rows = records(spark, path).select(
        accession.alias("accession"), F.coalesce(given("ORGANISM"), given("SOURCE"), F.lit("")).alias("organism"),
        origin(b).alias("sequence"), features(b).alias("features"), "pos",
    )
    return rows.where("accession <> ''")


def read_flat_entries(spark: SparkSession, path: str, records: Records = flat_records) -> DataFrame:
    """(accession, description, organism, version) of DDBJ-style records; the last record of an accession counts."""
    b = F.col("block")
    word = lambda tag: F.regexp_extract(field(b, tag), r"^(\S+)", 1)
    organism = F.regexp_extract(b, r"(?m)^  ORGANISM +(.*(?:\n {12}.*)*)", 1)
    rows = records(spark, path).select(
        word("ACCESSION").alias("accession"), field(b, "DEFINITION").alias("description"),
        F.coalesce(F.nullif(F.trim(F.regexp_replace(organism, r"\s+", " ")), F.lit("")), field(b, "SOURCE")).alias("organism"),
        F.nullif(word("VERSION"), F.lit("")).alias("version"), "pos",
    )
    return best_of_each(rows.where("accession <> ''"), ["accession"], F.col("pos")).drop("pos")


def read_embl_coding(spark: SparkSession, path: str, records: Records = flat_records) -> DataFrame:
    """(accession, description, organism, protein_id, parent_accession, translation, sequence_version, pos).

    Records of EMBL coding entries; those without a translation go. A numeric version follows the accession.
    """
    b = F.col("block")
    values = lambda tag: F.array_join(F.transform(F.regexp_extract_all(b, F.lit(rf"(?m)^{tag}(.*)$"), F.lit(1)), lambda x: F.trim(x)), " ")
    parts = F.filter(F.transform(F.split(F.regexp_extract(b, r"(?m)^ID(.*)$", 1), ";"), lambda x: F.trim(x)), lambda p: p != "")
    version = F.try_element_at(F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: p.startswith("SV ")), F.lit(-1))
    suffix = F.trim(F.substr(version, F.lit(4)))
    ft = F.array_join(F.transform(F.regexp_extract_all(b, F.lit(r"(?m)^FT(.*)$"), F.lit(1)), lambda x: F.rtrim(F.substr(x, F.lit(20)))), "\n")
    quoted = lambda name: F.regexp_extract("ft", rf'/{name}="([^"]+)"', 1)
    rows = records(spark, path).select(
        F.get(parts, F.lit(0)).alias("accession"), values("DE").alias("description"), values("OS").alias("organism"),
        F.nullif(F.trim(F.try_element_at(F.filter(F.transform(F.regexp_extract_all(b, F.lit(r"(?m)^PA(.*)$"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != ""), F.lit(-1))), F.lit("")).alias("parent_accession"),
        F.when(suffix.rlike(r"^\d+$"), F.concat(F.get(parts, F.lit(0)), F.lit("."), suffix)).otherwise(F.nullif(suffix, F.lit(""))).alias("sequence_version"),
        ft.alias("ft"), "pos",
    )
    coded = rows.withColumn("translation", F.upper(F.regexp_replace(quoted("translation"), "[^A-Za-z*]", "")))
    return coded.where("accession IS NOT NULL AND translation <> ''").select(
        "accession", "description", "organism", F.nullif(F.trim(quoted("protein_id")), F.lit("")).alias("protein_id"),
        "parent_accession", "translation", "sequence_version", "pos",
    )


def without_period(text: Column) -> Column:
    return F.regexp_replace(text, r"\.$", "")


def tracked_qualifiers(found: Column) -> Column:
    """The distinct values of the tracked qualifiers of tracked features, as a map of arrays."""
    tracked = F.filter(found, lambda f: F.lower(f["feature_type"]).isin(*TRACKED_FEATURES))
    pairs = F.flatten(F.transform(tracked, lambda f: F.flatten(F.transform(
        F.map_entries(f["qualifiers"]),
        lambda e: F.transform(e["value"], lambda v: F.struct(F.lower(e["key"]).alias("key"), v.alias("value"))),
    ))))
    kept = F.filter(pairs, lambda p: p["key"].isin(*TRACKED_QUALIFIERS) & (F.trim(p["value"]) != ""))
    return F.transform_values(let(kept, grouped), lambda _, v: F.array_distinct(v))


def read_genpept(spark: SparkSession, path: str, source_name: str = "refseq", records: Records = complete_records) -> DataFrame:
    """(accession, accession_version, description, organism, sequence, metadata, pos) of protein records.

    ``metadata`` has the record's fields and tracked qualifiers that aren't blank, and the folder and the name of its
    file without endings, by which archives of one bundle are paired. The tail of a truncated archive is no record.
    """
    b, file = F.col("block"), F.col("pos.file_path")
    # Qualifiers come with any location; for a protein they are ranges of residues.
    qualifiers = tracked_qualifiers(features(b, TRACKED_FEATURES))
    version = F.regexp_extract(F.coalesce(F.nullif(field(b, "VERSION"), F.lit("")), field(b, "ACCESSION")), r"^(\S+)", 1)
    organism = F.coalesce(F.nullif(first_line(b, "ORGANISM"), F.lit("")), field(b, "SOURCE"))
    taxonomy = F.regexp_extract(b, r"(?m)^  ORGANISM.*((?:\n {12}.*)*)", 1)
    plain = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    fields = {
        "dataset_group": F.element_at(F.split(file, "/"), -2),
        "dataset_bundle": F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.(gpff|faa)(\.gz)?$", ""),
        "source_name": F.lit(source_name), "description": F.col("described"),
        "keywords": without_period(field(b, "KEYWORDS")), "dbsource": field(b, "DBSOURCE"),
        "scientific_name": F.col("organism"), "taxonomy": plain(taxonomy),
    }
    own = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()])
    more = F.transform(F.map_entries(qualifiers), lambda e: F.struct(e["key"].alias("key"), F.array_join(e["value"], "; ").alias("value")))
    metadata = F.map_from_entries(F.filter(F.concat(own, more), lambda e: F.coalesce(F.trim(e["value"]) != "", F.lit(False))))
    found = made_once(records(spark, path), accession_version=version).where("accession_version <> ''")
    found = made_once(found, described=field(b, "DEFINITION"), organism=plain(organism))
    rows = found.select(
        canonical_accession(F.col("accession_version")).alias("accession"), "accession_version", "described", "organism",
        origin(b).alias("sequence"), metadata.alias("metadata"), "pos",
    )
    description = F.coalesce(F.nullif(F.col("described"), F.lit("")), F.col("metadata")["product"], F.lit(""))
    return rows.select("accession", "accession_version", description.alias("description"), "organism", "sequence", "metadata", "pos")


def fasta_entries(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence, pos) of FASTA entries; those without a header or a sequence go."""
    blocks = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "\r", "").alias("value"), place())
    block = F.regexp_replace("value", "^>", "")
    header, cut = F.trim(F.substring_index(block, "\n", 1)), F.instr(block, "\n")
    rest = F.when(cut > 0, F.substr(block, cut + 1)).otherwise("")
    return blocks.select(header.alias("header"), upper_residues(rest).alias("sequence"), "pos").where("sequence <> '' AND header <> ''")


def read_faa(spark: SparkSession, path: str) -> DataFrame:
    """(accession, accession_version, description, organism, sequence, pos) of protein FASTA archives."""
    version = F.regexp_extract("header", r"^(\S+)", 1)
    described = F.trim(F.regexp_replace(F.regexp_replace("header", r"^\S+", ""), r"\[[^\[\]]+\]\s*$", ""))
    return fasta_entries(spark, path).select(
        canonical_accession(version).alias("accession"), version.alias("accession_version"), described.alias("description"),
        header_organism(F.col("header")).alias("organism"), "sequence", "pos",
    )


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, pos) of the aligned sequences of a FASTA file."""
    return fasta_entries(spark, path).select("sequence", "pos")


UNIPROT_KEY = "OS|OX|GN|PE|SV"


def read_uniprot(spark: SparkSession, path: str) -> DataFrame:
    """(accession, description, organism, sequence, metadata, pos) of UniProt FASTA: ``db|ACC|ENTRY name OS= GN= ..``."""
    h = F.col("header")
    named = h.rlike(r"^[^|]*\|[^|]*\|.")
    tail = F.trim(F.regexp_extract(h, r"^[^|]*\|[^|]*\|(.*)$", 1))
    rest = F.when(named, F.coalesce(F.nullif(F.trim(F.regexp_replace(tail, r"^\S+", "")), F.lit("")), tail)).otherwise(h)
    rows = fasta_entries(spark, path).select("header", "sequence", "pos", rest.alias("rest"), named.alias("named"))
    value = lambda key: F.trim(F.regexp_extract("rest", rf"(?:^|\s){key}=(.*?)(?=\s(?:{UNIPROT_KEY})=|$)", 1))
    name = F.trim(F.regexp_extract("rest", rf"^(.*?)(?=(?:^|\s)(?:{UNIPROT_KEY})=|$)", 1))
    fields = {"gene": value("GN"), "product": name, "taxid": value("OX"), "source": F.lit("uniprot")}
    metadata = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()]), lambda e: e["value"] != ""
    ))
    accession = F.when(F.col("named"), F.trim(F.get(F.split("header", r"\|"), F.lit(1)))).otherwise("")
    return rows.select(
        F.coalesce(F.nullif(accession, F.lit("")), F.regexp_extract("rest", r"^(\S+)", 1)).alias("accession"),
        F.coalesce(F.nullif(name, F.lit("")), F.col("rest")).alias("description"), value("OS").alias("organism"), "sequence",
        metadata.alias("metadata"), "pos",
    )


def organism_of_headers(headers: DataFrame, header: str = "header", pos: str = "pos") -> str | None:
    """``Genus species`` of the first header whose second word is capitalised and whose third isn't; a minimum by place."""
    words = F.split(F.trim(header), r"\s+")
    fits = (F.size(words) >= 3) & words[1].rlike(r"^\p{Lu}") & words[2].rlike(r"^\p{Ll}")
    found = headers.where(fits).agg(F.min_by(F.concat_ws(" ", words[1], words[2]), pos).alias("organism")).first()
    return found["organism"]
