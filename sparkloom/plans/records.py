"""Queries over records: flat files made of the tables and read back, annotated features, instruction rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import annotations, artifacts, instructions
from ..operators.matching import Rule
from ..operators.ordered import numbered
from ..operators.storage import scratch_path, stored
from ..sources import flatfiles
from ..sources.sequences import read_json_lines
from .registry import query, table

RULES = [Rule("metal ring", ("ring",)), Rule("small part", ("small", "tiny part")), Rule("bolt", ("bolt", "second line"))]


def written(rows: DataFrame, text: Column, name: str) -> str:
    """The path of text files that hold a text of each row."""
    path = scratch_path(rows.sparkSession, name)
    rows.select(text.alias("value")).write.text(path)
    return path


def written_objects(rows: DataFrame, member: Column, key: str, path: str, files: int = 64) -> None:
    """Text files that hold a JSON object each, whose members are those of the rows: entries are written one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "{"
        for batch in batches:
            said = []
            for x in batch.column(0):
                said.append(mark + x.as_py())
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if mark == "{" else "}"])], names=["value"])

    rows.repartition(files, key).select(member.alias("value")).mapInArrow(run, "value string").write.text(path)


def lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _letters(name: Column) -> Column:
    return F.translate(F.md5(name), "0123456789abcdef", "acgtacgtacgtacgt")


def _genbank(spark: SparkSession, sf_dir: str) -> str:
    """The parts as GenBank records of three features, one of which has no usable place."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    return written(
        table(spark, sf_dir, "part"),
        lines(
            text("LOCUS       P", key, "  32 bp    DNA"), text("DEFINITION  ", name, "."), text("ACCESSION   P", key),
            text("VERSION     P", key, ".", F.col("p_size").cast("string")), text("SOURCE      ", F.col("p_type")),
            text("  ORGANISM  ", F.col("p_brand")), "FEATURES             Location/Qualifiers", "     source          1..32",
            text('                     /organism="', F.col("p_brand"), '"'),
            "     gene            complement(join(2..5,<8..>12))", text('                     /product="', name),
            '                     second line"', "                     /pseudo", "     CDS             unknown",
            '                     /note="lost"', "ORIGIN", text("        1 ", F.substring(_letters(name), 1, 10), " ", F.substring(_letters(name), 11, 22)),
            "//",
        ),
        "genbank",
    )


GENBANK = """WITH p AS (SELECT 'P' || p_partkey AS accession, p_brand AS organism, p_name, p_size, p_type,
upper(translate(md5(p_name), '0123456789abcdef', 'acgtacgtacgtacgt')) AS sequence FROM part),
g AS (SELECT *, reverse(translate(substr(sequence, 2, 4) || substr(sequence, 8, 5), 'ACGT', 'TGCA')) AS fragment, 'gene ' || p_name || ' second line' AS text FROM p)"""


@query(GENBANK + """ SELECT accession, organism, sequence, 'source' AS feature_type, 1 AS start_at, 32 AS end_at, '+' AS strand, NULL AS product, FALSE AS pseudo FROM p
UNION ALL SELECT accession, organism, sequence, 'gene', 2, 12, '-', p_name || ' second line', TRUE FROM p""")
def genbank_features(spark, sf_dir):
    """GenBank records read back, a row for each feature."""
    rows = flatfiles.read_genbank(spark, _genbank(spark, sf_dir)).select("accession", "organism", "sequence", F.explode("features").alias("f"))
    return rows.select(
        "accession", "organism", "sequence", "f.feature_type", F.col("f.start").alias("start_at"), F.col("f.end").alias("end_at"), "f.strand",
        F.get(F.col("f.qualifiers")["product"], F.lit(0)).alias("product"), F.map_contains_key("f.qualifiers", "pseudo").alias("pseudo"),
    )


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # Parsed once, and stored: features and sequences are two readings of it.
    found = stored(flatfiles.read_genbank(spark, _genbank(spark, sf_dir)), "genbank")
    features = found.select(F.col("accession").alias("sequence_id"), "pos", F.posexplode("features").alias("n", "f"))
    features = features.select("sequence_id", F.struct("pos", "n").alias("pos"), "f.*")
    return features, found.select(F.col("accession").alias("sequence_id"), "organism", "sequence")


def _rule_sql(rule: Rule, text_column: str) -> str:
    return " OR ".join(f"contains(' ' || lower({text_column}) || ' ', ' {k} ')" for k in rule.keywords)


@query(GENBANK + ", r AS (" + " UNION ALL ".join(f"SELECT *, '{r.label}' AS label FROM g WHERE {_rule_sql(r, 'text')}" for r in RULES) + """)
SELECT accession AS sequence_id, 2 AS start_at, 12 AS end_at, label, upper(label[1]) || label[2:] || ' gene in ' || organism AS profile, fragment AS sequence, '-' AS strand, text AS annotation_text FROM r""")
def feature_pairs(spark, sf_dir):
    """Profiles and sequences of the features that keyword rules match."""
    pairs = annotations.feature_pairs(*_features(spark, sf_dir), RULES)
    return pairs.select("sequence_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "label", "profile", "sequence", "strand", "annotation_text")


@query(GENBANK + ", t AS (SELECT text, TRUE AS gene FROM g UNION ALL SELECT 'source', FALSE FROM p), m AS (SELECT *, "
       + " + ".join(f"({_rule_sql(r, 'text')})::INT" for r in RULES) + """ AS n FROM t)
SELECT count(*) AS features, count(*) AS eligible, count(*) FILTER (WHERE n > 0) AS matched, count(*) FILTER (WHERE n = 0) AS unmatched, 0::BIGINT AS missing_annotation,
0::BIGINT AS missing_sequence, 0::BIGINT AS empty_sequence_fragment, count(*) FILTER (WHERE n > 1) AS multi_label, count(*) FILTER (WHERE n > 0)::DOUBLE / count(*) AS match_rate FROM m""")
def label_audit_summary(spark, sf_dir):
    """What the rules match, over all features."""
    return annotations.audit_summary(annotations.label_audit(*_features(spark, sf_dir), RULES))


@query(GENBANK + ", h AS (" + " UNION ALL ".join(
    [f"SELECT 'label' AS kind, '{r.label}' AS value FROM g WHERE {_rule_sql(r, 'text')}" for r in RULES]
    + [f"SELECT 'keyword', '{k}' FROM g WHERE contains(' ' || lower(text) || ' ', ' {k} ')" for r in RULES for k in r.keywords]
    + ["SELECT 'feature_type', 'gene' FROM g", "SELECT 'feature_type', 'source' FROM g", "SELECT 'unmatched_feature_type', 'source' FROM g"]
) + ") SELECT kind, value, count(*) AS n FROM h GROUP BY 1, 2")
def label_audit_histograms(spark, sf_dir):
    return annotations.audit_histograms(annotations.label_audit(*_features(spark, sf_dir), RULES))


@query(GENBANK + " SELECT text AS annotation_text, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, min(substr(accession, 2)::INT) LIMIT 5")
def top_annotations(spark, sf_dir):
    """The five most frequent texts of features with a label, of equals the first."""
    audit = annotations.label_audit(*_features(spark, sf_dir), RULES).withColumn("at", F.substr("sequence_id", F.lit(2)).cast("long"))
    return annotations.top_annotations(audit, F.col("status") == "matched", 5, "at")


@query("SELECT 'P' || p_partkey AS accession, p_name || '.' AS description, p_brand AS organism, 'P' || p_partkey || '.' || p_size AS version FROM part")
def flat_entries(spark, sf_dir):
    """The header fields of flat-file records, the last record of an accession."""
    return flatfiles.read_flat_entries(spark, _genbank(spark, sf_dir))


@query(GENBANK + " SELECT accession, accession || '.' || p_size AS accession_version, p_name || '.' AS description, organism, sequence, organism AS scientific_name, 5 AS fields FROM p")
def genpept_records(spark, sf_dir):
    """Protein records with their metadata: folder, bundle, source name, description and scientific name."""
    rows = flatfiles.read_genpept(spark, _genbank(spark, sf_dir))
    return rows.select(
        "accession", "accession_version", "description", "organism", "sequence", F.col("metadata")["scientific_name"].alias("scientific_name"),
        F.size("metadata").alias("fields"),
    )


@query("""SELECT 'S' || s_suppkey AS accession, s_name || ' coding' AS description, 'NATION ' || s_nationkey AS organism, 'P' || s_suppkey || '.1' AS protein_id,
'PAR' || s_nationkey AS parent_accession, upper(translate(md5(s_name), '0123456789', 'GHIKLMNPQR')) AS translation, 'S' || s_suppkey || '.' || (s_suppkey % 7) AS sequence_version
FROM supplier WHERE s_suppkey % 5 <> 0""")
def embl_coding(spark, sf_dir):
    """Coding entries of EMBL records; those without a translation go."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    letters = F.translate(F.md5("s_name"), "0123456789", "GHIKLMNPQR")
    translation = F.when(F.col("s_suppkey") % 5 != 0, lines(
        text('FT                   /translation="', F.substring(letters, 1, 20)), text("FT                   ", F.substring(letters, 21, 12), '"')
    ))
    path = written(table(spark, sf_dir, "supplier"), lines(
        text("ID   S", key, "; SV ", (F.col("s_suppkey") % 7).cast("string"), "; linear; mRNA"), text("PA   PAR", nation),
        text("DE   ", F.col("s_name")), "DE   coding", text("OS   NATION ", nation), "FT   CDS             1..90",
        text('FT                   /protein_id="P', key, '.1"'), translation, "//",
    ), "embl")
    return flatfiles.read_embl_coding(spark, path).drop("pos")


@query("""SELECT 'C' || c_custkey AS accession, c_name || ' protein' AS description, 'Genus ' || c_nationkey AS organism, upper(translate(md5(c_name), '0123456789', 'GHIKLMNPQR')) AS sequence,
CASE WHEN c_custkey % 3 = 0 THEN 'g' || c_custkey END AS gene, c_nationkey::VARCHAR AS taxid FROM customer""")
def uniprot_records(spark, sf_dir):
    """UniProt entries with the fields of their headers."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    letters = F.translate(F.md5("c_name"), "0123456789", "GHIKLMNPQR")
    gene = F.when(F.col("c_custkey") % 3 == 0, text(" GN=g", key)).otherwise("")
    header = text(">sp|C", key, "|E", key, "_X ", F.col("c_name"), " protein OS=Genus ", nation, " OX=", nation, gene, " PE=1 SV=2")
    path = written(table(spark, sf_dir, "customer"), lines(header, F.substring(letters, 1, 20), F.substring(letters, 21, 12)), "uniprot")
    rows = flatfiles.read_uniprot(spark, path)
    return rows.select("accession", "description", "organism", "sequence", F.col("metadata")["gene"].alias("gene"), F.col("metadata")["taxid"].alias("taxid"))


@query("""WITH l AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT * FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(l.c_custkey, r.c_custkey) AS accession, CASE WHEN l.c_custkey IS NULL THEN 'right_only' WHEN r.c_custkey IS NULL THEN 'left_only' ELSE 'paired' END AS origin,
coalesce(r.c_custkey || '.2', l.c_custkey || '.1') AS accession_version, coalesce(l.c_name, r.c_mktsegment) AS description, coalesce(r.c_custkey % 10 = 1 AND l.c_custkey IS NOT NULL, FALSE) AS sequence_mismatch,
coalesce(CASE WHEN r.c_custkey % 10 = 1 THEN 'OTHER' ELSE r.c_name END, l.c_name) AS sequence, CASE WHEN l.c_custkey IS NOT NULL THEN 'left' ELSE 'right' END AS side,
CASE WHEN r.c_custkey IS NOT NULL THEN r.c_mktsegment END AS segment FROM l FULL JOIN r ON l.c_custkey = r.c_custkey""")
def merged_records(spark, sf_dir):
    """Two archives of one set of records, paired; metadata is filled up and differing sequences are marked."""
    customer = table(spark, sf_dir, "customer")
    record = lambda rows, version, description, sequence, metadata: rows.select(
        F.col("c_custkey").alias("accession"), text(F.col("c_custkey").cast("string"), version).alias("accession_version"),
        F.col(description).alias("description"), F.lit("").alias("organism"), sequence.alias("sequence"), metadata.alias("metadata"),
    )
    left = record(customer.where("c_custkey % 3 <> 0"), ".1", "c_name", F.col("c_name"), F.create_map(F.lit("side"), F.lit("left")))
    other = F.when(F.col("c_custkey") % 10 == 1, "OTHER").otherwise(F.col("c_name"))
    right = record(customer.where("c_custkey % 4 <> 0"), ".2", "c_mktsegment", other, F.create_map(F.lit("side"), F.lit("right"), F.lit("segment"), F.col("c_mktsegment")))
    rows = annotations.merged_records(left, right)
    return rows.select("accession", "origin", "accession_version", "description", "sequence_mismatch", "sequence", F.col("metadata")["side"].alias("side"), F.col("metadata")["segment"].alias("segment"))


@query("""WITH m AS (SELECT p_partkey, p_name, p_brand, p_type, CASE p_size % 4 WHEN 0 THEN 'genomic DNA' WHEN 1 THEN 'mRNA' WHEN 2 THEN 'transcribed RNA' ELSE 'protein' END AS moltype,
CASE WHEN p_size % 3 = 0 THEN 'linear' WHEN p_size % 3 = 1 THEN 'circular' END AS topology, CASE WHEN p_size % 5 = 0 THEN 'plasmid' END AS genome FROM part),
l AS (SELECT *, contains(' ' || p_name || ' ', ' ring ') AS a, contains(' ' || p_name || ' ', ' small ') AS b, contains(' ' || p_name || ' ', ' bolt ') AS c FROM m),
s AS (SELECT *, list_filter([CASE WHEN a THEN 'metal ring' END, CASE WHEN b THEN 'small part' END, CASE WHEN c THEN 'bolt' END], lambda x: x IS NOT NULL) AS by_rule,
list_filter([CASE WHEN a THEN 'ring' END, CASE WHEN b THEN 'small' END, CASE WHEN c THEN 'bolt' END], lambda x: x IS NOT NULL) AS words,
list_filter([CASE WHEN genome = 'plasmid' THEN 'plasmid sequence' END, CASE WHEN moltype = 'genomic DNA' THEN 'genomic sequence' END, CASE WHEN topology = 'circular' THEN 'circular molecule' END,
CASE WHEN topology = 'linear' THEN 'linear molecule' END, CASE WHEN moltype = 'mRNA' THEN 'mRNA sequence' END, CASE WHEN moltype = 'genomic DNA' THEN 'genomic DNA sequence' END,
CASE WHEN moltype = 'transcribed RNA' THEN 'RNA sequence' END, 'protein sequence'], lambda x: x IS NOT NULL) AS by_structure FROM l)
SELECT p_partkey, 'task conditional sequence generation; labels ' || CASE WHEN len(by_rule) > 0 THEN array_to_string(by_rule, ', ') || '; label source keyword rules; keywords ' || array_to_string(words, ', ')
ELSE array_to_string(by_structure, ', ') || '; label source structural metadata' END || '; description ' || p_name || '; organism ' || p_brand || '; sequence type protein; source parts; moltype ' || moltype
|| coalesce('; genome ' || genome, '') || coalesce('; topology ' || topology, '') AS profile FROM s""")
def compiled_profiles(spark, sf_dir):
    """Profiles of records from their metadata, by keyword rules or by structure."""
    size = F.col("p_size")
    moltype = F.when(size % 4 == 0, "genomic DNA").when(size % 4 == 1, "mRNA").when(size % 4 == 2, "transcribed RNA").otherwise("protein")
    metadata = F.create_map(
        F.lit("moltype"), moltype, F.lit("topology"), F.when(size % 3 == 0, "linear").when(size % 3 == 1, "circular"),
        F.lit("genome"), F.when(size % 5 == 0, "plasmid"),
    )
    rows = table(spark, sf_dir, "part").withColumn("m", metadata)
    profile = annotations.profile_text(F.col("p_name"), F.col("p_brand"), F.col("m"), F.lit("protein"), F.lit("parts"), RULES)
    return rows.select("p_partkey", profile.alias("profile"))


def _instruction_file(spark: SparkSession, sf_dir: str) -> str:
    """Turns as instruction rows: some lack a field, some lines are blank, no JSON or no object."""
    turn, n = F.col("turn"), F.col("conv_id")
    row = F.to_json(F.struct(
        F.when(n % 7 != 1, F.col("text")).alias("instruction"), F.when(turn % 2 == 0, F.col("role")).alias("input"),
        F.when(n % 7 != 2, F.substring(F.md5("text"), 1, 12)).alias("output"), F.when(n % 3 == 0, "DNA ").alias("sequence_type"),
        F.when(n % 4 == 0, F.struct(F.lit("rna").alias("sequence_type"))).alias("metadata"), F.concat_ws("-", n, turn).alias("id"),
    ))
    line = F.when(n % 11 == 3, "").when(n % 11 == 4, "{broken").when(n % 11 == 5, "[1]").otherwise(row)
    return written(table(spark, sf_dir, "conversations").where("text IS NOT NULL"), line, "instructions")


INSTRUCTIONS = r"""WITH t AS (SELECT conv_id AS n, turn, text, CASE WHEN turn % 2 = 0 THEN role END AS given FROM conversations WHERE text IS NOT NULL),
s AS (SELECT *, CASE WHEN n % 7 <> 1 THEN trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') ELSE '' END AS i, CASE WHEN n % 7 <> 2 THEN upper(substr(md5(text), 1, 12)) ELSE '' END AS o,
CASE WHEN n % 3 = 0 THEN 'dna' WHEN n % 4 = 0 THEN 'rna' ELSE 'protein' END AS kind FROM t),
j AS (SELECT *, CASE WHEN n % 11 = 3 THEN 'empty' WHEN n % 11 = 4 THEN 'invalid' WHEN n % 11 = 5 THEN 'not_object' WHEN i = '' AND o = '' THEN 'missing_both' WHEN i = '' THEN 'missing_instruction'
WHEN o = '' THEN 'missing_output' ELSE 'valid' END AS status FROM s)"""


def _instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instructions.records(read_json_lines(spark, _instruction_file(spark, sf_dir)))


@query(INSTRUCTIONS + """, e AS (SELECT 'rows' AS kind, 'seen' AS value FROM j WHERE status <> 'empty' UNION ALL SELECT 'status', status FROM j UNION ALL SELECT 'sequence_type', kind FROM j WHERE status = 'valid'
UNION ALL SELECT 'output_format', 'unspecified' FROM j WHERE status = 'valid'
UNION ALL SELECT 'key', unnest(list_filter(['id', CASE WHEN n % 7 <> 1 THEN 'instruction' END, CASE WHEN given IS NOT NULL THEN 'input' END, CASE WHEN n % 7 <> 2 THEN 'output' END,
CASE WHEN n % 3 = 0 THEN 'sequence_type' END, CASE WHEN n % 4 = 0 THEN 'metadata' END], lambda x: x IS NOT NULL)) FROM j WHERE status NOT IN ('empty', 'invalid', 'not_object'))
SELECT kind, value, count(*) AS n FROM e GROUP BY 1, 2""")
def instruction_audit(spark, sf_dir):
    """Status, key, type and format counts over a JSON Lines file."""
    return instructions.audit(_instructions(spark, sf_dir))


@query(INSTRUCTIONS + f""" SELECT md5('{instructions.PREAMBLE} ### Instruction: ' || i || coalesce(' ### Input: ' || given, '') || ' ### Response:') AS profile_md5, o AS sequence, kind AS sequence_type, count(*) AS n
FROM j WHERE status = 'valid' GROUP BY ALL""")
def instruction_records(spark, sf_dir):
    """The valid rows as prompts and sequences."""
    rows = _instructions(spark, sf_dir).where("status = 'valid'")
    return rows.groupBy(F.md5("profile").alias("profile_md5"), "sequence", "sequence_type").agg(F.count("*").alias("n"))


@query(INSTRUCTIONS + """ SELECT 'accession:' || n || '-' || turn AS key, CASE WHEN (('0x' || substr(sha1('7:accession:' || n || '-' || turn), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE) < 0.9::DOUBLE
THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM j WHERE status NOT IN ('empty', 'invalid', 'not_object') GROUP BY ALL""")
def instruction_splits(spark, sf_dir):
    """The split of each row by its key."""
    from ..operators.sampling import split_of

    rows = _instructions(spark, sf_dir).where("status NOT IN ('empty', 'invalid', 'not_object')")
    keyed = rows.select(instructions.split_key(F.col("payload"), F.lit("none")).alias("key"))
    return keyed.groupBy("key", split_of(F.col("key"), 0.9, 7).alias("split")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, 'name ' || c_name || '; segment ' || c_mktsegment AS profile, upper(md5(c_name)) AS sequence FROM customer")
def train_lines(spark, sf_dir):
    """Tagged training lines, written, read back and taken apart."""
    rows = table(spark, sf_dir, "customer")
    profile = instructions.instruction_of({"name": F.col("c_name"), "nothing": F.lit(" "), "segment": F.col("c_mktsegment")})
    line = instructions.train_line(profile, F.upper(F.md5("c_name")))
    path = written(rows.where(~instructions.field_faults(profile)), text(line, "#", F.col("c_custkey").cast("string")), "train")
    back = spark.read.text(path).select(F.substring_index("value", "#", -1).cast("long").alias("c_custkey"), F.regexp_replace("value", "#[0-9]+$", "").alias("line"))
    return back.select("c_custkey", instructions.parsed_line(F.col("line")).alias("p")).select("c_custkey", "p.profile", "p.sequence")


@query(r"""WITH q AS (SELECT doc_id, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS q FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, q, (doc_id % 50)::INT AS a, (8 + doc_id % 20)::INT AS w FROM q WHERE length(q) >= 100),
r AS (SELECT *, substr(q, a + 1, w) AS output, substr(q, greatest(a - 64, 0) + 1, least(a, 64)) AS l, substr(q, a + w + 1, 64) AS r FROM s),
g AS (SELECT *, 'mask_policy random_span; mask_start ' || a || '; mask_length ' || w || '; left_flank ' || l || '; right_flank ' || r || '; partial_sequence ' || l || '<MASK_' || w || '>' || r AS given FROM r)
SELECT doc_id, output, md5(given) AS input_md5, contains('task protein span completion; go on; input ' || given, output) AS leaks,
CASE WHEN contains('task protein span completion; go on; input ' || given, output) THEN 'leak' ELSE '' END AS faults FROM g""")
def span_rows(spark, sf_dir):
    """Span rows of documents' residues in the shape of instructions, and the invariants that each breaks."""
    residues = F.regexp_replace(F.upper("text"), f"[^{T.STANDARD}]", "")
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", residues.alias("q")).where(F.length("q") >= 100)
    start, width = (F.col("doc_id") % 50).cast("int"), (F.col("doc_id") % 20 + 8).cast("int")
    made = rows.select("doc_id", start.alias("a"), width.alias("w"), instructions.span_row(F.col("q"), start, width, F.lit("random_span"), F.lit("go on")).alias("s"))
    faults = instructions.span_row_faults(F.col("s.instruction"), F.col("s.input"), F.col("s.output"), F.col("a"), F.col("a") + F.col("w"), F.col("w"))
    return made.select("doc_id", "s.output", F.md5("s.input").alias("input_md5"), "s.leaks", F.array_join(faults, ",").alias("faults"))


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two archives of the customers: one with two versions of some records, one with other sequences for some."""
    customer, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.when(key % 9 == 4, "shared").otherwise(F.col("c_name"))
    row = lambda rows, version, described, sequence, metadata: rows.select(
        F.lpad(key.cast("string"), 9, "0").alias("accession"), text("A", key.cast("string"), ".", version).alias("accession_version"),
        described.alias("description"), F.lit("Genus").alias("organism"), F.upper(F.md5(sequence)).alias("sequence"), metadata.alias("metadata"),
    )
    left = customer.where(key % 3 != 0)
    plain = F.create_map(F.lit("genome"), F.lit("plasmid"))
    first = row(left, "1", F.lit("old"), F.lit("old"), plain)
    later = row(left, "12", text("a ring of ", F.lower("c_mktsegment")), name, plain)
    right = row(customer.where(key % 4 != 0), "3", F.lit("plain"), F.when(key % 10 == 1, "other").otherwise(name), F.create_map(F.lit("topology"), F.lit("linear")))
    return artifacts.compiled(first.union(later), right, RULES, "made")


ARCHIVES = """WITH l AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT * FROM customer WHERE c_custkey % 4 <> 0),
m AS (SELECT coalesce(l.c_custkey, r.c_custkey) AS k, coalesce(l.c_name, r.c_name) AS c_name, CASE WHEN l.c_custkey IS NULL THEN 'right_only' WHEN r.c_custkey IS NULL THEN 'left_only' ELSE 'paired' END AS origin,
coalesce(l.c_mktsegment, r.c_mktsegment) AS seg FROM l FULL JOIN r ON l.c_custkey = r.c_custkey),
s AS (SELECT *, CASE WHEN k % 9 = 4 THEN 'shared' ELSE c_name END AS mine FROM m), t AS (SELECT *, CASE WHEN origin <> 'left_only' AND k % 10 = 1 THEN 'other' ELSE mine END AS seq FROM s),
c AS (SELECT *, upper(md5(seq)) AS sequence, min(k) OVER (PARTITION BY seq) < k AS duplicate, origin = 'paired' AND k % 10 = 1 AS mismatch FROM t)"""


@query(ARCHIVES + """ SELECT lpad(k::VARCHAR, 9, '0') AS accession, origin, CASE WHEN origin = 'left_only' THEN 'A' || k || '.12' ELSE 'A' || k || '.3' END AS accession_version, sequence, duplicate, mismatch AS sequence_mismatch,
'task conditional sequence generation; labels ' || CASE WHEN origin = 'right_only' THEN 'linear molecule, protein sequence; label source structural metadata; description plain'
ELSE 'metal ring; label source keyword rules; keywords ring; description a ring of ' || lower(seg) END || '; organism Genus; sequence type protein; source made' || CASE WHEN origin = 'right_only' THEN '' ELSE '; genome plasmid' END
|| CASE WHEN origin = 'left_only' THEN '' ELSE '; topology linear' END AS profile FROM c""")
def compiled_records(spark, sf_dir):
    """One record for each accession of two archives, with profiles and duplicate sequences marked."""
    return _archives(spark, sf_dir).select("accession", "origin", "accession_version", "sequence", "duplicate", "sequence_mismatch", "profile")


@query(ARCHIVES + """ SELECT count(*) AS records, count(*) FILTER (WHERE origin = 'right_only') AS right_only, count(*) FILTER (WHERE origin = 'left_only') AS left_only, count(*) FILTER (WHERE origin = 'paired') AS paired,
count(*) FILTER (WHERE mismatch) AS mismatches, count(*) FILTER (WHERE duplicate) AS duplicates, count(*) FILTER (WHERE NOT duplicate) AS kept FROM c""")
def archive_summary(spark, sf_dir):
    return artifacts.summary(_archives(spark, sf_dir))


@query(ARCHIVES + " SELECT row_number() OVER (ORDER BY k) - 1 AS place, md5(sequence) AS sequence_md5 FROM c WHERE NOT duplicate")
def written_archive(spark, sf_dir):
    """The kept records as tagged text, read back in the order of its files."""
    path, rows = scratch_path(spark, "train-text"), _archives(spark, sf_dir).where("NOT duplicate")
    artifacts.write_train_text(rows, path, 5)
    back = artifacts.train_text(spark, path).select("pos", F.md5(instructions.parsed_line(F.col("line"))["sequence"]).alias("sequence_md5"))
    return numbered(back, [], ["pos"], "place").select("place", "sequence_md5")


@query(GENBANK + ", r AS (" + " UNION ALL ".join(f"SELECT '{r.label}' AS label FROM g WHERE {_rule_sql(r, 'text')}" for r in RULES) + ") SELECT label, count(*) AS n FROM r GROUP BY 1")
def pairs_dataset(spark, sf_dir):
    """Profile-sequence pairs written as a dataset, and how many there are of each label."""
    return artifacts.pairs_dataset(annotations.feature_pairs(*_features(spark, sf_dir), RULES), scratch_path(spark, "pairs"))
