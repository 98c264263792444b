"""Readers of flat files and plain files, on small texts with odd parts."""

import gzip

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import annotations
from sparkloom.operators.matching import Rule
from sparkloom.sources import files, flatfiles, sequences

GENBANK = """LOCUS       chr1                      39 bp    DNA
DEFINITION  Test record.
ACCESSION   chr1
VERSION     chr1.1
KEYWORDS    RefSeq; Nitrogen fixation.
SOURCE      rice
  ORGANISM  Oryza sativa
            Eukaryota; Viridiplantae.
FEATURES             Location/Qualifiers
     source          1..39
                     /organism="Oryza sativa"
     CDS             complement(join(1..5,<8..>10))
                     /product="heat shock
                     protein"
                     /pseudo
                     /note="one"
                     /note="two"
                     /go_process="DNA repair|0006281||IEA"
     CDS             bogus
                     /note="lost"
     misc            7
                     /note="chlorophyllase"
ORIGIN
        1 acgtacgtac gtacgtacgt
       21 acgtacgtac gtacgtacg
//
LOCUS       x
ACCESSION   x2
//
LOCUS       nothing
//
"""


@pytest.fixture
def genbank(tmp_path):
    (tmp_path / "a.gb").write_text(GENBANK)
    return str(tmp_path / "a.gb")


def test_genbank(spark, genbank):
    one, two = flatfiles.read_genbank(spark, genbank).orderBy("accession").collect()
    assert (one["accession"], one["organism"], len(one["sequence"]), two["accession"], two["features"]) == ("chr1", "Oryza sativa", 39, "x2", [])
    found = [(f["feature_type"], f["start"], f["end"], f["strand"], [tuple(s) for s in f["segments"]]) for f in one["features"]]
    assert found == [("source", 1, 39, "+", [(1, 39)]), ("CDS", 1, 10, "-", [(1, 5), (8, 10)]), ("misc", 7, 7, "+", [(7, 7)])]
    q = one["features"][1]["qualifiers"]
    assert q["product"] == ["heat shock protein"] and q["pseudo"] == ["true"] and q["note"] == ["one", "two"]


def test_locations(spark):
    cases = {
        "5..9": ("+", [(5, 9)]), "complement(5..9)": ("-", [(5, 9)]), "order(1..2, 4)": ("+", [(1, 2), (4, 4)]),
        "complement(order(join(<1..>2,5^6)))": ("-", [(1, 2)]), "join(1..2": ("+", []), "": ("+", []), "J00194.1:1..9": ("+", []),
    }
    strand, segments = flatfiles.location(F.col("x"))
    rows = spark.createDataFrame([(c,) for c in cases], "x string").select("x", strand.alias("s"), segments.alias("g")).collect()
    assert {r["x"]: (r["s"], [tuple(g) for g in r["g"]]) for r in rows if r["x"] != "join(1..2"} == {k: v for k, v in cases.items() if k != "join(1..2"}
    assert next(r["g"] for r in rows if r["x"] == "join(1..2") == []


def test_protein_records_and_archives(spark, tmp_path):
    folder = tmp_path / "plants"
    folder.mkdir()
    with gzip.open(folder / "one.gpff.gz", "wt") as out:
        out.write(GENBANK)
    with gzip.open(folder / "one.faa.gz", "wt") as out:
        out.write(">chr1.2 other name [Oryza]\nACGT\n>lone.1 alone\nMK\n")
    left = flatfiles.read_genpept(spark, f"{folder}/one.gpff.gz")
    right = flatfiles.read_faa(spark, f"{folder}/one.faa.gz").withColumn("metadata", F.create_map(F.lit("from"), F.lit("faa")))
    record = left.where("accession = 'chr1'").first()
    assert record["metadata"]["keywords"] == "RefSeq; Nitrogen fixation" and record["metadata"]["taxonomy"] == "Eukaryota; Viridiplantae."
    assert record["metadata"]["product"] == "heat shock protein" and record["metadata"]["note"] == "one; two"
    assert (record["metadata"]["dataset_group"], record["metadata"]["dataset_bundle"]) == ("plants", "one")
    rows = {r["accession"]: r for r in annotations.merged_records(left, right).collect()}
    assert {k: r["origin"] for k, r in rows.items()} == {"chr1": "paired", "x2": "left_only", "lone": "right_only"}
    assert rows["chr1"]["sequence_mismatch"] and rows["chr1"]["sequence"] == "ACGT" and rows["chr1"]["accession_version"] == "chr1.2"
    assert rows["chr1"]["description"] == "Test record." and rows["chr1"]["metadata"]["from"] == "faa"


def test_truncated_archive_and_incomplete_tail(spark, tmp_path):
    (tmp_path / "cut.gb").write_text(GENBANK + "LOCUS       cut\nACCESSION   cut\n")
    assert "cut" not in " ".join(r["block"] for r in flatfiles.complete_records(spark, str(tmp_path / "cut.gb")).collect())
    assert flatfiles.flat_records(spark, str(tmp_path / "cut.gb")).count() == 4 and flatfiles.complete_records(spark, str(tmp_path / "cut.gb")).count() == 3
    whole = gzip.compress((GENBANK * 400).encode(), mtime=0)
    (tmp_path / "half.gb.gz").write_bytes(whole[: len(whole) // 2])
    assert files.tolerant(spark).text(str(tmp_path / "half.gb.gz")).count() >= 0
    with pytest.raises(Exception, match="half.gb.gz|EOF|end of"):  # no other read is let off
        spark.read.text(str(tmp_path / "half.gb.gz")).count()


def test_embl_uniprot_and_flat_entries(spark, tmp_path, genbank):
    (tmp_path / "c.embl").write_text(
        "ID   ABC123; SV 2; linear; mRNA\nPA   PAR1.1\nDE   First part\nDE   second part\nOS   Homo sapiens\nFT   CDS             1..30\n"
        'FT                   /protein_id="P1.1"\nFT                   /translation="MKV\nFT                   LLA*x"\n//\nID   NOTR; SV x9\nDE   none\n//\n'
    )
    (row,) = flatfiles.read_embl_coding(spark, str(tmp_path / "c.embl")).collect()
    assert (row["accession"], row["description"], row["organism"]) == ("ABC123", "First part second part", "Homo sapiens")
    assert (row["protein_id"], row["parent_accession"], row["translation"], row["sequence_version"]) == ("P1.1", "PAR1.1", "MKVLLA*X", "ABC123.2")
    (tmp_path / "u.fa").write_text(">sp|P12345|ENT_HUMAN Heat shock protein OS=Homo sapiens OX=9606 GN=HSP PE=1 SV=2\nMKV\nLLA\n>plain Header here\nAAA\n>tr|Q1|E OS=Mus\nCC\n>x\n")
    rows = {r["accession"]: r for r in flatfiles.read_uniprot(spark, str(tmp_path / "u.fa")).collect()}
    assert rows["P12345"]["metadata"] == {"gene": "HSP", "product": "Heat shock protein", "taxid": "9606", "source": "uniprot"}
    assert rows["P12345"]["sequence"] == "MKVLLA" and rows["plain"]["description"] == "plain Header here" and rows["Q1"]["organism"] == "Mus" and len(rows) == 3
    assert flatfiles.organism_of_headers(flatfiles.fasta_entries(spark, str(tmp_path / "u.fa"))) == "Heat shock"
    (tmp_path / "d.txt").write_text(GENBANK + "LOCUS       x\nDEFINITION  two\n            lines\nACCESSION   x2\nSOURCE      only source\n")
    entries = {r["accession"]: r for r in flatfiles.read_flat_entries(spark, str(tmp_path / "d.txt")).collect()}
    assert entries["x2"]["description"] == "two lines" and entries["x2"]["organism"] == "only source" and entries["chr1"]["version"] == "chr1.1"


def test_feature_pairs_and_audit(spark, genbank, tmp_path):
    found = flatfiles.read_genbank(spark, genbank)
    rows = found.select(F.col("accession").alias("sequence_id"), "pos", F.posexplode("features").alias("n", "f"))
    features = rows.select("sequence_id", F.struct("pos", "n").alias("pos"), "f.*")
    features = features.union(features).union(features.withColumn("sequence_id", F.lit("unknown")))
    known = found.select(F.col("accession").alias("sequence_id"), "organism", "sequence")
    rules = [Rule("DNA repair", ("dna repair",)), Rule("stress", ("heat shock", "shock protein")), Rule("leaf", ("phyll",))]
    pairs = {r["label"]: r for r in annotations.feature_pairs(features, known, rules).collect()}
    assert set(pairs) == {"DNA repair", "stress"} and pairs["stress"]["keywords"] == ["heat shock", "shock protein"]
    assert pairs["stress"]["profile"] == "Stress gene in Oryza sativa" and pairs["DNA repair"]["profile"] == "DNA repair gene in Oryza sativa"
    assert pairs["stress"]["sequence"] == "GTATACGT"  # ACGTA and TAC, turned
    audit = annotations.label_audit(features, known, rules)
    (row,) = annotations.audit_summary(audit).collect()
    assert (row["features"], row["eligible"], row["matched"], row["missing_sequence"], row["multi_label"]) == (9, 6, 2, 3, 2)
    empty = annotations.audit_summary(audit.limit(0)).first()
    assert empty["features"] == 0 and empty["match_rate"] == 0


def test_minus_strand_of_gff(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 Oryza sativa\nACGTTTGGGCCC\n")
    (tmp_path / "a.gff").write_text("chr1\tx\tgene\t1\t4\t.\t-\t.\tNote=x\n")
    (row,) = sequences.feature_sequences(sequences.read_gff(spark, str(tmp_path / "a.gff")), sequences.read_fasta(spark, str(tmp_path / "a.fa"))).collect()
    assert row["sequence"] == "ACGT"


def test_plain_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\t b \t\n1 \t\tz\n x\t2\tz\n")
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "t.tsv"), "\t").orderBy("a").collect()] == [("1", ""), ("x", "2")]
    for n, body in ((10, "c\n"), (2, "b\nb2"), (1, "a\n")):
        (tmp_path / f"train_part_{n}.txt").write_text(body)
    rows = files.train_parts(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r["line"] for r in rows] == ["a", "b", "b2", "c"]
    files.write_in_order(files.train_parts(spark, str(tmp_path)), f"{tmp_path}/whole", 3)
    names = sorted((tmp_path / "whole").glob("part-*"))
    assert "".join(p.read_text() for p in names) == "a\nb\nb2\nc\n"
    (tmp_path / "index.json").write_text('{"a": {"sequence": "MK"}, "b": 3, "c": {"sequence": "L"}}')
    assert sorted(r["key"] for r in files.read_json_object(spark, str(tmp_path / "index.json")).collect()) == ["a", "c"]
    fields, body = files.front_matter(F.lit("no fields\n"))
    assert spark.range(1).select(F.size(fields).alias("n"), body.alias("b")).first() == (0, "no fields")
    with pytest.raises(Exception, match="lacks its tags"):
        files.checked_corpus(files.train_parts(spark, str(tmp_path)), ("<|protein|>",)).collect()


def test_manifests_scopes_and_metrics(spark, tmp_path):
    (tmp_path / "m.json").write_text('{\n "records": 3,\n "name": "x"\n}\n')
    assert files.read_manifest(spark, str(tmp_path / "m.json")).first()["records"] == 3
    (tmp_path / "in" / "plants").mkdir(parents=True)
    assert files.scoped_root(spark, str(tmp_path / "in"), "/out/plants").endswith("in/plants") and files.scoped_root(spark, str(tmp_path / "in"), "/out/x") == str(tmp_path / "in")
    for name in ("a_unrelaxed.pdb", "b_relaxed.pdb", "c.pdb"):
        (tmp_path / name).write_text("x")
    assert files.best_file(files.listing(spark, str(tmp_path), "*.pdb"), "_relaxed").endswith("b_relaxed.pdb")
    rows = spark.createDataFrame([(1, 2.5), (2, float("nan")), (3, float("inf"))], "step long, loss double")
    files.append_metrics(rows, f"{tmp_path}/log")
    files.append_metrics(rows, f"{tmp_path}/log")
    back = spark.read.json(f"{tmp_path}/log", schema="step long, loss double")
    assert back.count() == 6 and back.where("loss IS NOT NULL").count() == 2
    assert files.expected_rows(rows, 3).count() == 3
    with pytest.raises(ValueError, match="expected"):
        files.expected_rows(rows, 4)


def test_blocks_stay_where_they_are_read(spark, tmp_path):
    record = 'LOCUS       X\r\nDEFINITION  Protein {0}   \r\n            of two lines.\r\nVERSION     P{0}.1\r\nFEATURES             Location/Qualifiers\r\n'
    record += '     Protein         join(1..3,<5..>9)\r\n                     /product="p{0}"\r\n     Site            4\r\n                     /note="not tracked"\r\n'
    record += "     CDS             unknown\r\n                     /gene=\"lost\"\r\nORIGIN\r\n        1 mk va\r\n\u2028 \t\r\n//\r\n"
    for name in ("a.gpff", "b.gpff"):
        whole = "".join(record.format(f"{name[0]}{i}") for i in range(200))
        (tmp_path / name).write_bytes((" \t\r\n" + whole + ("LOCUS  cut" if name == "b.gpff" else "")).encode())
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = flatfiles.read_genpept(spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        found = rows.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted(r["accession"] for r in found) == sorted(f"P{n}{i}" for n in "ab" for i in range(200))
    for r in found:
        key = r["accession"][1:]
        assert (r["description"], r["sequence"]) == (f"Protein {key} of two lines.", "MKVA")
        assert r["metadata"]["product"] == f"p{key}" and not {"note", "gene"} & set(r["metadata"])
