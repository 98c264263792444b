from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import clean, matching, ordered, sampling, tokens
from sparkloom.sources import sequences


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sequence_functions(spark):
    assert one(spark, T.normal_protein(F.lit("mpe p\tt!de"))) == "MPEPTXDE"
    assert one(spark, T.reverse_complement(F.lit("AACGTN"))) == "NACGTT"
    assert one(spark, T.slug(F.lit("  Nitrogen fixation, II "))) == "nitrogen-fixation-ii"
    assert one(spark, T.accession_version(F.lit("NP_1.12"))) == 12 and one(spark, T.accession_version(F.lit("x"))) == -1
    assert one(spark, T.longest_run(F.lit("KAILMK"), T.HYDROPHOBIC)) == 4 and one(spark, T.longest_run(F.lit(""), "A")) == 0
    segments = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(9).alias("start"), F.lit(3).alias("end")))
    assert one(spark, T.join_segments(F.lit("ACGT"), segments, F.lit("-"))) == "GT"


def test_natural_order(spark):
    df = spark.createDataFrame([("part_10",), ("part_2",), ("Part_1",)], "n string")
    assert [r["n"] for r in df.orderBy(T.natural_key(F.col("n"))).collect()] == ["Part_1", "part_2", "part_10"]


def test_token_arrays(spark):
    assert one(spark, tokens.kmers(F.lit("ABCDE"), 2, 2)) == ["AB", "CD", "DE"]
    assert one(spark, tokens.kmers(F.lit("A"), 2)) == []
    found = one(spark, tokens.windows(F.sequence(F.lit(1), F.lit(7)), 2, 3))
    assert [(w["start"], w["tokens"]) for w in found] == [(0, [1, 2, 3]), (3, [4, 5, 6]), (4, [5, 6, 7])]
    assert one(spark, tokens.padded(F.array(F.lit(5)), 3, 0)) == [5, 0, 0]
    assert one(spark, tokens.masked_labels(F.array(*map(F.lit, (1, 4, 3, 5, 6, 2))), F.lit(3), F.lit(5))) == [-100, -100, 5, 6, -100]


def test_systematic_sample_is_even(spark):
    df = spark.range(10).withColumn("s", F.lit("a"))
    kept = sampling.systematic(df, ["s"], ["id"], 3, 1 << 19)
    assert sorted(r["id"] for r in kept.collect()) == [1, 4, 8]


def test_numbering_and_running_minimum_over_hot_and_null_groups(spark):
    rows = [("hot" if i % 3 else None, i, (i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {(r["g"], r["i"]): (r["k"]) for r in ordered.numbered(df, ["g"], ["i"]).collect()}
    best = {(r["g"], r["i"]): r["best"] for r in ordered.running_minimum(df, ["g"], ["i"], "v").collect()}
    for g in ("hot", None):
        mine = [r for r in rows if r[0] == g]
        for k, (_, i, _) in enumerate(mine):
            assert got[g, i] == k and best[g, i] == (min(x[2] for x in mine[:k]) if k else None)


def test_reasons_and_first_wins(spark):
    df = spark.createDataFrame([(1, "mpept!de"), (2, "MPEPTXDE"), (3, "M?**?"), (4, ""), (5, None), (6, "MP")], "doc_id int, text string")
    found = {r["doc_id"]: r["reason"] for r in clean.normalised(df, "text", "doc_id", 3, 100, 0.25).collect()}
    assert found == {1: None, 2: "duplicate_sequence", 3: "too_ambiguous", 4: "invalid_sequence", 5: "invalid_sequence", 6: "too_short"}


def test_rules_keep_word_limits(spark):
    rules = [matching.Rule("a", ("dna repair",)), matching.Rule("b", ("phyll",))]
    assert one(spark, matching.matched_labels(F.lit("DNA-repair, chlorophyllase"), rules)) == ["a"]
    assert one(spark, matching.matched_labels(F.lit(None).cast("string"), rules)) == []


def test_fasta_and_gff(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">NP_1.2 some protein [Oryza sativa]\nacg\n\nTT\n>empty\n>chr1 x\nAAACCC\n")
    rows = {r["accession"]: r for r in sequences.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert set(rows) == {"NP_1.2", "chr1"}
    assert (rows["NP_1.2"]["sequence"], rows["NP_1.2"]["organism"], rows["NP_1.2"]["description"]) == ("ACGTT", "Oryza sativa", "some protein")
    (tmp_path / "a.gff").write_text("##gff\nchr1\tx\tgene\t1\t4\t.\t-\t.\tID=g%201;Note=a,b;flag;ID=h\nbad line\nchr1\tx\tgene\tq\t4\t.\t-\t.\t\n")
    features = sequences.read_gff(spark, str(tmp_path / "a.gff"))
    (row,) = sequences.feature_sequences(features, sequences.read_fasta(spark, str(tmp_path / "a.fa"))).collect()
    assert row["attributes"] == {"Note": ["a", "b"], "flag": ["true"], "ID": ["h"]} and row["sequence"] == "GTTT"


def test_json_lines_status(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\nno\n')
    assert [r["status"] for r in sequences.read_json_lines(spark, str(tmp_path / "a.jsonl")).collect()] == ["valid", "empty", "not_object", "invalid"]
