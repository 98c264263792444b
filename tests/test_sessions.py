"""Sessions in the order of their accessions, and training sets."""

import json

import pytest
from conftest import DATA

from sparkloom.operators import artifacts, sessions
from sparkloom.operators.matching import Rule
from sparkloom.operators.vocabulary import Vocabulary
from sparkloom.plans.registry import QUERIES, SQL

ENTRIES = {
    "P3": {"included_in_current_dataset": True, "normalized_sequence": " MKV ", "sequence": "X", "description": "heat shock protein", "organism": "Org", "metadata": {"sequence_type": " Protein", "accession": "own", "n": 3}},
    "P1": {"included_in_current_dataset": True, "sequence": "ACD", "source_name": "other", "metadata": None},
    "P2": {"included_in_current_dataset": False, "sequence": "ACD"},
    "P4": {"included_in_current_dataset": True, "sequence": "  "},
    "P5": 7,
    "P6": {"included_in_current_dataset": True, "sequence": "LLL"},
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "raw_index.json").write_text(json.dumps(ENTRIES))
    (tmp_path / "accessions.txt").write_text("P6\n\nP1.2\nP9\nP6\n")
    return str(tmp_path)


def records(spark, folder):
    return sessions.session_records(sessions.read_session(spark, folder), "refseq", [Rule("chaperone", ("heat shock",))])


def test_records_of_a_session(spark, folder, tmp_path):
    rows = records(spark, folder).orderBy("place").collect()
    assert [(r["accession"], r["sequence"], r["sequence_type"]) for r in rows] == [("P6", "LLL", "protein"), ("P1", "ACD", "protein"), ("P3", "MKV", "protein")]
    last = rows[2]
    assert last["metadata"] | {"x": 1} == {
        "accession": "own", "source_name": "refseq", "description": "heat shock protein", "organism": "Org", "derived_labels": '["chaperone"]',
        "derived_keywords": '["heat shock"]', "derived_label_source": "keyword rules", "sequence_type": " Protein", "n": "3", "x": 1,
    }
    assert "labels chaperone" in last["profile"] and rows[1]["metadata"]["source_name"] == "other"
    (tmp_path / "accessions.txt").unlink()
    assert [r["accession"] for r in records(spark, folder).orderBy("place").collect()] == ["P3", "P1", "P6"]
    with pytest.raises(FileNotFoundError):
        sessions.read_session(spark, f"{folder}/none")
    (tmp_path / "raw_index.json").write_text(json.dumps({"Q": {"included_in_current_dataset": True, "sequence": "A", "metadata": {"sequence_type": "sugar"}}}))
    with pytest.raises(Exception, match="isn't known: sugar"):
        records(spark, folder).collect()
    (tmp_path / "raw_index.json").write_text('{"Q": {"sequence": "A"}, "R": 1, "Q": {"included_in_current_dataset": true, "sequence": "B"}}')
    assert [r["sequence"] for r in records(spark, folder).collect()] == ["B"]


PROFILES = Vocabulary.of("".join(map(chr, range(32, 127))), ("task ", "labels "), kind="profile")


def test_training_set_round_trip(spark, folder, tmp_path):
    sequences = Vocabulary.of("ACDEFGHIKLMNPQRSTVWYX", ("MK", "LL"))
    rows, path = records(spark, folder), f"{tmp_path}/set"
    made = sessions.save_training_set(rows, path, PROFILES, sequences, 2)
    back = sessions.load_training_set(spark, path)
    assert made == back and back.records == 3 and back.kind == "protein"
    want = [(r["profile"], r["sequence"]) for r in rows.orderBy("place").collect()]
    assert [(r["profile"], r["sequence"]) for r in back.rows(spark).orderBy("pos").collect()] == want
    coded = back.encoded(back.rows(spark))
    for r in coded.select("profile", "sequence", back.profile_of(coded["profile_ids"]).alias("p"), back.sequence_of(coded["sequence_ids"]).alias("s"), "sequence_ids").collect():
        assert (r["p"], r["s"]) == (r["profile"], r["sequence"]) and r["sequence_ids"][0] == 1 and r["sequence_ids"][-1] == 2
    for r in back.fused(back.rows(spark)).collect():
        ids, f = r["fused"]["ids"], r["fused"]
        assert ids[f["separator_at"]] == back.layout.separator and len(r["labels"]) == len(ids) - 1
        assert [x for x in r["labels"] if x != -100] == ids[f["sequence_start"] :]
    with pytest.raises(FileExistsError):
        sessions.save_training_set(rows, path, PROFILES, sequences)
    for kind, some in (("rna", rows), ("protein", rows.limit(0))):
        with pytest.raises(ValueError, match="one type"):
            sessions.save_training_set(some, f"{tmp_path}/no", PROFILES, Vocabulary.of("ACG", kind=kind))
    with pytest.raises(FileNotFoundError):
        sessions.load_training_set(spark, f"{tmp_path}/no")
    said = json.loads((tmp_path / "set" / "tokenizer_map.json").read_text())
    (tmp_path / "set" / "tokenizer_map.json").write_text(json.dumps(said | {"record_count": 4}))
    with pytest.raises(ValueError, match="3 records"):
        sessions.load_training_set(spark, path).rows(spark)
    (tmp_path / "set" / "tokenizer_map.json").write_text(json.dumps(said | {"format": "x"}))
    with pytest.raises(ValueError, match="isn't known"):
        sessions.load_training_set(spark, path)


def test_query(spark, same_as_sql):
    same_as_sql(QUERIES["session_rows"](spark, DATA), SQL["session_rows"])


def test_places_over_batches_and_splits(spark, tmp_path):
    path, rows = f"{tmp_path}/set", spark.range(3000).selectExpr("id AS accession", "'p' || id AS profile", "'MKV' AS sequence")
    artifacts.write_train_text(rows, path, 3)
    artifacts.write_train_text(rows.selectExpr("accession", "'q' || accession AS profile", "sequence"), path, 4, append=True)
    made = sessions.TrainingSet(path, 6000, "protein", PROFILES, Vocabulary.of("MKV"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        placed = made.rows(spark, "k")
        found = placed.select("k", "profile", "pos.block").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r["block"] for r in found}) > 10
    assert sorted((r["k"], r["profile"]) for r in found) == [(i, f"{'pq'[i // 3000]}{i % 3000}") for i in range(6000)]
    # Lines are numbered where they lie, without a sort or a shuffle of texts.
    assert "rangepartitioning" not in placed._jdf.queryExecution().executedPlan().toString()
