"""Instruction rows, candidates, spans, token rows, metrics, incremental states and the dataset store, on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import artifacts, candidates, datasets, fused, incremental, instructions, metrics, retrieval, sampling, spans, storage
from sparkloom.operators.matching import Rule
from sparkloom.sources.sequences import read_json_lines


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_instruction_records(spark, tmp_path):
    lines = [
        '{"instruction": "make  a<|sep|>b", "input": "x", "output": "mk v", "sequence_type": "DNA "}', "", "nope", "[1]", '{"output": "MK"}',
        '{"instruction": "go", "output": " "}', "{}", '{"instruction": "go", "output": "mk", "metadata": {"sequence_type": "rna"}, "output_format": "plain"}',
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    rows = instructions.records(read_json_lines(spark, str(tmp_path / "a.jsonl"))).collect()
    assert [r["status"] for r in rows] == ["valid", "empty", "invalid", "not_object", "missing_instruction", "missing_output", "missing_both", "valid"]
    assert rows[0]["profile"] == f"{instructions.PREAMBLE} ### Instruction: make a b ### Input: x ### Response:"
    assert (rows[0]["sequence"], rows[0]["sequence_type"], rows[7]["sequence_type"], rows[7]["output_format"]) == ("MKV", "dna", "rna", "plain")
    counts = {(r["kind"], r["value"]): r["n"] for r in instructions.audit(instructions.records(read_json_lines(spark, str(tmp_path / "a.jsonl")))).collect()}
    assert counts["rows", "seen"] == 7 and counts["status", "valid"] == 2 and counts["key", "instruction"] == 3 and counts["key", "metadata"] == 1
    found = instructions.records(read_json_lines(spark, str(tmp_path / "a.jsonl")), form="compact")
    assert found.first()["profile"] == "make a b; input x"
    with pytest.raises(Exception, match="instruction row is"):
        instructions.required(found).collect()
    assert [r["output_length"] for r in instructions.previews(found, 1, "value").collect()] == [2]


def test_split_keys_and_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 7}\n{"accession": "A", "id": 7}\n{"output": "b\\"c", "input": "", "instruction": "é"}\n{"x": 1}\n')
    keys = [r["k"] for r in read_json_lines(spark, str(tmp_path / "a.jsonl")).select(instructions.split_key(F.col("payload"), F.lit("f:1")).alias("k")).collect()]
    assert keys == ["accession:7", "accession:A", '{"instruction": "é", "output": "b\\"c"}', "f:1"]
    line = one(spark, instructions.train_line(F.lit("p; q"), F.lit("MK")))
    assert one(spark, instructions.parsed_line(F.lit(line + "\n"))) == ("p; q", "MK") and one(spark, instructions.parsed_line(F.lit("MK"))) is None
    assert one(spark, instructions.between_tags(F.lit("x<|protein|>A<|protein|>M K<|endoftext|>rest"))) == "MK"
    assert one(spark, instructions.field_faults(F.lit("a<|sep|>"))) and not one(spark, instructions.field_faults(F.lit("a")))
    assert one(spark, instructions.prefixed(F.lit("  Task Protein span completion; x"), "task protein span completion")) == "Task Protein span completion; x"


def test_candidates(spark):
    rows = spark.createDataFrame(
        [("ok", "M K" * 40, 0.9, 80.0, True, 1.0), ("none", " ", None, None, False, None), ("odd", "MKB" * 30, None, 55.0, True, 0.2)],
        "id string, sequence string, confidence double, plddt double, has_prediction boolean, geo double",
    ).withColumns({"ptm": F.lit(None).cast("double"), "iptm": F.lit(None).cast("double")})
    limits = candidates.Limits(min_plddt=60.0, min_triangle_consistency=0.5)
    found = {r["id"]: r["validation"] for r in candidates.validated(rows, limits, geometry="geo").collect()}
    assert found["ok"]["passed"] and math.isclose(found["ok"]["score"], (1 + 1 + 1 + 0.9 + 1) / 5)
    assert found["none"]["reasons"] == ["empty_sequence", "missing_structure_provider"] and found["none"]["score"] == 0
    assert found["odd"]["reasons"] == ["invalid_amino_acid", "low_plddt", "low_triangle_consistency"]
    assert math.isclose(found["odd"]["score"], (2 / 3 + 1 + 1 + 0.55 + 0.2) / 5)
    score = one(spark, candidates.weighted_score(F.lit("M" * 50), F.lit(0.5), F.lit(None).cast("double"), F.lit(2.0)))
    assert math.isclose(score, 0.2 + 0.1 + 0.1 + 0.15 + 0.1)
    assert one(spark, candidates.reject_reasons(F.lit("A" * 13 + "KDE" * 40))) == ["single_residue_run", "hydrophobic_run", "hydrophobic_start"]


def plain_consistency(m, tolerance=1e-6):
    n, bad = len(m), 0
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(j + 1, n):
                a, b, c = m[i][j], m[i][k], m[j][k]
                bad += (a + b + tolerance < c) + (a + c + tolerance < b) + (b + c + tolerance < a)
    return 1 - bad / (n * (n - 1) * (n - 2) / 2) if n > 2 else 1.0


def test_triangles_by_brute_force(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 7):
        m = np.abs(rng.normal(size=(n, n)))
        m = m + m.T
        got = one(spark, candidates.triangle_consistency(F.array(*[F.array(*map(F.lit, map(float, r))) for r in m])))
        assert math.isclose(got, plain_consistency(m.tolist()), abs_tol=1e-12)


def plain_span(q, width, flank):
    best = None
    for s in range(len(q) - width + 1):
        span = q[s : s + width]
        if set(span) - set(T.STANDARD) or span in q[:s] + q[s + width :]:
            continue
        run = max(len(list(g)) for _, g in __import__("itertools").groupby(span))
        central = 1.0 if len(q) <= width else 1 - abs(s + width / 2 - len(q) / 2) / (len(q) / 2)
        flanks = (min(flank, s) / flank + min(flank, len(q) - s - width) / flank) / 2
        score = max(0, min(1, 0.42 * len(set(span)) / min(20, width) + 0.34 * flanks + 0.24 * central - min(0.35, run / width * 0.7)))
        if best is None or score > best[1] + 1e-12:
            best = (s, score)
    return best


def test_best_spans_by_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ACDEFGHIKLX"), n)) for n in (4, 9, 30, 60)] + ["AAAAAAAAAA", "AC" * 20]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, q string")
    got = {r["k"]: (r["start"], r["score"]) for r in candidates.best_spans(rows, "k", "q", 5, 8).collect()}
    for k, q in enumerate(texts):
        want = plain_span(q, 5, 8)
        assert (k in got) == (want is not None)
        if want:
            assert math.isclose(got[k][1], want[1], abs_tol=1e-9)


def test_spans_take_the_first_unused_attempt(spark):
    rows = spark.createDataFrame([(1, "ACDEFGHIKLMNPQRSTVWY" * 4), (2, "ACDEFGHIKL"), (3, "ACDXFGHIKLMNPQRSTVWY" * 40)], "k int, q string")
    found = spans.span_examples(rows, "k", "q", examples=6, shortest=64, longest=900, mask=(22, 24)).collect()
    mine = [r for r in found if r["k"] == 1]
    places = [(r["policy"], r["mask_start"], r["mask_end"]) for r in mine]
    assert len(set(places)) == len(places) and all(r["k"] != 2 for r in found)
    assert {r["reason"]: r["n"] for r in spans.span_skips(rows, "q").collect()} == {"fitting": 2, "too_short": 1}
    assert not [r for r in spans.span_faults(spans.span_examples(rows, "k", "q")).collect() if r["faults"]]


def test_kmers_and_fused_rows(spark):
    rows = spark.createDataFrame([(1, "ABCAB"), (2, "CABX")], "k long, q string")
    vocabulary = {r["kmer"]: r["id"] for r in fused.kmer_vocabulary(rows, "q", "k", 2).collect()}
    assert vocabulary == {"AB": 4, "BC": 5, "CA": 6, "BX": 7}
    few = fused.kmer_vocabulary(rows, "q", "k", 2, most=3)
    coded = {r["k"]: r["ids"] for r in fused.kmer_codes(rows, "q", "k", few, 2).collect()}
    assert coded == {1: [1, 4, 5, 6, 4, 2], 2: [1, 6, 4, 3, 2]}
    assert one(spark, fused.merged_kmers(F.array(*map(F.lit, ("AB", "BC", "CA"))), 2)) == "ABCA"
    assert one(spark, fused.merged_kmers(F.array(*map(F.lit, ("AB", "CA"))), 2)) is None
    layout = fused.Layout(10, 5)
    row = one(spark, fused.fused(F.array(*map(F.lit, (1, 4, 2))), F.array(*map(F.lit, (1, 7, 8, 2))), layout))
    assert row["ids"] == [1, 14, 15, 7, 8, 2] and (row["separator_at"], row["sequence_start"], row["sequence_end"]) == (2, 3, 5)
    made = F.struct(F.array(*map(F.lit, row["ids"])).alias("ids"), F.lit(2).alias("separator_at"), F.lit(3).alias("sequence_start"), F.lit(5).alias("sequence_end"))
    assert one(spark, fused.causal_labels(made)) == [-100, -100, 7, 8, 2] and one(spark, fused.causal_labels(made, on_end=False)) == [-100, -100, 7, 8, -100]
    assert one(spark, fused.causal_labels(made, on_prompt=True)) == [14, 15, 7, 8, 2] and one(spark, fused.causal_labels(made, on_separator=True))[1] == 15
    with pytest.raises(Exception, match="outside its range"):
        one(spark, fused.fused(F.array(F.lit(9)), F.array(F.lit(7)), layout))


def test_logits(spark):
    x = F.array(*map(F.lit, (2.0, 1.0, 1.0, -1.0)))
    assert one(spark, fused.penalised(x, F.array(F.lit(0), F.lit(3)), 2.0)) == [1.0, 1.0, 1.0, -2.0]
    assert one(spark, fused.top_k(x, 2)) == [2.0, 1.0, 1.0, float("-inf")] and one(spark, fused.top_k(x, 0)) == [2.0, 1.0, 1.0, -1.0]
    assert one(spark, fused.top_p(x, 1e-9)) == [2.0] + [float("-inf")] * 3
    df = spark.range(4).select(x.alias("x"), (F.col("id") / 4).alias("u"))
    seen = F.array().cast("array<int>")
    assert {r["token"] for r in fused.with_next_token(df, F.col("x"), seen, F.col("u"), temperature=0.0).collect()} == {0}
    drawn = [r["token"] for r in fused.with_next_token(df, F.col("x"), seen, F.col("u"), k=3).orderBy("u").collect()]
    assert drawn == [0, 0, 0, 1]  # 0.58, 0.21 and 0.21


def test_metrics(spark):
    values = spark.createDataFrame([("1.5",), ("nan",), ("None",), ("x",), ("",)], "v string").select(metrics.lenient_number(F.col("v")).alias("d"), metrics.lenient_number(F.col("v"), "long").alias("n")).collect()
    assert values[0]["d"] == 1.5 and all(math.isnan(r["d"]) for r in values[1:]) and [r["n"] for r in values] == [1, 0, 0, 0, 0]
    assert one(spark, metrics.perplexity(F.lit(0.0))) == 1 and math.isnan(one(spark, metrics.perplexity(F.lit(51.0))))
    rng = np.random.default_rng(2)
    v = rng.normal(size=40)
    rows = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("b", 0, 3.0)], "s string, t int, v double")
    got = {(r["s"], r["t"]): r["smooth"] for r in metrics.smoothed(rows, "s", "t", "v", 5, 3).collect()}
    middle = [np.median(np.pad(v, 2, "edge")[i : i + 5]) for i in range(40)]
    want = [np.pad(middle, 1, "edge")[i : i + 3].mean() for i in range(40)]
    assert all(math.isclose(got["a", i], want[i], abs_tol=1e-12) for i in range(40)) and got["b", 0] == 3.0
    assert math.isnan(metrics.mean_of_first(rows.limit(0), "v", "t", 3).first()["mean"])


def test_incremental_states(spark):
    rows = spark.createDataFrame([(" A.1", 3), ("A.2", 1), ("B", 2), (" ", 0)], "a string, p int")
    assert {tuple(r) for r in incremental.requested(rows, "a", "p").collect()} == {("A", "A.2", 1, 2), ("B", "B", 2, 1)}
    plan = spark.createDataFrame([("A", "unchanged")], "k string, action string")
    parameters = {"vocab": 256, "name": "x"}
    done = {"signature": incremental.signature(parameters), "complete": True}
    assert not incremental.stale(done, parameters, plan) and incremental.stale(done, {"vocab": 2}, plan) and incremental.stale({}, parameters, plan)
    assert incremental.stale(done, parameters, plan.withColumn("action", F.lit("new")))


def test_dataset_store(spark, tmp_path):
    store = datasets.DatasetStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", 1, "old"), ("b", 2, "x"), ("a", 3, "new")], "k string, pos int, v string")
    store.save(rows, "src", "one", "k", "pos")
    assert sorted(tuple(r) for r in store.read("src", "one").collect()) == [("a", 1, "new"), ("b", 2, "x")]
    first = store.catalog().first()["snapshot"]
    store.save(rows.limit(1), "src", "one")
    store.save(rows, "src", "two")
    assert [(r["dataset"], r["records"]) for r in datasets.catalog_listed(store.catalog(), "src").orderBy("dataset").collect()] == [("one", 1), ("two", 3)]
    assert spark.read.parquet(store.path("src", "one", first)).count() == 2  # the history stays
    store.delete("src", "one")
    store.delete("src", "two", permanent=True)
    assert store.catalog().count() == 0 and list((tmp_path / "store" / "trash").glob("*/src/one")) and not (tmp_path / "store" / "data" / "src" / "two").exists()
    with pytest.raises(KeyError):
        store.read("src", "one")


def test_retrieval_edges(spark):
    queries = spark.createDataFrame([(1, "heat shock protein"), (2, None)], "q int, text string")
    rows = spark.createDataFrame([(10, "a heat shock protein here"), (11, None), (12, "protein shock heat"), (13, "heat shock protein")], "k int, text string")
    found = retrieval.ranked(queries, rows, "q", "k", 2).orderBy("q", "rank").collect()
    assert [(r["q"], r["k"], r["rank"]) for r in found] == [(1, 13, 1), (1, 10, 2), (2, 10, 1), (2, 11, 2)]
    assert retrieval.ranked(queries.limit(0), rows, "q", "k", 2).count() == 0


def test_bounded_shuffle(spark):
    moved = sampling.bounded_shuffle(spark.range(500).withColumnRenamed("id", "p"), "p", 16, 3)
    order = [r["p"] for r in moved.orderBy("place").collect()]
    assert order != sorted(order) and max(i - p for i, p in enumerate(order)) < 16 and sorted(order) == list(range(500))


def test_storage_refuses_local_folders_on_clusters(monkeypatch):
    class Conf:
        def get(self, _):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    session = type("Session", (), {"sparkContext": Context()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(session)
    session.sparkContext.master = "local[4]"
    assert storage.shared_folder(session) == storage.shared_folder(session)


def test_natural_order_of_long_numbers(spark):
    names = ["x" + "9" * 30, "x1" + "0" * 30, "x007", "x7a", "x10"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.orderBy(T.natural_key(F.col("n")), "n").collect()] == ["x007", "x7a", "x10", "x" + "9" * 30, "x1" + "0" * 30]


def archive(spark, rows):
    return spark.createDataFrame(rows, "accession string, accession_version string, description string, organism string, sequence string, metadata map<string,string>")


def test_compiled_records(spark, tmp_path):
    left = archive(spark, [("a", "a.2", "short", "O", "MK", {}), ("a", "a.10", "ring thing", "O", "MKV", {"genome": "plasmid"}), ("b", "b.1", "", "", "ML", {}), ("e", "e.1", "x", "", "", {})])
    right = archive(spark, [("a", "a.10", "", "", "MKX", {"topology": "linear"}), ("c", "c.1", "one", "P", "ML", {})])
    rows = artifacts.compiled(left, right, [Rule("metal ring", ("ring",))], "made")
    found = {r["accession"]: r for r in rows.collect()}
    assert set(found) == {"a", "b", "c"} and [found[k]["duplicate"] for k in "abc"] == [False, False, True]
    assert found["a"]["sequence"] == "MKX" and found["a"]["sequence_mismatch"] and found["a"]["labels"] == ["metal ring"]
    assert found["b"]["label_source"] == "structural metadata" and found["b"]["origin"] == "left_only"
    row = artifacts.summary(rows).first()
    assert (row["records"], row["paired"], row["left_only"], row["right_only"], row["mismatches"], row["duplicates"], row["kept"]) == (3, 1, 1, 1, 1, 1, 2)
    assert tuple(artifacts.label_split(rows, 1).first()) == (1, 0)
    assert {r["accession"] for r in artifacts.compiled(left, right, [], "made", most=1).collect()} == {"a"}
    artifacts.write_json_lines(rows, f"{tmp_path}/lines")
    artifacts.write_json_lines(rows, f"{tmp_path}/lines", append=True)
    back = instructions.records(read_json_lines(spark, f"{tmp_path}/lines"), form="compact")
    assert back.where("status = 'valid'").count() == 6
    artifacts.write_train_text(rows, f"{tmp_path}/train", 2)
    assert [instructions.PROFILE in r["value"] for r in spark.read.text(f"{tmp_path}/train").collect()] == [True] * 3
    with pytest.raises(Exception, match="can't be tagged"):
        artifacts.write_train_text(rows.withColumn("profile", F.lit("<|sep|>")), f"{tmp_path}/bad", 2)


def test_span_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ACDEFGHIKLMNPQRSTVWY" * 4, "go"), (2, "MK", "go")], "k int, q string, asked string")
    counts = artifacts.span_json_lines(rows, "k", "q", "asked", f"{tmp_path}/spans", mask=(22, 30)).collect()
    assert sum(r["n"] for r in counts) >= 1 and all(22 <= r["mask_length"] <= 30 for r in counts)


def test_jobs(spark, tmp_path, capsys):
    from sparkloom.__main__ import main

    (tmp_path / "a.txt").write_text("b\n\n a\nb\nc\n")
    main(["dedupe-lines", str(tmp_path / "a.txt"), "--output", f"{tmp_path}/once", "--parts", "2"])
    assert "".join(p.read_text() for p in sorted((tmp_path / "once").glob("part-*"))) == "b\na\nc\n"
    rows = "".join(f'{{"metadata": {{"dataset_group": "g{k % 2}"}}, "product": "p{k % 3}", "n": {k}}}\n' for k in range(60))
    (tmp_path / "b.jsonl").write_text(rows)
    main(["downsample", str(tmp_path / "b.jsonl"), "--output", f"{tmp_path}/less", "--keep", "0.25", "--parts", "2"])
    kept = "".join(p.read_text() for p in sorted((tmp_path / "less").glob("part-*"))).splitlines()
    assert len(kept) == 15 and kept == [x for x in rows.splitlines() if x in kept]
    main(["audit", str(tmp_path / "b.jsonl")])
    assert "missing_both" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["concat", str(tmp_path / "a.txt")])
