"""Which files a job reads, strata of records, and strict downsampling."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.__main__ import main
from sparkloom.operators import instructions
from sparkloom.sources.sequences import json_lines_parts, json_lines_paths, read_json_lines


def names(paths):
    return [p.rsplit("/", 1)[-1] for p in paths]


def test_files_that_paths_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b.jsonl", "a.jsonl", "c.txt"):
        (tmp_path / "in" / name).write_text("{}\n")
    (tmp_path / "in" / "d.jsonl").mkdir()
    assert names(json_lines_paths(spark, f"{tmp_path}/in")) == ["a.jsonl", "b.jsonl"]
    assert names(json_lines_paths(spark, [f"{tmp_path}/in/c.txt", f"{tmp_path}/in"])) == ["c.txt", "a.jsonl", "b.jsonl"]
    assert read_json_lines(spark, json_lines_paths(spark, f"{tmp_path}/in"), numbered=True).count() == 2
    with pytest.raises(FileNotFoundError):
        json_lines_paths(spark, [f"{tmp_path}/in", f"{tmp_path}/none.jsonl"])
    (tmp_path / "empty").mkdir()
    for nothing in (f"{tmp_path}/empty", []):
        with pytest.raises(ValueError, match="no file"):
            json_lines_paths(spark, nothing)


def test_parts_or_the_single_file(spark, tmp_path):
    single = f"{tmp_path}/instruction.jsonl"
    assert json_lines_parts(spark, single) == [single]
    for k in (2, 10, 1):
        (tmp_path / f"instruction_part_{k}.jsonl").write_text("{}\n")
    want = [f"instruction_part_{k}.jsonl" for k in (1, 2, 10)]
    assert names(json_lines_parts(spark, single, prefer_parts=False)) == want
    (tmp_path / "instruction.jsonl").write_text("{}\n")
    assert names(json_lines_parts(spark, single)) == want and json_lines_parts(spark, single, prefer_parts=False) == [single]
    assert json_lines_parts(spark, single, f"{tmp_path}/none") == [single]


def test_strata(spark):
    rows = [
        ({"metadata": {"dataset_group": " Plants\t X ", "product": "Heat  Shock"}, "product": "no"}, ("plants x", "heat shock")),
        ({"metadata": {"product": " "}, "product": "P"}, ("unknown", "p")), ({"description": "D", "accession": "A"}, ("unknown", "d")),
        ({"accession": "A1"}, ("unknown", "a1")), ({"metadata": 3}, ("unknown", "unknown-protein")),
    ]
    df = spark.createDataFrame([(k, json.dumps(p)) for k, (p, _) in enumerate(rows)], "k int, v string").withColumn("p", F.parse_json("v"))
    group, bucket = instructions.stratum(F.col("p"))
    assert [(r["g"], r["b"]) for r in df.select("k", group.alias("g"), bucket.alias("b")).orderBy("k").collect()] == [want for _, want in rows]


def test_downsampling_keeps_order_and_names_bad_lines(spark, tmp_path):
    line = lambda i: json.dumps({"i": i, "metadata": {"dataset_group": f"g{i % 2}", "product": f"p{i % 3}"}})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a2.jsonl").write_text("".join(line(i) + "\n\n" for i in range(60)))
    (tmp_path / "in" / "a10.jsonl").write_text("".join(line(i) + "\n" for i in range(60, 120)))
    main(["downsample", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--keep", "0.25", "--parts", "3"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    kept = [json.loads(x)["i"] for x in text.splitlines()]
    assert len(kept) == 30 and kept == sorted(kept) and {i % 6 for i in kept} == set(range(6))
    (tmp_path / "in" / "bad.jsonl").write_text("{}\n\n[1]\n")
    with pytest.raises(Exception, match="bad.jsonl:3"):
        main(["downsample", f"{tmp_path}/in", "--output", f"{tmp_path}/none", "--keep", "0.25", "--parts", "3"])
