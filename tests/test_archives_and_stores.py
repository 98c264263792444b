"""Damaged archives, line numbers, batches of text, and a store with several writers."""

import gzip
import json
import random
import threading
from pathlib import Path

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from sparkloom.operators import artifacts, datasets, incremental, instructions
from sparkloom.plans.registry import QUERIES
from sparkloom.sources import archives, files, flatfiles
from sparkloom.sources.sequences import read_json_lines
from sparkloom.streaming import batches


def read(spark, path, record="line", pattern="*"):
    rows = archives.read_archives(spark, str(path), pattern, record).collect()
    values, ends = {}, {}
    for r in sorted(rows, key=lambda r: (r["path"], r["n"])):
        name = r["path"].rsplit("/", 1)[-1]
        if r["value"] is None:
            ends[name] = (r["n"], r["truncated"], r["dropped"])
        else:
            values.setdefault(name, []).append(r["value"])
    return values, ends


def test_whole_archives(spark, tmp_path):
    lines = [f"line {i} é" for i in range(5000)]
    text = "\n".join(lines) + "\n"
    (tmp_path / "a.gz").write_bytes(gzip.compress(text.encode()))
    # Two members with zeros behind them, no last line end, other line ends.
    (tmp_path / "b.gz").write_bytes(gzip.compress(text.encode()) + gzip.compress(b"x\r\ny") + b"\0" * 700)
    (tmp_path / "c.txt").write_bytes(b"\xff one\ntwo\r\nthree")
    (tmp_path / "d.txt").write_bytes(b"")
    values, ends = read(spark, tmp_path)
    assert values["a.gz"] == lines and values["b.gz"] == [*lines, "x", "y"] and values["c.txt"] == ["� one", "two", "three"]
    assert ends == {"a.gz": (5000, False, 0), "b.gz": (5002, False, 0), "c.txt": (3, False, 0), "d.txt": (0, False, 0)}
    assert set(read(spark, tmp_path, pattern="*.gz")[1]) == {"a.gz", "b.gz"} and read(spark, tmp_path / "c.txt")[1] == {"c.txt": (3, False, 0)}
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none") == ({}, {})


@pytest.mark.parametrize("record", archives.RECORDS)
def test_damaged_archives(spark, tmp_path, record):
    rng = random.Random(4)
    bodies = ["".join(rng.choices("ACGT", k=60)) + f"\nlast of {i}" for i in range(3000)]
    form = {"line": "{}\n", "block": "{}\n//\n", "entry": ">{}\n"}[record]
    data = gzip.compress("".join(form.format(b) for b in bodies).encode(), mtime=0)
    (tmp_path / "cut.gz").write_bytes(data[: len(data) // 2])
    flipped = bytearray(data)
    flipped[len(data) // 3] ^= 0xFF
    (tmp_path / "flipped.gz").write_bytes(bytes(flipped))
    (tmp_path / "nothing.gz").write_bytes(b"no archive")
    (tmp_path / "open.txt").write_text("".join(form.format(b) for b in bodies[:2]) + ("tail" if record == "block" else ""))
    values, ends = read(spark, tmp_path, record)
    want = [x for b in bodies for x in b.split("\n")] if record == "line" else [(">" if record == "entry" else "") + b for b in bodies]
    assert 1000 < len(values["cut.gz"]) < len(want) and values["cut.gz"] == want[: len(values["cut.gz"])]
    assert ends["cut.gz"] == (len(values["cut.gz"]), True, 1)
    # Broken data may also decode to something else before the checksum tells; what lies before is right.
    assert ends["flipped.gz"][1] and values["flipped.gz"][:500] == want[:500]
    assert ends["nothing.gz"] == (0, True, 0) and ends["open.txt"] == (4 if record == "line" else 2, False, int(record == "block"))
    with pytest.raises(Exception, match="gz"):  # the session's other reads still fail
        spark.read.text(str(tmp_path / "cut.gz")).count()


def test_records_of_damaged_archives(spark, tmp_path):
    record = "LOCUS       {0}\nDEFINITION  Protein {0}.\nACCESSION   P{0}\nVERSION     P{0}.1\nORIGIN\n        1 mkva\n//\n"
    whole = "".join(record.format(i) for i in range(2000))
    (tmp_path / "x.gpff.gz").write_bytes(gzip.compress(whole.encode())[:-3000])
    source = lambda spark, path: archives.blocks(archives.read_archives(spark, path, "*.gz", "block"))
    rows = flatfiles.read_genpept(spark, str(tmp_path), records=source).collect()
    assert 100 < len(rows) < 2000 and {r["accession"] for r in rows} == {f"P{i}" for i in range(len(rows))}
    assert all(r["sequence"] == "MKVA" for r in rows)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "y.gpff").write_text(record.format(1) + record.format(2).replace("//\n", ""))
    assert [r["accession"] for r in flatfiles.read_genpept(spark, str(tmp_path / "plain")).collect()] == ["P1"]
    assert flatfiles.read_genbank(spark, str(tmp_path / "plain")).count() == 2
    assert flatfiles.read_genbank(spark, str(tmp_path / "plain"), flatfiles.complete_records).count() == 1


def test_line_numbers_over_splits(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("".join("\n" if i % 7 == 0 else f"{name} {i}\n" for i in range(1, 4001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert files.read_lines(spark, str(tmp_path)).select("pos.block").distinct().count() > 10
        rows = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 8000 and all(r["line"] == ("" if r["line_number"] % 7 == 0 else f"{r['file'][-5:]} {r['line_number']}") for r in rows)


def test_sort_keys_are_made_once_a_file(spark, tmp_path):
    for name in ("part 2.txt", "part 10.txt", "Part%201.txt", "part 3.txt.gz"):
        text = "".join(f"{name} {i}\n" for i in range(50)).encode()
        (tmp_path / name).write_bytes(gzip.compress(text) if name.endswith(".gz") else text)
    rows = files.read_lines(spark, str(tmp_path))
    want = [f"{name} {i}" for name in ("part 2.txt", "part 3.txt.gz", "part 10.txt", "Part%201.txt") for i in range(50)]
    assert [r["line"] for r in rows.orderBy("pos").collect()] == want
    one = files.read_lines(spark, [str(tmp_path / "part 2.txt")])
    assert [r["line"] for r in one.orderBy("pos").collect()] == want[:50]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "binaryFile" in plan and "content" not in plan


def test_errors_and_split_keys_name_the_line(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"instruction": "go", "output": "MK"}\n\n{"other": 1}\n[1]\n')
    rows = read_json_lines(spark, str(path), numbered=True)
    keys = {r["place"]: r["k"] for r in rows.where("status = 'valid'").select("place", instructions.split_key(F.col("payload"), F.col("place")).alias("k")).collect()}
    assert keys[f"{path}:3"] == f"{path}:3" and keys[f"{path}:1"].startswith("{")
    with pytest.raises(Exception, match=f"{path}:[34]"):
        instructions.required(instructions.records(rows, form="compact")).collect()


def test_front_matter_of_either_line_end(spark):
    page = "---\r\ntitle: x\r\nnotes: |\r\n  one\r\n  two\r\ntitle: 'y'\r\n---\r\nBody\r\n"
    fields, body = files.front_matter(F.lit(page))
    row = spark.range(1).select(fields.alias("f"), body.alias("b")).first()
    assert row["f"] == {"title": "y", "notes": "one\ntwo"} and row["b"] == "Body"


def test_appended_batches_follow_one_another(spark, tmp_path):
    make = lambda name: spark.createDataFrame([(f"{name}{i}", "go", "MKV") for i in range(9)], "accession string, profile string, sequence string")
    path = f"{tmp_path}/text"
    artifacts.write_train_text(make("b").withColumn("profile", F.col("accession")), path, 3)
    artifacts.write_train_text(make("a").withColumn("profile", F.col("accession")), path, 4, append=True)
    back = artifacts.train_text(spark, path).select("pos", instructions.parsed_line(F.col("line"))["profile"].alias("p")).orderBy("pos").collect()
    assert [r["p"] for r in back] == [f"b{i}" for i in range(9)] + [f"a{i}" for i in range(9)]
    with pytest.raises(FileExistsError):
        artifacts.write_train_text(make("c"), path, 1)
    (tmp_path / "text" / "batch=00000001" / "_SUCCESS").unlink()  # as a failure would leave it
    assert artifacts.train_text(spark, path).count() == 9
    artifacts.write_train_text(make("a"), path, 2, append=True)
    assert artifacts.train_text(spark, path).count() == 18 and artifacts.train_text(spark, f"{tmp_path}/none").count() == 0


def test_two_writers_lose_nothing(spark, tmp_path):
    root, rows, faults = str(tmp_path / "store"), spark.createDataFrame([(1,)], "k int"), []

    def work(name):
        try:
            for i in range(3):
                datasets.DatasetStore(spark, root).save(rows, "src", f"{name}{i}")
        except Exception as e:
            faults.append(e)

    threads = [threading.Thread(target=work, args=(name,)) for name in "xyz"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = datasets.DatasetStore(spark, root).catalog().collect()
    assert not faults and sorted(r["dataset"] for r in found) == sorted(f"{n}{i}" for n in "xyz" for i in range(3))


def test_a_writer_that_is_overtaken_makes_its_change_again(spark, tmp_path):
    store, other = (datasets.DatasetStore(spark, str(tmp_path / "store")) for _ in range(2))
    rows, done = spark.createDataFrame([(1,)], "k int"), []

    def slow(catalog):
        if not done:
            done.append(1)
            other.save(rows, "src", "y")
        return datasets.catalog_upserted(catalog, spark.createDataFrame([("src", "z", "s", 1, "parquet", "replace", 0)], datasets.CATALOG))

    store._publish(slow)
    assert sorted(r["dataset"] for r in store.catalog().collect()) == ["y", "z"]


def test_equal_content_writes_nothing(spark, tmp_path):
    store = datasets.DatasetStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "a", {"k": None}), (2, None, None), (2, None, None)], "k int, v string, m map<string,string>")
    first = store.save_if_changed(rows, "src", "one")
    versions = store._catalogs()
    assert first and store.save_if_changed(rows.orderBy(F.desc("k")).repartition(3), "src", "one") is None
    assert store._catalogs() == versions and len(list((tmp_path / "store" / "data" / "src" / "one").iterdir())) == 1
    for other in (rows.where("k = 1").unionByName(rows.where("k = 2").limit(1)), rows.withColumn("v", F.lit("")), rows.withColumnRenamed("v", "w"), rows.withColumn("k", F.col("k").cast("long"))):
        assert datasets.digest(other) != datasets.digest(rows)
    second = store.save_if_changed(rows.limit(1), "src", "one")
    assert store.history("src", "one") == [first, second] and store.read("src", "one").count() == 1
    store.restore("src", "one", first)
    assert store.read("src", "one").count() == 3 and store.history("src", "one") == [second, first]
    rows.write.parquet(f"{tmp_path}/built")
    store.adopt(f"{tmp_path}/built", "src", "two")
    assert store.read("src", "two").count() == 3 and not (tmp_path / "built").exists()
    with pytest.raises(KeyError):
        store.restore("src", "two", first)


def test_reasons_to_make_a_dataset_anew(spark, tmp_path):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    asked, index = make([("a",), ("b",)], "k string"), make([("a", "x")], "k string, v string")
    plan = make([("a", "same")], "k string, action string")
    (tmp_path / "made").write_text("x")
    wanted = {"storage_mode": "parquet", "sequence_type": "protein", "vocab_size": 9, "normalization": {"min": 1}, "duplicate_accession_count": 0}
    whole = wanted | {"is_complete": True, "keys_digest": incremental.keys_digest(asked, "k"), "artifacts": [str(tmp_path / "made")]}
    why = lambda manifest=whole, index=index, asked=asked, plan=plan, wanted=wanted: incremental.stale_reasons(spark, manifest, index, asked, "k", plan, wanted)
    assert why() == [] and why(asked=make([("b",), ("a",)], "k string")) == [] and why(manifest={k: v for k, v in whole.items() if k != "duplicate_accession_count"}) == []
    assert why(manifest={}) == why(index=None) == why(index=index.limit(0)) == ["no_state"]
    assert why(plan=plan.withColumn("action", F.lit("new"))) == ["keys_to_fetch"] and why(asked=asked.limit(1)) == ["other_keys"]
    for name, value in wanted.items():
        assert why(manifest=whole | {name: value + 1 if isinstance(value, int) else "other"}) == [name]
    assert why(manifest=whole | {"is_complete": False}) == ["incomplete"]
    for paths in ([], [str(tmp_path / "made"), str(tmp_path / "gone")]):
        assert why(manifest=whole | {"artifacts": paths}) == ["artifacts_missing"]


@pytest.mark.parametrize("upto", [0, 1, 3])
def test_a_stream_goes_on_where_it_stopped(spark, tmp_path, upto):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "k int, v string")
    rows.repartition(4, "k").write.parquet(f"{tmp_path}/feed")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    batches.upsert_stream(stream(), "k", f"{tmp_path}/index", f"{tmp_path}/state", upto)
    done = sorted(int(p.name) for p in (tmp_path / "state" / "commits").glob("[0-9]*")) if (tmp_path / "state" / "commits").exists() else []
    assert done == list(range(upto)) and len(list((tmp_path / "index").glob("batch=*"))) == upto + 1
    batches.upsert_stream(stream(), "k", f"{tmp_path}/index", f"{tmp_path}/state")
    assert len(list((tmp_path / "index").glob("batch=*"))) == 4
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/index").collect()) == list(range(40))


def test_queries_over_written_files(spark, same_as_sql):
    from sparkloom.plans.registry import SQL

    for name in ("line_numbers", "archive_blocks", "concatenated_parts", "written_archive", "resumed_upserts"):
        from conftest import DATA

        same_as_sql(QUERIES[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_entries_of_pieces_of_any_size(size):
    made = {"a": {"x": [1, {"y": "}\"{"}]}, "b": 12345, "ü": {}, "c": -1.5e10, "d": None, "e": {"long": "z" * 50}, "": {"n": True}}
    for text in (json.dumps(made), json.dumps(made, indent=3, ensure_ascii=False)):
        cut = iter([text[i : i + size] for i in range(0, len(text), size)])
        assert {k: json.loads(v) for k, v in archives.entries(cut)} == made
    for text in ("", "  ", "{}", "[1]", "3", '"x"'):
        assert list(archives.entries(iter(text))) == []
    for text in ('{"a": {}', '{"a" 1}', '{"a": 1 "b": 2}', '{1: 2}', '{"a": {"b": ]}}'):
        with pytest.raises(ValueError):
            list(archives.entries(iter(text)))


def test_objects_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({f"k{i}": {"sequence": "M" * (i % 50)} if i % 3 else i for i in range(3000)}))
    (tmp_path / "b.json").write_text("")
    rows = archives.read_objects(spark, str(tmp_path), "*.json").collect()
    assert sorted(r["key"] for r in rows) == sorted(f"k{i}" for i in range(3000) if i % 3)
    assert archives.read_objects(spark, f"{tmp_path}/b.json").count() == 0


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"{i:03}.json").write_text(json.dumps({f"k{i}": {"n": i}, f"x{i}": i}))
    found = archives.read_objects(spark, str(tmp_path), "*.json")
    assert found.rdd.getNumPartitions() <= 2 * archives.TASKS
    rows = found.collect()
    assert {(r["path"].rsplit("/", 1)[-1], r["n"], r["key"], json.loads(r["value"])["n"]) for r in rows} == {(f"{i:03}.json", 0, f"k{i}", i) for i in range(600)}
    lines = archives.read_archives(spark, str(tmp_path), "*.json")
    assert lines.rdd.getNumPartitions() <= 2 * archives.TASKS
    assert archives.states(lines).where("records = 1 AND NOT truncated").count() == 600
    large = archives.TASK_BYTES
    assert archives.dealt([("a", large), ("b", 1), ("c", 2 * large)]) == [["a"], ["b"], ["c"]]
    assert archives.dealt([]) == [] and max(map(len, archives.dealt([(str(k), 10) for k in range(100_000)]))) <= large // archives.OPEN_BYTES


@pytest.mark.parametrize("name", ["raw_index_rows", "session_rows"])
def test_files_of_an_index_are_few(spark, monkeypatch, name):
    from sparkloom.operators import sessions
    from sparkloom.plans import files as file_plans

    read = []
    kept = archives.read_objects

    def seen(spark, path, *rest):
        read.append(path)
        return kept(spark, path, *rest)

    monkeypatch.setattr(sessions, "read_objects", seen)
    monkeypatch.setattr(file_plans.archives, "read_objects", seen)
    QUERIES[name](spark, DATA)
    assert len(read) == 1 and 1 <= len(list(Path(read[0].removeprefix("file:")).rglob("part-*"))) <= 64


def test_first_seen_in_a_table(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7 if i % 5 else None, i) for i in range(60)], "k int, v int")
    rows.repartition(4, "v").write.parquet(f"{tmp_path}/feed")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    done = batches.first_seen_stored(stream(), ["k"], f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r["k"] is not None, r["k"] or 0) for r in done.collect()) == [(False, 0)] + [(True, k) for k in range(7)]
    spark.createDataFrame([(3, 1), (99, 1)], rows.schema).write.mode("append").parquet(f"{tmp_path}/feed")
    again = batches.first_seen_stored(stream(), ["k"], f"{tmp_path}/out", f"{tmp_path}/state")
    assert again.count() == 9 and again.where("k = 99").count() == 1


def test_a_long_series_is_smoothed(spark):
    from sparkloom.operators import metrics

    rng = random.Random(3)
    rows = [("s", i, rng.random()) for i in range(400)] + [(None, 7, 1.0)]
    got = {(r["s"], r["t"]): r["smooth"] for r in metrics.smoothed(spark.createDataFrame(rows, "s string, t int, v double"), "s", "t", "v", 5, 3).collect()}
    v = [x for s, _, x in rows if s]
    at = lambda values, i: values[max(0, min(len(values) - 1, i))]
    middle = [sorted(at(v, i + o) for o in range(-2, 3))[2] for i in range(400)]
    assert got == {("s", i): pytest.approx(sum(at(middle, i + o) for o in (-1, 0, 1)) / 3) for i in range(400)} | {(None, 7): 1.0}
