"""k-mer states that merge, batches of like length, and part readers that go on, against plain forms."""

import json
import random
from collections import Counter

import pytest

from sparkloom.operators import kmers, padding, parts, storage
from sparkloom.plans.registry import QUERIES, SQL


def plain_state(rows, k):
    n, first = Counter(), {}
    for key, text in sorted(((a, t or "") for a, t in rows), key=lambda r: (r[0] is not None, r[0])):
        for at in range(len(text) - k + 1):
            kmer = text[at : at + k]
            n[kmer] += 1
            place = (key is not None, key, at)
            first[kmer] = min(first.get(kmer, place), place)
    return {x: (n[x], *first[x][1:]) for x in n}


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_states_merge_to_that_of_one_pass(spark, k, monkeypatch):
    monkeypatch.setattr(kmers, "SLICE", 64)
    rng = random.Random(k)
    rows = [(i // 2, "".join(rng.choices(["a", "ß", "𝔘", "\n", "aa"], k=rng.randrange(60)))) for i in range(60)] + [(None, "aaß"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = lambda s: {r["kmer"]: (r["n"], r["row"], r["at"]) for r in s.collect()}
    whole = kmers.kmer_state(df.repartition(3), "k", "t", k)
    assert got(whole) == plain_state(rows, k)
    pieces = [kmers.kmer_state(spark.createDataFrame(rows[i::3], df.schema), "k", "t", k) for i in range(3)]
    assert got(kmers.merged(kmers.merged(pieces[2], pieces[0]), pieces[1])) == plain_state(rows, k)
    want = sorted(plain_state(rows, k).items(), key=lambda x: (x[1][1] is not None, *x[1][1:], x[0]))
    ids = {r["kmer"]: r["id"] for r in kmers.numbered_kmers(whole, 5).collect()}
    assert ids == {x: 5 + i for i, (x, _) in enumerate(want)}
    assert kmers.kmer_state(df.limit(0), "k", "t", k).count() == 0


def test_a_slice_counts_like_all(spark):
    found, n, first, at = kmers.count_slice([3, 1, 1], ["abab", "xab", "abb"], 2)
    assert {f: (c, r, a) for f, c, r, a in zip(found, n.tolist(), first, at.tolist(), strict=True)} == {"ab": (4, 1, 0), "ba": (1, 3, 1), "xa": (1, 1, 0), "bb": (1, 1, 1)}


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_batches_of_like_length(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [(i, [rng.randrange(1, 9) for _ in range(rng.choice([0, 1, 3, 40]))]) for i in range(150)] + [(150, None)]
    made = padding.padded_batches(spark.createDataFrame(rows, "k int, ids array<int>"), "k", "ids", size, pad=0, seed=3)
    said = padding.write_batches(made, f"{tmp_path}/out", 0, {"ids": spark.range(9)}, {"name": "x"})
    back, manifest = padding.read_batches(spark, f"{tmp_path}/out")
    assert said == manifest and manifest["vocabularies"] == {"ids": 9} and manifest["name"] == "x"
    found, ids = back.collect(), {k: v or [] for k, v in rows}
    assert sorted(r["k"] for r in found) == list(range(151))
    for r in found:
        own = ids[r["k"]]
        assert r["input_ids"] == own + [0] * (r["width"] - len(own)) and r["attention_mask"] == [1] * len(own) + [0] * (r["width"] - len(own))
    order = sorted(found, key=lambda r: (r["length"], r["k"]))
    assert [r["batch"] for r in order] == [i // size for i in range(151)]
    assert all(r["width"] == max(x["length"] for x in found if x["batch"] == r["batch"]) for r in found)
    pads = sum(r["width"] - r["length"] for r in found)
    assert manifest["pad_tokens"] == pads < max(1, size) * 40 and manifest["rows"] == 151
    if size == 4:
        assert manifest["pad_share"] < 0.1
        assert [r["turn"] for r in back.select("batch", "turn").distinct().orderBy("batch").limit(3).collect()] != sorted(r["turn"] for r in found)[:3]
    (tmp_path / "out" / "manifest.json").unlink()
    with pytest.raises(FileNotFoundError):
        padding.read_batches(spark, f"{tmp_path}/out")


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "parts"
    at.mkdir()
    lines = []
    for part, n in (("part_2.txt", 7), ("part_10.txt", 0), ("part_11.txt", 12), ("part_1.txt", 5)):
        (at / part).write_text("".join(f"{part}:{i}\n" for i in range(n)))
    for part, n in (("part_1.txt", 5), ("part_2.txt", 7), ("part_11.txt", 12)):
        lines += [f"{part}:{i}" for i in range(n)]
    return str(at), lines


@pytest.mark.parametrize("stop", range(0, 7))
def test_a_reader_goes_on_after_any_batch(spark, tmp_path, folder, stop):
    path, lines = folder
    seen = {}

    def work(reader, most):
        for batch in reader.batches(epochs=2):
            if len(seen) - done >= most:
                return  # the batch isn't worked through
            seen[batch.number] = [r["line"] for r in batch.rows.orderBy("row").collect()]
            reader.note(loss=10.0 - batch.number)

    done = 0
    work(parts.PartReader(spark, path, f"{tmp_path}/state", 10), stop)
    done = len(seen)
    reader = parts.PartReader(spark, path, f"{tmp_path}/state", 10)
    assert reader.state["progress"]["global_step"] == stop
    work(reader, 100)
    per = [lines[i : i + 10] for i in range(0, 24, 10)]
    assert [seen[k] for k in range(6)] == per + per
    assert list(parts.PartReader(spark, path, f"{tmp_path}/state", 10).batches(epochs=2)) == []


def test_states_of_readers(spark, tmp_path, folder):
    path, lines = folder
    reader = parts.PartReader(spark, path, f"{tmp_path}/state", 10)
    work = reader.batches()
    first = next(work)
    assert first.rows.select("line_number", "row").orderBy("row").collect()[5] == (1, 5)
    reader.note(loss=3.0)
    next(work)
    state = json.loads((tmp_path / "state" / "state.json").read_text())
    assert state["progress"] | {"completed_parts": None, "current_part": None} == {
        "epoch": 0, "global_step": 1, "rows_seen": 10, "current_part_index": 1, "current_part": None, "part_offset": 5, "completed_parts": None,
    }
    assert [p.rsplit("/", 1)[-1] for p in state["progress"]["completed_parts"]] == ["part_1.txt"] and state["metrics"] == {"loss": [3.0], "best_loss": 3.0}
    (tmp_path / "state" / "state.json").write_text("{")  # a torn state: the one before counts
    assert parts.PartReader(spark, path, f"{tmp_path}/state", 10).state["progress"]["global_step"] == 0
    for change in (lambda: None, lambda: (tmp_path / "parts" / "part_3.txt").write_text("x\n")):
        change()
        with pytest.raises(ValueError, match="changed"):
            parts.PartReader(spark, path, f"{tmp_path}/state", 11)
    fresh = parts.PartReader(spark, path, f"{tmp_path}/state", 11, anew=True)
    assert fresh.state["progress"]["global_step"] == 0 and fresh.total == 25
    (tmp_path / "none").mkdir()
    assert list(parts.PartReader(spark, str(tmp_path / "none"), f"{tmp_path}/empty", 3).batches()) == []


def test_text_is_replaced_in_one_step(spark, tmp_path):
    path = f"{tmp_path}/a.json"
    assert storage.read_text(spark, path) is None
    storage.write_text(spark, path, "one é")
    storage.write_text(spark, path, "two", backup=True)
    assert storage.read_text(spark, path) == "two" and storage.read_text(spark, f"{path}.bak") == "one é"
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".tmp")]
    (tmp_path / "b").write_text("b")
    assert not storage.renamed(spark, path, f"{tmp_path}/b") and (tmp_path / "b").read_text() == "b"


@pytest.mark.parametrize("name", ["length_batches", "merged_vocabulary", "kmer_counts", "kmer_vocabulary", "kmer_round_trip"])
def test_queries(spark, same_as_sql, name):
    from conftest import DATA

    same_as_sql(QUERIES[name](spark, DATA), SQL[name])
