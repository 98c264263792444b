"""The manifest, the mix and fill-in-the-middle: brute force, held cases and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from sparkloom.llm import fim, manifest, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mix string, merkle string, fim string, own0 string"
LONG = "alpha  beta\tgämma, δελτα. " * 4000 + "x" * 50_000 + "  \n"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, lang, s, n, "mine", "mine", "mine", "mine") for i, t, lang, s, n in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(
        spark, (1, None, None, "a", 1), (2, "", "en", None, 0), (3, " \n\t", "en", "a", None), (4, LONG, "de", "a", 9),
        (4, LONG, "de", "a", 9), (None, "One two three four.", None, None, None), (5, "one <P> TWO", "en", "b", 3), (5, "x", "en", "b", 3),
    )


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in manifest.FIELDS))


def plain_tree(leaves):
    """Root, and for each leaf the siblings level by level, by whole levels from the bottom."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            other = k ^ 1
            paths[leaf].append(None if other >= len(nodes) else ("RL"[k & 1], nodes[other]))
            at[leaf] = k >> 1
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


@pytest.mark.parametrize("height", [1, 2, 9])
@pytest.mark.parametrize("sizes", [[1], [2], [5], [1, 3, 4, 17], [8, 1, 33]])
def test_trees_of_blocks_by_brute_force(spark, height, sizes):
    rows = [(g, i, f"{g}/{i}") for g, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g int, i int, v string")
    got = {(r["g"], r["i"]): r["merkle"] for r in manifest.manifest(df, F.sha2("v", 256), "g", "i", height).collect()}
    trees = [plain_tree([h(f"{g}/{i}") for i in range(n)]) for g, n in enumerate(sizes)]
    root, tops = plain_tree([t[0] for t in trees])
    assert len(got) == len(rows)
    for (g, i), m in got.items():
        want = trees[g][1][i] + tops[g]
        assert m["root"] == root and m["subroot"] == trees[g][0]
        assert m["path"] == ["-" if s is None else s[0] + s[1] for s in want]


def test_a_changed_leaf_is_found_and_others_verify(spark):
    df = spark.createDataFrame([(i, i % 3, str(i)) for i in range(100)], "i int, g int, v string")
    done = manifest.manifest(df, F.sha2("v", 256), "g", "i", 2)
    m = F.col("merkle")
    told = done.select(
        (manifest.folded(m["leaf"], m["path"]) == m["root"]).alias("same"),
        (manifest.folded(F.sha2(F.concat("v", F.lit("!")), 256), m["path"]) == m["root"]).alias("changed"),
    )
    assert {tuple(r) for r in told.collect()} == {(True, False)}


def test_manifest_of_odd_rows(odd):
    done = manifest.manifest(odd, manifest.leaf_digest([F.col(c) for c in manifest.FIELDS]), "lang", "doc_id", 1).collect()
    rows = [r.asDict() for r in odd.collect()]
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)) for r in rows if r["lang"] == lang)
        trees[lang] = plain_tree([x[2] for x in own])
    root, _ = plain_tree([trees[x][0] for x in langs])
    assert len(done) == len(rows)
    for r in done:
        found = r[-1]
        assert found["leaf"] == plain_leaf(r.asDict()) and found["subroot"] == trees[r["lang"]][0] and found["root"] == root


def test_tampered_rows_of_the_query(spark):
    from sparkloom.llm.queries import QUERIES

    for r in QUERIES["op11_merkle_manifest"](spark, DATA).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)


def plain_targets(sizes, weights, epochs):
    """Shares again and again, until none is above its size times ``epochs``."""
    total, full = sum(sizes), set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(epochs * sizes[i] for i in full)
        share = left / sum(weights[i] for i in rest) if rest else 0
        more = {i for i in rest if weights[i] * share > epochs * sizes[i]}
        if not more:
            return [epochs * s if i in full else weights[i] * share for i, s in enumerate(sizes)]
        full |= more


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_repeated_shares(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 100, 10_000]) * rng.randrange(1, 9) for _ in range(rng.randrange(1, 14))]
    rows = [(f"s{i:02d}", s) for i, s in enumerate(sizes)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = plain_targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], mixing.EPOCHS)
    assert [got[s] for s, _ in rows] == pytest.approx(want)


def test_mix_fills_targets_by_whole_epochs_first(spark):
    rows = [(i, "abc"[i % 7 % 3], i % 50, 1.0 + i % 2) for i in range(700)]
    df = spark.createDataFrame(rows, "i int, s string, n int, q double")
    done = mixing.mixed(df, "i", "s", "n", "q")
    rows = done.collect()
    for source in "abc":
        own = [r["mix"] for r in rows if r["s"] == source]
        assert sum(m["taken"] for m in own) == int(own[0]["target"] + 0.5)
        epochs = int(own[0]["target"] + 0.5) // own[0]["source_size"]
        assert all(epochs * m["size"] <= m["taken"] <= min(3, epochs + 1) * m["size"] for m in own)
        assert sum(epochs * m["size"] < m["taken"] < (epochs + 1) * m["size"] for m in own) <= 1
    assert sorted(map(repr, rows)) == sorted(map(repr, done.repartition(3).collect()))
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mixed(df.repartition(5), "i", "s", "n", "q").collect()))


def test_quality_raises_the_share(spark):
    rows = [(i, "a" if i % 10 else "b", 10, 4.0 if i % 2 else 1.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "i int, s string, n int, q double")
    # The large source weighs less than its size, so that it's sampled.
    taken = mixing.mixed(df, "i", "s", "n", "q", weights=(1, 1)).where("s = 'a' AND mix.target < mix.source_size").groupBy("q").agg(F.avg("mix.taken").alias("m"))
    mean = {r["q"]: r["m"] for r in taken.collect()}
    assert mean[4.0] > 1.05 * mean[1.0] > 0


def test_mix_of_odd_rows(odd):
    sized = odd.withColumn("size", mixing.n_words(F.col("text"))).withColumn("quality", F.lit(None).cast("double"))
    rows = mixing.mixed(sized, "doc_id", "source", "size", "quality").collect()
    assert len(rows) == 8 and all(r["mix"] == "mine" for r in rows)
    found = [r[-1] for r in rows]
    assert all(m["taken"] == 0 for r, m in zip(rows, found, strict=True) if not r["size"])
    assert sum(m["taken"] for m in found) == pytest.approx(sum(r["size"] for r in rows), abs=3)
    assert all(m["taken"] <= 3 * m["size"] for m in found)


TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_fim(key, text, rate=50, spm=80):
    digest = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = TOKEN.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm_form = h4 % 100 < spm
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm_form else f"<P>{pre}<S>{suf}<M>{mid}"
    return len(units), "spm" if spm_form else "psm", len(pre), len(mid), out


def strange_texts(rng, n):
    for _ in range(n):
        yield "".join(rng.choice(["a", "ß", "𝔘", " ", "\n", "\x1c", "\x85", " ", "<", ">", "P>", "<S", "word", "<P>", "<<M>>"]) for _ in range(rng.randrange(0, 30)))


@pytest.mark.parametrize("most", [1, 64, 1 << 22])
def test_kernel_by_brute_force(most):
    rng = random.Random(3)
    texts = [*strange_texts(rng, 400), LONG, "", "", " ", "<P", "P>"]
    padded = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    hashes = [hashlib.sha256(f"42:{i}".encode()).hexdigest() for i in range(len(texts))]
    draws = [np.array([int(x[8 * k : 8 * k + 8], 16) for x in hashes]) for k in range(4)]
    ends, found = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]), []
    for i, j in fim.slices(ends, most):
        assert j == i + 1 or ends[j] - ends[i] <= most
        found += zip(*[c.to_pylist() for c in fim.transform_rows(padded.slice(i, j - i), [d[i:j] for d in draws], 90, 50)], strict=True)
    assert found == [plain_fim(i, t, 90, 50) for i, t in enumerate(texts)]


def test_fim_of_odd_rows_and_round_trip(spark, odd):
    rng = random.Random(5)
    strange = docs(spark, *[(i, t, "en", "a", 1) for i, t in enumerate(strange_texts(rng, 300))])
    done = fim.transformed(odd.unionByName(strange), rate=100)
    assert done.columns[:-1] == odd.columns
    made = F.col(done.columns[-1])
    rows = done.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), made.alias("f"), fim.restored(made["output"], made["form"]).alias("back"), "fim").collect()
    assert len(rows) == 308 and all(r["fim"] == "mine" for r in rows)
    for r in rows:
        assert tuple(r["f"]) == plain_fim("" if r["doc_id"] is None else r["doc_id"], r["t"], 100)
        assert r["back"] == r["t"]


@pytest.mark.parametrize("work", [
    lambda d: manifest.manifest(d, F.sha2("text", 256), "lang", "doc_id"),
    lambda d: mixing.mixed(d.withColumn("size", mixing.n_words(F.col("text"))).withColumn("q", F.lit(1.0)), "doc_id", "source", "size", "q"),
    fim.transformed,
])
def test_empty_tables(odd, work):
    assert work(odd.where("1 = 0")).count() == 0
