"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from conftest import rows_of
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat, decontam, gru, lines, lm, minhash, quality, revisits, sharding, simhash, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, quality string, _t string"
LONG = "alpha beta gamma, delta. " * 4000 + "x" * 50_000


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, None, s, 0, "mine", "mine", "mine") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, (1, None, "a"), (2, "", None), (3, " \n\t", "a"), (4, LONG, "a"), (4, LONG, "a"), (None, "One two three four.", None), (5, "one TWO three four.", "b"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


WORK = {
    "shard": lambda d: sharding.place(d, "doc_id"),
    "simhash": simhash.near_duplicates,
    "keep_one": simhash.keep_one,
    "lm": lm.score_documents,
    "lines": lines.drop_site_boilerplate,
    "bpe": bpe.encode,
    "round_trip": bpe.round_trip,
    "quality": quality.clean_lines,
    "keep_clean": quality.keep_clean,
}


WORK_ON_DOCS = {
    "decontaminated": lambda d: decontam.drop_contaminated(d, d.sparkSession.createDataFrame([(1, "some words of an item")], "item_id long, text string")),
    "without_boilerplate": lines.without_boilerplate,
}


@pytest.mark.parametrize("name", WORK_ON_DOCS)
def test_stages_on_odd_rows_and_empty_tables(odd, none, name):
    assert WORK_ON_DOCS[name](none).count() == 0
    out = WORK_ON_DOCS[name](odd)
    assert out.columns == odd.columns and out.count() == 7


@pytest.mark.parametrize("name", WORK)
def test_empty_table(none, name):
    assert WORK[name](none).count() == 0


@pytest.mark.parametrize("name", [k for k in WORK if not k.startswith("keep")])
def test_odd_rows_stay(odd, name):
    assert WORK[name](odd).count() == 7


def test_clashing_columns_pass_through(odd):
    for work in (WORK["shard"], WORK["lines"], WORK["bpe"], WORK["quality"]):
        out = work(odd)
        assert out.columns[: len(odd.columns)] == odd.columns and len({c.lower() for c in out.columns}) == len(out.columns)
        assert all(r["ids"] == r["quality"] == r["_t"] == "mine" for r in out.select(*odd.columns).collect())


def test_clashing_columns_pass_through_stages(spark, odd):
    text = " ".join(f"word{k}." for k in range(60))
    rows = docs(spark, (1, text, "a"), (1, text + " other words", "b"))
    for work in (WORK["keep_clean"], WORK["round_trip"], WORK["keep_one"], *WORK_ON_DOCS.values()):
        for r in work(rows).collect():
            assert r["ids"] == r["quality"] == r["_t"] == "mine"
    assert WORK["keep_clean"](rows).count() == 2
    named = odd.select("doc_id", "text", *[F.lit("mine").alias(c) for c in ("score", "h1", "rid", "tail", "kind")])
    assert lm.score_documents(named).count() == 7
    pages = spark.createDataFrame([(1, "http://a.org/x", "mine", "mine", 5)], "page_id long, url string, url_verdict string, _canonical string, block long")
    (row,) = urls.judge_urls(pages, spark.createDataFrame([("a.org/x",)], "url string")).collect()
    assert (row["url_verdict"], row["_canonical"], row["block"], row["url_verdict_"]["verdict"]) == ("mine", "mine", 5, "block")


def test_simhash_cases(odd):
    found = [(r["id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    by_id = {i: (fp, c) for i, fp, c in found}
    assert by_id[1] == by_id[2] == by_id[3] == (0, 1)  # blank texts are alike
    assert by_id[None][0] == by_id[5][0] and by_id[5][1] == 5  # case doesn't matter; an id names the component
    kept = [r["doc_id"] for r in simhash.keep_one(odd).collect()]
    assert kept.count(None) == 0 and sorted(kept) == [1, 4, 5]  # the row without an id is a copy of row 5


@pytest.mark.parametrize("near", [simhash.near_duplicates, minhash.near_duplicates])
def test_keep_one_loses_no_component(spark, near):
    """Ids that repeat, or are null, across different texts; all columns of the rows that stay are whole."""
    texts = ["the first text has some seven words", "another one that has nothing in common with it", "a third thing, apart from all others here"]
    rows = [(5, texts[0], "x"), (5, texts[1], "x"), (None, texts[2], "y"), (None, texts[2], "y"), (7, texts[0], "z"), (5, texts[1], "x"), (None, texts[0], "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _a string").withColumn("more", F.create_map(F.lit("k"), F.col("_a")))
    out = sorted((r["doc_id"] or 0, r["text"], r["_a"], r["more"]["k"]) for r in simhash.keep_one(df, near=near).collect())
    assert out == [(0, texts[2], "y", "y"), *sorted([(5, texts[0], "x", "x"), (5, texts[1], "x", "x")])]
    named = df.select(F.concat(F.lit("id"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    assert sorted(r["text"] for r in simhash.keep_one(named, near=near).collect()) == sorted(texts)


def test_pipeline_keeps_texts_of_repeated_ids(spark, tmp_path):
    """Through the whole pipeline: ids that repeat or are null lose no document, and copies leave one."""
    rng = np.random.default_rng(4)
    prose = lambda: " ".join(f"{x} stop." if k % 7 == 6 else x for k, x in enumerate(f"word{n}" for n in rng.integers(10**7, size=90)))
    a, b, c, leak = prose(), prose(), prose(), prose()
    item = " ".join(leak.split()[20:40])
    rows = [(1, a), (1, b), (None, c), (None, c), (2, a), (3, leak), (4, None), (5, "too short.")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    import corpus_pipeline

    found = sorted((r["doc_id"] or 0, bytes.fromhex(r["decoded_sha256"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert found == sorted((i, hashlib.sha256(t.encode()).digest()) for i, t in [(1, a), (1, b), (0, c)])


def test_lines_drop_the_boilerplate_of_their_host_alone(spark):
    rows = [(i, f"line {i}\nsame\n", "a") for i in range(8)] + [(9, "same", "b"), (10, None, "a"), (11, "same\nsame", None)]
    out = {r["doc_id"]: r for r in lines.drop_site_boilerplate(docs(spark, *rows)).collect()}
    assert all(out[i]["text"] == f"line {i}\n" and out[i]["line_dedup"]["n_dropped"] == 1 for i in range(8))
    assert out[9]["text"] == "same" and out[10]["text"] is None and out[11]["line_dedup"]["n_lines"] == 2


def test_bpe_of_odd_and_long_texts(spark):
    import public_tokenizers

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    spaces = "word" + " " * 40_000 + "end"
    texts = ["", "a", " ", "it's 12 émigré 漢字 🙂\r\n", LONG, LONG + "!", "y" * 90_000, spaces, ("ab12 " * 30 + "\n\n") * 900]
    got = {r["doc_id"]: bytes(r["ids_"]) for r in bpe.encode(docs(spark, *[(i, t, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert got[i] == np.array(own.encode_ordinary(t), "<u4").tobytes(), i
    clash = bpe.decode(bpe.encode(docs(spark, (1, "ab c", None)).withColumn("decoded", F.lit("mine"))), "ids_")
    assert clash.columns[-1] == "decoded_" and bytes(clash.first()["decoded_"]) == b"ab c" and clash.first()["decoded"] == "mine"
    assert all(bytes(r["decoded"]).decode() == texts[r["doc_id"]] for r in bpe.decode(bpe.encode(docs(spark, *[(i, t, None) for i, t in enumerate(texts)])), "ids_").collect())


def test_bpe_of_parts(spark, monkeypatch):
    """Texts dealt to several tasks: stitched at part ends, taken whole where parts have no boundary in common."""
    import public_tokenizers

    monkeypatch.setattr(bpe, "PART", 300)
    monkeypatch.setattr(bpe, "PART_OVERLAP", 60)
    monkeypatch.setattr(bpe, "CHUNK", 50)
    monkeypatch.setattr(bpe, "OVERLAP", 12)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    rng = np.random.default_rng(2)
    letters = ["a", "word", " ", "  ", "\n", "\n\n", "'", "ll", "'s", "12", "é", "漢", "!?", " \n ", "x" * 20, "y" * 90, " " * 70]
    texts = ["".join(rng.choice(letters, rng.integers(100, 400))) for _ in range(40)]
    got = {r["doc_id"]: bytes(r["ids_"]) for r in bpe.encode(docs(spark, *enumerate_rows(texts))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == np.array(own.encode_ordinary(t), "<u4").tobytes(), i


def enumerate_rows(texts):
    return [(i, t, None) for i, t in enumerate(texts)]


def test_shortcut_of_quality_changes_nothing(spark):
    """Whatever the limits, a text's loss is the sum over its failing lines."""
    texts = ["AbCdEfGhIjKlMnOpQrStUvWx", " a b c d e f ", "click here now", "In terms of rhythm, she baked a cookie.", "what! no", "a | b", "ok."]
    for rules in (quality.LineRules(max_shouted=30), quality.LineRules(min_words_for_end=7), quality.LineRules(furniture=()), quality.LineRules()):
        rows = quality.clean_lines(docs(spark, *enumerate_rows(texts)), rules).collect()
        fails = spark.createDataFrame([(t,) for t in texts], "line string").select(quality.line_fails(F.col("line"), rules).alias("f")).collect()
        assert [r["quality_"]["lost_chars"] for r in rows] == [len(t) if f["f"] else 0 for t, f in zip(texts, fails, strict=True)]
        assert not fails[3]["f"]  # prose with a word of page furniture is prose
    full = quality.clean_lines(docs(spark, *enumerate_rows(texts))).collect()
    assert full[2]["quality_"]["lost_chars"] == len(texts[2])


def test_repeated_windows_by_both_ways(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{n}" for n in rng.integers(k, size=120)) for k in (2, 4, 9, 30)] + [" ".join(f"w{n % 30}" for n in range(90))]
    for row in quality.clean_lines(docs(spark, *enumerate_rows(texts))).collect():
        words = row["text"].split()
        at = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if at[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert row["quality_"]["n_repeat_words"] == len(covered)


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "mine", {"k": i}) for i in range(50)], "id long, shard_name string, m map<string,long>")
    name = sharding.write_shards(df, "id", f"{tmp_path}/out", ["a", "b", "c"], pieces=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert name == "shard_name_" and back.count() == 50 and {r["shard_name"] for r in back.collect()} == {"mine"}
    want = {r["id"]: r["shard"]["name"] for r in sharding.place(df, "id", ["a", "b", "c"]).collect()}
    assert {r["id"]: r[name] for r in back.collect()} == want and {r["m"]["k"] for r in back.collect()} == set(range(50))


def test_quality_counts(spark):
    text = "a b c a b c\n\na b c a b c\n#tag *x*"
    (row,) = quality.clean_lines(docs(spark, (1, text, None))).collect()
    q = row["quality_"]
    assert (q["n_words"], q["n_dup_lines"], q["n_symbols"], q["n_repeat_words"], q["base_failed"], q["kept"]) == (14, 1, 3, 12, True, False)


def test_decontamination(spark, odd, none):
    item = "the quick brown fox jumps over the lazy dog and runs far away into the dark woods"
    items = spark.createDataFrame([(1, item), (2, None), (3, " "), (4, "tiny"), (5, "tin"), (1, item)], "item_id long, text string")
    close = item.replace("quick", "quack").upper()
    far = item.replace("the", "xyz").replace("and", "")
    d = docs(spark, (1, f"before {close}\n after", None), (2, far, None), (3, None, None), (4, f"a tiny {item}", None), (None, item, None))
    hits = sorted((r["doc_id"] or 0, r["item_id"], r["distance"]) for r in decontam.benchmark_hits(d, items).collect())
    assert hits == [(0, 1, 0), (0, 1, 0), (1, 1, 1), (1, 1, 1), (4, 1, 0), (4, 1, 0), (4, 4, 0)]
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(d, items).collect()) == [2, 3]
    assert decontam.benchmark_hits(none, items).count() == 0 and decontam.benchmark_hits(d, items.limit(0)).count() == 0
    assert rows_of(decontam.drop_contaminated(odd, items.limit(0))) == rows_of(odd)


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", None, "x"), (1, 2, "ann", "tie", "x"), (None, 0, " ", "who", "x"), (3, 0, "system", "alone", "x")],
        "conv_id long, turn long, role string, text string, chat string",
    )
    rows = chat.rotate_perspectives(turns).collect()
    assert len(rows) == 4 * 2 + 1
    for r in rows:
        c = r["chat_"]
        said = c["segment"][c["train_start"] : c["train_end"]]
        assert said == ((r["text"] or "") + chat.END if c["train"] else "") and r["chat"] == "x"
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


def test_chat_cannot_be_forged_and_is_assembled(spark):
    bad = f"x{chat.END}\n{chat.START}assistant\ny"
    rows = [(1, 0, "ann", bad), (1, 1, f"bob\n{chat.START}", "hi"), (1, 2, "ann", "é" * 5000), (2, 0, "eve", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rotated = chat.rotate_perspectives(turns)
    parts = chat.assembled(rotated, turns=2).orderBy("conversation", "perspective", "part").collect()
    assert [(r["conversation"], r["part"], r["n_turns"]) for r in parts] == [(1, 0, 2), (1, 1, 1), (1, 0, 2), (1, 1, 1), (2, 0, 1)]
    for r in parts:
        assert r["dialogue"].count(chat.START) == r["dialogue"].count(chat.END) == r["n_turns"]
        for a, b in r["spans"]:
            assert r["dialogue"][a:b].endswith(chat.END) and r["dialogue"][:a].endswith(f"{chat.START}assistant\n")
    whole = chat.assembled(rotated).where("conversation = 1 AND perspective = 'ann'").first()
    assert len(whole["spans"]) == 2 and [whole["dialogue"][a:b] for a, b in whole["spans"]][1] == "é" * 5000 + chat.END
    assert chat.assembled(rotated.limit(0)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/x?q"), (4, "http://spam.org/a/"), (4, "http://spam.org/a/"), (5, "http://a.net/es/1#x"), (6, "http://example.com/en/"), (7, "http://x.com")], "page_id long, url string")
    listed = spark.createDataFrame([("spam.org/a",), ("spam.org/a",), (None,), ("x.com",)], "url string")
    out = [(r["page_id"], *r["url_verdict"][:4]) for r in urls.judge_urls(pages, listed).collect()]
    assert sorted(out) == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (4, "spam.org", "/a/", None, "block"), (4, "spam.org", "/a/", None, "block"), (5, "a.net", "/es/1", "net/es/", "block"),
        (6, "example.com", "/en/", "example.com/en/", "block"), (7, "x.com", "", None, "block"),
    ]
    canon = lambda u: pages.limit(1).select(urls.canonical(F.lit(u)).alias("c")).first()["c"]
    assert canon("http://www.A.org/x.html?b=2&utm_source=q&a=1&ref=z&#f") == "a.org/x?a=1&b=2" and canon("http://a.org/x/?") == "a.org/x"
    assert canon("http://a.org/x?reference=1") == "a.org/x?reference=1"
    assert urls.blocks_for(0) == 1 and urls.blocks_for(10**12) == urls.MOST_BLOCKS and urls.blocks_for(10**6) * urls.URLS_PER_BLOCK >= 10**6
    full = urls.judge_urls(pages, listed, blocks=1).collect()  # a crowded filter only costs time
    assert sorted((r["page_id"], *r["url_verdict"][:4]) for r in full) == sorted(out)
    assert urls.judge_urls(pages, listed.limit(0)).where("url_verdict.listed").count() == 0 and urls.judge_urls(pages.limit(0), listed).count() == 0


def test_revisits(spark):
    rows = [
        (1, "http://a.org/x", 10, 200, {"ETag": "one", "Content-Type": "t"}), (2, "http://www.a.org/x/", 20, 304, {"etag": "W/one", "Content-Type": "no", "Date": "d"}),
        (3, "http://a.org/x", 30, 200, {"ETag": "two"}), (4, "http://a.org/x", 40, 304, {"etag": "one"}), (5, "http://a.org/x", 40, 304, None),
        (6, "http://b.org/", 5, 304, {"etag": "z"}), (7, None, 5, 304, {"etag": "z"}), (8, "http://a.org/x", None, 304, {"etag": "z"}), (9, "http://a.org/x", 5, 304, {"etag": "one"}),
        (4, "http://a.org/x", 40, 304, {"etag": "one"}), (10, "http://a.org/x", 10, 304, {"ETag": "one", "etag": "two"}),
    ]
    df = spark.createDataFrame([(i, u, t, s, h, "body") for i, u, t, s, h in rows], "record_id long, url string, at int, status int, headers map<string,string>, body string")
    df = df.withColumn("captured", F.timestamp_seconds("at"))
    out = revisits.resolve_revisits(df).collect()
    reasons = sorted((r["record_id"], r["reason"], r["response_id"]) for r in out)
    assert reasons == [
        (2, "resolved", 1), (4, "validator_mismatch", 3), (4, "validator_mismatch", 3), (5, "no_validator", 3), (6, "no_response", None),
        (7, "no_url", None), (8, "no_time", None), (9, "no_response", None), (10, "resolved", 1),
    ]
    assert next(r["headers"] for r in out if r["record_id"] == 2) == {"etag": "W/one", "content-type": "t", "date": "d"}
    dates = spark.createDataFrame([({"last-modified": x},) for x in ("Mon, 06 Nov 1994 08:49:37 GMT", " 06 Nov  1994 08:49:37 UTC", "Tue, 07 Nov 1994 08:49:37 GMT")], "h map<string,string>")
    one, same, other = (r["d"] for r in dates.select(revisits._date(F.col("h")).alias("d")).collect())
    assert one == same != other
    assert revisits.with_bodies(revisits.resolve_revisits(df), df).count() == 2 and revisits.resolve_revisits(df.limit(0)).count() == 0


def test_hot_url_spans_partitions(spark):
    n = 2000
    df = spark.range(n).select(
        F.col("id").alias("record_id"), F.lit("http://hot.org/a").alias("url"), F.timestamp_seconds("id").alias("captured"),
        F.when(F.col("id") == 3, 200).otherwise(304).alias("status"), F.create_map(F.lit("etag"), F.lit("e")).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    counts = {r["reason"]: r["count"] for r in revisits.resolve_revisits(df).groupBy("reason").count().collect()}
    assert counts == {"no_response": 3, "resolved": n - 4}


def test_dates_of_all_forms_are_one_instant(spark):
    same = [
        "Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994", "Sun, 6 Nov 1994 8:49:37 UTC", "6 nov 1994 08:49:37 +0000",
    ]
    others = ["Sun, 06 Nov 1994 08:49:38 GMT", "Sunday, 06-Nov-05 08:49:37 GMT", "no date", "Sun, 06 Foo 1994 08:49:37 GMT", "", None]
    rows = spark.createDataFrame([(k, {"last-modified": x}) for k, x in enumerate(same + others)], "k int, h map<string,string>")
    got = [r["d"] for r in rows.select("k", revisits._date(F.col("h")).alias("d")).orderBy("k").collect()]
    assert got[:5] == ["1994-11-06 08:49:37"] * 5 and got[5:] == ["1994-11-06 08:49:38", "2005-11-06 08:49:37", "no date", "sun, 06 foo 1994 08:49:37 gmt", None, None]


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_headers_brought_along_partitions(spark, monkeypatch, most):
    monkeypatch.setattr(revisits, "BROUGHT_BYTES", most)
    n = 3000
    df = spark.range(n).select(
        F.col("id").alias("record_id"), F.lit("http://hot.org/a").alias("url"), F.timestamp_seconds("id").alias("captured"),
        F.when(F.col("id") % 1000 == 5, 200).otherwise(304).alias("status"), F.create_map(F.lit("etag"), (F.col("id") / 1000).cast("int").cast("string")).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    for r in revisits.resolve_revisits(df).collect():
        i = r["record_id"]
        want = None if i < 5 else (i - 5) // 1000 * 1000 + 5
        assert r["response_id"] == want and r["reason"] == ("no_response" if want is None else "resolved" if want // 1000 == i // 1000 else "validator_mismatch")


def test_text_ids_and_dotted_names(spark):
    text = "a passage of the benchmark that is long enough to be matched by edits"
    rows = spark.createDataFrame([("x7", text), ("8", "other words")], "doc_id string, text string")
    items = spark.createDataFrame([("i1", text)], "item_id string, text string")
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.benchmark_hits(rows, items).collect()] == [(None, None, 0)]
    assert [r["doc_id"] for r in decontam.drop_contaminated(rows, items).collect()] == ["8"]
    scored = {r["doc_id"]: r["n_tokens"] for r in lm.score_documents(rows).collect()}
    assert scored == {None: 15, 8: 3}
    dotted = spark.createDataFrame([(f"d{i}", "menu\nown " + str(i), "h") for i in range(9)], "`doc.id` string, `page.text` string, `site.host` string")
    out = lines.drop_site_boilerplate(dotted, "site.host", "page.text", "doc.id").collect()
    assert sorted(r["page.text"] for r in out) == [f"own {i}" for i in range(9)]


def test_copies_are_dealt_out_before_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(lm, "COPIES", 10)
    rows = spark.createDataFrame([(i, False, 1, 2, bytearray(b"ab")) for i in range(95)] + [(99, False, 3, 4, bytearray(b"cd"))], "rid long, held_out boolean, h1 long, h2 long, symbols binary")
    made = lm.training_shards(rows, 100)
    found = made.collect()
    assert sorted(r["nth"] for r in found if r["h1"] == 1) == list(range(1, 96)) and sum(r["h1"] == 3 for r in found) == 1
    assert made.where("h1 = 1").select(F.spark_partition_id()).distinct().count() > 2
    assert len({(r["round"], r["shard"]) for r in found}) == lm.ROUNDS


def test_gradients():
    rng = np.random.default_rng(0)
    flat = gru.initial(rng.integers(1, 99, gru.SYMBOLS).astype(float)) + rng.normal(0, 0.05, gru.SIZE).astype(np.float32)
    ids, ends = np.concatenate([rng.integers(0, 60, (3, 4)), rng.integers(0, gru.SYMBOLS, (3, 4))]), np.zeros((6, 4), bool)
    ends[2, 1] = True

    def loss(f):
        net = gru.Net(f.astype(np.float32))
        states, saved = net.forward(net.inputs(ids), ends, np.zeros((4, gru.HIDDEN), np.float32), keep=True)
        grad = np.zeros(gru.SIZE, np.float32)
        log_p, back = net.outputs(states.reshape(-1, gru.HIDDEN + 1), ids.reshape(-1), gru.unpack(grad))
        net.backward(ids, ends, states, saved, back.reshape(states.shape), gru.unpack(grad))
        return -float(log_p.astype(np.float64).sum()), grad

    _, grad = loss(flat)
    at = 0
    for name, shape in gru.SHAPES.items():  # the largest slopes of each part of the model
        size = int(np.prod(shape))
        for k in at + np.argsort(-np.abs(grad[at : at + size]))[:40:8]:
            step = np.zeros(gru.SIZE, np.float32)
            step[k] = 1e-2
            slope = (loss(flat + step)[0] - loss(flat - step)[0]) / 2e-2
            assert abs(slope - grad[k]) < 2e-2 * max(1.0, abs(grad[k])), (name, k)
        at += size


def test_model_is_a_distribution_and_carries_state():
    rng = np.random.default_rng(0)
    flat = gru.initial(rng.integers(1, 99, gru.SYMBOLS).astype(float)) + rng.normal(0, 0.05, gru.SIZE).astype(np.float32)
    texts = [rng.integers(0, gru.SYMBOLS, n).astype(np.uint16) for n in (1, 5, 40, 333)]
    together, _ = gru.score(flat, texts)
    assert np.allclose(together, [gru.score(flat, [t])[0][0] for t in texts], rtol=1e-4)
    start = np.array([3, 7, 11], np.uint16)
    base = gru.score(flat, [start])[0][0]
    shares = rng.random(gru.TAILS)
    rows = [np.append(start, s).astype(np.uint16) for s in range(gru.SYMBOLS)]
    each, gains = gru.score(flat, rows, shares, [np.array([3])] * len(rows))
    p = np.exp(each - base)
    assert abs(p.sum() - 1) < 1e-3
    # An unknown word has its share of every tail class, whichever its own is.
    tails = p[gru.SHORT :]
    assert np.allclose(tails * np.exp([g[0] for g in gains[gru.SHORT :]]), tails @ shares, rtol=1e-3)


def test_training_learns_across_windows():
    """A word that repeats what stood more than a window before can only be told by a state that is carried."""
    rng = np.random.default_rng(1)
    texts = [np.concatenate([[k], np.full(3, 9), [k]]).astype(np.uint16) for k in rng.integers(0, 2, 4000)]
    flat = gru.initial(np.bincount(np.concatenate(texts), minlength=gru.SYMBOLS).astype(float))
    for _ in range(4):
        flat, n = gru.train(flat, texts, 0.02)
    assert n == 20_000
    seen = [gru.score(flat, [np.array(t, np.uint16)])[0][0] for t in ([0, 9, 9, 9, 0], [0, 9, 9, 9, 1])]
    assert seen[0] > seen[1] + 1


def test_head_of_counts(spark):
    """The head holds the most frequent words whatever the histogram's steps, and long words meet their counts."""
    counts = spark.createDataFrame([(f"w{k:03d}".encode(), k % gru.TAILS, c) for k, c in enumerate([10**9, 70_000, 69_999, 66_000, 5, 5, 5, 1, 1])] + [(b"x" * 500, 0, 10**6)], "word binary, kind int, c long")
    for head in range(1, 12):
        vocab = lm.vocabulary(counts, head)
        assert vocab.words == [f"w{k:03d}".encode() for k in range(min(head, 9))] and vocab.v == 10
    long = "y" * 300
    df = spark.createDataFrame([(i, f"{long} a b") for i in range(20)], "doc_id long, text string")
    assert all(r["n_known"] == 4 for r in lm.score_documents(df).collect())


def test_stages_on_text_ids(spark, tmp_path):
    """Ids that are no numbers: no stage fails on them or takes two such rows for one document."""
    import corpus_pipeline

    words = [f"word{k}" for k in range(400)]
    text = lambda seed: " ".join(np.random.default_rng(seed).choice(words, 120)) + "."
    rows = [("a-1", text(1), "en", "s", 1), ("b", text(1), "en", "s", 1), ("c", text(2), "en", "s", 1), ("c", text(3), None, None, None), (None, text(4), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long")
    spark.createDataFrame([("i", text(3)[50:300])], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        df = spark.createDataFrame((out := stage(spark, df, str(tmp_path))).collect(), out.schema)
        sizes.append(df.count())
    assert sizes == [5, 5, 4, 3, 3] and [r["doc_id"] for r in df.collect() if r["doc_id"] in ("a-1", "b")]


def test_very_long_values(spark):
    url, turn = "http://a.org/" + "x/" * 100_000 + "?b=2&a=1", "many words " * 50_000
    pages = spark.createDataFrame([(1, url), (2, "http://a.org/y")], "page_id long, url string")
    listed = pages.select(urls.canonical(F.col("url")).alias("url")).where(F.length("url") > 1000)
    assert [r["url_verdict"]["verdict"] for r in urls.judge_urls(pages, listed).orderBy("page_id").collect()] == ["block", "allow"]
    captures = pages.crossJoin(spark.createDataFrame([(1, 200), (2, 304)], "at int, status int")).select(
        (F.col("page_id") * 10 + F.col("at")).alias("record_id"), "url", F.timestamp_seconds("at").alias("captured"), "status",
        F.create_map(F.lit("etag"), F.col("url")).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    assert sorted((r["record_id"], r["reason"]) for r in revisits.resolve_revisits(captures).collect()) == [(12, "resolved"), (22, "resolved")]
    talk = spark.createDataFrame([(1, 0, "user", turn), (1, 1, "assistant", "short")], "conv_id long, turn long, role string, text string")
    assert max(len(r["segment"]) for r in chat.rotate_perspectives(talk).select("chat.segment").collect()) > len(turn)
