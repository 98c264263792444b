"""Encoding by a given vocabulary against plain loops, and span rows against their originals."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import instructions
from sparkloom.operators.vocabulary import SPECIALS, Coder, Vocabulary, decoded, encoded


def plain(coder, text, allowed):
    """Cut at the longest special token of each place; then all places of the lowest pair, again and again."""
    found, held, i = [], "", 0

    def flush():
        nonlocal held
        if held in allowed:
            found.append(coder.v.ids[held])
        elif held:
            ids = [coder.v.ids[x] for x in held]
            while ranked := [coder.ranks[p] for p in zip(ids, ids[1:]) if p in coder.ranks]:
                pair, out, k = coder.pairs[min(ranked)], [], 0
                while k < len(ids):
                    if tuple(ids[k : k + 2]) == pair:
                        out.append(coder.v.merges[pair])
                        k += 2
                    else:
                        out.append(ids[k])
                        k += 1
                ids = out
            found.extend(ids)
        held = ""

    while i < len(text):
        for s in sorted(coder.v.specials, key=len, reverse=True):
            if text.startswith(s, i):
                flush()
                found.append(coder.v.ids[s])
                i += len(s)
                break
        else:
            held += text[i].replace("\r", "")
            i += 1
    flush()
    return found


@pytest.mark.parametrize("seed", range(6))
def test_encode_by_plain_loops(seed):
    rng = random.Random(seed)
    ids = {t: k for k, t in enumerate([*SPECIALS, "<|eos|>x", *"abc"])}
    merges = {}
    for k in range(rng.randrange(2, 25)):
        names = list(ids)
        a, b = rng.choice(names[5:]), rng.choice(names[5:])
        # Some merges use a token that's there, and even one of their own pair.
        new = rng.choice([a, b, a + b, a + b, a + b])
        merges.setdefault((ids[a], ids[b]), ids.setdefault(new, len(ids)))
    drop = {p for p, new in merges.items() if new in p}
    merges = {p: new for p, new in merges.items() if p not in drop or rng.random() < 0.5}
    vocabulary = Vocabulary(ids, merges, (*SPECIALS, "<|eos|>x"))
    coder = Coder(vocabulary)
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", "c", "aa", "abab", "\r", "<|eos|>", "<|eos|>x", "<|bos|>"], [9, 9, 9, 4, 4, 1, 1, 1, 1], k=rng.randrange(30)))
        assert coder.encode(text) == plain(coder, text, set(vocabulary.specials))


def test_round_trips_errors_and_long_texts(spark):
    v = Vocabulary.of("ACDEFGHIKLMNPQRSTVWYX", ("MKV", "AA", "AAAA", "LL"))
    assert Vocabulary.from_json(v.to_json()) == v and Vocabulary.from_json('{"tokenizer": ' + v.to_json() + "}") == v
    rng = random.Random(1)
    texts = ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWYX", k=n)) for n in (0, 1, 7, 300_000)] + ["A" * 100_000, "MKV<|eos|>AAAA", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    ids = rows.select("k", "t", encoded(F.col("t"), v, bos=True, eos=True).alias("ids"))
    for r in ids.select("k", "t", "ids", decoded(F.col("ids"), v).alias("all"), decoded(F.col("ids"), v, True).alias("plain")).collect():
        whole = r["t"] or ""
        assert r["all"] == f"<|bos|>{whole}<|eos|>" and r["plain"] == whole.replace("<|eos|>", "")
        assert len(r["ids"]) <= len(whole) + 2
    with pytest.raises(ValueError, match="lacks: .'B'"):
        Coder(v).encode("ABA")
    with pytest.raises(ValueError, match="isn't allowed"):
        Coder(v, {"<|bos|>"}).encode("A<|eos|>")
    with pytest.raises(ValueError, match="no token 999"):
        Coder(v).decode([999])
    with pytest.raises(ValueError, match="two tokens"):
        Vocabulary.from_json('{"str_to_int": {"a": 0}, "int_to_str": {"0": "a"}, "bpe_merges": [{"pair": [0], "new_id": 1}]}')
    with pytest.raises(ValueError, match="directions"):
        Vocabulary.from_json('{"str_to_int": {"a": 0}, "int_to_str": {"0": "b"}}')


def test_span_rows_against_their_originals(spark):
    whole = "MKTAYIAKQRQISFVKSHFSRQ"
    row = lambda start, n: instructions.span_row(F.lit(whole), F.lit(start), F.lit(n), F.lit("random"), F.lit("go"), 5)

    def faults(start, end, original, made=(4, 6), output=None):
        s = row(*made)
        out = s["output"] if output is None else F.lit(output)
        f = instructions.span_row_faults(s["instruction"], s["input"], out, F.lit(start), F.lit(end), F.lit(6), None if original is None else F.lit(original))
        return spark.range(1).select(f.alias("f")).first()["f"]

    assert faults(4, 10, whole) == faults(4, 10, f" {whole.lower()}\n") == faults(4, 10, None) == []
    assert faults(20, 26, whole) == ["outside_original", "original_output", "original_left", "original_right"]
    assert faults(4, 10, whole[:4] + "A" + whole[5:]) == ["original_output"]
    assert faults(4, 10, "W" * 3 + whole[3:]) == ["original_left"] and faults(4, 10, whole[:11] + "WWWW") == ["original_right"]


def test_coded_documents(spark, same_as_sql):
    from conftest import DATA

    from sparkloom.plans.registry import QUERIES, SQL

    same_as_sql(QUERIES["coded_documents"](spark, DATA), SQL["coded_documents"])


def test_pieces_are_cut_where_no_merge_goes():
    given = Vocabulary.of("abcdn ", ("ab", "bc", "and "))
    coder = Coder(given)
    assert list(coder.parts("abcdn and")) == ["abc", "d", "n", " ", "and"]
    text = "and abcd banda " * 50
    assert coder.encode(text) == coder.merged(text)
    merged, seen = coder.merged, []
    coder.merged = lambda part: seen.append(part) or merged(part)
    assert coder.encode(text * 20) == merged(text * 20)
    assert len(seen) <= 12  # a part is merged once, however often it occurs
    plain = Coder(Vocabulary.of("ACD"))
    assert plain.piece is None and plain.encode("CAD") == [5, 4, 6]


def test_ids_that_are_used_twice_are_made_once(spark, capsys):
    given = Vocabulary.of("abcdn ", ("ab", "and "))
    coded = spark.createDataFrame([("and ab",), (None,)], "t string").select(encoded(F.col("t"), given, bos=True, eos=True).alias("ids"))
    both = coded.select(decoded(F.col("ids"), given, skip_special=True).alias("t"), F.size("ids").alias("n"))
    both.explain()
    assert "run(run(" not in capsys.readouterr().out
    assert [tuple(r) for r in both.collect()] == [("and ab", 4), ("", 2)]
