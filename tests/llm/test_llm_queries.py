"""The queries of the training-data operators against SQL or brute force over whole tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
import xxhash
from conftest import DATA
from test_near_dedup import plain_components

import corpus_pipeline
from sparkloom.llm import bpe, decontam, gru, lm, sharding, simhash
from sparkloom.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, DATA), SQL[name])


def plain_table(names, size):
    """An independent fill: in each turn every shard takes the first free slot of its whole permutation, written out."""

    def number(name, salt):
        return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, salt=salt).digest(), "big")

    orders = []
    for name in names:
        offset, skip = number(name, b"offset") % size, number(name, b"skip") % (size - 1) + 1
        orders.append(iter([(offset + k * skip) % size for k in range(size)]))
    owner, free = {}, set(range(size))
    while free:
        for name, order in zip(names, orders, strict=True):
            if not free:
                break
            slot = next(s for s in order if s in free)
            owner[slot] = name
            free.remove(slot)
    return owner


@pytest.mark.parametrize(("shards", "size"), [(1, 3), (3, 7), (7, 7), (10, 997)])
def test_lookup_table_by_brute_force(shards, size):
    names = [f"s{k}" for k in range(shards)]
    want = plain_table(names, size)
    assert [names[k] for k in sharding.lookup_table(names, size)] == [want[slot] for slot in range(size)]


def test_shards_by_brute_force(spark):
    names, size = [f"shard-{k:03d}" for k in range(256)], 65_537
    want = plain_table(names, size)
    counts = Counter(want.values())
    assert len(counts) == 256 and max(counts.values()) - min(counts.values()) <= 1
    rows = QUERIES["op1_shard_lookup"](spark, DATA).collect()
    ids = [r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    for r in rows:
        key = xxhash.xxh64_intdigest(int(r["doc_id"]).to_bytes(8, "little", signed=True), 42)
        slot = (key - 2**64 if key >> 63 else key) % size
        assert (r["slot"], r["shard"], names[r["shard_id"]]) == (slot, want[slot], want[slot])
    fewer = plain_table(names[:-1], size)
    moved = sum(want[s] != fewer[s] for s in range(size) if want[s] != names[-1])
    assert moved < 0.05 * size  # little moves beyond the lost share


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b, n in enumerate(bits) if 2 * n > len(shingles))


def components(fps, radius=2):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_by_brute_force(spark, documents):
    fps = {i: plain_fingerprint(t) for i, t in documents.items()}
    want = components(fps)
    rows = QUERIES["op3_simhash_components"](spark, DATA).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("small", [2, 64])
def test_links_of_dense_fingerprints(spark, small):
    """Small limits send all buckets the way of large ones; no link may be lost on either way."""
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**62, 5)]
    near = {b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(40)}
    signed = sorted({x - 2**64 if x >> 63 else x for x in near})
    found = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), small=small)
    got = {tuple(sorted((r["u"], r["v"]))) for r in found.collect()}
    want = {(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) % 2**64).bit_count() <= 2}
    assert got == want


def plain_network_score(flat, symbols, unknown, shares):
    """log10 P of a document's symbols, token by token in double precision, from the parameters alone.

    An unknown word's P is the sum over the tail classes of their P times their ``shares`` of such words.
    """
    m = {k: v.astype(np.float64) for k, v in gru.unpack(flat).items()}
    h, total, H = np.zeros(gru.HIDDEN), 0.0, gru.HIDDEN
    for s, odd in zip(symbols.tolist(), unknown, strict=True):
        state = np.append(h, 1.0)
        p = np.exp(m["Wc"] @ state)
        p /= p.sum()
        c = int(gru.CLASS_OF[s])
        total += np.log(p[gru.BINS :] @ shares if odd else p[c])
        if s < gru.SHORT:
            low, high = gru.EDGES[c], gru.EDGES[c + 1]
            logits = m["W2"][low:high] @ state
            total += logits[s - low] - np.log(np.exp(logits).sum())
        x, u = m["E"][s] @ m["P"] + m["b"], h @ m["U"]
        r, z = (1 / (1 + np.exp(-(x[a : a + H] + u[a : a + H]))) for a in (0, H))
        h = z * h + (1 - z) * np.tanh(x[2 * H :] + r * u[2 * H :])
    return total / math.log(10)


def witten_bell(train, texts):
    """Mean log10 P a token of a bigram model that backs off to the add-one base distribution."""
    ones, twos, after = Counter(), Counter(), Counter()
    for words in train:
        for a, b in zip([b"", *words], words, strict=False):
            ones[b] += 1
            twos[a, b] += 1
    context = Counter()
    for (a, _), n in twos.items():
        context[a] += n
        after[a] += 1
    n, v, total, tokens = sum(ones.values()), len(ones), 0.0, 0
    for words in texts:
        for a, b in zip([b"", *words], words, strict=False):
            base = (ones[b] + 1) / (n + v + 1)
            p = (twos[a, b] + after[a] * base) / (context[a] + after[a]) if context[a] else base
            total += math.log10(p)
            tokens += 1
    return total / tokens


def test_language_model(spark, documents):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in documents}
    words = {i: lm.words_of(t) for i, t in documents.items()}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    fitted = lm.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    rows = lm.scores_of(fitted).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    # The whole score anew: short list, tail classes and discount from the counts, the network token by token.
    top = sorted(counts, key=lambda w: (-counts[w], w))[: gru.SHORT]
    rank = {w: k for k, w in enumerate(top)}
    kind = lambda w: zlib.crc32(w[-3:]) % gru.TAILS
    tail_n, tail_v, twice = Counter(), Counter(), Counter()
    for w, c in counts.items():
        if w not in rank:
            tail_n[kind(w)] += c
            tail_v[kind(w)] += 1
            twice[c] += 1
    d = min(0.95, max(0.05, twice[1] / (twice[1] + 2 * twice[2]))) if twice[1] else 0.5
    for r in rows:
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), total)
        assert r["n_known"] == sum(w in counts for w in ws)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), rel_tol=1e-9)
        symbols = np.array([rank[w] if w in rank else gru.SHORT + kind(w) for w in ws])
        inner = sum(math.log10((counts[w] - d) / tail_n[kind(w)]) for w in ws if w in counts and w not in rank)
        shares = np.array([d * tail_v[k] / tail_n[k] if tail_n[k] else 1.0 for k in range(gru.TAILS)])
        want = plain_network_score(fitted.flat, symbols, [w not in counts for w in ws], shares) + inner
        assert math.isclose(r["score"], want, rel_tol=2e-4), r["doc_id"]
    away = [r for r in rows if r["held_out"]]
    mean = sum(r["score"] for r in away) / sum(r["n_tokens"] for r in away)
    assert mean > sum(r["base_score"] for r in away) / sum(r["n_tokens"] for r in away)
    bigram = witten_bell([w for i, w in words.items() if not held[i]], [w for i, w in words.items() if held[i]])
    assert mean > bigram, (mean, bigram)


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    one, many = (
        {r["doc_id"]: r["score"] for r in lm.score_documents(d, shard_tokens=20_000).collect()}
        for d in (docs.coalesce(1), docs.repartition(7, "text"))
    )
    assert one.keys() == many.keys() and all(math.isclose(one[i], many[i], rel_tol=1e-3) for i in one)


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def all_least_distances(item, text):
    """The least distance of an item to any passage of a text, row by row; a row's insertions are a running minimum."""
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    places = np.arange(len(letters) + 1)
    row = np.zeros(len(letters) + 1, np.int64)
    for i, a in enumerate(item, 1):
        step = np.empty_like(row)
        step[0] = i
        step[1:] = np.minimum(row[:-1] + (letters != ord(a)), row[1:] + 1)
        row = np.minimum.accumulate(step - places) + places
    return int(row.min())


def test_decontamination_by_brute_force(spark, documents):
    """Every document against every item, whole: which pairs are within the budget, and at which distance."""
    rows = QUERIES["op7_benchmark_edit_matches"](spark, DATA).collect()
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows}
    items = {r["item_id"]: decontam.normal(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    want = {}
    for doc, text in documents.items():
        whole = decontam.normal(text)
        for item, passage in items.items():
            # A pair is out of reach if letters that the text lacks need more edits than the budget allows.
            lacking = sum((Counter(passage) - Counter(whole)).values()) if len(whole) < 400 else 0
            most = len(passage) // 16 - 1
            if lacking <= most and (found := all_least_distances(passage, whole)) <= most:
                want[doc, item] = found
    assert want and got == want
    for r in rows:
        whole = decontam.normal(documents[r["doc_id"]])
        passage = whole[r["passage_start"] : r["passage_end"]]
        assert least_distance(items[r["item_id"]], passage) == r["distance"]
        assert abs(len(passage) - len(items[r["item_id"]])) <= r["distance"]


def leaks(item, text):
    most = len(item) // 16 - 1
    return sum((Counter(item) - Counter(text)).values()) <= most and all_least_distances(item, text) <= most


def encoding():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})


def test_bpe_as_the_library(spark, documents):
    own = encoding()
    for r in QUERIES["op8_byte_bpe"](spark, DATA).collect():
        ids = own.encode_ordinary(documents[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((documents[r["doc_id"]] or "").encode()).hexdigest()


def test_ordinary_texts_are_stitched(spark):
    """The chunk method runs on ordinary documents, and gives what one pass over the whole text gives."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    encoder, own = bpe.Encoder(bpe.load_ranks()), encoding()
    stitched = []
    for text in texts:
        before = encoder.stitched
        assert encoder.encode(text) == np.array(own.encode_ordinary(text), "<u4").tobytes()
        stitched.append(encoder.stitched - before)
    long = [k for k, t in zip(stitched, texts, strict=True) if len(t) > bpe.CHUNK + bpe.OVERLAP]
    assert len(long) > 100 and sum(k > 0 for k in long) > 0.9 * len(long)


def test_pipeline_by_brute_force(spark):
    """Each stage against its plain form, on the rows of the stage before."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows or {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(rows) and set(rows) <= set(before)
        assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        if name == "quality":
            judged = {r["doc_id"]: r["kept"] for r in QUERIES["op10_line_quality"](spark, DATA).collect()}
            assert set(rows) == {i for i, kept in judged.items() if kept}
        elif name == "line_dedup":
            hosts, seen = Counter(r["source"] for r in before.values()), defaultdict(set)
            for i, r in before.items():
                for line in r["text"].split("\n"):
                    if line.strip(" \t\r\v\f"):
                        seen[r["source"], line].add(i)
            bad = {k for k, v in seen.items() if len(v) >= 5 and len(v) > 0.02 * hosts[k[0]]}
            for i, r in before.items():
                assert rows[i]["text"] == "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad)
        elif name == "near_dedup":
            assert set(rows) == set(plain_components({i: r["text"] for i, r in before.items()}).values())
        else:
            items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
            found = {i for i, r in before.items() if any(leaks(decontam.normal(x["text"]), decontam.normal(r["text"])) for x in items)}
            assert set(rows) == before.keys() - found
    own = encoding()
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect():
        assert r["n_tokens"] == len(own.encode_ordinary(rows[r["doc_id"]]["text"]))
