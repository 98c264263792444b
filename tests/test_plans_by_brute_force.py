import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import DATA

from sparkloom.operators import candidates, coevolution, quota, sampling, spans
from sparkloom.plans import queries as plan_queries
from sparkloom.plans.registry import QUERIES


def test_downsampling(spark):
    plan = QUERIES["downsample_plan"](spark, DATA).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "lang").collect()]
    counts = Counter((s, g) for _, s, g in docs)
    assert {(r["source"], r["lang"]): r["n"] for r in plan} == counts
    assert sum(r["keep"] for r in plan) == round(len(docs) * 0.5)
    assert all(1 <= r["keep"] <= r["n"] for r in plan)
    for r in plan:
        digest = hashlib.blake2b(f"{r['source']}␟{r['lang']}".encode(), digest_size=8).digest()
        assert r["phase"] == int.from_bytes(digest, "big") % 2**20
    kept = Counter((r["source"], r["lang"]) for r in QUERIES["downsample_rows"](spark, DATA).collect())
    assert kept == {(r["source"], r["lang"]): r["keep"] for r in plan}


def test_quotas_of_tied_strata(spark):
    strata = [("g", f"b{i}", n) for i, n in enumerate([1, 1, 7, 7, 7, 7, 30, 400])] + [("h", "only", 3)]
    counts = spark.createDataFrame(strata, "g string, b string, n long")
    got = {(r["g"], r["b"]): r["keep"] for r in quota.downsample_plan(counts, "g", "b", 0.3).collect()}
    sizes = np.array([n for g, _, n in strata if g == "g"])
    target = sum(v for (g, _), v in got.items() if g == "g")
    assert target + got["h", "only"] == round(463 * 0.3)
    share = quota.fitted_share(sizes, np.ones(len(sizes)), target, 0.5)
    assert math.isclose(share.sum(), target, rel_tol=1e-9)
    base = np.maximum(1, np.floor(share)).astype(int)
    order = sorted((i for i in range(8) if base[i] < sizes[i]), key=lambda i: (share[i] - base[i], sizes[i], f"b{i}"), reverse=True)
    for i in order[: target - base.sum()]:
        base[i] += 1
    assert [got["g", f"b{i}"] for i in range(8)] == base.tolist()


def test_sampling_of_huge_strata(spark):
    n, keep, phase = 9 * 10**12 + 7, 4 * 10**12 + 1, 2**20 - 3
    places = [0, 1, 2, 3, n // 2, n // 2 + 1, n - 3, n - 2, n - 1]
    quota_at = lambda k: (k * keep * 2**20 + phase * n) // (n * 2**20)
    rows = spark.createDataFrame([(k, keep, n, phase) for k in places], "k long, keep long, n long, phase long")
    got = rows.select(sampling.evenly_kept("k", "keep", "n", "phase").alias("x")).collect()
    assert [r["x"] for r in got] == [quota_at(k + 1) > quota_at(k) for k in places]


def test_targets_raised_by_many_strata():
    assert quota.group_targets([("a", 10, 10), ("b", 100, 1), ("c", 100, 1)], 21) == {"a": 10, "b": 5, "c": 6}
    assert quota.group_targets([], 0) == {}


def test_spans(spark):
    rows = QUERIES["span_examples"](spark, DATA).collect()
    assert rows and not any(r["faults"] for r in rows)
    assert {r["policy"] for r in rows} == set(spans.POLICIES)
    assert len({(r["doc_id"], r["policy"], r["mask_start"], r["mask_end"]) for r in rows}) == len(rows)
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 4
    bad = spark.createDataFrame(
        [(1, 0, "random_span", 1, 3, "A", "CD", "E", "A<MASK_3>E")],
        "k int, example int, policy string, mask_start int, mask_end int, left_flank string, target string, right_flank string, partial string",
    )
    assert spans.span_faults(bad).first()["faults"] == ["one_mask"]


def test_coevolution(spark):
    rows = ["ACDA", "ACEA", "CAD-", "CAEx", "ACDA"]
    found = coevolution.mutual_information(spark.createDataFrame([(r,) for r in rows], "s string"), "s")
    coded = np.array([[coevolution.ALIGNED.index(c) for c in r.upper()] for r in rows])
    full, k = np.zeros((4, 4)), 22
    for i in range(4):
        for j in range(i + 1, 4):
            joint = np.full((k, k), 1e-3)
            np.add.at(joint, (coded[:, i], coded[:, j]), 1)
            joint /= joint.sum()
            one = [(np.bincount(coded[:, c], minlength=k) + 1e-3) / (5 + k * 1e-3) for c in (i, j)]
            full[i, j] = full[j, i] = (joint * np.log(joint / np.outer(*one))).sum()
    got = {(r["i"], r["j"]): r["score"] for r in found.collect()}
    assert len(got) == 6 and all(math.isclose(v, full[p], rel_tol=1e-9, abs_tol=1e-12) for p, v in got.items())
    less = full - np.outer(full.mean(1), full.mean(0)) / full.mean()
    assert all(math.isclose(r["score"], less[r["i"], r["j"]], rel_tol=1e-9, abs_tol=1e-12) for r in coevolution.corrected(found, 4).collect())


def plain_span(q, width, flank):
    best = None
    for at in range(len(q) - width + 1):
        span, n = q[at : at + width], len(q)
        if any(x not in "ACDEFGHIKLMNPQRSTVWY" for x in span) or span in q[:at] + q[at + width :]:
            continue
        run = max(len(list(g)) for _, g in itertools.groupby(span))
        sides = (min(flank, at) / flank + min(flank, n - at - width) / flank) / 2
        central = 1.0 if n <= width else max(0, 1 - abs(at + width / 2 - n / 2) / (n / 2))
        score = 0.42 * min(1, len(set(span)) / min(20, width)) + 0.34 * sides + 0.24 * central - min(0.35, run / width * 0.7)
        if best is None or max(0, min(1, score)) > best[1]:
            best = (at, max(0, min(1, score)))
    return best


def test_best_span_of_repetitive_texts():
    rng = random.Random(2)
    for _ in range(600):
        q = "".join(rng.choice(["A", "AC", "D", "X", "ACA", "𝔸"]) for _ in range(rng.randrange(1, 26)))
        width = rng.randrange(1, 9)
        want, got = plain_span(q, width, 4), candidates.best_span(q, width, 4)
        assert (want is None) == (got is None), (q, width)
        if want:
            assert math.isclose(want[1], got[1], abs_tol=1e-9) and (want[0] == got[0] or math.isclose(plain_span(q, width, 4)[1], got[1])), (q, width)


def test_alignments_of_several_lengths_are_refused(spark):
    rows = spark.createDataFrame([("ACD",), ("ACDE",)], "s string").repartition(2)
    with pytest.raises(ValueError, match="one length"):
        coevolution.mutual_information(rows, "s")


def test_constraints_from_an_alignment(spark):
    rows = spark.createDataFrame([("AACAA",), ("CCDAC",), ("AADCA",), ("CCCCC",)], "s string")
    scores = coevolution.corrected(coevolution.mutual_information(rows, "s"), 5)
    all_pairs = {(r["i"], r["j"]): r["score"] for r in scores.collect()}
    made = coevolution.contact_constraints(coevolution.top_pairs(scores, 3, 3)).collect()
    want = sorted((p for p in all_pairs if p[1] - p[0] >= 3), key=lambda p: (-all_pairs[p], p))[:3]
    assert [(r["i"], r["j"]) for r in made] == want and all(r["max_distance"] == 8.0 and r["min_distance"] is None for r in made)
    for k, apart in ((0, 1), (1, -1)):
        with pytest.raises(ValueError, match="positive"):
            coevolution.top_pairs(scores, k, apart)


def test_coevolving_pairs_leave_no_pair_out(spark):
    scores = coevolution.corrected(coevolution.mutual_information(plan_queries._aligned(spark, DATA), "s"), 6).collect()
    assert len(scores) == 15
    best = sorted(scores, key=lambda r: (-r["score"], r["i"], r["j"]))[:5]
    found = QUERIES["coevolving_pairs"](spark, DATA).collect()
    assert [(r["i"], r["j"]) for r in found] == [(r["i"], r["j"]) for r in best]
    assert any(r["j"] - r["i"] == 1 for r in found)


def test_the_best_windows_are_looked_for_first(monkeypatch):
    def no_sort(*_):
        raise AssertionError("all windows are sorted")

    monkeypatch.setattr(candidates, "_alone", no_sort, raising=False)
    monkeypatch.setattr(candidates, "equal_windows", no_sort)
    rng = random.Random(5)
    q = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(5_000))
    at, score = candidates.best_span(q, 12, 20)
    assert q.count(q[at : at + 12]) == 1 and 0 < score <= 1
