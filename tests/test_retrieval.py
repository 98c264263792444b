"""Retrieval by postings against scores of all pairs."""

import math
import random
import re

import pytest

from sparkloom.operators import retrieval
from sparkloom.plans.registry import QUERIES


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def plain_score(query, text, special):
    q, t = tokens(query), tokens(text)
    q_terms, terms = {x for x in q if len(x) > 1}, set(t)
    lexical = len(q_terms & terms) / math.sqrt(len(q_terms) * len(terms)) if q_terms and terms else 0.0
    phrases = [" ".join(q[i : i + n]) for n in (2, 3) for i in range(len(q) - n + 1)]
    hits = sum(p in " ".join(t) for p in phrases) if t else 0
    return min(1.0, 0.52 * lexical + (0.18 * hits / len(phrases) if phrases else 0.0) + 0.12 * special)


def texts(rng, words, n, most):
    return [" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "k"), [(0, 1), (1, 3), (2, 8), (3, 200)])
def test_all_pairs_agree(spark, seed, k):
    rng = random.Random(seed)
    # Words that end and begin in each other, so that phrases also lie across the ends of other words.
    words = [a + b for a in ("an", "x", "so", "tan", "i") for b in ("", "s", "t", "so")]
    rows = [(i, t, rng.choice([None, " ", "en"])) for i, t in enumerate([*texts(rng, words, 60, 12), None, "", "??"])]
    asked = [(i, t) for i, t in enumerate([*texts(rng, words, 9, 7), "an so", "zz yy", "", None])]
    got = retrieval.ranked(
        spark.createDataFrame(asked, "q int, text string"), spark.createDataFrame(rows, "k int, text string, lang string").repartition(3), "q", "k", k, filled=("lang",)
    ).collect()
    for q, text in asked:
        scored = sorted((-round(plain_score(text, t, bool((s or "").strip())), 9), i) for i, t, s in rows)[:k]
        own = sorted((r["rank"], r["k"], round(r["score"], 9)) for r in got if r["q"] == q)
        # Of a query without terms or phrases only the fill is left.
        assert [x[2] for x in own] == pytest.approx([-s for s, _ in scored])
        assert [x[1] for x in own] == [i for _, i in scored]


@pytest.mark.parametrize("k", [1, 4, 30, 100])
def test_best_overlaps_of_all_pairs(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(40)]
    make = lambda n: [(i, sorted(set(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randrange(14))))) for i in range(n)]
    rows, asked = make(80), make(12)
    got = retrieval.best_overlaps(spark.createDataFrame(asked, "q int, terms array<string>"), spark.createDataFrame(rows, "k int, terms array<string>"), "q", "k", k).collect()
    for q, terms in asked:
        score = lambda t: len(set(t) & set(terms)) / math.sqrt(len(t) * len(terms)) if t and terms else 0.0  # noqa: B023, E731
        want = sorted((-score(t), i) for i, t in rows)[:k]
        assert [(-r["score"], r["k"]) for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == want


def test_no_nested_loops(spark):
    from conftest import DATA

    for name in ("lexical_rank", "ranked_documents"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
