"""Joins: paired records, change plans, keyword rules, lexical overlap."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import free_name, let, match_text


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of two inputs of unique keys, with ``origin``: paired, left_only or right_only."""
    ours, theirs = free_name(left, "_in_left"), free_name(right, "_in_right")
    l, r = left.withColumn(ours, F.lit(True)), right.withColumn(theirs, F.lit(True))
    origin = F.when(F.col(ours) & F.col(theirs), "paired").when(F.col(ours), "left_only").otherwise("right_only")
    return l.join(r, key, "full").withColumn("origin", origin).drop(ours, theirs)


def change_plan(wanted: DataFrame, index: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """``wanted`` keys with ``action``: new, updated or unchanged. Only a known version can mark an update."""
    old, have, now = (free_name(wanted, x) for x in ("_old", "_have", "_now"))
    known = index.select(key, F.col(version).alias(old), F.lit(True).alias(have))
    joined = wanted.join(known, key, "left").join(current.select(key, F.col(version).alias(now)), key, "left")
    action = (
        F.when(F.col(have).isNull(), "new")
        .when(F.col(now).isNotNull() & ~F.col(now).eqNullSafe(F.col(old)), "updated")
        .otherwise("unchanged")
    )
    return joined.withColumn("action", action).drop(old, have, now)


def matched(text: Column, rules: list[Rule]) -> Column:
    """(label, keywords) of the rules of which keywords occur as whole words, in order of rules and keywords.

    The text is brought into its matching form once for each row; the rules are a constant.
    """

    if not rules:
        return F.array().cast("array<struct<label:string,keywords:array<string>>>")

    def found(norm: Column) -> Column:
        hits = []
        for rule in rules:
            words = F.array_compact(F.array(*[
                F.when(norm.contains(f" {plain} "), F.lit(word)) for word in rule.keywords if (plain := plain_words(word))
            ]).cast("array<string>"))
            hits.append(F.struct(F.lit(rule.label).alias("label"), words.alias("keywords")))
        return F.filter(F.array(*hits), lambda h: F.size(h["keywords"]) > 0)

    return let(match_text(F.coalesce(text, F.lit(""))), found)


def plain_words(keyword: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", keyword.lower()))


def matched_labels(text: Column, rules: list[Rule]) -> Column:
    """Labels of the rules of which a keyword occurs as whole words, in order of the rules; the rules are a constant."""

    if not rules:
        return F.array().cast("array<string>")

    def fits(norm: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(reduce(or_, [norm.contains(f" {plain_words(w)} ") for w in r.keywords]), F.lit(r.label)) for r in rules
        ]))

    return let(match_text(F.coalesce(text, F.lit(""))), fits)


def overlap(a: Column, b: Column) -> Column:
    """Shared terms over the geometric mean of the sizes of two sets; 0 if either is empty."""
    sizes = F.size(a) * F.size(b)
    return F.when(sizes == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(sizes.cast("double")))
