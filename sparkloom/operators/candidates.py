"""Candidate sequences: validation with reasons, composite and weighted scores, geometry and contacts, choice of spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HYDROPHOBIC, PROTEIN, STANDARD, let, longest_run, share_of
from .instructions import compact
from .kmers import equal_windows

# Weights of the six parts of a candidate's score.
WEIGHTS = {
    "validity": 0.20, "length": 0.10, "ambiguity": 0.10, "model_confidence": 0.30, "geometry_confidence": 0.20, "contact_consistency": 0.10,
}
# Weights of the parts of a span's score.
SPAN_WEIGHTS = (0.42, 0.34, 0.24)
#: Windows of the highest scores that are looked for in the rest one by one.
TRIES = 8


@dataclass(frozen=True)
class Limits:
    """Limits of validation; None leaves a check out."""

    min_length: int = 30
    max_length: int = 1024
    max_x_fraction: float = 0.05
    min_confidence: float | None = None
    min_plddt: float | None = None
    min_ptm: float | None = None
    min_iptm: float | None = None
    min_triangle_consistency: float | None = None


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def length_score(n: Column, shortest: int, longest: int) -> Column:
    """1 inside the window, n / shortest below it and longest / n above it."""
    if shortest <= 0 or longest < shortest:
        raise ValueError("lengths must be positive and in order")
    return F.when(n < shortest, n / F.lit(float(shortest))).when(n > longest, F.lit(float(longest)) / n).otherwise(F.lit(1.0))


def best_confidence(*metrics: Column) -> Column:
    """The first metric that isn't null, as a share: per cents are divided by 100; 0 if there's none."""
    first = F.coalesce(*[m.cast("double") for m in metrics])
    return F.coalesce(clamped(F.when(first > 1, first / 100).otherwise(first)), F.lit(0.0))


METRICS = ("confidence", "plddt", "ptm", "iptm")


def validated(rows: DataFrame, limits: Limits = Limits(), sequence: str = "sequence", geometry: str | None = None) -> DataFrame:
    """``rows`` with ``validation``: validity, length, ambiguity, model_confidence, geometry, score, passed and reasons.

    ``rows`` has the columns ``METRICS`` and has_prediction; ``geometry`` names a column of triangle consistency, null
    where coordinates lack. The score is the mean of the parts above 0, and a row passes if nothing speaks against it.
    """
    q = compact(F.col(sequence))

    def of(m: Column) -> Column:
        n, none = m["n"], m["n"] == 0
        validity, x = m["validity"], m["x"]
        length = F.when(none, 0.0).otherwise(length_score(n, limits.min_length, limits.max_length))
        ambiguity = F.when(none, 0.0).otherwise(1 - x)
        there = F.coalesce(F.col("has_prediction"), F.lit(False))
        model = F.when(there, best_confidence(*map(F.col, METRICS))).otherwise(0.0)
        shape = F.col(geometry).cast("double") if geometry else F.lit(None).cast("double")
        checked = there & shape.isNotNull() if limits.min_triangle_consistency is not None else F.lit(False)
        parts = F.array(validity, length, ambiguity, model, F.when(checked, shape).otherwise(0.0))
        reasons = [
            F.when(none, "empty_sequence"), F.when(~none & (validity < 1), "invalid_amino_acid"),
            F.when(~none & (length < 1), "length_outside_window"), F.when(~none & (x > limits.max_x_fraction), "too_many_x"),
            F.when(~there, "missing_structure_provider"),
        ]
        for metric, least in zip(METRICS, (limits.min_confidence, limits.min_plddt, limits.min_ptm, limits.min_iptm), strict=True):
            if least is not None:
                reasons.append(F.when(there & (F.coalesce(F.col(metric).cast("double"), F.lit(0.0)) < least), f"low_{metric}"))
        if limits.min_triangle_consistency is not None:
            reasons.append(F.when(checked & (shape < limits.min_triangle_consistency), "low_triangle_consistency"))

        def judged(why: Column) -> Column:
            positive = F.filter(parts, lambda v: v > 0)
            mean = F.aggregate(positive, F.lit(0.0), lambda a, v: a + v) / F.size(positive)
            return F.struct(
                validity.alias("validity"), length.alias("length"), ambiguity.alias("ambiguity"), model.alias("model_confidence"),
                F.when(checked, shape).alias("geometry"), F.when(F.size(positive) > 0, mean).otherwise(0.0).alias("score"),
                (F.size(why) == 0).alias("passed"), why.alias("reasons"),
            )

        return let(F.array_compact(F.array(*reasons)), judged)

    # What is read of the whole text is read once.
    measures = lambda q: F.struct(F.length(q).alias("n"), share_of(q, PROTEIN).alias("validity"), share_of(q, "X").alias("x"))
    return rows.withColumn("validation", let(let(q, measures), of))


def weighted_score(
    sequence: Column, model_confidence: Column, geometry: Column, contacts: Column, limits: Limits = Limits(), weights: dict[str, float] = WEIGHTS
) -> Column:
    """The weighted mean of the six parts, between 0 and 1; null geometry or contacts count as 0."""
    if sum(weights.values()) <= 0:
        raise ValueError("a weight must be positive")

    def of(q: Column) -> Column:
        none = q == ""
        parts = {
            "validity": share_of(q, PROTEIN),
            "length": F.when(none, 0.0).otherwise(length_score(F.length(q), limits.min_length, limits.max_length)),
            "ambiguity": F.when(none, 0.0).otherwise(1 - share_of(q, "X")), "model_confidence": model_confidence,
            "geometry_confidence": clamped(F.coalesce(geometry, F.lit(0.0))), "contact_consistency": clamped(F.coalesce(contacts, F.lit(0.0))),
        }
        total = sum((F.lit(weights[k]) * v for k, v in parts.items()), F.lit(0.0))
        return clamped(total / F.lit(float(sum(weights.values()))))

    return let(compact(sequence), of)


def equal_run(text: Column) -> Column:
    """The length of the longest run of one character."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def repeat_penalty(text: Column) -> Column:
    """At most 0.35: the share of the longest run of one character, times 0.7."""
    return F.when(text == "", 0.0).otherwise(F.least(F.lit(0.35), equal_run(text) / F.length(text) * 0.7))


def solubility_reasons(text: Column, ends: int = 30) -> Column:
    """What speaks against a soluble sequence: a long hydrophobic run, hydrophobic ends."""

    def of(q: Column) -> Column:
        first, last = F.substring(q, 1, ends), F.substr(q, F.greatest(F.length(q) - ends, F.lit(0)) + 1)
        return F.array_compact(F.array(
            F.when(longest_run(q, HYDROPHOBIC) > 10, "hydrophobic_run"), F.when(share_of(first, HYDROPHOBIC) >= 0.4, "hydrophobic_start"),
            F.when(share_of(last, HYDROPHOBIC) >= 0.4, "hydrophobic_end"),
        ))

    return let(F.trim(text), of)


def reject_reasons(text: Column, shortest: int = 100, longest: int = 220, ends: int = 30) -> Column:
    """The full list of what speaks against a sequence: alphabet, length, runs, ends and one residue too often."""

    def of(q: Column) -> Column:
        n = F.length(q)
        counts = [n - F.length(F.replace(q, F.lit(letter), F.lit(""))) for letter in STANDARD]
        return F.concat(
            F.array_compact(F.array(
                F.when(q.rlike(f"[^{STANDARD}]") | (q == ""), "alphabet"), F.when(~n.between(shortest, longest), "length"),
                F.when(equal_run(q) > 12, "single_residue_run"), F.when((q != "") & (F.greatest(*counts) > 0.35 * n), "residue_share"),
            )),
            solubility_reasons(q, ends),
        )

    return let(compact(text), of)


def distances(points: DataFrame, pairs: DataFrame, key: str, at: str = "i", coordinates: str = "xyz") -> DataFrame:
    """``pairs`` (key, i, j) with the Euclidean distance of their points; null where a point lacks.

    Only asked pairs are met, so that no chain's square of distances is made.
    """
    one = points.select(F.col(key).alias("_k"), F.col(at).alias("_i"), F.col(coordinates).alias("_a"))
    two = points.select(F.col(key).alias("_l"), F.col(at).alias("_j"), F.col(coordinates).alias("_b"))
    joined = pairs.join(one, (F.col(key) == F.col("_k")) & (F.col("i") == F.col("_i")), "left").join(
        two, (F.col(key) == F.col("_l")) & (F.col("j") == F.col("_j")), "left"
    )
    square = F.aggregate(F.zip_with("_a", "_b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return joined.withColumn("distance", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.sqrt(square))).drop("_k", "_l", "_i", "_j", "_a", "_b")


def contact_precision(ranked: DataFrame, key: str, k: int, threshold: float = 8.0) -> DataFrame:
    """(key, selected, precision): the share of the first ``k`` pairs by ``rank`` that are within the threshold.

    ``rank`` counts from 1; a pair without a distance is an error, as its place is outside the chain.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    bad = F.when(F.col("distance").isNull(), F.raise_error(F.lit("a pair is outside the chain")).cast("boolean")).otherwise(True)
    first = ranked.where(F.col("rank") <= k).where(bad)
    return first.groupBy(key).agg(F.count("*").alias("selected"), (F.count_if(F.col("distance") <= threshold) / F.count("*")).alias("precision"))


def constraint_results(constraints: DataFrame) -> DataFrame:
    """``constraints`` (i, j, min_distance, max_distance, distance) with ``reason``, null where they hold."""
    over = F.coalesce(F.col("distance") > F.col("max_distance"), F.lit(False))
    under = F.coalesce(F.col("distance") < F.col("min_distance"), F.lit(False))
    place = F.concat(F.lit("("), F.col("i").cast("string"), F.lit(","), F.col("j").cast("string"))
    reason = (
        F.when(F.col("distance").isNull(), F.concat(F.lit("constraint_index_out_of_bounds"), place, F.lit(")")))
        .when(over | under, F.concat(F.lit("contact_violated"), place, F.lit(",dist="), F.format_string("%.2f", "distance"), F.lit(")")))
    )
    return constraints.withColumn("reason", reason)


def constraint_scores(results: DataFrame, key: str) -> DataFrame:
    """(key, constraints, score): the share of constraints that hold."""
    held = F.count_if(F.col("reason").isNull())
    return results.groupBy(key).agg(F.count("*").alias("constraints"), (held / F.count("*")).alias("score"))


def triangle_consistency(matrix: Column, tolerance: float = 1e-6) -> Column:
    """1 less the share of violated triangle inequalities of a square array of distances; 1 for fewer than three points.

    For chains of bounded length: one row's work grows with the cube of it.
    """
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")

    def share(m: Column) -> Column:
        n = F.size(m)

        def of_pair(i: Column, j: Column) -> Column:
            ks = F.when(j + 1 < n, F.sequence(j + 1, n - 1)).otherwise(F.array().cast("array<int>"))
            a = m[i][j]
            off = lambda k: ((a + m[i][k] + tolerance < m[j][k]).cast("int") + (a + m[j][k] + tolerance < m[i][k]).cast("int") + (m[i][k] + m[j][k] + tolerance < a).cast("int"))
            return F.aggregate(ks, F.lit(0).cast("long"), lambda s, k: s + off(k))

        rows = F.sequence(F.lit(0), n - 3)
        violated = F.aggregate(rows, F.lit(0).cast("long"), lambda s, i: F.aggregate(F.sequence(i + 1, n - 2), s, lambda t, j: t + of_pair(i, j)))
        return F.when(n < 3, 1.0).otherwise(1 - violated / (n.cast("double") * (n - 1) * (n - 2) / 2))

    return let(matrix, share)


def distance_matrix(points: Column) -> Column:
    """All distances of an array of coordinates, of one bounded chain."""
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return let(points, lambda p: F.transform(p, lambda a: F.transform(p, lambda b: F.sqrt(square(a, b)))))


def _alone(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Those of the starts whose windows don't occur in the rest, the two sides joined."""
    n = len(codes)
    # Again elsewhere: the first or the last equal window lies a width away or more.
    order = np.argsort(same := equal_windows(codes, width)[starts], kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
    group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(order))))
    first, last = starts[order[edge]], starts[order[np.append(edge[1:], len(order)) - 1]]
    good = np.zeros(len(starts), bool)
    good[order] = (first[group] > starts[order] - width) & (last[group] < starts[order] + width)
    starts = starts[good]
    # Again across the seam of both sides: k characters before the span and width - k behind it.
    for k in range(1, width):
        at = starts[(starts >= k) & (starts + 2 * width - k <= n)]
        for j in range(k):
            at = at[codes[at - k + j] == codes[at + j]]
        for j in range(width - k):
            at = at[codes[at + width + j] == codes[at + k + j]]
        if len(at):
            starts = np.setdiff1d(starts, at, assume_unique=True)
    return starts


def best_span(sequence: str, width: int, flank: int) -> tuple[int, float] | None:
    """Start and score of the best span of a sequence, of equals the first; None if there's none.

    All windows are scored, and the best are looked for in the rest; where the first ``TRIES`` of them all recur, windows
    that recur are found at once by a sort. So time is in proportion to the length, but for that sort.
    """
    codes = np.frombuffer(sequence.encode("utf-32-le"), np.uint32).astype(np.int64)
    n = len(codes)
    if n < width:
        return None
    # One bit for each standard residue; others have none.
    table = np.zeros(int(codes.max()) + 1, np.int32)
    for k, letter in enumerate(STANDARD):
        if ord(letter) < len(table):
            table[ord(letter)] = 1 << k
    bits = table[codes]
    odd = np.concatenate([[0], np.cumsum(bits == 0)])
    fit = odd[width:] == odd[:-width]
    if not fit.any():
        return None
    # Residues of a window, by windows of doubled widths.
    seen, size = bits, 1
    while size < width:
        step = min(size, width - size)
        seen, size = seen[:-step] | seen[step:], size + step
    variety = np.bitwise_count(seen) / float(min(20, width))
    change = np.concatenate([[True], codes[1:] != codes[:-1]])
    places = np.arange(n)
    kind = np.uint8 if width < 256 else np.int64
    since = np.minimum(places - np.maximum.accumulate(np.where(change, places, 0)) + 1, width).astype(kind)
    run = np.zeros(n - width + 1, kind)
    for k in range(width):
        np.maximum(run, np.minimum(since[k : n - width + 1 + k], kind(k + 1)), out=run)
    penalty = np.minimum(0.35, run / width * 0.7)
    starts = places[: n - width + 1]
    shares = 1.0 if not flank else (np.minimum(starts, flank) / float(flank) + np.minimum(n - starts - width, flank) / float(flank)) / 2
    central = 1.0 if n <= width else np.clip(1 - np.abs(starts + width / 2 - n / 2) / (n / 2), 0, 1)
    a, b, c = SPAN_WEIGHTS
    score = np.where(fit, np.clip(a * np.clip(variety, 0, 1) + b * shares + c * central - penalty, 0, 1), -1.0)
    left = score.copy()
    for _ in range(TRIES):
        at = int(np.argmax(left))
        if left[at] < 0:
            return None
        if sequence[at : at + width] not in sequence[:at] + sequence[at + width :]:
            return at, float(score[at])
        left[at] = -1.0
    starts = _alone(codes, np.flatnonzero(fit), width)
    if not len(starts):
        return None
    at = int(starts[np.argmax(score[starts])])
    return at, float(score[at])


def best_spans(rows: DataFrame, key: str, sequence: str, width: int, flank: int = 64) -> DataFrame:
    """(key, start, end, score): the best span of ``width`` residues of each sequence, of equals the first.

    A span has standard residues alone and doesn't occur in the rest, the two sides joined. Its score weighs the
    variety of residues, the flanks that are there and how central it is, less a penalty for runs. A sequence's spans are
    found in its own row, without a copy for each; sequences without a span have no row.
    """
    if width <= 0:
        raise ValueError("width must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_span(q.as_py(), width, flank) or (None, None) for q in batch.column(1)]
            starts = pa.array([f[0] for f in found], pa.int32())
            made = [batch.column(0), starts, pc.add(starts, width).cast(pa.int32()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(made, names=["key", "start", "end", "score"])

    kind = rows.schema[key].dataType.simpleString()
    fit = rows.select(key, compact(F.col(sequence)).alias("_q"))
    found = fit.mapInArrow(run, f"key {kind}, start int, end int, score double").where("start IS NOT NULL")
    return found.select(F.col("key").alias(key), "start", "end", "score")


def best_record(rows: DataFrame, key: str, order: str, sequence: str, mask_end: int) -> DataFrame:
    """The first row of each key in ``order`` that is longer than ``mask_end``, one of standard residues before others."""
    q = compact(F.col(sequence))
    fit = rows.where(F.length(q) > mask_end)
    rank = F.struct(q.rlike(f"[^{STANDARD}]").alias("odd"), F.col(order).alias("at"))
    rest = [c for c in rows.columns if c != key]
    return fit.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("_row")).select(key, "_row.*")
