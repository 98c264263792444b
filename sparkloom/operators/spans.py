"""Span completion: training rows from which a stretch of a sequence is masked out, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STANDARD, let

# The policies in the order in which examples take turns.
POLICIES = ("random_span", "n_terminal_span", "c_terminal_span")


def draw(*parts: Column) -> Column:
    """A stable number below 2^32 from the md5 of the parts; the same in any order of rows and after a retry."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def span_examples(
    rows: DataFrame,
    key: str,
    sequence: str,
    examples: int = 4,
    shortest: int = 64,
    longest: int = 1024,
    mask: tuple[int, int] = (8, 64),
    flank: int = 64,
    attempts: int = 32,
) -> DataFrame:
    """Up to ``examples`` masked spans of each sequence of ``shortest`` to ``longest`` residues, policies in turn.

    ``key`` is unique. Columns: key, example, policy, mask_start, mask_end, left_flank, target, right_flank, partial.
    An example takes the first of its attempts whose target has standard residues only, isn't found in the rest of the
    sequence and isn't the span of an earlier example of its policy; an example without one is left out. All of it is
    work on one row, so nothing is shuffled. Sequences of other lengths have no examples; ``span_skips`` counts them.
    """
    q, n = F.col("_q"), F.length("_q")
    fit = rows.select(F.col(key), F.upper(F.regexp_replace(sequence, r"(?U)\s+", "")).alias("_q")).where(n.between(shortest, longest))
    spread = F.lit(max(1, mask[1] - mask[0] + 1))
    policy_of = lambda e: F.element_at(F.array(*map(F.lit, POLICIES)), e % len(POLICIES) + 1)

    def attempt(e: Column, t: Column) -> Column:
        width = F.least(mask[0] + F.pmod(draw(F.col(key), e, t, F.lit("n")), spread), n - 1).cast("int")

        def placed(w: Column) -> Column:
            free = F.pmod(draw(F.col(key), e, t, F.lit("at")), n - w + 1)
            at = F.when(policy_of(e) == POLICIES[0], free).when(policy_of(e) == POLICIES[1], F.lit(0)).otherwise(n - w)
            return F.struct(at.cast("int").alias("at"), w.alias("w"))

        return let(width, placed)

    def good(s: Column) -> Column:
        target = F.substr(q, s["at"] + 1, s["w"])
        before, after = F.substr(q, F.lit(1), s["at"]), F.substr(q, s["at"] + s["w"] + 1)
        return ~target.rlike(f"[^{STANDARD}]") & ~F.contains(before, target) & ~F.contains(after, target)

    def take(chosen: Column, e: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda t: attempt(e, t))
        used = lambda s: F.exists(chosen, lambda c: (c["policy"] == policy_of(e)) & (c["at"] == s["at"]) & (c["w"] == s["w"]))
        first = F.try_element_at(F.filter(tries, lambda s: good(s) & ~used(s)), F.lit(1))
        made = lambda s: F.struct(e.alias("example"), policy_of(e).alias("policy"), s["at"].alias("at"), s["w"].alias("w"))
        return let(first, lambda s: F.when(s.isNull(), chosen).otherwise(F.array_append(chosen, made(s))))

    none = F.array().cast("array<struct<example:int,policy:string,at:int,w:int>>")
    spans = fit.select(key, "_q", F.explode(F.aggregate(F.sequence(F.lit(0), F.lit(examples - 1)), none, take)).alias("s")).select(key, "_q", "s.*")
    at, end = F.col("at"), F.col("at") + F.col("w")
    before, after = F.substr(q, F.lit(1), at), F.substr(q, end + 1)
    partial = F.concat(before, F.lit("<MASK_"), F.col("w").cast("string"), F.lit(">"), after)
    return spans.select(
        key, "example", "policy", at.alias("mask_start"), end.alias("mask_end"),
        F.when(at > flank, F.substr(before, at - flank + 1)).otherwise(before).alias("left_flank"), F.substr(q, at + 1, F.col("w")).alias("target"),
        F.substr(after, F.lit(1), F.lit(flank)).alias("right_flank"), partial.alias("partial"),
    )


def span_skips(rows: DataFrame, sequence: str, shortest: int = 64, longest: int = 1024) -> DataFrame:
    """(reason, n): how many sequences are too_short, too_long, or fitting."""
    n = F.length(F.regexp_replace(F.coalesce(sequence, F.lit("")), r"(?U)\s+", ""))
    reason = F.when(n < shortest, "too_short").when(n > longest, "too_long").otherwise("fitting")
    return rows.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def span_faults(rows: DataFrame) -> DataFrame:
    """``rows`` of ``span_examples`` with ``faults``, the names of the invariants that a row breaks."""
    width, mark = F.col("mask_end") - F.col("mask_start"), F.lit(r"<MASK_(\d+)>")
    marks = F.regexp_extract_all("partial", mark, F.lit(1))
    around = F.split("partial", r"<MASK_\d+>")
    checks = {
        "mask_length": F.length("target") != width,
        "one_mask": (F.size(marks) != 1) | (F.try_element_at(marks, F.lit(1)) != width.cast("string")),
        "left_flank": ~F.endswith(around[0], F.col("left_flank")),
        "right_flank": ~F.startswith(around[1], F.col("right_flank")),
        "leak": F.contains(F.col("partial"), F.col("target")),
        "alphabet": F.col("target").rlike(f"[^{STANDARD}]"),
        "policy": ~F.col("policy").isin(*POLICIES),
    }
    return rows.withColumn("faults", F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in checks.items()])))
