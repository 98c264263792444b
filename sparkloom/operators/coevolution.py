"""Mutual information between the columns of aligned sequences, with the average-product correction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: the letters of an alignment; others count as X.
ALIGNED = "ACDEFGHIKLMNPQRSTVWYX-"


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Non-empty cells (i, j, a, b, c) of the rows of each batch; letters are places in ``ALIGNED``."""
    place = np.full(256, ALIGNED.index("X"), np.int64)
    for k, letter in enumerate(ALIGNED.encode()):
        place[letter] = k
    k = len(ALIGNED)
    for batch in batches:
        rows = [x.as_py().encode("ascii", "replace") for x in batch.column(0)]
        coded = place[np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)]
        for i in range(coded.shape[1] - 1):
            rest = coded.shape[1] - i - 1
            cells = (np.arange(rest) * k * k + coded[:, i : i + 1] * k + coded[:, i + 1 :]).reshape(-1)
            counts = np.bincount(cells, minlength=rest * k * k)
            at = np.flatnonzero(counts)
            columns = (np.full(len(at), i), i + 1 + at // (k * k), at // k % k, at % k, counts[at])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "j", "a", "b", "c"])


def mutual_information(rows: DataFrame, sequence: str, pseudocount: float = 1e-3) -> DataFrame:
    """(i, j, score) of all pairs of columns i < j of equally long sequences, in nats.

    Tasks count the letters of each pair of columns over a batch of rows at once, so that what is shuffled are a batch's
    non-empty cells and not its rows' pairs. Cells that no row has weigh the pseudocount; their part of the sum is closed
    in form, from the logarithms of the margins, and no grid is filled up.
    """
    k = len(ALIGNED)
    upper = F.upper(F.regexp_replace(sequence, r"\s+", ""))
    letters = rows.select(upper.alias("s")).where(F.length("s") > 0)
    shortest, longest = letters.agg(F.min(F.length("s")), F.max(F.length("s"))).first()
    if shortest != longest:
        raise ValueError(f"aligned sequences must be of one length; there are {shortest} and {longest}")
    joint = (
        letters
        .mapInArrow(_pair_counts, "i long, j long, a long, b long, c long")
        .groupBy(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "a", "b").agg(F.sum("c").alias("c"))
    )

    of_pair = W.partitionBy("i", "j")
    n = F.sum("c").over(of_pair)
    share = lambda c, cells: (c + F.lit(pseudocount)) / (F.col("n") + F.lit(pseudocount * cells))
    counted = joint.select(
        "*",
        n.alias("n"),
        F.sum("c").over(W.partitionBy("i", "j", "a")).alias("ca"),
        F.sum("c").over(W.partitionBy("i", "j", "b")).alias("cb"),
        F.row_number().over(W.partitionBy("i", "j", "a").orderBy("b")).alias("nth_a"),
        F.row_number().over(W.partitionBy("i", "j", "b").orderBy("a")).alias("nth_b"),
    )
    logs = counted.select(
        "i",
        "j",
        "n",
        share(F.col("c"), k * k).alias("p"),
        F.log(share(F.col("ca"), k)).alias("la"),
        F.log(share(F.col("cb"), k)).alias("lb"),
        (F.col("nth_a") == 1).alias("new_a"),
        (F.col("nth_b") == 1).alias("new_b"),
    )
    # Logarithms of a margin over all letters: those seen, and the rest at the pseudocount alone.
    once = lambda log, new: F.sum(F.when(F.col(new), F.col(log)).otherwise(0.0))
    sums = logs.groupBy("i", "j").agg(
        F.first("n").alias("n"),
        F.count("*").alias("seen"),
        F.sum(F.col("p") * (F.log("p") - F.col("la") - F.col("lb"))).alias("of_seen"),
        F.sum(F.col("la") + F.col("lb")).alias("logs_of_seen"),
        (once("la", "new_a") + once("lb", "new_b")).alias("logs"),
        (2 * k - F.count_if("new_a") - F.count_if("new_b")).alias("absent"),
    )
    least, alone = share(F.lit(0.0), k * k), F.log(share(F.lit(0.0), k))
    margins = F.lit(k) * (F.col("logs") + F.col("absent") * alone) - F.col("logs_of_seen")
    unseen = least * ((F.lit(k * k) - F.col("seen")) * F.log(least) - margins)
    return sums.select("i", "j", (F.col("of_seen") + unseen).alias("score"))


def corrected(scores: DataFrame, length: int) -> DataFrame:
    """(i, j, score) less the product of the means of both columns over the whole mean; means count the empty diagonal.

    The table has a row for each pair of columns, whatever the number of sequences.
    """
    both = scores.select("i", "score").unionByName(scores.select(F.col("j").alias("i"), "score"))
    mean = both.groupBy("i").agg((F.sum("score") / F.lit(float(length))).alias("m"))
    whole = scores.agg((2 * F.sum("score") / F.lit(float(length * length))).alias("all"))
    a, b = mean.select("i", F.col("m").alias("mi")), mean.select(F.col("i").alias("j"), F.col("m").alias("mj"))
    joined = scores.join(a, "i").join(b, "j").join(F.broadcast(whole), F.lit(True))
    less = F.when(F.col("all") == 0, F.col("score")).otherwise(F.col("score") - F.col("mi") * F.col("mj") / F.col("all"))
    return joined.select("i", "j", less.alias("score"))


def top_pairs(scores: DataFrame, k: int = 32, separation: int = 5) -> DataFrame:
    """The ``k`` highest (i, j, score) of columns that lie ``separation`` or more apart, of equals the first."""
    if k <= 0 or separation < 0:
        raise ValueError("k must be positive and the separation not negative")
    return scores.where(F.col("j") - F.col("i") >= separation).orderBy(F.desc("score"), "i", "j").limit(k)


def contact_constraints(pairs: DataFrame, max_distance: float = 8.0) -> DataFrame:
    """(i, j, min_distance, max_distance, score): pairs as limits on the distances of a structure's points."""
    return pairs.select("i", "j", F.lit(None).cast("double").alias("min_distance"), F.lit(max_distance).alias("max_distance"), "score")
