"""Training metrics: lenient numbers, perplexity, summaries, best so far, smoothing, token accuracy, step budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import numbered
from .storage import stored


def lenient_number(text: Column, kind: str = "double") -> Column:
    """A number from text; ``nan``, ``none`` and blank are NaN (0 for whole numbers), as is what is no number."""
    plain = F.lower(F.trim(text.cast("string")))
    value = F.when(plain.isin("nan", "none", "null", ""), None).otherwise(plain).try_cast("double")
    return F.coalesce(value, F.lit(float("nan"))) if kind == "double" else F.coalesce(F.when(F.isnan(value), None).otherwise(value), F.lit(0.0)).cast(kind)


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def perplexity(loss: Column) -> Column:
    """exp(loss); NaN where the loss isn't finite or is above 50."""
    return F.when(finite(loss).isNull() | (loss > 50), F.lit(float("nan"))).otherwise(F.exp(loss))


def read_metrics(spark: SparkSession, path: str, schema: str, level: int = -1) -> DataFrame:
    """Rows of JSON Lines metric files with source and line, in which order they stand.

    The source is the file's name, or the name of a folder above it by ``level``.
    """
    rows = spark.read.text(path).select("value", F.element_at(F.split("_metadata.file_path", "/"), level).alias("source"), F.monotonically_increasing_id().alias("line"))
    parsed = rows.where("trim(value) <> ''").select(F.from_json("value", schema).alias("m"), "source", "line")
    return parsed.select("m.*", "source", "line")


def summary(rows: DataFrame, step: str, tokens: str, losses: list[str]) -> DataFrame:
    """One row: rows, first and last step, most tokens, the best finite value of each loss, and the sources in order."""
    best = [F.min(finite(F.col(c))).alias(f"best_{c}") for c in losses]
    return rows.agg(
        F.count("*").alias("rows"), F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.max(tokens).alias("tokens"),
        *best, F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


def mean_of_first(rows: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """(n, mean) of the first ``k`` values in order; the mean of none is NaN."""
    first = rows.select(value, order).orderBy(order).limit(k)
    return first.agg(F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(float("nan"))).alias("mean"))


def token_accuracy(rows: DataFrame, predicted: str, labels: str, loss: str, ignored: int = -100) -> DataFrame:
    """(tokens, hits, accuracy, mean_loss, perplexity) over arrays of predicted ids and labels; ignored labels don't count."""
    pairs = F.filter(F.arrays_zip(F.col(predicted).alias("p"), F.col(labels).alias("l")), lambda x: x["l"] != ignored)
    hits = F.size(F.filter(pairs, lambda x: x["p"] == x["l"]))
    each = rows.select(F.size(pairs).alias("n"), hits.alias("hits"), F.col(loss).alias("loss"))
    whole = each.agg(F.sum("n").alias("tokens"), F.sum("hits").alias("hits"), F.avg("loss").alias("mean_loss"))
    return whole.select("tokens", "hits", F.when(F.col("tokens") > 0, F.col("hits") / F.col("tokens")).alias("accuracy"), "mean_loss", perplexity(F.col("mean_loss")).alias("perplexity"))


def smoothed(rows: DataFrame, series: str, order: str, value: str, median: int = 21, mean: int = 7) -> DataFrame:
    """``rows`` (series, order, value) with ``smooth``: a centred moving median, then a centred moving mean.

    Windows that reach over an end are filled up with the value there; ``order`` is unique within a series. Steps are
    numbered over ranges, and each meets the steps of its window by their numbers, so a series of any length is spread
    over tasks.
    """
    n = rows.groupBy(series).agg(F.count("*").cast("long").alias("_n"))
    k = numbered(rows.select(series, order, F.col(value).cast("double").alias("_v")), [series], [order], "_k")
    a, b = k.alias("a"), n.alias("b")
    steps = stored(a.join(b, F.col(f"a.{series}").eqNullSafe(F.col(f"b.{series}"))).select(F.col(f"a.{series}").alias("_s"), order, "_k", "_n", "_v"), "steps")

    def window(source: DataFrame, width: int, of) -> DataFrame:
        """(_s, _k, _n, _v) with the value that ``of`` makes of each window's values, in order."""
        half = width // 2
        offsets = F.explode(F.sequence(F.lit(-half), F.lit(half)))
        asked = source.select("_s", "_k", "_n", offsets.alias("_o"))
        asked = asked.select("*", F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.col("_k") + F.col("_o"))).alias("_at"))
        held = source.select(F.col("_s").alias("_t"), F.col("_k").alias("_j"), "_v")
        met = asked.join(held, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_at") == F.col("_j")))
        gathered = met.groupBy("_s", "_k", "_n").agg(F.array_sort(F.collect_list(F.struct("_o", "_v"))).alias("w"))
        return gathered.select("_s", "_k", "_n", of(F.transform("w", lambda x: x["_v"])).alias("_v"))

    middle = window(steps.drop(order), median, lambda v: F.get(F.array_sort(v), F.lit(median // 2)))
    done = window(middle, mean, lambda v: F.aggregate(v, F.lit(0.0), lambda x, y: x + y) / mean)
    c, d = steps.select("_s", order, "_k").alias("c"), done.alias("d")
    smooth = c.join(d, F.col("c._s").eqNullSafe(F.col("d._s")) & (F.col("c._k") == F.col("d._k"))).select("c._s", f"c.{order}", F.col("d._v").alias("smooth"))
    e, f = rows.alias("e"), smooth.alias("f")
    on = F.col(f"e.{series}").eqNullSafe(F.col("f._s")) & F.col(f"e.{order}").eqNullSafe(F.col(f"f.{order}"))
    return e.join(f, on).select(*[F.col(f"e.{x}") for x in rows.columns], "smooth")


def steps_for(budget: Column, per_step: Column, least: int, most: int) -> Column:
    """How many steps a budget of tokens allows, within limits."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(budget / F.greatest(per_step, F.lit(1))))).cast("long")
