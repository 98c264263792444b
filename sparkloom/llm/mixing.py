"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in columns alone.

Sources share the words of the corpus by their weights. A target stops at ``epochs`` times its source's size, and the
excess is shared among the others by weight until none is above; in closed form: with sources by size / weight, those
that stop are the first, so sums over the earlier sources tell for each whether it stops. A target is filled by complete
epochs of its source, then by a sample: each document has the key ``-ln(u) / quality``, with ``u`` hashed from its id, and
documents are taken by ascending key until the running sum of their sizes reaches what is left. Of the last of them only
the words that are still missing are taken, so that a source's words are its target, rounded to a whole number.

Keys sort over ranges of (source, key), so that a source may hold any share of the rows; sums over sources are aggregated
before they are shuffled.

Defined cases: a null text or size has no words, and nothing is taken of it; a null source is a source of its own, last by
order; a null, zero or negative quality counts as the least; documents that tie in their key are taken by id, then by a
hash of the whole row; repeated rows are taken each on its own; an empty table, or one without a word, gives nothing
taken; texts of any length are counted whole; further columns pass through, and new ones take free names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered, running_sums
from .common import WORD, free_name, read_table, row_hash, stored

EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 7
LEAST_QUALITY = 1e-6
#: Of labelled documents by label, and of the others.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size); sources by code point, null last, weigh ``weights`` in turn."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("null", F.col("source").isNull())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    exact = "decimal(38,0)"
    weighed = numbered(sums, [], ["null", "source"]).select(
        "*", weight.cast(exact).alias("w"), (F.col("source_size") * epochs).cast(exact).alias("cap")
    )
    ordered = weighed.withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double"))
    summed = running_sums(ordered, [], ["ratio", "null", "source"], {"caps": "cap", "ws": "w"})
    summed = stored(summed.select("source", "source_size", "w", "cap", "caps", "ws"), "mix-sources")
    size, all_w = summed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    number = lambda x: F.lit(str(x)).cast("decimal(19,0)")
    stops = F.col("cap") * (number(all_w) - F.col("ws")) <= F.col("w") * (number(size) - F.col("caps"))
    zero = F.lit(0).cast(exact)
    stopped_cap, stopped_w = summed.where(stops).agg(F.coalesce(F.sum("cap"), zero), F.coalesce(F.sum("w"), zero)).first()
    left_w = float(int(all_w) - int(stopped_w))
    share = float(int(size) - int(stopped_cap)) / left_w if left_w else 0.0
    target = F.when(stops, F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * F.lit(share))
    return summed.select("source", "source_size", target.alias("target"))


def mixed(
    df: DataFrame, key: str, source: str, size: str, quality: str, weights: tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """``df``, which has the words of each document in ``size``, with a struct column ``mix``.

    Its fields are size, source_size, target and taken, all in words. Texts are best left out: rows are shuffled.
    """
    own, column = [f"own{k}" for k in range(len(df.columns))], lambda c: F.col(f"`{c}`")
    at = dict(zip(df.columns, own, strict=True))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column(key).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    weight = F.greatest(F.coalesce(column(quality).cast("double"), F.lit(LEAST_QUALITY)), F.lit(LEAST_QUALITY))
    table = stored(
        df.select(
            *[column(c).alias(o) for c, o in at.items()], column(source).alias("source"),
            F.coalesce(column(size).cast("long"), F.lit(0)).alias("size"), (-F.log(u) / weight).alias("key"), row_hash(df, "mix").alias("row"),
        ),
        "mix-sizes",
    )
    targets = source_targets(table, weights, epochs)
    # Equal rows tie to the end; a number of its own for each lets a range boundary fall between them.
    keyed = table.withColumn("place", F.monotonically_increasing_id())
    summed = running_sums(keyed, ["source"], ["key", at[key], "row", "place"], {"before": "size"})
    a, b = summed.alias("a"), targets.alias("b")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before")))
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")))
    mix = F.struct(F.col("size"), F.col("source_size"), F.col("target"), taken.alias("taken"))
    return joined.select(*[F.col(f"a.{o}").alias(c) for c, o in at.items()], mix.alias(free_name(df, "mix")))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document; labelled quality scales the keys."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    labels = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    quality = F.when(F.col("label") == 1, GOOD).when(F.col("label") == 0, BAD).otherwise(UNKNOWN)
    weighed = docs.join(labels, "doc_id", "left").select("doc_id", "source", "size", quality.alias("quality"))
    done = mixed(weighed, "doc_id", "source", "size", "quality")
    return done.select("doc_id", "source", *[F.col("mix")[c].alias(c) for c in ("size", "source_size", "target", "taken")])


SQL = f"""
WITH q AS (SELECT doc_id, max(quality) AS label FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    -ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r})
        / CASE label WHEN 1 THEN {GOOD} WHEN 0 THEN {BAD} ELSE {UNKNOWN} END AS key
    FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::HUGEINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
c AS (SELECT *, {EPOCHS} * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS ws FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS before FROM c
    WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * (ws - before) <= w * (total - caps) AS stops FROM r),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE w::DOUBLE * ((total
    - coalesce(sum(cap) FILTER (WHERE stops) OVER (), 0))::DOUBLE / (ws - coalesce(sum(w) FILTER (WHERE stops) OVER (), 0))::DOUBLE) END AS target FROM f),
b AS (SELECT *, floor(target + 0.5)::HUGEINT AS budget FROM t),
k AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole, budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size::BIGINT AS source_size, target,
    (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken FROM k
"""
