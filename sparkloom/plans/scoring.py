"""Queries that score, choose and rank: candidates, contacts, spans, retrieval, token rows, logits, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates, fused, metrics, retrieval
from .queries import NORMAL
from .registry import query, table

LIMITS = candidates.Limits(min_length=200, max_length=4000, max_x_fraction=0.1, min_confidence=0.3, min_plddt=40.0, min_triangle_consistency=0.6)

CANDIDATES = rf"""WITH s AS (SELECT doc_id, upper(regexp_replace(replace(coalesce(text, ''), 'ß', 'ss'), '\s+', '', 'g')) AS q, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS confidence,
(doc_id % 101)::DOUBLE AS plddt, doc_id % 4 <> 3 AS has_prediction, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 7) / 6.0::DOUBLE END AS geometry FROM documents),
n AS (SELECT *, length(q) AS n, length(regexp_replace(q, '[^{T.PROTEIN}]', '', 'g')) AS good, length(q) - length(replace(q, 'X', '')) AS x FROM s),
p AS (SELECT *, CASE WHEN n = 0 THEN 0::DOUBLE ELSE good / n::DOUBLE END AS validity, CASE WHEN n = 0 THEN 0::DOUBLE WHEN n < 200 THEN n / 200.0::DOUBLE WHEN n > 4000 THEN 4000.0::DOUBLE / n ELSE 1::DOUBLE END AS length_score,
CASE WHEN n = 0 THEN 0::DOUBLE ELSE 1 - x / n::DOUBLE END AS ambiguity,
CASE WHEN has_prediction THEN CASE WHEN coalesce(confidence, plddt) > 1 THEN least(1, coalesce(confidence, plddt) / 100) ELSE coalesce(confidence, plddt) END ELSE 0 END AS model FROM n)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("sequence"), F.when(i % 5 != 0, (i % 10) / 10.0).alias("confidence"), (i % 101).cast("double").alias("plddt"),
        F.lit(None).cast("double").alias("ptm"), F.lit(None).cast("double").alias("iptm"), (i % 4 != 3).alias("has_prediction"), F.when(i % 3 != 0, (i % 7) / 6.0).alias("geometry"),
    )


@query(CANDIDATES + """, v AS (SELECT *, has_prediction AND geometry IS NOT NULL AS checked FROM p), l AS (SELECT *, list_filter([validity, length_score, ambiguity, model, CASE WHEN checked THEN geometry ELSE 0 END], lambda z: z > 0) AS parts FROM v)
SELECT doc_id, round(CASE WHEN len(parts) = 0 THEN 0 ELSE list_sum(parts) / len(parts) END, 6) AS score, array_to_string(list_filter([CASE WHEN n = 0 THEN 'empty_sequence' END, CASE WHEN n > 0 AND validity < 1 THEN 'invalid_amino_acid' END,
CASE WHEN n > 0 AND length_score < 1 THEN 'length_outside_window' END, CASE WHEN n > 0 AND x / n::DOUBLE > 0.1::DOUBLE THEN 'too_many_x' END, CASE WHEN NOT has_prediction THEN 'missing_structure_provider' END,
CASE WHEN has_prediction AND coalesce(confidence, 0) < 0.3::DOUBLE THEN 'low_confidence' END, CASE WHEN has_prediction AND plddt < 40 THEN 'low_plddt' END, CASE WHEN checked AND geometry < 0.6::DOUBLE THEN 'low_triangle_consistency' END],
lambda z: z IS NOT NULL), ',') AS reasons FROM l""")
def validated_candidates(spark, sf_dir):
    """Sequences with predicted metrics: composite score and what speaks against each."""
    rows = candidates.validated(_candidates(spark, sf_dir), LIMITS, geometry="geometry")
    return rows.select("doc_id", F.round("validation.score", 6).alias("score"), F.array_join("validation.reasons", ",").alias("reasons"))


@query(CANDIDATES + """ SELECT doc_id, round(0.2::DOUBLE * validity + 0.1::DOUBLE * length_score + 0.1::DOUBLE * ambiguity + 0.3::DOUBLE * model + 0.2::DOUBLE * coalesce(geometry, 0) + 0.1::DOUBLE * (doc_id % 3) / 2, 6) AS score
FROM p ORDER BY score DESC, doc_id LIMIT 100""")
def ranked_candidates(spark, sf_dir):
    """The 100 best by the six-part score, the first of equals."""
    model = F.when(F.col("has_prediction"), candidates.best_confidence(*map(F.col, candidates.METRICS))).otherwise(0.0)
    score = candidates.weighted_score(F.col("sequence"), model, F.col("geometry"), (F.col("doc_id") % 3) / 2, LIMITS)
    return _candidates(spark, sf_dir).select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(100)


RUNS = "|".join(f"{x}+" for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@query(rf"""WITH s AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', '', 'g')) AS q FROM documents),
c AS (SELECT *, length(q) AS n, coalesce(list_max(list_transform(regexp_extract_all(q, '{RUNS}'), lambda z: length(z))), 0) AS run, coalesce(list_max(list_transform(regexp_extract_all(q, '[AILMFWVY]+'), lambda z: length(z))), 0) AS hydro,
list_max(list_transform(string_split('{T.STANDARD}', ''), lambda z: length(q) - length(replace(q, z, '')))) AS most, substr(q, 1, 30) AS a, right(q, 30) AS b FROM s)
SELECT doc_id, array_to_string(list_filter([CASE WHEN q = '' OR regexp_matches(q, '[^{T.STANDARD}]') THEN 'alphabet' END, CASE WHEN n NOT BETWEEN 100 AND 220 THEN 'length' END, CASE WHEN run > 12 THEN 'single_residue_run' END,
CASE WHEN q <> '' AND most > 0.35::DOUBLE * n THEN 'residue_share' END, CASE WHEN hydro > 10 THEN 'hydrophobic_run' END, CASE WHEN n > 0 AND length(regexp_replace(a, '[^AILMFWVY]', '', 'g')) / length(a)::DOUBLE >= 0.4::DOUBLE THEN 'hydrophobic_start' END,
CASE WHEN n > 0 AND length(regexp_replace(b, '[^AILMFWVY]', '', 'g')) / length(b)::DOUBLE >= 0.4::DOUBLE THEN 'hydrophobic_end' END], lambda z: z IS NOT NULL), ',') AS reasons FROM c""")
def reject_reasons(spark, sf_dir):
    """All that speaks against the letters of each document as a sequence."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(candidates.reject_reasons(letters), ",").alias("reasons"))


CHAINS = """WITH e AS (SELECT label AS chain, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT - 1 AS i, list_transform(embedding, lambda z: z::DOUBLE) AS xyz FROM embeddings),
q AS (SELECT chain, i, i + 1 + i % 3 AS j FROM e), d AS (SELECT q.chain, q.i, q.j, sqrt(list_sum(list_transform(list_zip(a.xyz, b.xyz), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance
FROM q JOIN e a ON a.chain = q.chain AND a.i = q.i LEFT JOIN e b ON b.chain = q.chain AND b.i = q.j)"""


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of chains, numbered in order, and the distances of asked pairs."""
    from ..operators.ordered import numbered

    points = numbered(table(spark, sf_dir, "embeddings").select(F.col("label").alias("chain"), "vec_id", "embedding"), ["chain"], ["vec_id"], "i")
    xyz = F.transform("embedding", lambda z: z.cast("double"))
    points = points.select("chain", F.col("i").cast("int").alias("i"), xyz.alias("xyz"))
    pairs = points.select("chain", "i", (F.col("i") + 1 + F.col("i") % 3).alias("j"))
    return candidates.distances(points, pairs, "chain")


@query(CHAINS + """, r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY i, j) AS rank FROM d WHERE distance IS NOT NULL)
SELECT chain, count(*) AS selected, round(count(*) FILTER (WHERE distance <= 1.4::DOUBLE) / count(*)::DOUBLE, 6) AS precision FROM r WHERE rank <= 10 GROUP BY 1""")
def contact_precision(spark, sf_dir):
    """How many of the first ten asked pairs of each chain are in contact."""
    place = F.row_number().over(W.partitionBy("chain").orderBy("i", "j"))  # the ten first of a chain are kept in each task
    ranked = _contacts(spark, sf_dir).where("distance IS NOT NULL").withColumn("rank", place)
    return candidates.contact_precision(ranked, "chain", 10, 1.4).select("chain", "selected", F.round("precision", 6).alias("precision"))


@query(CHAINS + """ SELECT chain, i, j, CASE WHEN distance IS NULL THEN 'constraint_index_out_of_bounds(' || i || ',' || j || ')' WHEN distance > 1.45::DOUBLE OR (i % 2 = 0 AND distance < 1.3::DOUBLE) THEN 'contact_violated(' || i || ',' || j || ',dist=' || printf('%.2f', distance) || ')' END AS reason FROM d""")
def contact_constraints(spark, sf_dir):
    """Limits on distances of pairs, and why they don't hold."""
    limits = _contacts(spark, sf_dir).withColumns({"max_distance": F.lit(1.45), "min_distance": F.when(F.col("i") % 2 == 0, 1.3)})
    return candidates.constraint_results(limits).select("chain", "i", "j", "reason")


@query("""WITH p AS (SELECT vec_id, unnest(range(0, 16))::INT AS k, embedding FROM embeddings), x AS (SELECT vec_id, k, list_transform(embedding[(4 * k + 1)::INT:(4 * k + 4)::INT], lambda z: z::DOUBLE) AS xyz FROM p),
d AS (SELECT a.vec_id, a.k AS i, b.k AS j, CASE WHEN a.k = 0 AND b.k = 3 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END * sqrt(list_sum(list_transform(list_zip(a.xyz, b.xyz), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM x a JOIN x b USING (vec_id)),
t AS (SELECT u.vec_id, u.d AS ij, v.d AS ik, w.d AS jk FROM d u JOIN d v ON u.vec_id = v.vec_id AND u.i = v.i AND u.i < u.j AND u.j < v.j JOIN d w ON w.vec_id = u.vec_id AND w.i = u.j AND w.j = v.j)
SELECT vec_id, round(1 - sum((ij + ik + 1e-6::DOUBLE < jk)::INT + (ij + jk + 1e-6::DOUBLE < ik)::INT + (ik + jk + 1e-6::DOUBLE < ij)::INT) / (3 * count(*))::DOUBLE, 6) AS consistency FROM t GROUP BY 1""")
def triangle_scores(spark, sf_dir):
    """Triangle consistency of each vector as sixteen points; one entry of the matrix is stretched, so that it can fail."""
    rows = table(spark, sf_dir, "embeddings")
    points = F.array(*[F.transform(F.slice("embedding", 4 * k + 1, 4), lambda z: z.cast("double")) for k in range(16)])
    stretched = F.transform(candidates.distance_matrix(points), lambda r, i: F.transform(r, lambda v, j: F.when((i == 0) & (j == 3), v * 3).otherwise(v)))
    return rows.select("vec_id", F.round(candidates.triangle_consistency(stretched), 6).alias("consistency"))


@query(rf"""WITH s AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', '', 'g')) AS q FROM documents),
c AS (SELECT doc_id, q, length(q) AS n, unnest(range(0, length(q) - 11))::INT AS st FROM s WHERE length(q) >= 12),
g AS (SELECT *, substr(q, st + 1, 12) AS span FROM c WHERE NOT regexp_matches(substr(q, st + 1, 12), '[^{T.STANDARD}]') AND NOT contains(substr(q, 1, st) || substr(q, st + 13), substr(q, st + 1, 12))),
v AS (SELECT *, len(list_distinct(string_split(span, ''))) / 12.0::DOUBLE AS variety, (least(20, st) / 20.0::DOUBLE + least(20, n - st - 12) / 20.0::DOUBLE) / 2 AS flank,
CASE WHEN n <= 12 THEN 1::DOUBLE ELSE 1 - abs(st + 6 - n / 2.0::DOUBLE) / (n / 2.0::DOUBLE) END AS central, least(0.35::DOUBLE, list_max(list_transform(regexp_extract_all(span, '{RUNS}'), lambda z: length(z))) / 12.0::DOUBLE * 0.7::DOUBLE) AS penalty FROM g),
w AS (SELECT *, greatest(0, least(1, 0.42::DOUBLE * variety + 0.34::DOUBLE * flank + 0.24::DOUBLE * central - penalty)) AS score FROM v)
SELECT doc_id, round(max(score), 6) AS score, count(*) > 0 AS found FROM w GROUP BY 1""")
def best_spans(spark, sf_dir):
    """The score of the best span of twelve residues in the letters of each document."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", ""))
    rows = table(spark, sf_dir, "documents").select("doc_id", letters.alias("q"))
    found = candidates.best_spans(rows, "doc_id", "q", 12, 20)
    return found.select("doc_id", F.round("score", 6).alias("score"), (F.col("end") - F.col("start") == 12).alias("found"))


SYNONYMS = {"the": ("der", "la"), "and": ("und",)}


@query("""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark),
x AS (SELECT item_id, t, list_filter(list_distinct(list_concat(t, CASE WHEN list_contains(t, 'the') THEN ['der', 'la'] ELSE [] END, CASE WHEN list_contains(t, 'and') THEN ['und'] ELSE [] END)), lambda z: length(z) > 1) AS terms,
list_concat(list_transform(range(1, len(t)), lambda k: array_to_string(t[k:k + 1], ' ')), list_transform(range(1, len(t) - 1), lambda k: array_to_string(t[k:k + 2], ' '))) AS phrases FROM i),
d AS (SELECT doc_id, list_distinct(t) AS terms, array_to_string(t, ' ') AS plain, special FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t, ((coalesce(trim(lang), '') <> '')::INT + (coalesce(trim(source), '') <> '')::INT) / 2.0::DOUBLE AS special FROM documents)),
s AS (SELECT item_id, doc_id, 0.52::DOUBLE * CASE WHEN len(x.terms) * len(d.terms) = 0 THEN 0 ELSE len(list_intersect(d.terms, x.terms)) / sqrt(len(x.terms)::DOUBLE * len(d.terms)) END
+ 0.18::DOUBLE * CASE WHEN len(phrases) = 0 OR plain = '' THEN 0 ELSE len(list_filter(phrases, lambda p: contains(plain, p))) / len(phrases)::DOUBLE END + 0.12::DOUBLE * special AS score FROM x, d),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def ranked_documents(spark, sf_dir):
    """The three best documents for every benchmark item, by terms, phrases and filled fields."""
    queries, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = retrieval.ranked(queries, docs, "item_id", "doc_id", 3, filled=("lang", "source"), synonyms=SYNONYMS)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark)
SELECT item_id, count(*) AS shared FROM t WHERE w IN ('the', 'and', 'of', 'in', 'for', 'with') GROUP BY 1 HAVING count(*) >= 2 ORDER BY shared DESC, item_id LIMIT 4""")
def best_skills(spark, sf_dir):
    """The four items that share most terms with a question."""
    found = retrieval.best_skills(table(spark, sf_dir, "benchmark"), "text", "item_id", "the and of in for with")
    return found.select("item_id", F.col("shared").cast("long").alias("shared"))


@query("""WITH g AS (SELECT item_id, i, substr(lower(text), i, 3) AS kmer FROM (SELECT item_id, text, unnest(range(1, length(text) - 1)) AS i FROM benchmark)),
f AS (SELECT kmer, min(item_id * 1000000 + i) AS place FROM g GROUP BY 1) SELECT kmer, (3 + row_number() OVER (ORDER BY place))::INT AS id FROM f""")
def kmer_vocabulary(spark, sf_dir):
    """3-mers of the benchmark, numbered in order of first places."""
    return fused.kmer_vocabulary(table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("t")), "t", "item_id", 3)


@query("SELECT item_id, length(text)::INT AS n_ids, lower(text) AS merged FROM benchmark")
def kmer_round_trip(spark, sf_dir):
    """Benchmark items as ids of 3-mers, and merged back from them."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("t"))
    vocabulary = fused.kmer_vocabulary(items, "t", "item_id", 3)
    ids = fused.kmer_codes(items, "t", "item_id", vocabulary, 3)
    each = ids.select("item_id", F.posexplode(fused.trimmed(F.col("ids"))).alias("at", "id")).join(vocabulary, "id")
    back = each.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "kmer"))).alias("s"))
    merged = fused.merged_kmers(F.transform("s", lambda s: s["kmer"]), 3)
    return ids.select("item_id", F.size("ids").alias("n_ids")).join(back.select("item_id", merged.alias("merged")), "item_id")


LAYOUT = fused.Layout(300, 200)


@query("""WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda z: length(z) + 3) AS s, length(role) + 4 AS p FROM conversations)
SELECT conv_id, turn, (len(s) + 4)::INT AS length, 2 AS separator_at, 3 AS sequence_start, (3 + len(s))::INT AS sequence_end, (1 + 300 + p + 500 + coalesce(list_sum(s), 0) + 2)::BIGINT AS id_sum, (len(s) + 1)::INT AS supervised FROM t""")
def fused_rows(spark, sf_dir):
    """Roles and texts as one row of ids each, with the labels that count."""
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1)), lambda z: F.length(z) + 3)
    whole = F.concat(F.array(F.lit(fused.BOS)), words, F.array(F.lit(fused.EOS)))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", fused.fused(F.array(F.length("role") + 4), whole, LAYOUT).alias("f"))
    labels = fused.causal_labels(F.col("f"))
    total = F.aggregate("f.ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "conv_id", "turn", F.size("f.ids").alias("length"), "f.separator_at", "f.sequence_start", "f.sequence_end", total.alias("id_sum"),
        F.size(F.filter(labels, lambda x: x != -100)).alias("supervised"),
    )


LOGITS = """WITH x AS (SELECT vec_id, unnest(range(0, len(embedding)))::INT AS i, unnest(embedding)::DOUBLE * 10 AS l FROM embeddings),
p AS (SELECT vec_id, i, CASE WHEN i % 4 = vec_id % 4 THEN CASE WHEN l > 0 THEN l / 1.2::DOUBLE ELSE l * 1.2::DOUBLE END ELSE l END AS l FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, i) AS r FROM p), t AS (SELECT * FROM k WHERE r <= 8),
e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY vec_id)) AS e FROM t), q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS q FROM e),
c AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY vec_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)"""


def _logits() -> tuple[Column, Column]:
    logits = F.transform("embedding", lambda z: z.cast("double") * 10)
    seen = F.filter(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i % 4 == F.col("vec_id") % 4)
    return logits, seen


@query(LOGITS + " SELECT vec_id, count(*) FILTER (WHERE before < 0.8::DOUBLE)::INT AS kept, min(i) FILTER (WHERE r = 1)::INT AS best FROM c GROUP BY 1")
def logit_filters(spark, sf_dir):
    """Repetition penalty, the eight largest values, then those that first reach 0.8 of the probability."""
    logits, seen = _logits()
    shaped = fused.top_p(fused.top_k(fused.penalised(logits, seen, 1.2), 8), 0.8)
    kept = F.size(F.filter(shaped, lambda x: x > F.lit(fused.LOW)))
    best = fused.greedy(logits, seen, 1.2)
    return table(spark, sf_dir, "embeddings").select("vec_id", kept.alias("kept"), best.alias("best"))


@query(LOGITS + """, m AS (SELECT vec_id, i, r, q / sum(q) OVER (PARTITION BY vec_id) AS q FROM c WHERE before < 0.8::DOUBLE), s AS (SELECT *, sum(q) OVER (PARTITION BY vec_id ORDER BY i) AS upto FROM m)
SELECT vec_id, min(i)::INT AS token FROM s WHERE upto > (vec_id % 10) / 10.0::DOUBLE GROUP BY 1""")
def drawn_tokens(spark, sf_dir):
    """The next token by a draw from what the filters leave."""
    logits, seen = _logits()
    found = fused.with_next_token(table(spark, sf_dir, "embeddings"), logits, seen, (F.col("vec_id") % 10) / 10.0, 1.2, 1.0, 8, 0.8)
    return found.select("vec_id", "token")


@query("""WITH d AS (SELECT event_type AS series, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY h)::INT AS k, count(*) OVER (PARTITION BY series)::INT AS n FROM d),
o AS (SELECT unnest(range(-10, 11))::INT AS o), m AS (SELECT a.series, a.k, a.n, list_sort(list(b.v))[11] AS m FROM k a CROSS JOIN o JOIN k b ON b.series = a.series AND b.k = greatest(1, least(a.n, a.k + o)) GROUP BY 1, 2, 3),
p AS (SELECT unnest(range(-3, 4))::INT AS o) SELECT a.series, a.k, round(avg(b.m), 6) AS smooth FROM m a CROSS JOIN p JOIN m b ON b.series = a.series AND b.k = greatest(1, least(a.n, a.k + o)) GROUP BY 1, 2""")
def smoothed_metrics(spark, sf_dir):
    """Hourly means of each event type, by a moving median of 21 and a moving mean of 7, ends filled up."""
    hourly = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))
    rows = metrics.smoothed(hourly, "series", "h", "v").withColumn("k", F.row_number().over(W.partitionBy("series").orderBy("h")))
    return rows.select("series", "k", F.round("smooth", 6).alias("smooth"))


@query("""WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda z: length(z)) AS l FROM conversations),
u AS (SELECT len(list_filter(l, lambda z: z <> 3)) AS n, len(list_filter(l, lambda z: z <> 3 AND z % 4 = 0)) AS hits, (turn % 5)::DOUBLE AS loss FROM t)
SELECT sum(n)::BIGINT AS tokens, sum(hits)::BIGINT AS hits, round(sum(hits) / sum(n)::DOUBLE, 6) AS accuracy, round(avg(loss), 6) AS mean_loss, round(exp(avg(loss)), 6) AS perplexity FROM u""")
def token_accuracy(spark, sf_dir):
    """How many labels a guess meets: word lengths as labels, those of four's multiples guessed right; threes don't count."""
    length = F.transform(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1)), lambda z: F.length(z))
    rows = table(spark, sf_dir, "conversations").select(length.alias("l"), (F.col("turn") % 5).cast("double").alias("loss"))
    rows = rows.select(F.transform("l", lambda z: F.when(z % 4 == 0, z).otherwise(-1)).alias("p"), F.transform("l", lambda z: F.when(z == 3, -100).otherwise(z)).alias("l"), "loss")
    found = metrics.token_accuracy(rows, "p", "l", "loss")
    return found.select("tokens", "hits", *[F.round(c, 6).alias(c) for c in ("accuracy", "mean_loss", "perplexity")])


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value FROM events ORDER BY ts, event_id LIMIT 500)")
def mean_of_first(spark, sf_dir):
    """The mean of the first 500 values in order of time."""
    rows = table(spark, sf_dir, "events").select("value", F.struct("ts", "event_id").alias("at"))
    return metrics.mean_of_first(rows, "value", "at", 500).select("n", F.round("mean", 6).alias("mean"))


@query(f"SELECT doc_id, length({NORMAL}) AS n, greatest(10, least(5000, floor(2000000 / greatest(length({NORMAL}), 1))))::BIGINT AS steps FROM documents")
def budget_steps(spark, sf_dir):
    """How many steps a budget of two million residues allows for each document's length."""
    n = F.length(T.normal_protein(F.coalesce("text", F.lit(""))))
    rows = table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n"))
    return rows.select("doc_id", "n", metrics.steps_for(F.lit(2_000_000), F.col("n"), 10, 5000).alias("steps"))


