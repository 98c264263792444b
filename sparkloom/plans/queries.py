"""The library's queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clean, coevolution, kmers, matching, ordered, quota, retrieval, sampling, spans, tokens
from ..operators.storage import scratch_path
from ..sources.sequences import hrefs
from ..streaming import batches
from .registry import QUERIES, SQL, query, table  # noqa: F401

RULES = [
    matching.Rule("articles", ("the", "der", "la")),
    matching.Rule("links", ("and", "und", "et", "y")),
    matching.Rule("in phrase", ("in the", "in der")),
]
SEED = 42
#: Parameter: weights of the parts of the quick score.
WEIGHTS = {"validity": 0.5, "length_score": 0.3, "variety": 0.2}


NORMAL = r"regexp_replace(upper(regexp_replace(replace(coalesce(text, ''), 'ß', 'ss'), '\s+', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWYX]', 'X', 'g')"
REASONS = f"""
WITH s AS (SELECT doc_id, {NORMAL} AS sequence FROM documents),
r AS (SELECT *, CASE WHEN sequence = '' THEN 'invalid_sequence' WHEN length(sequence) < 200 THEN 'too_short'
        WHEN length(sequence) > 20000 THEN 'too_long'
        WHEN length(sequence) - length(replace(sequence, 'X', '')) > length(sequence) * 0.25::DOUBLE THEN 'too_ambiguous' END AS reason
      FROM s),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY reason IS NULL, sequence) AS first_pos FROM r),
d AS (SELECT doc_id, CASE WHEN reason IS NULL AND first_pos < doc_id THEN 'duplicate_sequence' ELSE reason END AS reason FROM f)
"""


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.reasons(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", 200, 20_000, 0.25)


@query(REASONS + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS rows FROM d GROUP BY 1")
def normalize_filter_reasons(spark, sf_dir):
    """How many rows the cleaning chain keeps, and drops for which first reason."""
    return _normalised(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


@query(REASONS + "SELECT doc_id, reason FROM d")
def normalize_rows(spark, sf_dir):
    return _normalised(spark, sf_dir).select("doc_id", "reason")


@query("SELECT doc_id, sha256(text) AS text_hash, min(doc_id) OVER (PARTITION BY text) AS duplicate_of FROM documents")
def first_wins_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return clean.first_of_each(docs, F.col("text_hash"), "doc_id").withColumnRenamed("first_pos", "duplicate_of")


@query("""WITH l AS (SELECT trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents)
SELECT count(*) AS before, count(DISTINCT line) AS after, count(*) - count(DISTINCT line) AS removed FROM l WHERE line <> ''""")
def line_dedupe_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("line")).where("line <> ''")
    by_line = lines.groupBy(F.xxhash64("line").alias("a"), F.xxhash64(F.lit("b"), "line").alias("b")).agg(F.count("*").alias("n"))
    return by_line.agg(F.sum("n").alias("before"), F.count("*").alias("after")).withColumn("removed", F.expr("before - after"))


@query("""SELECT lang, source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r
FROM documents) WHERE r = 1""")
def argmax_per_key(spark, sf_dir):
    """The longest document of each language and source, the first of equals."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    return clean.best_of_each(docs, ["lang", "source"], F.col("n_chars"), -F.col("doc_id"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, quality, toxic, CASE WHEN d.doc_id IS NULL THEN 'right_only'
WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'paired' END AS origin FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def full_outer_paired(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return matching.paired(docs, table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH w AS (SELECT o_orderkey FROM orders), i AS (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderpriority <> '1-URGENT'),
c AS (SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'F' ELSE o_orderstatus END AS v FROM orders WHERE o_orderstatus <> 'P')
SELECT w.o_orderkey, CASE WHEN i.o_orderkey IS NULL THEN 'new' WHEN c.v IS NOT NULL AND c.v IS DISTINCT FROM i.v THEN 'updated'
ELSE 'unchanged' END AS action FROM w LEFT JOIN i USING (o_orderkey) LEFT JOIN c USING (o_orderkey)""")
def cdc_plan(spark, sf_dir):
    """What an incremental fetch of orders must do, against an index without urgent orders and later versions."""
    orders = table(spark, sf_dir, "orders")
    index = orders.where("o_orderpriority <> '1-URGENT'").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    now = F.when(F.col("o_totalprice") < 100000, "F").otherwise(F.col("o_orderstatus"))
    current = orders.where("o_orderstatus <> 'P'").select("o_orderkey", now.alias("v"))
    return matching.change_plan(orders.select("o_orderkey"), index, current, "o_orderkey", "v")


def _labels_sql() -> str:
    def fits(rule):
        return " OR ".join(f"contains(t, ' {k} ')" for k in rule.keywords)

    cases = ", ".join(f"CASE WHEN {fits(r)} THEN '{r.label}' END" for r in RULES)
    return rf"""WITH n AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ' AS t FROM documents),
m AS (SELECT doc_id, lang, list_filter([{cases}], lambda x: x IS NOT NULL) AS labels FROM n)"""


@query(_labels_sql() + " SELECT doc_id, array_to_string(labels, '; ') AS labels, len(labels)::INT AS n FROM m")
def keyword_labels(spark, sf_dir):
    found = matching.matched_labels(F.col("text"), RULES)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, "; ").alias("labels"), F.size(found).alias("n"))


@query(_labels_sql() + """, e AS (SELECT unnest(labels) AS label FROM m), c AS (SELECT label, count(*) AS n FROM e GROUP BY 1)
SELECT count(*) FILTER (WHERE n >= 100) AS frequent, count(*) FILTER (WHERE n < 100) AS rare FROM c""")
def label_threshold_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.explode(matching.matched_labels(F.col("text"), RULES)).alias("label"))
    counts = docs.groupBy("label").agg(F.count("*").alias("n"))
    return counts.agg(F.count_if(F.col("n") >= 100).alias("frequent"), F.count_if(F.col("n") < 100).alias("rare"))


@query(_labels_sql() + """ SELECT lang, CASE WHEN len(labels) = 0 THEN 'unmatched' WHEN len(labels) > 1 THEN 'multi' ELSE 'matched' END AS status,
count(*) AS rows, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang), 6) AS rate FROM m GROUP BY 1, 2""")
def audit_status(spark, sf_dir):
    found = F.size(matching.matched_labels(F.col("text"), RULES))
    status = F.when(found == 0, "unmatched").when(found > 1, "multi").otherwise("matched")
    counts = table(spark, sf_dir, "documents").select("lang", status.alias("status")).groupBy("lang", "status").agg(F.count("*").alias("rows"))
    return counts.withColumn("rate", F.round(F.col("rows") / F.sum("rows").over(W.partitionBy("lang")), 6))


@query("""WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events WHERE json_valid(props))
SELECT key, count(*) AS n FROM k GROUP BY 1""")
def json_key_counts(spark, sf_dir):
    keys = F.explode(F.json_object_keys("props")).alias("key")
    return table(spark, sf_dir, "events").select(keys).groupBy("key").agg(F.count("*").alias("n"))


SPLIT_SQL = f"(('0x' || substr(sha1('{SEED}:' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE) < 0.9::DOUBLE"


@query(f"SELECT doc_id, CASE WHEN {SPLIT_SQL} THEN 'train' ELSE 'val' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sampling.split_of(F.col("doc_id").cast("string"), 0.9, SEED).alias("split"))


@query(f"SELECT count(*) FILTER (WHERE {SPLIT_SQL}) AS train, count(*) FILTER (WHERE NOT {SPLIT_SQL}) AS val, count(*) FILTER (WHERE n_chars > 8192) AS too_long FROM documents")
def split_counts(spark, sf_dir):
    train = sampling.split_of(F.col("doc_id").cast("string"), 0.9, SEED) == "train"
    return table(spark, sf_dir, "documents").agg(
        F.count_if(train).alias("train"), F.count_if(~train).alias("val"), F.count_if(F.col("n_chars") > 8192).alias("too_long")
    )


@query("""SELECT doc_id, CASE WHEN k < greatest(1, least(n - 1, floor(n * 0.9)::BIGINT)) THEN 'train' ELSE 'val' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)""")
def positional_split(spark, sf_dir):
    """Head and tail in order of ids; ranks are counted by ranges, not in one task."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    cut = max(1, min(n - 1, n * 9 // 10))
    ranked = ordered.numbered(docs.withColumn("all", F.lit(0)), ["all"], ["doc_id"])
    return ranked.select("doc_id", F.when(F.col("k") < cut, "train").otherwise("val").alias("split"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def stratum_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS k,
count(*) OVER (PARTITION BY lang, source) AS n FROM documents), q AS (SELECT *, greatest(1, n // 3) AS keep FROM r)
SELECT doc_id, lang, source FROM q WHERE ((k + 1) * keep * 1048576 + 524288 * n) // (n * 1048576) > (k * keep * 1048576 + 524288 * n) // (n * 1048576)""")
def systematic_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.systematic(docs, ["lang", "source"], ["doc_id"], 3, 1 << 19)


@query("SELECT doc_id % 8 AS rank, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def round_robin_shard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.pmod("doc_id", F.lit(8)).alias("rank")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""WITH b AS (SELECT doc_id AS item_id, lower(text) AS t FROM documents),
g AS (SELECT substr(t, i, 3) AS kmer, item_id * 1000000 + i AS place FROM (SELECT item_id, t, unnest(range(1, length(t) - 1)) AS i FROM b))
SELECT kmer, count(*) AS n, min(place) AS first_at FROM g GROUP BY 1""")
def kmer_counts(spark, sf_dir):
    """3-mers of all documents, with their counts and first places."""
    state = kmers.kmer_state(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t")), "doc_id", "t", 3)
    return state.select("kmer", "n", (F.col("row") * 1_000_000 + F.col("at") + 1).alias("first_at"))


@query("""WITH c AS (SELECT string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM c))
SELECT a AS left_token, b AS right_token, count(*) AS n FROM p GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20""")
def pair_counts_top(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select(F.explode(tokens.adjacent_pairs(F.split("text", " "))).alias("p"))
    counts = pairs.groupBy(F.col("p.left").alias("left_token"), F.col("p.right").alias("right_token")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "left_token", "right_token").limit(20)


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
s AS (SELECT doc_id, t, greatest(len(t) - 129, 0) AS last FROM w),
x AS (SELECT DISTINCT doc_id, t, unnest(list_concat(range(0, last + 1, 64), [last])) AS st FROM s)
SELECT doc_id, st::INT AS start, len(t[st + 1:st + 129])::INT AS n, md5(array_to_string(t[st + 1:st + 129], ' ')) AS tokens_md5 FROM x""")
def token_windows(spark, sf_dir):
    """Training windows of 128 + 1 tokens at stride 64."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("t"))
    rows = docs.select("doc_id", F.explode(tokens.windows(F.col("t"), 128, 64)).alias("w"))
    return rows.select("doc_id", F.col("w.start").alias("start"), F.size("w.tokens").alias("n"), F.md5(F.array_join("w.tokens", " ")).alias("tokens_md5"))


@query("""WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x)) AS ids FROM conversations)
SELECT conv_id, turn, least(len(ids), 64)::INT AS used, coalesce(list_sum(ids[1:64]), 0)::BIGINT AS id_sum, greatest(0, least(len(ids), 64) - 5)::INT AS supervised FROM t""")
def pad_and_mask(spark, sf_dir):
    """Word lengths as ids, padded to 64; labels count from the fifth token on."""
    ids = F.transform(T.words(F.coalesce("text", F.lit(""))), lambda x: F.length(x))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids"))
    used = F.least(F.size("ids"), F.lit(64))
    row = rows.select("conv_id", "turn", used.alias("used"), tokens.padded(F.col("ids"), 64, 0).alias("p"))
    labels = tokens.masked_labels(F.col("p"), F.lit(5), F.col("used"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x)
    return row.select("conv_id", "turn", "used", total.alias("id_sum"), F.size(F.filter(labels, lambda x: x != -100)).alias("supervised"))


SCORES = rf"""WITH s AS (SELECT doc_id, {NORMAL} AS q FROM documents),
v AS (SELECT doc_id, q, length(q) AS n, CASE WHEN q = '' THEN 0.0::DOUBLE ELSE length(regexp_replace(q, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g'))::DOUBLE / length(q) END AS validity,
  CASE WHEN length(q) = 0 THEN 0.0::DOUBLE WHEN length(q) < 100 THEN length(q) / 100.0::DOUBLE WHEN length(q) > 2000 THEN 2000.0::DOUBLE / length(q) ELSE 1.0::DOUBLE END AS length_score,
  CASE WHEN q = '' THEN 0.0::DOUBLE ELSE len(list_distinct(string_split(q, '')))::DOUBLE / 21 END AS variety,
  coalesce(list_max(list_transform(regexp_extract_all(q, '[AILMFWVY]+'), lambda x: length(x))), 0)::INT AS hydrophobic_run FROM s)"""


def _scores(spark, sf_dir):
    q, n = F.col("q"), F.length("q")
    rows = table(spark, sf_dir, "documents").select("doc_id", T.normal_protein(F.coalesce("text", F.lit(""))).alias("q"))
    return rows.select(
        "doc_id",
        T.share_of(q, T.STANDARD).alias("validity"),
        F.when(n == 0, 0.0).when(n < 100, n / 100.0).when(n > 2000, 2000.0 / n).otherwise(1.0).alias("length_score"),
        (T.distinct_letters(q, T.PROTEIN) / 21.0).alias("variety"),
        T.longest_run(q, T.HYDROPHOBIC).alias("hydrophobic_run"),
    )


@query(SCORES + " SELECT doc_id, round(validity, 6) AS validity, round(length_score, 6) AS length_score, round(variety, 6) AS variety, hydrophobic_run FROM v")
def char_class_scores(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    return scores.select("doc_id", *[F.round(c, 6).alias(c) for c in WEIGHTS], "hydrophobic_run")


@query(SCORES + """ SELECT doc_id, array_to_string(list_filter([CASE WHEN validity < 0.8 THEN 'alphabet' END, CASE WHEN length_score < 1 THEN 'length' END,
CASE WHEN hydrophobic_run > 10 THEN 'hydrophobic_run' END], lambda x: x IS NOT NULL), ',') AS reasons FROM v""")
def quick_report(spark, sf_dir):
    """The reasons that speak against a sequence."""
    reasons = F.array_compact(F.array(
        F.when(F.col("validity") < 0.8, "alphabet"), F.when(F.col("length_score") < 1, "length"),
        F.when(F.col("hydrophobic_run") > 10, "hydrophobic_run"),
    ))
    return _scores(spark, sf_dir).select("doc_id", F.array_join(reasons, ",").alias("reasons"))


@query(SCORES + """ SELECT doc_id, score FROM (SELECT doc_id, round(0.5::DOUBLE * validity + 0.3::DOUBLE * length_score + 0.2::DOUBLE * variety, 6) AS score FROM v)
ORDER BY score DESC, doc_id LIMIT 50""")
def weighted_score_rank(spark, sf_dir):
    """The 50 best by weighted score, the first of equals."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * F.col(name)
    return _scores(spark, sf_dir).select("doc_id", F.round(total, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query("""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM benchmark),
d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM documents),
s AS (SELECT item_id, doc_id, CASE WHEN len(d.t) * len(q.t) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(d.t, q.t)) / sqrt(len(d.t)::DOUBLE * len(q.t)) END AS score FROM d, q),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) SELECT item_id, doc_id, round(score, 6) AS score FROM r WHERE r <= 25""")
def lexical_rank(spark, sf_dir):
    """For each benchmark item the 25 documents that share most terms with it."""
    terms = lambda name, key: table(spark, sf_dir, name).select(key, F.array_distinct(T.words(F.coalesce("text", F.lit("")))).alias("terms"))
    best = retrieval.best_overlaps(terms("benchmark", "item_id"), terms("documents", "doc_id"), "item_id", "doc_id", 25)
    return best.select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets, min(href) AS first_target FROM h GROUP BY 1""")
def href_index(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(hrefs(F.col("html"))).alias("href"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"), F.min("href").alias("first_target"))


@query("SELECT s_suppkey, s_name, row_number() OVER (ORDER BY regexp_extract(s_name, '[0-9]+')::BIGINT, s_suppkey)::INT AS place FROM supplier")
def natural_sort(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", T.natural_key(F.col("s_name")).alias("key"), F.lit(0).alias("all"))
    return ordered.numbered(names, ["all"], ["key", "s_suppkey"]).select("s_suppkey", "s_name", (F.col("k") + 1).cast("int").alias("place"))


@query("""SELECT c_custkey, 'customer ' || c_name || '; nation ' || n_name || '; region ' || r_name || CASE WHEN c_mktsegment <> '' THEN '; segment ' || lower(c_mktsegment) ELSE '' END AS profile
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def profile_text(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    field = lambda k, v: F.when(v != "", F.concat(F.lit(f"{k} "), v))
    parts = [("customer", F.col("c_name")), ("nation", F.col("n_name")), ("region", F.col("r_name")), ("segment", F.lower("c_mktsegment"))]
    return rows.select("c_custkey", F.array_join(F.array_compact(F.array(*[field(*p) for p in parts])), "; ").alias("profile"))


@query("""SELECT conv_id, turn, '### ' || upper(substr(role, 1, 1)) || substr(role, 2) || ':' || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS prompt
FROM conversations WHERE text IS NOT NULL""".replace("\\\\", "\\"))
def prompt_format(spark, sf_dir):
    role = F.concat(F.upper(F.substring("role", 1, 1)), F.substr("role", F.lit(2)))
    prompt = F.concat(F.lit("### "), role, F.lit(":\n"), T.collapse(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.alias("prompt"))


@query("""WITH c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2),
v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM embeddings)
SELECT vec_id, round(sqrt(sum((x - m) * (x - m))), 5) AS distance, sqrt(sum((x - m) * (x - m))) < 8 AS contact FROM v JOIN c USING (label, i) GROUP BY 1""")
def centroid_distance(spark, sf_dir):
    """Euclidean distance of every vector to the centroid of its label, and whether they are in contact."""
    rows = table(spark, sf_dir, "embeddings")
    mean = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))  # 64 entries a label
    diff = F.zip_with("embedding", "c", lambda x, c: (x.cast("double") - c["m"]) * (x.cast("double") - c["m"]))
    d = F.sqrt(F.aggregate(diff, F.lit(0.0), lambda a, x: a + x))
    return rows.join(whole, "label").select("vec_id", F.round(d, 5).alias("distance"), (d < 8).alias("contact"))


@query("""SELECT event_type, count(*) AS n, round(min(value), 6) AS low, round(avg(value), 6) AS mean, round(max(value), 6) AS high,
count(DISTINCT user_id) AS users, count(*) - count(DISTINCT user_id) AS repeats FROM events GROUP BY 1""")
def metric_summary(spark, sf_dir):
    value = [F.round(f("value"), 6).alias(k) for k, f in (("low", F.min), ("mean", F.avg), ("high", F.max))]
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), *value, F.count_distinct("user_id").alias("users"))
    return by.withColumn("repeats", F.expr("n - users"))


@query("""SELECT event_id, event_type, min(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events""")
def running_best(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    return ordered.running_minimum(events, ["event_type"], ["ts", "event_id"], "value").select("event_id", "event_type", "best")


@query("""WITH d AS (SELECT date_trunc('day', ts)::DATE AS day, avg(value) AS v FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, round(median(v) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM d""")
def smooth_median(spark, sf_dir):
    """Moving median of daily means; events are summed up by day first, so the one window has a row for each day."""
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    near = F.percentile("v", 0.5).over(W.orderBy("day").rowsBetween(-3, 3))
    return daily.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(near, 6).alias("smooth"))


@query("""SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type)""")
def group_and_total(spark, sf_dir):
    """Counts by type and over all; a null type is a row of its own."""
    sums = [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.grouping("event_type").alias("whole")]
    rolled = table(spark, sf_dir, "events").rollup("event_type").agg(*sums)
    return rolled.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("event_type")).alias("event_type"), "n", "total")


@query("""WITH u AS (SELECT n_name AS name, n_regionkey AS v, 1 AS gen FROM nation UNION ALL SELECT r_name, r_regionkey + 100, 2 FROM region
UNION ALL SELECT n_name, n_nationkey + 1000, 3 FROM nation WHERE n_regionkey = 1)
SELECT name, v FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY gen DESC) AS r FROM u) WHERE r = 1""")
def catalog_upsert(spark, sf_dir):
    """Later generations of a catalog replace earlier rows of the same name."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("v"), F.lit(1).alias("gen")).union(
        region.select("r_name", F.col("r_regionkey") + 100, F.lit(2))
    ).union(nation.where("n_regionkey = 1").select("n_name", F.col("n_nationkey") + 1000, F.lit(3)))
    return clean.best_of_each(rows, ["name"], F.col("gen")).select("name", "v")


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey < 1000 THEN (o_orderkey + 1) / 1000.0::DOUBLE
ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5 * (1 + cos(pi() * least(1.0::DOUBLE, (o_orderkey - 1000) / 59000.0::DOUBLE))) END, 6) AS scale FROM orders""")
def lr_schedule(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(T.warmup_cosine(F.col("o_orderkey"), 1000, 60_000), 6).alias("scale"))


@query()
def downsample_plan(spark, sf_dir):
    """How many documents each language of a source keeps at half the rows, and where its sampling starts."""
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return quota.downsample_plan(counts, "source", "lang", 0.5)


@query()
def downsample_rows(spark, sf_dir):
    """The documents that this plan keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return quota.downsample(docs, "source", "lang", ["doc_id"], 0.5)


@query()
def span_examples(spark, sf_dir):
    """Masked spans of the residues of documents, with the invariants that a row breaks (none)."""
    residues = F.regexp_replace(F.upper("text"), f"[^{T.STANDARD}]", "")
    rows = spans.span_examples(table(spark, sf_dir, "documents").select("doc_id", residues.alias("q")), "doc_id", "q")
    return spans.span_faults(rows).withColumn("faults", F.array_join("faults", ","))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0")
    columns = [
        F.col("l_returnflag"), F.col("l_linestatus"), F.translate(F.col("l_linenumber").cast("string"), "1234567", "ACDEFGH"),
        F.substr(F.lit("ACDEFGHIKLMN"), F.month("l_shipdate"), F.lit(1)), F.translate(quantity, "0123456789", "ACDEFGHIKL"),
    ]
    return table(spark, sf_dir, "lineitem").select(F.concat(*columns).alias("s"))


MUTUAL = """WITH m AS (SELECT row_number() OVER () AS r, l_returnflag || replace(l_linestatus, 'O', 'X') || translate(l_linenumber::VARCHAR, '1234567', 'ACDEFGH')
|| substr('ACDEFGHIKLMN', month(l_shipdate)::INT, 1) || translate(lpad(l_quantity::INT::VARCHAR, 2, '0'), '0123456789', 'ACDEFGHIKL') AS s FROM lineitem),
c AS (SELECT r, i::INT AS i, substr(s, i::INT + 1, 1) AS a FROM m, range(6) t(i)), t AS (SELECT count(*)::DOUBLE AS n FROM m),
o AS (SELECT i, a, count(*) AS n FROM c GROUP BY 1, 2), j AS (SELECT x.i, y.i AS j, x.a, y.a AS b, count(*) AS n FROM c x JOIN c y ON x.r = y.r AND x.i < y.i GROUP BY ALL),
l AS (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWYX-', '')) AS a),
g AS (SELECT x.i::INT AS i, y.j::INT AS j, p.a, q.a AS b FROM range(6) x(i), range(6) y(j), l p, l q WHERE x.i < y.j),
v AS (SELECT g.i, g.j, (coalesce(j.n, 0) + 0.001::DOUBLE) / (t.n + 0.484::DOUBLE) AS p, (coalesce(u.n, 0) + 0.001::DOUBLE) / (t.n + 0.022::DOUBLE) AS pa,
(coalesce(w.n, 0) + 0.001::DOUBLE) / (t.n + 0.022::DOUBLE) AS pb FROM g CROSS JOIN t LEFT JOIN j ON g.i = j.i AND g.j = j.j AND g.a = j.a AND g.b = j.b
LEFT JOIN o u ON u.i = g.i AND u.a = g.a LEFT JOIN o w ON w.i = g.j AND w.a = g.b)"""


@query(MUTUAL + " SELECT i, j, round(sum(p * ln(p / (pa * pb))), 6) AS score FROM v GROUP BY 1, 2")
def mutual_information(spark, sf_dir):
    """Mutual information of six columns of letters made of line items."""
    return coevolution.mutual_information(_aligned(spark, sf_dir), "s").select("i", "j", F.round("score", 6).alias("score"))


@query(MUTUAL + """, s AS (SELECT i, j, sum(p * ln(p / (pa * pb))) AS score FROM v GROUP BY 1, 2), b AS (SELECT i, score FROM s UNION ALL SELECT j, score FROM s),
e AS (SELECT i, sum(score) / 6.0::DOUBLE AS e FROM b GROUP BY 1), w AS (SELECT 2 * sum(score) / 36.0::DOUBLE AS whole FROM s)
SELECT s.i, s.j, round(score - x.e * y.e / whole, 6) AS score FROM s JOIN e x ON x.i = s.i JOIN e y ON y.i = s.j CROSS JOIN w ORDER BY score - x.e * y.e / whole DESC, s.i, s.j LIMIT 5""")
def coevolving_pairs(spark, sf_dir):
    """The five pairs that are left highest by the average-product correction, neighbouring columns included."""
    scores = coevolution.corrected(coevolution.mutual_information(_aligned(spark, sf_dir), "s"), 6)
    return coevolution.top_pairs(scores, 5, 1).select("i", "j", F.round("score", 6).alias("score"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    """Extension: a relational aggregate over the largest fact table."""
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    )


@query(f"SELECT doc_id, CASE WHEN {SPLIT_SQL} THEN 'train' ELSE 'val' END AS split FROM documents")
def stream_split(spark, sf_dir):
    """The hash split as a stream over files."""
    path = f"{sf_dir}/documents.parquet"
    rows = batches.file_stream(spark, path, spark.read.parquet(path).schema).select("doc_id")
    to = scratch_path(spark, "stream-split")
    return batches.run_to_end(batches.split_stream(rows, "doc_id", 0.9, SEED), f"{to}/rows", f"{to}/state")


@query("SELECT DISTINCT md5(text) AS text_md5 FROM documents")
def stream_dedupe(spark, sf_dir):
    """First-wins de-duplication as a stream over files."""
    path = f"{sf_dir}/documents.parquet"
    rows = batches.file_stream(spark, path, spark.read.parquet(path).schema).select(F.md5("text").alias("text_md5"))
    to = scratch_path(spark, "stream-dedupe")
    return batches.first_seen_stored(rows, ["text_md5"], f"{to}/rows", f"{to}/state")
