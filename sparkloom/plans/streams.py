"""Queries over the corpus as one token stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import kmers, padding, stream, vocabulary
from ..operators.storage import scratch_path
from .registry import query, table


@query("""WITH t AS (SELECT doc_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS p FROM (SELECT doc_id, list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ['.']) AS t FROM documents)),
g AS (SELECT token, row_number() OVER (ORDER BY doc_id, p) - 1 AS g FROM t), n AS (SELECT count(*) AS n, greatest(count(*) - 257, 0) AS last FROM g),
s AS (SELECT DISTINCT unnest(list_concat(range(0, last + 1, 200), [last])) AS start FROM n)
SELECT (row_number() OVER (ORDER BY start) - 1)::BIGINT AS "window", start::BIGINT AS start, count(*)::INT AS n, md5(string_agg(token, ' ' ORDER BY g)) AS digest
FROM s JOIN g ON g.g >= s.start AND g.g < s.start + 257 GROUP BY start""")
def corpus_windows(spark, sf_dir):
    """Windows of 257 tokens, 200 apart, over all documents as one stream, each document closed by a token of its own."""
    ids = F.concat(T.words(F.coalesce("text", F.lit(""))), F.array(F.lit(".")))
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("t"))
    cut = stream.stream_windows(rows, ["doc_id"], "t", 256, 200)
    return cut.select("window", "start", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def buffered_order(spark, sf_dir):
    """Documents dealt to four shards in turn and shuffled through a buffer of 64 rows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return stream.buffer_shuffled(rows, "doc_id", 4, 64, 5, epoch=1)


query()(buffered_order)


@query("""WITH t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))::INT AS length FROM documents), r AS (SELECT *, (row_number() OVER (ORDER BY length, doc_id) - 1) // 32 AS batch FROM t)
SELECT doc_id, batch::BIGINT AS batch, length, max(length) OVER (PARTITION BY batch)::INT AS width, (max(length) OVER (PARTITION BY batch) - length)::INT AS pads FROM r""")
def length_batches(spark, sf_dir):
    """Word lengths of documents as rows of ids, in batches of 32 rows of like length, written with their manifest."""
    ids = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: F.length(w))
    made = padding.padded_batches(table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")), "doc_id", "ids", 32)
    path = scratch_path(spark, "batches")
    padding.write_batches(made, path, 0)
    rows, _ = padding.read_batches(spark, path)
    return rows.select("doc_id", "batch", "length", "width", F.size(F.filter("attention_mask", lambda x: x == 0)).alias("pads"))


@query("""WITH g AS (SELECT substr(t, i, 2) AS kmer, item * 1000000 + i AS place FROM (SELECT doc_id AS item, lower(coalesce(text, '')) AS t, unnest(range(1, length(coalesce(text, '')))) AS i FROM documents)),
f AS (SELECT kmer, count(*) AS n, min(place) AS first FROM g GROUP BY 1) SELECT kmer, n, (4 + row_number() OVER (ORDER BY first) - 1)::INT AS id FROM f""")
def merged_vocabulary(spark, sf_dir):
    """2-mers of all documents, counted in four batches whose states are merged one after the other."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    state = None
    for k in range(4):
        more = kmers.kmer_state(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k), "doc_id", "t", 2)
        state = more if state is None else kmers.merged(state, more)
    return state.select("kmer", "n").join(kmers.numbered_kmers(state, 4), "kmer").select("kmer", "n", "id")


#: Parameter: letters and words of a vocabulary that is given.
GIVEN = vocabulary.Vocabulary.of("abcdefghijklmnopqrstuvwxyz .,", ("the ", "and ", "ing", "ion", "en ", "er ", "de ", "es ", "st", "th"))


@query("""SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z.,]+', ' ', 'g'))) AS decoded_md5, TRUE AS fewer FROM documents""")
def coded_documents(spark, sf_dir):
    """Documents as ids of a given vocabulary with merges, and decoded again."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z.,]+", " "))
    rows = table(spark, sf_dir, "documents").select("doc_id", plain.alias("t"))
    coded = rows.select("doc_id", F.length("t").alias("n"), vocabulary.encoded(F.col("t"), GIVEN, bos=True, eos=True).alias("ids"))
    back = vocabulary.decoded(F.col("ids"), GIVEN, skip_special=True)
    return coded.select("doc_id", F.md5(back).alias("decoded_md5"), (F.size("ids") <= F.col("n") + 2).alias("fewer"))
