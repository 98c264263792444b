"""Queries of incremental preparation: requested keys, the raw index, rebuilt states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental, sessions
from ..operators.storage import scratch_path
from ..operators.vocabulary import Vocabulary
from .queries import NORMAL
from .records import text, written_objects
from .registry import query, table


@query("""WITH r AS (SELECT ' acc' || (o_custkey % 500) || CASE WHEN o_orderkey % 2 = 0 THEN '.' || (o_orderkey % 9) ELSE '' END AS given, o_orderkey AS pos FROM orders UNION ALL SELECT ' ', -o_orderkey FROM orders),
p AS (SELECT trim(given, ' ') AS given, pos FROM r WHERE trim(given, ' ') <> '') SELECT regexp_replace(given, '\\.[0-9]+$', '') AS accession, arg_min(given, pos) AS alias, min(pos) AS first_pos, count(*) AS times FROM p GROUP BY 1""".replace("\\\\", "\\"))
def requested_accessions(spark, sf_dir):
    """Requested keys in canonical form with their first spelling, place and number."""
    orders = table(spark, sf_dir, "orders")
    version = F.when(F.col("o_orderkey") % 2 == 0, text(".", (F.col("o_orderkey") % 9).cast("string"))).otherwise("")
    rows = orders.select(text(" acc", (F.col("o_custkey") % 500).cast("string"), version).alias("given"), F.col("o_orderkey").alias("pos"))
    blank = orders.select(F.lit(" ").alias("given"), (-F.col("o_orderkey")).alias("pos"))
    return incremental.requested(rows.union(blank), "given", "pos")


@query("""SELECT coalesce(f.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN f.c_custkey IS NULL THEN c.c_name ELSE 'new ' || f.c_name END AS sequence
FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c FULL JOIN (SELECT * FROM customer WHERE c_custkey % 4 = 0) f ON c.c_custkey = f.c_custkey""")
def raw_index_upsert(spark, sf_dir):
    """The raw index after a fetch: fetched rows replace, others stay."""
    customer = table(spark, sf_dir, "customer")
    index = customer.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_name").alias("sequence"))
    fetched = customer.where("c_custkey % 4 = 0").select("c_custkey", text("new ", F.col("c_name")).alias("sequence"))
    return incremental.upserted(index, fetched.union(fetched), "c_custkey")


@query(f"""WITH s AS (SELECT doc_id, {NORMAL} AS q FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT -1),
m AS (SELECT s.*, CASE WHEN q = '' THEN 'invalid_sequence' WHEN length(q) < 200 THEN 'too_short' WHEN length(q) > 20000 THEN 'too_long'
WHEN length(q) - length(replace(q, 'X', '')) > length(q) * 0.25::DOUBLE THEN 'too_ambiguous' END AS reason FROM s JOIN a USING (doc_id)),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY reason IS NULL, q) AS first_id FROM m)
SELECT doc_id, reason IS NULL AND first_id = doc_id AS included, CASE WHEN reason IS NULL AND first_id < doc_id THEN 'duplicate_sequence' ELSE reason END AS reason,
CASE WHEN reason IS NULL AND first_id < doc_id THEN first_id END AS duplicate_of FROM f
UNION ALL SELECT doc_id, FALSE, 'not_requested', NULL FROM s WHERE doc_id NOT IN (SELECT doc_id FROM a) UNION ALL SELECT doc_id, FALSE, 'missing', NULL FROM a WHERE doc_id NOT IN (SELECT doc_id FROM s)""")
def rebuilt_states(spark, sf_dir):
    """The state of every row of an index after a rebuild, and of requested rows that it lacks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 5 <> 0").select("doc_id").union(spark.range(1).select(F.lit(-1).cast("long")))
    return incremental.rebuilt(docs.where("doc_id % 7 <> 0"), asked, "doc_id", "text", 200, 20_000, 0.25)


@query("SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_orderstatus <> 'P'")
def wanted_versions(spark, sf_dir):
    """Versions of requested keys that the index has."""
    orders = table(spark, sf_dir, "orders")
    versions = orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    return incremental.wanted_versions(orders.where("o_orderkey % 3 = 0"), orders.where("o_orderkey % 2 = 0"), versions, "o_orderkey")


LETTERS = "ACDEFGHIKLMNPQRSTVWYX"


@query("""WITH p AS (SELECT 'P' || p_partkey AS accession, p_partkey AS k, upper(translate(md5(p_name), '0123456789', 'GHIKLMNPQR')) AS s FROM part WHERE p_partkey % 5 <> 0)
SELECT row_number() OVER (ORDER BY k DESC) - 1 AS place, md5(replace(s, 'B', 'X')) AS sequence_md5, 34 AS n_ids FROM p""")
def session_rows(spark, sf_dir):
    """A preparation session in the order asked for, saved as a training set, loaded and encoded."""
    key = F.col("p_partkey").cast("string")
    letters = F.replace(F.upper(F.translate(F.md5("p_name"), "0123456789", "GHIKLMNPQR")), F.lit("B"), F.lit("X"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("P"), key).alias("a"), letters.alias("s"), "p_name")
    folder, out = scratch_path(spark, "session"), scratch_path(spark, "training-set")
    entry = F.to_json(F.struct((F.col("p_partkey") % 5 != 0).alias("included_in_current_dataset"), F.col("s").alias("sequence"), F.col("p_name").alias("description")))
    member = F.concat(F.lit('"'), F.col("a"), F.lit('": '), entry)
    written_objects(parts, member, "p_partkey", f"{folder}/raw_index.json")
    parts.repartitionByRange(4, F.desc("p_partkey")).sortWithinPartitions(F.desc("p_partkey")).select("a").write.text(f"{folder}/accessions.txt")
    records = sessions.session_records(sessions.read_session(spark, folder), "parts", [])
    profiles = Vocabulary.of("".join(map(chr, range(32, 127))), ("task ", "sequence "), kind="profile")
    sessions.save_training_set(records, out, profiles, Vocabulary.of(LETTERS))
    loaded = sessions.load_training_set(spark, out)
    return loaded.encoded(loaded.rows(spark, "place")).select("place", F.md5("sequence").alias("sequence_md5"), F.size("sequence_ids").alias("n_ids"))
