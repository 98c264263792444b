"""Queries over plain files made of the tables: delimited rows, listings, ordered text parts, JSON objects, FASTA, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import datasets, metrics, sampling, tokens
from ..operators.ordered import running_sums
from ..operators.storage import scratch_path
from ..sources import archives, files, sequences
from ..streaming import batches
from .records import text, written, written_objects
from .registry import query, table


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'nation ' || s_nationkey END AS note FROM supplier")
def delimited_rows(spark, sf_dir):
    """A tab-separated table with blanks around cells, nulls and a column without a name."""
    path = scratch_path(spark, "delimited")
    note = F.when(F.col("s_suppkey") % 4 != 0, text(" nation ", F.col("s_nationkey").cast("string"), " "))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("s_suppkey"), text(" ", F.col("s_name")).alias("s_name"), note.alias("note"), F.lit("x").alias(" "))
    rows.write.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_delimited(spark, path, "\t")


@query("""SELECT 'group' || (n_nationkey % 3) AS "group", 'b' || n_nationkey AS stem, n_nationkey % 4 <> 0 AS has_left, n_nationkey % 5 <> 0 AS has_right FROM nation WHERE n_nationkey % 20 <> 0""")
def archive_bundles(spark, sf_dir):
    """Archives of two kinds, paired by folder and stem, from listings of their folders."""
    root, nation = scratch_path(spark, "archives"), table(spark, sf_dir, "nation")
    for part, ending in (("n_nationkey % 4 <> 0", ".gpff"), ("n_nationkey % 5 <> 0", ".faa")):
        fold = text("group", (F.col("n_nationkey") % 3).cast("string")).alias("fold")
        name = text("b", F.col("n_nationkey").cast("string"), ending).alias("name")
        nation.where(part).select(F.lit("x").alias("value"), fold, name).write.mode("append").partitionBy("fold", "name").text(root)
    # A folder stands for an archive: its name is the archive's.
    whole = files.listing(spark, root, "part-*").select(F.regexp_replace("path", "/(?:name=)([^/]*)/part-[^/]*$", "/$1").alias("path"))
    paired = files.bundles(whole, whole, (".gpff", ".faa"))
    return paired.select(
        F.regexp_replace("group", "^fold=", "").alias("group"), F.element_at(F.split("bundle", "/"), -1).alias("stem"),
        F.col("left_path").isNotNull().alias("has_left"), F.col("right_path").isNotNull().alias("has_right"),
    )


@query("""SELECT row_number() OVER (ORDER BY p_partkey) AS line_number, p_name || ' ' || p_partkey AS line, sum(octet_length(encode(p_name || ' ' || p_partkey)) + 1) OVER (ORDER BY p_partkey)::BIGINT AS bytes_so_far FROM part""")
def concatenated_parts(spark, sf_dir):
    """Text parts in natural order of their names, written as one in order, and read back: the files' contents follow one another."""
    rows = table(spark, sf_dir, "part").select("p_partkey", text(F.col("p_name"), " ", F.col("p_partkey").cast("string")).alias("line"))
    folder, out = scratch_path(spark, "parts"), scratch_path(spark, "whole")
    rows.repartitionByRange(12, "p_partkey").sortWithinPartitions("p_partkey").select("line").write.text(folder)
    files.write_in_order(files.read_lines(spark, folder, "part-*"), out, 4)
    back = files.read_lines(spark, out, "part-*").select("line", "pos", (F.octet_length("line") + 1).cast("long").alias("n"), F.lit(1).cast("long").alias("one"))
    found = running_sums(back, [], ["pos"], {"before": "n", "k": "one"})
    return found.select((F.col("k") + 1).alias("line_number"), "line", (F.col("before") + F.col("n")).alias("bytes_so_far"))


@query("SELECT p_partkey, p_partkey % 7 AS part, row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey) AS line_number FROM part")
def line_numbers(spark, sf_dir):
    """The number of each line in its file, where files lie in several splits."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 7).alias("part"))
    folder = scratch_path(spark, "numbered")
    rows.repartition(7, "part").sortWithinPartitions("part", "p_partkey").select(F.col("p_partkey").cast("string").alias("line"), "part").write.partitionBy("part").text(folder)
    found = files.numbered_lines(spark, folder)
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("long")
    return found.select(F.col("line").cast("long").alias("p_partkey"), part.alias("part"), "line_number")


@query("""SELECT doc_id, md5(trim(regexp_replace(replace(coalesce(text, ''), chr(13), ''), '\\s+', ' ', 'g'), ' ')) AS text_md5 FROM documents""".replace("\\\\", "\\"))
def archive_blocks(spark, sf_dir):
    """Documents as records of gzip archives that ``//`` lines end, read by the source for damaged archives."""
    rows = table(spark, sf_dir, "documents").select(
        text("ID ", F.col("doc_id").cast("string"), "\n", T.collapse(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(""))), "\n//").alias("value")
    )
    folder = scratch_path(spark, "archives")
    rows.write.option("compression", "gzip").text(folder)
    found = archives.blocks(archives.read_archives(spark, folder, "part-*.gz", "block"))
    body = F.regexp_replace("block", r"^ID \d+\n?", "")
    return found.select(F.regexp_extract("block", r"^ID (\d+)", 1).cast("long").alias("doc_id"), F.md5(body).alias("text_md5"))


@query("SELECT 'acc' || c_custkey AS accession, c_name AS sequence FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 6 <> 1")
def raw_index_rows(spark, sf_dir):
    """A JSON object keyed by accession as rows; values that aren't objects go."""
    key = F.col("c_custkey").cast("string")
    entry = F.when(F.col("c_custkey") % 6 == 1, "3").otherwise(F.to_json(F.struct(F.col("c_name").alias("sequence"))))
    rows = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    folder = scratch_path(spark, "index")
    written_objects(rows, text('"acc', key, '": ', entry), "c_custkey", folder)
    found = archives.read_objects(spark, folder, "part-*")
    return found.select(F.col("key").alias("accession"), F.get_json_object("value", "$.sequence").alias("sequence"))


@query("SELECT n_nationkey, n_name AS title, 'one' || chr(10) || 'two ' || n_nationkey AS notes, 'Body of ' || n_name AS body FROM nation")
def front_matter(spark, sf_dir):
    """Fields and body of texts with front matter."""
    key, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    page = text("---\ntitle: '", name, "'\nnotes: |\n  one\n  two ", key, "\n---\n\nBody of ", name, "\n")
    fields, body = files.front_matter(page)
    return table(spark, sf_dir, "nation").select("n_nationkey", fields["title"].alias("title"), fields["notes"].alias("notes"), body.alias("body"))


@query("SELECT 'part' || p_partkey AS accession, p_name AS description, upper(repeat(translate(md5(p_name), '0123456789', 'GHIKLMNPQR'), 1 + p_size % 4)) AS sequence FROM part")
def fasta_round_trip(spark, sf_dir):
    """Records as FASTA with lines of 80 residues, and read back."""
    letters = F.translate(F.md5("p_name"), "0123456789", "GHIKLMNPQR")
    sequence = F.upper(F.repeat(letters, F.lit(1) + F.col("p_size") % 4))
    entry = files.fasta_text(text("part", F.col("p_partkey").cast("string")), F.col("p_name"), sequence)
    path = written(table(spark, sf_dir, "part"), entry, "fasta")
    return sequences.read_fasta(spark, path).select("accession", "description", "sequence")


@query("""SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run, count(*) AS n, min(event_id) AS first_step, max(event_id) AS last_step,
round(min(value) FILTER (WHERE event_id % 10 <> 0), 6) AS best, round(exp(min(value) FILTER (WHERE event_id % 10 <> 0)), 6) AS best_perplexity FROM events WHERE value < 50 GROUP BY 1""")
def metric_ingest(spark, sf_dir):
    """Metric files of two runs as JSON Lines with odd numbers, summed up by run."""
    loss = F.when(F.col("event_id") % 10 == 0, F.lit("nan")).otherwise(F.col("value").cast("string"))
    rows = table(spark, sf_dir, "events").where("value < 50").select(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("run"), F.to_json(F.struct(F.col("event_id").alias("step"), loss.alias("loss"))).alias("value"))
    folder = scratch_path(spark, "metrics")
    rows.write.partitionBy("run").text(folder)
    found = metrics.read_metrics(spark, folder, "step long, loss string", -2).withColumn("run", F.regexp_replace("source", "^run=", ""))
    best = F.min(metrics.finite(metrics.lenient_number(F.col("loss"))))
    return found.groupBy("run").agg(
        F.count("*").alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.round(best, 6).alias("best"),
        F.round(metrics.perplexity(best), 6).alias("best_perplexity"),
    )


@query("""WITH d AS (SELECT doc_id, ('0x' || substr(md5('5:' || doc_id), 1, 8))::BIGINT % 64 AS delay FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY doc_id + delay, doc_id)::BIGINT - 1 AS place FROM d""")
def shuffled_order(spark, sf_dir):
    """A shuffle in which a row moves behind at most 63 later ones, as places from 0."""
    from ..operators.ordered import numbered

    moved = sampling.bounded_shuffle(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64, 5, "at")
    ranked = numbered(moved.select("doc_id", "at.at", F.lit(0).alias("whole")), ["whole"], ["at", "doc_id"], "place")
    return ranked.select("doc_id", "place")


@query("""SELECT source, dataset, snapshot, records FROM (SELECT * FROM (SELECT 'region' || n_regionkey AS source, n_name AS dataset, 'one' AS snapshot, n_nationkey::BIGINT AS records FROM nation WHERE n_nationkey % 2 = 0)
UNION ALL SELECT 'region' || n_regionkey, n_name, 'two', 100 + n_nationkey FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey % 4 = 0) t
WHERE NOT (snapshot = 'one' AND dataset IN (SELECT n_name FROM nation WHERE n_nationkey % 4 = 0)) AND source <> 'region1'""")
def catalog_changes(spark, sf_dir):
    """A catalog after an upsert and a removal."""
    nation = table(spark, sf_dir, "nation")
    row = lambda rows, snapshot, n: rows.select(
        text("region", F.col("n_regionkey").cast("string")).alias("source"), F.col("n_name").alias("dataset"), F.lit(snapshot).alias("snapshot"), n.cast("long").alias("records")
    )
    first = row(nation.where("n_nationkey % 2 = 0"), "one", F.col("n_nationkey"))
    later = row(nation.where("n_nationkey % 2 = 1 OR n_nationkey % 4 = 0"), "two", F.col("n_nationkey") + 100)
    both = datasets.catalog_upserted(first, later)
    return datasets.catalog_listed(datasets.catalog_removed(both, both.where("source = 'region1'").select("source", "dataset")))


@query("SELECT s_suppkey, s_suppkey || ',' || CASE WHEN s_suppkey % 2 = 0 THEN '\"' || s_name || ', \"\"x\"\"\"' ELSE s_name END || ',,' || s_nationkey || ',parquet,,' AS line FROM supplier")
def catalog_lines(spark, sf_dir):
    """Catalog rows as CSV lines."""
    name = F.when(F.col("s_suppkey") % 2 == 0, text(F.col("s_name"), ', "x"')).otherwise(F.col("s_name"))
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_suppkey").cast("string").alias("source"), name.alias("dataset"), F.lit(None).cast("string").alias("snapshot"), F.col("s_nationkey").cast("long").alias("records"),
        F.lit("parquet").alias("storage"), F.lit(None).cast("string").alias("merge"), F.lit(None).cast("long").alias("saved_at"),
    )
    return rows.select("s_suppkey", datasets.catalog_csv(rows).alias("line"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
s AS (SELECT doc_id, t, greatest(len(t) - 65, 0) AS last FROM w), x AS (SELECT DISTINCT doc_id, len(t) AS n, unnest(list_concat(range(0, last + 1, 64), [last])) AS st FROM s)
SELECT doc_id, count(*) AS windows, sum(least(n - st, 65))::BIGINT AS tokens FROM x GROUP BY 1""")
def streamed_windows(spark, sf_dir):
    """Training windows cut while documents stream in, and summed up by document."""
    path = f"{sf_dir}/documents.parquet"
    rows = batches.file_stream(spark, path, spark.read.parquet(path).schema).select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("t"))
    cut = rows.select("doc_id", F.explode(tokens.windows(F.col("t"), 64, 64)).alias("w")).select("doc_id", F.size("w.tokens").alias("n"))
    to = scratch_path(spark, "stream-windows")
    out = batches.run_to_end(cut, f"{to}/rows", f"{to}/state")
    return out.groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum("n").alias("tokens"))


@query("""SELECT source, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY 1""")
def resumed_upserts(spark, sf_dir):
    """A raw index kept by a stream that stops in its third batch and goes on from its checkpoint."""
    path, to = f"{sf_dir}/documents.parquet", scratch_path(spark, "stream-index")
    feed = scratch_path(spark, "feed")
    docs = spark.read.parquet(path).select("doc_id", "source", "n_chars")
    docs.repartition(4, "doc_id").write.parquet(feed)
    for upto in (2, None):  # the second run finds what the first has left
        rows = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(feed)
        batches.upsert_stream(rows, "doc_id", f"{to}/index", f"{to}/state", upto)
    index = batches.read_upserts(spark, f"{to}/index", docs.schema, "doc_id")
    return index.groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


@query("""WITH r AS (SELECT translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ', '') AS r FROM documents WHERE text IS NOT NULL), l AS (SELECT unnest(string_split(r, '')) AS letter FROM r WHERE r <> '')
SELECT letter, count(*) AS n FROM l GROUP BY 1""")
def missing_letters(spark, sf_dir):
    """Characters of documents that plain letters and spaces don't cover."""
    known = "".join(map(chr, range(97, 123))) + "".join(map(chr, range(65, 91))) + " "
    return files.missing_letters(table(spark, sf_dir, "documents"), "text", known)


@query("""WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' Yes' WHEN 2 THEN 'off' ELSE 'ON ' END AS flag, '.' || c_name || ' / ' || c_mktsegment || repeat('x', (c_custkey % 90)::INT) AS name,
CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_custkey || ' ' ELSE c_name END AS count FROM customer)
SELECT c_custkey, coalesce(nullif(substr(regexp_replace(regexp_replace(name, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 80), ''), 'candidate') AS file_name,
coalesce(lower(trim(flag)) IN ('1', 'true', 'yes', 'on'), TRUE) AS wanted, CASE WHEN regexp_matches(trim(count), '^[0-9]+$') THEN trim(count)::BIGINT END AS number FROM c""")
def settings_rows(spark, sf_dir):
    """Names of files, yes-or-no settings and whole numbers as texts give them."""
    n = F.col("c_custkey")
    flag = F.when(n % 4 == 1, " Yes").when(n % 4 == 2, "off").when(n % 4 == 3, "ON ")
    name = F.concat(F.lit("."), F.col("c_name"), F.lit(" / "), F.col("c_mktsegment"), F.repeat(F.lit("x"), (n % 90).cast("int")))
    count = F.when(n % 3 == 0, F.concat(F.lit(" "), n.cast("string"), F.lit(" "))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.safe_name(name).alias("file_name"), T.truth(flag, True).alias("wanted"), T.whole_number(count).alias("number"))
