"""Site-relative line dedup: a line that too large a share of a host's pages carries is boilerplate and goes.

Pages become arrays of distinct line hashes before anything is shuffled, so a line counts once for a page; counts by
(host, line) are pre-aggregated in each task. Only lines on enough pages meet the host totals. The join that finds the
pages of boilerplate lines is an inner join, of which Spark splits skewed partitions, and what comes back to a page is
the set of its own boilerplate lines, at most as many as it has lines.

Lines are told apart by two 64-bit hashes, and pages by two hashes of id, host and text, so that null or repeated ids
do no harm. Defined cases: a null host is a host of its own (the empty name); a null text stays null and has no lines;
blank lines are neither counted nor dropped; repeated rows are pages each; a page may lose all its lines and is kept
with what is left; a line at exactly the ratio stays; an empty table gives an empty result; texts and lines of any length
are taken whole; further columns pass through, and the new one takes a free name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, free_name, read_table

#: A line is boilerplate on a host if more than this share of the host's pages carry it, and at least MIN_PAGES do: on a
#: host of fewer than MIN_PAGES / MAX_RATIO pages the ratio alone would drop lines that occur once.
MAX_RATIO = 0.02
MIN_PAGES = 5


def _named(column: str) -> Column:
    """A column by its whole name, which may hold dots."""
    return F.col(f"`{column}`")


def _line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def host_line_ratios(
    docs: DataFrame, host: str = "source", text: str = "text", min_pages: int = MIN_PAGES, distinct: bool = False
) -> DataFrame:
    """(host, line, pages, host_pages) of each line, by its key, that ``min_pages`` pages of a host carry.

    With ``distinct`` the copies of a text on a host are one page, in the counts and in the total.
    """
    site = F.coalesce(_named(host).cast("string"), F.lit(""))
    full = F.array_distinct(F.filter(_lines(_named(text)), lambda x: x.rlike(WORD)))
    if distinct:
        # What is shuffled is a text's line keys, and copies in a task are one row before that.
        copy = F.struct(F.xxhash64(_named(text)).alias("a"), F.xxhash64(F.lit("text"), _named(text)).alias("b"))
        keyed = docs.select(site.alias("host"), copy.alias("copy"), F.transform(full, _line_key).alias("lines"))
        pages = keyed.groupBy("host", "copy").agg(F.first("lines").alias("lines"))
        found = pages.select("host", F.explode("lines").alias("line"))
    else:
        pages = docs.select(site.alias("host"))
        found = docs.select(site.alias("host"), F.explode(full).alias("line")).select("host", _line_key(F.col("line")).alias("line"))
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = found.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return counts.join(totals, "host")


def drop_site_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    key: str = "doc_id",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    distinct: bool = False,
) -> DataFrame:
    """``docs`` with ``text`` cleaned, and a struct column ``line_dedup`` of n_lines, n_dropped and dropped_chars."""
    site = F.coalesce(_named(host).cast("string"), F.lit(""))
    page = F.struct(
        F.xxhash64(_named(key), site, _named(text)).alias("p"), F.xxhash64(_named(text), site, F.lit("page"), _named(key)).alias("q")
    )
    full = F.filter(_lines(_named(text)), lambda x: x.rlike(WORD))
    flagged = (
        host_line_ratios(docs, host, text, min_pages, distinct)
        .where(F.col("pages") > max_ratio * F.col("host_pages"))
        .select("host", "line")
    )
    bad = (
        docs.select(page.alias("page"), site.alias("host"), F.explode(F.array_distinct(full)).alias("line"))
        .select("page", "host", _line_key(F.col("line")).alias("line"))
        .join(flagged, ["host", "line"])
        .groupBy("page")
        .agg(F.collect_set("line").alias("bad"))
    )
    at, ours, out = (free_name(docs, x) for x in ("_page", "_bad", "line_dedup"))
    joined = docs.withColumn(at, page).join(bad.select(F.col("page").alias(at), F.col("bad").alias(ours)), at, "left")
    dropped = lambda x: F.coalesce(F.array_contains(F.col(ours), _line_key(x)), F.lit(False)) & x.rlike(WORD)
    lines = _lines(_named(text))
    gone = F.when(F.col(ours).isNotNull(), F.filter(lines, dropped)).otherwise(F.array().cast("array<string>"))
    left = F.when(F.col(ours).isNotNull(), F.array_join(F.filter(lines, lambda x: ~dropped(x)), "\n")).otherwise(_named(text))
    n_lines = F.size(F.filter(lines, lambda x: x.rlike(WORD)))
    joined = joined.withColumn(
        out,
        F.struct(
            n_lines.cast("long").alias("n_lines"),
            F.size(gone).cast("long").alias("n_dropped"),
            F.length(F.array_join(gone, "")).cast("long").alias("dropped_chars"),
        ),
    ).withColumn(text, left)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(out))


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """Columns as before, ``text`` cleaned and ``n_chars`` brought up to date.

    Copies of a text count as one page here, lest a large group of copies be taken for boilerplate and lost as a whole.
    """
    cleaned = drop_site_boilerplate(docs, distinct=True)
    fresh = {"n_chars": F.length("text").cast("long")}
    return cleaned.select(*[fresh.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op5_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: how many lines it has and loses, and the text that is left."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = drop_site_boilerplate(docs)
    return cleaned.select(
        "doc_id",
        "source",
        *[F.col("line_dedup")[c].alias(c) for c in ("n_lines", "n_dropped", "dropped_chars")],
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_md5"),
    )


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(source, '') AS host, text FROM documents),
l AS (SELECT r, host, i, ls[i] AS line FROM (
        SELECT r, host, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT r, host, string_split(coalesce(text, ''), chr(10)) AS ls FROM d))),
f AS (SELECT * FROM l WHERE regexp_matches(line, '{WORD}')),
t AS (SELECT host, count(*) AS host_pages FROM d GROUP BY host),
bad AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT r) AS pages FROM f GROUP BY host, line)
        JOIN t USING (host) WHERE pages >= {MIN_PAGES} AND pages > {MAX_RATIO}::DOUBLE * host_pages),
j AS (SELECT l.r, l.i, l.line, bad.line IS NOT NULL AS gone, regexp_matches(l.line, '{WORD}') AS has_word
      FROM l LEFT JOIN bad ON l.host = bad.host AND l.line = bad.line),
a AS (SELECT r, count(*) FILTER (WHERE has_word) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
      coalesce(sum(length(line)) FILTER (WHERE gone), 0) AS dropped_chars,
      coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS left_text FROM j GROUP BY r)
SELECT doc_id, source, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped,
    dropped_chars::BIGINT AS dropped_chars, md5(CASE WHEN n_dropped > 0 THEN left_text ELSE coalesce(text, '') END) AS text_md5
FROM d JOIN a USING (r)
"""
