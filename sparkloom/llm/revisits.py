"""Resolution of not-modified WARC revisits: an as-of join to the latest earlier full response of a canonical URL.

A ``304 Not Modified`` capture has no body. It stands for the body of the latest full response (status 200) that was
captured earlier under the same canonical URL, provided that its validator agrees: the entity tag if the revisit sends
one, compared weakly (``W/`` is ignored), else the Last-Modified date. The resolved record has the response's body and
headers, with those headers updated that a 304 may update; all others keep the value stored with the body.

The as-of join doesn't group by URL, since one URL may hold a large share of all captures. Captures are dealt out by
ranges of (URL, time, id), so that a hot URL spans partitions. Inside a partition the last response is a window over
(partition, URL). Only the first URL of a partition can go on from an earlier partition; the answers for these, one row
for each partition at most, are joined back. The range partitioning is checkpointed, so that a lost executor can't
change it.

Defined cases: a null or unusable url, or a null time, resolves to nothing (``no_url``, ``no_time``), and so does a null
record_id, which has no place among captures (``no_response``); of captures at the same time the one with the smaller id
is the earlier; a revisit without an earlier response is ``no_response``, one
without validators ``no_validator``, one that disagrees ``validator_mismatch``. Null header maps are empty, header names
are compared in lower case. Repeated records are resolved each. Urls and header values of any length are taken whole; an
empty table gives an empty result. Further columns and their names don't matter: the operator returns its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, let, read_table
from .urls import CANONICAL, canonical, host_of

# Headers that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
RECORDS = "record_id long, url string, captured timestamp, status int, headers map<string,string>, body string"


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then agree, the first in order of name stays."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return let(
        named,
        lambda n: F.map_from_entries(
            F.filter(n, lambda e, i: F.array_position(F.transform(n, lambda x: x["key"]), e["key"]) == i + 1)
        ),
    )


def _tag(headers: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(headers["etag"]), "^W/", ""), F.lit(""))


#: The months of HTTP dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_TIME = r"(\d{1,2}:\d{2}:\d{2})"
#: The three forms of an HTTP date, and which groups are day, month, year and time.
DATES = (
    (rf"^(?:[a-z]+,? )?(\d{{1,2}}) ([a-z]{{3}})[a-z]* (\d{{4}}) {_TIME} (?:gmt|utc|z|[+-]0000)$", (1, 2, 3, 4)),
    (rf"^(?:[a-z]+,? )?(\d{{1,2}})-([a-z]{{3}})[a-z]*-(\d{{2}}|\d{{4}}) {_TIME} (?:gmt|utc|z|[+-]0000)$", (1, 2, 3, 4)),
    (rf"^(?:[a-z]+,? )?([a-z]{{3}})[a-z]* (\d{{1,2}}) {_TIME} (?:(?:gmt|utc) )?(\d{{4}})$", (2, 1, 4, 3)),
)


def _date(headers: Column) -> Column:
    """The Last-Modified instant as ``yyyy-mm-dd hh:mm:ss``, from any of the three forms of an HTTP date; of any other text
    its lower case in single spaces. Years of two digits from 70 on are of the twentieth century."""
    plain = F.lower(F.trim(F.regexp_replace(headers["last-modified"], r"\s+", " ")))

    def instant(text: Column, pattern: str, places: tuple[int, int, int, int]) -> Column:
        day, month, year, time = (F.regexp_extract(text, pattern, k) for k in places)
        number = F.array_position(F.array(*map(F.lit, MONTHS)), month)
        whole = F.when(F.length(year) == 4, year).when(year >= "70", F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
        two = lambda x: F.lpad(x.cast("string"), 2, "0")
        return F.when(text.rlike(pattern) & (number > 0), F.concat(whole, F.lit("-"), two(number), F.lit("-"), two(day), F.lit(" "), F.lpad(time, 8, "0")))

    return let(plain, lambda x: F.coalesce(*[instant(x, *form) for form in DATES], F.nullif(x, F.lit(""))))


def merged_headers(stored: Column, sent: Column) -> Column:
    """The stored headers, of which the permitted ones are replaced or supplied by those sent."""
    fresh = F.map_filter(sent, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)


#: Bytes of headers that partitions bring along from earlier ones, up to which they are broadcast.
BROUGHT_BYTES = 32 << 20


def latest_responses(captures: DataFrame) -> DataFrame:
    """Revisits with ``earlier``, the latest earlier response as (captured, record_id, headers), or null.

    ``captures`` has key, captured, record_id, is_response and headers, none of the first three null.
    """
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(
        captures.repartitionByRange(n, "key", "captured", "record_id").withColumn("pid", F.spark_partition_id())
    )
    response = F.when(F.col("is_response"), F.struct("captured", "record_id", "headers"))
    before = W.partitionBy("pid", "key").orderBy("captured", "record_id").rowsBetween(W.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last(response, ignorenulls=True).over(before)).where(~F.col("is_response"))
    # What the first URL of a partition brings along from earlier partitions: a row for each partition at most.
    first = dealt.groupBy("pid").agg(F.min("key").alias("key"))
    place = F.struct("captured", "record_id")
    tails = (
        dealt.where("is_response")
        .join(F.broadcast(first.select("key").distinct()), "key", "left_semi")
        .groupBy("key", F.col("pid").alias("from"))
        .agg(F.max(place).alias("at"), F.max_by("headers", place).alias("headers"))
    )
    # For each partition the last of the tails before it: a key has a row for each partition that it spans, twice at most.
    row = W.partitionBy("key").orderBy("pid", "tail").rowsBetween(W.unboundedPreceding, -1)
    marks = first.select("key", "pid", F.lit(0).alias("tail"))
    marks = tails.select("key", F.col("from").alias("pid"), F.lit(1).alias("tail"), "at", "headers").unionByName(marks, allowMissingColumns=True)
    held = F.when(F.col("tail") == 1, F.struct("at.captured", "at.record_id", "headers"))
    brought = checkpointed(
        marks.withColumn("far", F.last(held, ignorenulls=True).over(row)).where((F.col("tail") == 0) & F.col("far").isNotNull()).select("pid", "key", "far")
    )
    # Headers may be of any length: only so many bytes of them are broadcast.
    size = brought.agg(F.sum(F.octet_length(F.to_json("far.headers")) + F.octet_length("key"))).first()[0] or 0
    found = near.join(F.broadcast(brought) if size <= BROUGHT_BYTES else brought, ["pid", "key"], "left")
    return found.select("key", "captured", "record_id", "headers", F.coalesce("near", "far").alias("earlier"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """A row for each revisit (status 304) of ``records``.

    Columns: record_id, canonical, captured, response_id (the latest earlier response, whether or not it agrees),
    resolved, reason and headers (merged; null unless resolved). Join ``response_id`` of resolved rows to ``record_id``
    for the body, or use ``with_bodies``.
    """
    narrow = records.where(F.col("status").isin(200, 304)).select(
        "record_id",
        canonical(F.col("url")).alias("key"),
        "captured",
        (F.col("status") == 200).alias("is_response"),
        _lowered(F.col("headers")).alias("headers"),
    )
    usable = F.col("key").isNotNull() & F.col("captured").isNotNull() & F.col("record_id").isNotNull()
    joined = latest_responses(narrow.where(usable))
    rest = narrow.where(~usable & ~F.col("is_response")).select("key", "captured", "record_id", "headers")
    found = joined.unionByName(rest, allowMissingColumns=True)
    old = F.col("earlier")["headers"]
    tag, date = _tag(F.col("headers")), _date(F.col("headers"))
    agrees = F.when(tag.isNotNull(), tag.eqNullSafe(_tag(old))).otherwise(date.eqNullSafe(_date(old)))
    reason = (
        F.when(F.col("key").isNull(), "no_url")
        .when(F.col("captured").isNull(), "no_time")
        .when(F.col("earlier").isNull(), "no_response")
        .when(tag.isNull() & date.isNull(), "no_validator")
        .when(~agrees, "validator_mismatch")
        .otherwise("resolved")
    )
    judged = found.withColumn("reason", reason)
    resolved = F.col("reason") == "resolved"
    return judged.select(
        "record_id",
        F.col("key").alias("canonical"),
        "captured",
        F.col("earlier")["record_id"].alias("response_id"),
        resolved.alias("resolved"),
        "reason",
        F.when(resolved, merged_headers(old, F.col("headers"))).alias("headers"),
    )


def with_bodies(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the body of their response. A hot response meets its many revisits in a join whose
    skewed partitions Spark splits."""
    bodies = records.where("status = 200").select(F.col("record_id").alias("response_id"), "body")
    return resolved.where("resolved").join(bodies, "response_id", "left")


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures for each page: full responses and a later revisit that sends the validators it knows.

    Times are minutes after the epoch, from the page's id and its url's hash. A quarter of the pages stand for the home
    page of their host, whose body changes every 40 minutes, so that the captures of one canonical URL come from many
    pages. Of the others, some have no response of their own and some change before the revisit. A third of the revisits
    know the date alone, an eighth know nothing, and a few lack url or time.
    """
    minute = lambda m: F.timestamp_seconds(60 * m)
    day = lambda m: F.date_format(F.date_from_unix_date(F.floor(m / 1440).cast("int")), "dd MMM yyyy")
    quoted = lambda x: F.concat(F.lit('"'), F.substring(F.md5(x), 1, 16), F.lit('"'))
    url, html, page = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")), F.col("page_id")
    code = F.conv(F.substring(F.md5(url), 1, 7), 16, 10).cast("long")
    home = (code % 4 == 0) & (host_of(F.col("url")) != "")
    epoch = lambda m: F.concat(host_of(F.col("url")), F.lit("#"), F.floor(m / 40).cast("string"))
    again = page + 2 + code % 5000
    rows = pages.select(
        "page_id", "html", html.alias("whole"), code.alias("code"), home.alias("home"), again.alias("again"),
        F.when(home, F.concat(F.lit("http://"), host_of(F.col("url")), F.lit("/"))).otherwise(F.col("url")).alias("at"),
        F.when(home, quoted(epoch(page))).otherwise(quoted(html)).alias("tag"),
        F.when(home & (code % 5 == 0), quoted(epoch(again))).when(home, quoted(epoch(page))).otherwise(quoted(html)).alias("known"),
    )
    length = F.octet_length("whole").cast("string")

    def response(record: int, later: int, tag: Column) -> Column:
        headers = F.create_map(
            F.lit("ETag"), tag, F.lit("Last-Modified"), F.concat(F.lit("Mon, "), day(page + later), F.lit(" 00:00:00 GMT")),
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), length,
        )
        return F.struct(
            (page * 4 + record).alias("record_id"), F.col("at").alias("url"), minute(page + later).alias("captured"),
            F.lit(200).alias("status"), headers.alias("headers"), F.col("html").alias("body"),
        )

    sent = F.when(F.col("code") % 8 == 1, F.create_map(F.lit("Date"), F.lit("later"))).when(
        F.col("code") % 3 == 0,
        F.create_map(F.lit("last-modified"), F.concat(day(page), F.lit(" 00:00:00 UTC")), F.lit("Date"), F.lit("later")),
    ).otherwise(
        F.create_map(
            F.lit("etag"), F.concat(F.lit("W/"), F.col("known")), F.lit("Expires"), F.lit("soon"), F.lit("Content-Type"), F.lit("text/plain")
        )
    )
    revisit = F.struct(
        (page * 4 + 3).alias("record_id"), F.when(F.col("code") % 29 != 0, F.col("at")).alias("url"),
        F.when(F.col("code") % 31 != 0, minute(F.col("again"))).alias("captured"), F.lit(304).alias("status"),
        sent.alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    own = F.when((F.col("code") % 9 != 0) | F.col("home"), response(0, 0, F.col("tag")))
    changed = F.when((F.col("code") % 7 == 0) & ~F.col("home"), response(1, 1, F.lit('"changed"')))
    return rows.select(F.explode(F.array_compact(F.array(own, changed, revisit))).alias("r")).select("r.*")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the pages: which response it stands for, whether it agrees, and the merged headers."""
    records = captures_of(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = resolve_revisits(records)
    header = lambda k: F.col("headers")[k]
    return found.select(
        "record_id",
        F.expr("record_id div 4").alias("page_id"),
        "canonical",
        "response_id",
        "resolved",
        "reason",
        header("etag").alias("etag"),
        header("content-type").alias("content_type"),
        header("content-length").alias("content_length"),
        header("date").alias("date"),
        header("expires").alias("expires"),
    )


SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html,
        CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest0,
        ('0x' || substr(md5(coalesce(url, '')), 1, 7))::BIGINT AS code FROM pages),
h AS (SELECT *, translate(regexp_extract(rest0, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host0,
        page_id + 2 + code % 5000 AS again FROM p),
a AS (SELECT *, code % 4 = 0 AND host0 <> '' AS home FROM h),
b AS (SELECT *, host0 AS host, CASE WHEN home THEN host0 || '/' ELSE rest0 END AS rest,
        CASE WHEN home THEN '/' ELSE regexp_extract(rest0, '^[^/?#]*([^?#]*)', 1) END AS path,
        CASE WHEN home THEN md5(host0 || '#' || (page_id // 40)) ELSE md5(html) END AS tag0,
        CASE WHEN home AND code % 5 = 0 THEN md5(host0 || '#' || (again // 40)) WHEN home THEN md5(host0 || '#' || (page_id // 40))
             ELSE md5(html) END AS known0 FROM a),
c AS (SELECT *, {CANONICAL} AS canonical, '"' || substr(tag0, 1, 16) || '"' AS tag, '"' || substr(known0, 1, 16) || '"' AS known,
        octet_length(encode(html))::VARCHAR AS len FROM b),
f AS (SELECT 4 * page_id AS record_id, page_id AS at, canonical, tag, page_id // 1440 AS day, len FROM c WHERE code % 9 <> 0 OR home
      UNION ALL SELECT 4 * page_id + 1, page_id + 1, canonical, '"changed"', (page_id + 1) // 1440, len FROM c WHERE code % 7 = 0 AND NOT home),
v AS (SELECT 4 * page_id + 3 AS record_id, page_id, code, CASE WHEN code % 29 <> 0 THEN canonical END AS canonical,
        CASE WHEN code % 31 <> 0 THEN again END AS at, known, page_id // 1440 AS day FROM c),
r AS (SELECT v.record_id, max(f.at::HUGEINT * 1000000000000 + f.record_id) AS place
      FROM v JOIN f ON f.canonical = v.canonical AND v.at IS NOT NULL AND (f.at, f.record_id) < (v.at, v.record_id) GROUP BY 1),
j AS (SELECT v.*, o.record_id AS response_id, o.tag AS old_tag, o.day AS old_day, o.len AS old_len,
        CASE WHEN v.canonical IS NULL THEN 'no_url' WHEN v.at IS NULL THEN 'no_time' WHEN o.record_id IS NULL THEN 'no_response'
             WHEN code % 8 = 1 THEN 'no_validator'
             WHEN code % 3 = 0 AND v.day <> o.day THEN 'validator_mismatch'
             WHEN code % 3 <> 0 AND v.known <> o.tag THEN 'validator_mismatch' ELSE 'resolved' END AS reason
      FROM v LEFT JOIN r USING (record_id) LEFT JOIN f o ON o.record_id = (r.place % 1000000000000)::BIGINT)
SELECT record_id, page_id, canonical, response_id, reason = 'resolved' AS resolved, reason,
    CASE WHEN reason = 'resolved' THEN CASE WHEN code % 3 = 0 THEN old_tag ELSE 'W/' || known END END AS etag,
    CASE WHEN reason = 'resolved' THEN 'text/html' END AS content_type,
    CASE WHEN reason = 'resolved' THEN old_len END AS content_length,
    CASE WHEN reason = 'resolved' AND code % 3 = 0 THEN 'later' END AS date,
    CASE WHEN reason = 'resolved' AND code % 3 <> 0 THEN 'soon' END AS expires
FROM j
"""
