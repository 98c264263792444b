"""URL verdicts: host rules first, then a blocked Bloom filter of listed canonical URLs backed by an exact join.

The filter is a table of blocks, each of eight 64-bit words; a URL's hash picks the block and one bit in each word, so
a lookup touches one row. It is built by ``bit_or`` with partial aggregation and sized by the list: a block for each
``URLS_PER_BLOCK`` listed URLs, ``MOST_BLOCKS`` at most. That is the proven bound under which it is broadcast (524,288
rows of ten longs, 42 MB, for 17 million URLs at their planned density). A longer list only means more false positives.
Possible hits, and they alone, meet the whole list in a hash join on the canonical URL, which removes them.

Defined cases: a null url or one without ``://`` has empty host and path, no canonical form, and is allowed; of rules of
equal length that fit, which can't differ in host and path, one counts; repeated list entries count once; repeated pages
are judged each; an empty list blocks nothing; an empty table of pages gives an empty result; urls of any length are
taken whole; further columns of pages pass through, and the new one takes a free name.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, read_table

WORDS = 8
#: 16 bits for each listed URL.
URLS_PER_BLOCK = 32
MOST_BLOCKS = 524_288

# Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Query parameters that name a visit rather than a page; a prefix if it ends in an underscore.
TRACKING = ("utm_", "fbclid", "gclid", "ref", "sessionid", "sid")
TRACKED = "^(?:" + "|".join(x + "[^=]*" if x.endswith("_") else x for x in TRACKING) + ")(?:=|$)"
#: Parameter of the query: first labels of hosts of which most URLs are listed.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^?#]*\?([^#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without ``.html`` or a closing slash, and the query's parameters in order.

    Scheme, fragment and the parameters that ``TRACKING`` names go. Null for a url without a host.
    """
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    kept = F.array_sort(F.filter(F.split(query_of(url), "&", -1), lambda p: (p != "") & ~p.rlike(TRACKED)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), r"(\.html|/)$", ""), query))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule = F.when(fits, F.lit(at + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _bit(url: Column, word: int) -> Column:
    place = F.shiftrightunsigned(F.xxhash64(F.lit("bits"), url), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def blocks_for(listed: int) -> int:
    """Blocks for so many URLs: a power of two, within limits."""
    return min(MOST_BLOCKS, 1 << max(0, (max(1, listed) // URLS_PER_BLOCK).bit_length()))


def bloom_filter(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """(block, w0 .. w7); at most ``blocks`` rows."""
    u = F.col(url)
    return listed.groupBy(_block(u, blocks).alias("block")).agg(
        *[F.bit_or(_bit(u, k)).alias(f"w{k}") for k in range(WORDS)]
    )


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    url: str = "url",
    rules: tuple = RULES,
    blocks: int | None = None,
) -> DataFrame:
    """``pages`` with a struct column ``url_verdict``: host, path, rule, verdict, canonical and listed.

    ``listed`` has a column ``url`` of canonical URLs; ``blocks`` overrides the filter's size, which is counted else.
    """
    out, key = free_name(pages, "url_verdict"), free_name(pages, "_canonical")
    listed = listed.select("url").where(F.col("url").isNotNull()).distinct()
    blocks = blocks or blocks_for(listed.count())
    bits = bloom_filter(listed, "url", blocks).withColumnsRenamed(
        {c: free_name(pages, f"_{c}") for c in ("block", *[f"w{k}" for k in range(WORDS)])}
    )
    block, *words = bits.columns
    marked = pages.withColumn(key, canonical(F.col(url)))
    at = F.col(key)
    hit = reduce(and_, [F.col(w).bitwiseAND(_bit(at, k)) != 0 for k, w in enumerate(words)])
    looked = marked.join(F.broadcast(bits), _block(at, blocks) == F.col(f"`{block}`"), "left")
    possible = F.coalesce(hit & at.isNotNull(), F.lit(False))
    flag, sure = free_name(pages, "_possible"), free_name(pages, "_listed")
    own = [F.col(f"`{c}`") for c in pages.columns]
    looked = looked.select(*own, at, possible.alias(flag))
    exact = listed.select(F.col("url").alias(key), F.lit(True).alias(sure))
    hits = looked.where(F.col(flag)).join(exact, key, "left").select(*own, at, flag, sure)
    rest = looked.where(~F.col(flag)).select(*own, at, flag, F.lit(None).cast("boolean").alias(sure))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = rule_for(host, path, rules)
    is_listed = F.coalesce(F.col(sure), F.lit(False))
    return rest.unionByName(hits).select(
        *own,
        F.struct(
            host.alias("host"),
            path.alias("path"),
            rule.alias("rule"),
            F.coalesce(verdict, F.when(is_listed, "block").otherwise("allow")).alias("verdict"),
            at.alias("canonical"),
            is_listed.alias("listed"),
        ).alias(out),
    )


def _digit(url: Column, n: int) -> Column:
    return F.substring(F.md5(url), 1, n)


def listed_urls(pages: DataFrame) -> DataFrame:
    """A list for this corpus, as a feed would give it, apart from what the pages' hosts tell.

    Of canonical URLs on hosts with a listed label three quarters are in it, and of all others one in 64, by their hash;
    for every canonical URL it also has two that no page has. So it's longer than the table of pages.
    """
    label = F.regexp_extract(host_of(F.col("url")), r"^(?:www\.|m\.|blog\.)?([^.]+)\.", 1)
    urls = pages.select(canonical(F.col("url")).alias("url"), label.isin(*LISTED_LABELS).alias("bad")).where("url IS NOT NULL")
    url = F.col("url")
    known = urls.where(F.when(F.col("bad"), _digit(url, 1) < "c").otherwise(_digit(url, 2).isin("3a", "7b", "c5", "e8"))).select("url")
    gone = urls.select(F.explode(F.array(F.concat(url, F.lit("/old")), F.concat(url, F.lit("/gone")))).alias("url"))
    return known.union(gone).distinct()


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, listed_urls(pages))
    names = ("host", "path", "rule", "verdict", "canonical", "listed")
    return judged.select("page_id", *[F.col("url_verdict")[c].alias(c) for c in names])


#: The canonical form in SQL, from columns rest (of the url behind its scheme), host and path.
CANONICAL = rf"""CASE WHEN regexp_replace(host, '^(www|m)\.', '') <> '' THEN
        regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') || coalesce('?' || nullif(array_to_string(
        list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKED}'))), '&'), ''), '') END"""


def _sql() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [
        f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{start}') THEN "
        for _, at, start in ordered
    ]
    rule = " ".join(f + f"'{r[1] + r[2]}'" for f, r in zip(fits, ordered, strict=True))
    verdict = " ".join(f + f"'{r[0]}'" for f, r in zip(fits, ordered, strict=True))
    labels = ", ".join(f"'{x}'" for x in LISTED_LABELS)
    lower = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
b AS (SELECT page_id, rest, {lower} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {CANONICAL} AS canonical FROM b),
k AS (SELECT canonical AS url, md5(canonical) AS digest,
        regexp_extract(host, '^(?:www\\.|m\\.|blog\\.)?([^.]+)\\.', 1) IN ({labels}) AS bad FROM c WHERE canonical IS NOT NULL),
l AS (SELECT DISTINCT url FROM k
      WHERE CASE WHEN bad THEN digest[1] < 'c' ELSE digest[1:2] IN ('3a', '7b', 'c5', 'e8') END
      UNION SELECT url || unnest(['/old', '/gone']) FROM k)
SELECT page_id, host, path, CASE {rule} END AS rule,
    coalesce(CASE {verdict} END, CASE WHEN l.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
    canonical, l.url IS NOT NULL AS listed
FROM c LEFT JOIN l ON c.canonical = l.url
"""


SQL = _sql()
