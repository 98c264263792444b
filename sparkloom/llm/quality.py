"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much text are rejected.

Everything is a row-local expression over arrays of lines and words: no shuffle, no Python, one pass over the text.

Defined cases: a null or empty text has no words and is rejected; a text of blank lines likewise; an empty table gives
an empty result; a text of any length is judged whole. Blank lines are kept as they are and count neither as text nor as
loss. Repeated rows are judged alike, each on its own; a document exactly at a limit passes. Null ids and further
columns pass through, and the new column takes a free name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, free_name, let, read_table

#: Default phrases of page furniture, lower case, in the corpus's four languages; give ``LineRules`` others as needed.
FURNITURE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum",
    "privacy policy", "subscribe to our", "terms of service", "terms of use",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "javascript aktivieren",
    "nutzungsbedingungen",
    "accepter les cookies", "cliquez ici", "conditions générales", "mentions légales", "politique de confidentialité",
    "tous droits réservés",
    "aceptar cookies", "haga clic aquí", "política de privacidad", "todos los derechos reservados", "términos de uso",
)
SYMBOL = r"[#*$%&|<>]"
SHOUTED = r"[A-ZÀ-ÖØ-Þ]"
BANG = r"[!?]"
BAR = r" [|>»·] "
STOP = r"[.!?:;]"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules (shares in per cent of the line's characters) and of the verdict."""

    max_symbols: int = 10
    max_shouted: int = 60
    max_bangs: int = 5
    max_bars: int = 2
    min_words_for_end: int = 8
    min_letters_for_shout: int = 12
    max_loss: int = 50
    min_words: int = 50
    max_repeat: int = 50
    #: Phrases without characters that are special in a regular expression; a line of at most so many words that has
    #: one is furniture, while a longer one may be prose about it.
    furniture: tuple[str, ...] = FURNITURE
    max_furniture_words: int = 12


def _count(line: Column, pattern: str) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, pattern, ""))


def _words(line: Column) -> Column:
    return F.size(F.split(line, r"[\x20\x09-\x0D]+", -1))


def _furniture(line: Column, rules: LineRules) -> Column:
    if not rules.furniture:
        return F.lit(False)
    return F.lower(line).rlike("|".join(rules.furniture)) & (_words(line) <= rules.max_furniture_words)


def line_fails(line: Column, rules: LineRules) -> Column:
    """True if any rule rejects the line: punctuation, navigation or boilerplate."""
    n = F.length(line)
    return (
        (_count(line, SYMBOL) * 100 > n * rules.max_symbols)
        | (_count(line, BANG) * 100 > n * rules.max_bangs)
        | ((n >= rules.min_letters_for_shout) & (_count(line, SHOUTED) * 100 > n * rules.max_shouted))
        | (F.size(F.split(line, BAR, -1)) - 1 > rules.max_bars)
        | _furniture(line, rules)
        | (~line.rlike(STOP) & (_words(line) >= rules.min_words_for_end))
    )


def may_fail(text: Column, lowered: Column, n_symbols: Column, rules: LineRules) -> Column:
    """False only if no line of the text can fail: the same rules in a form that few scans of the text answer.

    A line of more capitals than half has two that adjoin; where fewer are enough to fail, any capital counts. A line of
    w parts between white space, of which the first and the last may be empty, has 2w - 3 characters at least.
    """
    unstopped = r"\n[^.!?:;\n]{%d,}+\n" % max(1, 2 * rules.min_words_for_end - 3)
    shouted = SHOUTED * 2 if rules.max_shouted >= 50 else SHOUTED
    return reduce(
        or_,
        [lowered.contains(phrase) for phrase in rules.furniture],
        (n_symbols > 0)
        | text.rlike(f"[!?>»·]|{shouted}")
        | F.concat(F.lit("\n"), text, F.lit("\n")).rlike(unstopped),
    )


def covered_words(places: Column) -> Column:
    """The size of the union of [p, p + 2] over sorted places p."""
    return F.aggregate(
        F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, b: a + b,
    )


def repeated_places(hashes: Column, in_order: Column) -> Column:
    """Places of the windows whose hash occurs twice or more; ``in_order`` are the sorted hashes.

    Few repeated hashes are looked up directly; many are found by sorting (hash, place) pairs, so that a text of
    repeated windows takes no longer than n log n.
    """

    def by_sorting() -> Column:
        pairs = F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
        return let(
            F.sort_array(pairs),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["p"],
                )
            ),
        )

    def by_lookup(again: Column) -> Column:
        return F.filter(
            F.transform(hashes, lambda h, p: F.when(F.array_contains(again, h), p)), lambda p: p.isNotNull()
        )

    again = F.array_distinct(F.filter(in_order, lambda h, i: F.coalesce(F.get(in_order, i + 1) == h, F.lit(False))))
    return let(again, lambda a: F.when(F.size(a) <= 16, by_lookup(a)).otherwise(by_sorting()))


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """``docs`` with a last column, the struct ``quality``: counts, ``base_failed``, ``kept`` and the cleaned text.

    The work is laid out in steps so that each array is made once, and so that most documents, in which no line can
    fail and no window repeats, skip the costly parts.
    """
    name = {k: free_name(docs, f"_{k}") for k in ("t", "w", "l", "h", "s", "n", "m", "c", "q", "low")}
    t, w, lines, h, s, n, m, c, q, low = (F.col(x) for x in name.values())
    step = docs.withColumn(name["t"], F.coalesce(F.col(text), F.lit("")))
    step = step.withColumns({
        name["w"]: F.array_remove(F.split(t, r"[\x20\x09-\x0D]+", -1), ""),
        name["low"]: F.lower(t),
        name["l"]: F.split(t, "\n", -1),
        name["n"]: _count(t, SYMBOL).cast("long"),
    })
    # Windows of three words as 64-bit hashes; none in a text of fewer words.
    step = step.withColumns({
        name["h"]: F.when(
            F.size(w) > 3,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
        name["m"]: may_fail(t, low, n, rules),
    })
    step = step.withColumn(name["s"], F.sort_array(h))
    good = F.filter(lines, lambda x: ~x.rlike(WORD) | ~line_fails(x, rules))
    full = F.filter(lines, lambda x: x.rlike(WORD))

    def chars(a: Column) -> Column:
        return F.aggregate(F.filter(a, lambda x: x.rlike(WORD)), F.lit(0).cast("long"), lambda b, x: b + F.length(x))

    step = step.withColumn(
        name["c"],
        F.when(
            m,
            let(good, lambda g: F.struct(
                F.array_join(g, "\n").alias("text"), chars(g).alias("left"), chars(lines).alias("all")
            )),
        ),
    )
    step = step.withColumn(
        name["q"],
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            n.alias("n_symbols"),
            F.when(
                F.size(F.array_distinct(lines)) < F.size(lines),
                let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))),
            ).otherwise(F.lit(0)).cast("long").alias("n_dup_lines"),
            F.when(
                F.size(F.array_distinct(h)) < F.size(h), let(repeated_places(h, s), covered_words)
            ).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
            F.when(m, c["all"] - c["left"]).otherwise(F.lit(0).cast("long")).alias("lost_chars"),
            F.when(m, c["all"]).otherwise(F.lit(0).cast("long")).alias("line_chars"),
            F.when(m, c["text"]).otherwise(t).alias("clean_text"),
        ),
    )
    failed = (q["n_words"] < rules.min_words) | (100 * q["n_repeat_words"] > rules.max_repeat * q["n_words"])
    kept = ~failed & (100 * q["lost_chars"] <= rules.max_loss * q["line_chars"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "clean_text")
    return step.select(
        *[F.col(f"`{x}`") for x in docs.columns],
        F.struct(*[q[x].alias(x) for x in counts], failed.alias("base_failed"), kept.alias("kept")).alias(
            free_name(docs, "quality")
        ),
    )


def keep_clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, without their failing lines; columns as before, ``n_chars`` brought up to date."""
    judged = clean_lines(docs, rules)
    *own, found = judged.columns
    # A generator of one row: else the filter would be pushed below the steps, with copies of all their expressions.
    kept = judged.select(*[F.col(f"`{c}`") for c in own], F.explode(F.array(found)).alias(found)).where(F.col(found)["kept"])
    clean = F.col(found)["clean_text"]
    fresh = {"text": clean, "n_chars": F.length(clean).cast("long")}
    return kept.select(*[fresh.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    names = (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept",
    )
    return clean_lines(docs).select("doc_id", *[F.col("quality")[c].alias(c) for c in names])


def _sql() -> str:
    rules, word = LineRules(), WORD

    def count(pattern: str) -> str:
        return f"(length(line) - length(regexp_replace(line, '{pattern}', '', 'g')))"

    phrases, parts = "|".join(rules.furniture), "len(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{word}') AS ws FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(*) AS n_repeat_words
        FROM (SELECT DISTINCT r, i + k AS p FROM rep, (VALUES (0), (1), (2)) t(k)) GROUP BY r),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '{word}')),
judged AS (SELECT r, line,
    {count(SYMBOL)} * 100 > length(line) * {rules.max_symbols}
    OR {count(BANG)} * 100 > length(line) * {rules.max_bangs}
    OR (length(line) >= {rules.min_letters_for_shout} AND {count(SHOUTED)} * 100 > length(line) * {rules.max_shouted})
    OR len(regexp_split_to_array(line, '{BAR}')) - 1 > {rules.max_bars}
    OR (regexp_matches(lower(line), '{phrases}') AND {parts} <= {rules.max_furniture_words})
    OR ({parts} >= {rules.min_words_for_end}
        AND NOT regexp_matches(line, '{STOP}')) AS bad FROM lines),
per AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) AS chars,
        coalesce(sum(length(line)) FILTER (WHERE bad), 0) AS lost FROM judged GROUP BY r),
m AS (SELECT d.doc_id, len(ws) AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(lost, 0) AS lost, coalesce(chars, 0) AS chars
    FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN per USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, lost::BIGINT AS lost_chars,
    (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat} * n_words) AS base_failed,
    (NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat} * n_words)
     AND 100 * lost <= {rules.max_loss} * chars) AS kept
FROM m
"""


SQL = _sql()
