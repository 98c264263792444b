"""Lexical retrieval: expanded terms, overlap and phrase scores, and the best rows of each query.

Rows are found by postings of the terms that are asked for, rarest terms first; bounds on what a row can still reach keep
postings of common terms and looks into texts few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import STANDARD, let, share_of, words
from .storage import stored

#: Postings of a query that are read for its first bounds, as a multiple of the rows that are asked for.
SEEDS = 200
# Weights of lexical overlap, phrases, sequence quality and metadata.
WEIGHTS = (0.52, 0.18, 0.18, 0.12)


def expanded(terms: Column, synonyms: dict[str, tuple[str, ...]]) -> Column:
    """The distinct terms of two characters or more, with the synonyms of each."""
    if synonyms:
        table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        terms = F.concat(terms, F.flatten(F.transform(terms, lambda t: F.coalesce(table[t], F.array().cast("array<string>")))))
    return F.filter(F.array_distinct(terms), lambda t: F.length(t) > 1)


def phrases(tokens: Column) -> Column:
    """All runs of two and of three tokens, repeats included, as texts."""
    def runs(size: int) -> Column:
        last = F.size(tokens) - size
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(tokens, i + 1, size), " "))

    return F.concat(runs(2), runs(3))


def phrase_score(query_phrases: Column, text: Column) -> Column:
    """The share of the query's phrases that occur in a text of single-spaced tokens; 0 without phrases."""
    hits = F.size(F.filter(query_phrases, lambda p: F.contains(text, p)))
    return F.when((F.size(query_phrases) == 0) | (text == ""), 0.0).otherwise(hits / F.size(query_phrases))


def filled_share(*values: Column) -> Column:
    """The share of values that aren't blank."""
    filled = sum((F.when(F.coalesce(F.trim(v), F.lit("")) != "", 1).otherwise(0) for v in values), F.lit(0))
    return filled / F.lit(float(len(values)))


@dataclass(frozen=True)
class Postings:
    """What queries ask of rows: ``asked`` (query, term, nq, rank, before), rank 1 for the term that the fewest rows hold and
    before for the postings of rarer ones; ``held`` (term, key, n, ..carried), the postings of these terms alone; ``sets``
    and ``wanted``, the asked terms of each row and of each query as arrays."""

    query: str
    key: str
    asked: DataFrame
    held: DataFrame
    sets: DataFrame
    wanted: DataFrame

    @classmethod
    def of(cls, queries: DataFrame, rows: DataFrame, query: str, key: str, carried: tuple[str, ...] = ()) -> Postings:
        """Both inputs have an array ``terms`` of distinct terms."""
        wanted = stored(queries.select(query, "terms"), "queries")
        asked = wanted.select(query, F.size("terms").alias("nq"), F.explode("terms").alias("term"))
        each = rows.select(key, *carried, F.size("terms").alias("n"), F.explode("terms").alias("term"))
        held = stored(each.join(asked.select("term").distinct(), "term", "left_semi"), "postings")
        count = held.groupBy("term").agg(F.count("*").alias("df"))
        place = W.partitionBy(query).orderBy("df", "term")
        before = F.coalesce(F.sum("df").over(place.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        met = asked.join(count, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        ranked = met.select(query, "term", "nq", F.row_number().over(place).alias("rank"), before.alias("before"))
        # A row's asked terms are few, whatever its length.
        sets = held.groupBy(key, "n", *carried).agg(F.collect_list("term").alias("_of_row"))
        return cls(query, key, stored(ranked, "asked"), held, stored(sets, "row-terms"), wanted)

    def shared(self, pairs: DataFrame) -> DataFrame:
        """(query, key, n, nq, ..carried, shared) of pairs: how many of its terms a row shares with a query."""
        wanted = self.wanted.select(self.query, F.size("terms").alias("nq"), F.col("terms").alias("_of_query"))
        met = pairs.join(self.sets, self.key).join(wanted, self.query)
        return met.withColumn("shared", F.size(F.array_intersect("_of_row", "_of_query"))).drop("_of_row", "_of_query")

    def seeds(self, k: int) -> DataFrame:
        """The rows that share most of the rarer terms of each query: four times ``k``, of some hundred times as many postings."""
        few = self.asked.where(F.col("before") < SEEDS * k).join(self.held, "term")
        partial = few.groupBy(self.query, self.key, "n", "nq").agg(F.count("*").alias("shared"))
        best = best_of(partial.withColumn("score", _overlap()), self.query, self.key, 4 * k)
        return best.select(self.query, self.key)


def sharing_at_least(postings: Postings, least: DataFrame) -> DataFrame:
    """The pairs (query, key) whose overlap may reach ``least`` (query, bound).

    To reach it, a row of n terms must share ``m = bound * sqrt(nq * n)`` terms, hence one of the ``nq - m + 1`` rarest of the
    query: the postings of common terms are read for short rows only, and for queries without a bound.
    """
    m = F.greatest(F.lit(1), F.ceil(F.col("bound") * F.sqrt((F.col("nq") * F.col("n")).cast("double")) - 1e-9))
    bounded = postings.asked.join(least, postings.query, "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    met = bounded.join(postings.held, "term").where(F.col("rank") <= F.col("nq") - m + 1)
    return met.select(postings.query, postings.key).distinct()


def _overlap() -> Column:
    return F.col("shared") / F.sqrt((F.col("n") * F.col("nq")).cast("double"))


def _kth(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(query, bound): the k-th best score so far, where there are so many."""
    return best_of(scored, query, key, k).where(F.col("rank") == k).select(query, F.col("score").alias("bound"))


def best_overlaps(queries: DataFrame, rows: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(query, key, score, rank): the ``k`` rows that overlap most with each query, of equals the smallest key.

    Both have an array ``terms``. A query's rarest terms find rows for a first bound; rows that may exceed it are then found by
    the terms that they can't all lack. Rows that share nothing fill up by their key.
    """
    postings = Postings.of(queries, rows, query, key)
    scored = lambda pairs: postings.shared(pairs).select(query, key, _overlap().alias("score"))
    bound = stored(_kth(scored(postings.seeds(k)), query, key, k), "bounds")
    found = scored(sharing_at_least(postings, bound)).where("score > 0")
    # Of the 2k smallest keys at least k are left where fewer than k rows share a term.
    first = [r[0] for r in rows.select(key).orderBy(F.asc_nulls_first(key)).limit(2 * k).collect()]
    if first:
        kind = rows.schema[key].dataType.simpleString()
        none = queries.select(query, F.explode(F.array(*map(F.lit, first)).cast(f"array<{kind}>")).alias(key), F.lit(0.0).alias("score"))
        found = found.unionByName(none).groupBy(query, key).agg(F.max("score").alias("score"))
    return best_of(found, query, key, k)


def ranked(
    queries: DataFrame, rows: DataFrame, query: str, key: str, k: int, sequence: str | None = None, filled: tuple[str, ...] = (),
    synonyms: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """(query, key, score, rank): the ``k`` best rows of each query, of equals the smallest key.

    Both have a column ``text``. The score weighs the overlap of terms, the share of the query's phrases in the text, the
    share of standard residues in ``sequence`` and the share of ``filled`` columns that aren't blank. Terms are looked up in
    postings; a row's phrases are looked at only if the rest of its score leaves it a chance.
    """
    a, b, c, d = WEIGHTS
    tokens = lambda x: words(F.coalesce(F.col(x), F.lit("")))
    quality = share_of(F.col(sequence), STANDARD) if sequence else F.lit(0.0)
    special = filled_share(*map(F.col, filled)) if filled else F.lit(0.0)
    plain = rows.select(F.col(key), tokens("text").alias("t"), (c * quality + d * special).alias("static"))
    plain = stored(plain.select(key, F.array_distinct("t").alias("terms"), F.array_join("t", " ").alias("plain"), "static"), "plain")
    asks = queries.select(query, tokens("text").alias("t")).select(
        query, expanded(F.col("t"), synonyms or {}).alias("terms"), phrases(F.col("t")).alias("q_phrases"), F.col("t")
    )
    postings = Postings.of(asks, plain, query, key, ("static",))
    partial = (a * _overlap() + F.col("static")).alias("score")

    # Whatever a query shares, rows that aren't among the k best by the rest can only rank by what they share.
    best = plain.select(key, "static").orderBy(F.desc("static"), F.asc_nulls_first(key)).limit(k).collect()
    if not best:
        return asks.where(F.lit(False)).select(query, F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    kind = f"array<struct<{key}:{rows.schema[key].dataType.simpleString()},score:double>>"
    some = F.array(*[F.struct(F.lit(r[0]), F.lit(r[1])) for r in best]).cast(kind)
    static = asks.select(query, F.explode(some).alias("s")).select(query, f"s.{key}", "s.score")

    def scored(pairs: DataFrame) -> DataFrame:
        both = postings.shared(pairs).select(query, key, partial).unionByName(static)
        return both.groupBy(query, key).agg(F.max("score").alias("score"))

    bound = stored(_kth(scored(postings.seeds(k)), query, key, k), "bounds")
    need = bound.select(query, F.greatest(F.lit(0.0), (F.col("bound") - b - best[0]["static"]) / a).alias("bound"))
    parts = stored(scored(sharing_at_least(postings, need)), "partial-scores")
    chance = parts.join(_kth(parts, query, key, k), query, "left").where(F.coalesce(F.col("score") + b >= F.col("bound") - 1e-9, F.lit(True)))

    def whole(pairs: DataFrame) -> DataFrame:
        met = pairs.join(plain.select(key, "plain"), key).join(asks.select(query, "q_phrases"), query)
        score = F.col("score") + b * phrase_score(F.col("q_phrases"), F.col("plain"))
        return met.select(query, key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))

    final = stored(best_of(whole(chance), query, key, k), "best")
    # A phrase of two tokens may lie across the ends of longer ones, in a row that shares no whole term.
    pairs_of = F.transform(F.filter("q_phrases", lambda p: F.size(F.split(p, " ")) == 2), _edge)
    open_to = asks.join(_kth(final, query, key, k), query, "left").where(
        (F.size(pairs_of) > 0)
        & F.coalesce(b * F.size(pairs_of) / F.size("q_phrases") + best[0]["static"] >= F.col("bound") - 1e-9, F.lit(True))
    )
    wanted = stored(open_to.select(query, F.explode(F.array_distinct(pairs_of)).alias("edge")), "edges")
    if wanted.isEmpty():
        return final
    own = F.transform(F.sequence(F.lit(0), F.size("terms") - 2), lambda i: _edge(F.array_join(F.slice("t", i + 1, 2), " ")))
    edges = plain.withColumn("t", F.split("plain", " ")).withColumn("terms", F.col("t"))
    edges = edges.where(F.size("t") > 1).select(key, "static", F.explode(F.array_distinct(own)).alias("edge"))
    more = wanted.join(edges, "edge").select(query, key, F.col("static").alias("score")).distinct()
    more = more.join(parts.select(query, key), [query, key], "left_anti")
    return best_of(final.drop("rank").unionByName(whole(more)), query, key, k)


def _edge(phrase: Column) -> Column:
    """The last character of a phrase's first token and the first of its second."""
    return F.regexp_extract(phrase, "(. .)", 1)


def best_of(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(.., rank): the ``k`` rows of the highest ``score`` of each query, of equals the smallest key.

    Spark keeps the k best of a query in each task before the shuffle, as the rank is bounded.
    """
    place = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def best_skills(rows: DataFrame, text: str, key: str, asked: str, k: int = 4, least: int = 2) -> DataFrame:
    """The ``k`` rows that share most terms with a question, ``least`` at least; of equals the smallest key."""
    mine = F.array_distinct(words(F.coalesce(F.col(text), F.lit(""))))
    shared = let(words(F.lit(asked)), lambda q: F.size(F.array_intersect(mine, q)))
    return rows.select(key, shared.alias("shared")).where(F.col("shared") >= least).orderBy(F.desc("shared"), key).limit(k)
