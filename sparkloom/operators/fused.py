"""Arrays of token ids: k-mer vocabularies and codes, fused profile-sequence rows, labels, logits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import free_name, let
from .kmers import kmer_state, numbered_kmers
from .tokens import kmers

# The first ids.
PAD, BOS, EOS, UNKNOWN = 0, 1, 2, 3
SPECIALS = 4


def kmer_vocabulary(rows: DataFrame, sequence: str, order: str, k: int, stride: int = 1, most: int | None = None) -> DataFrame:
    """(kmer, id): k-mers numbered behind the special ids in order of their first place; a place is (row, position).

    First places are pre-aggregated minima. Numbers are dealt out over a sort of the distinct k-mers, of which there are
    at most 22 to the power of k for residues; ``most`` bounds them.
    """
    if stride == 1:
        state = kmer_state(rows, order, sequence, k)
    else:
        each = rows.select(F.col(order).alias("row"), F.posexplode(kmers(F.col(sequence), k, stride)).alias("at", "kmer"))
        state = each.groupBy("kmer").agg(F.min(F.struct("row", "at")).alias("first")).select("kmer", "first.row", "first.at")
    found = numbered_kmers(state, SPECIALS)
    return found.where(F.col("id") < SPECIALS + most) if most else found


def kmer_codes(rows: DataFrame, sequence: str, key: str, vocabulary: DataFrame, k: int, stride: int = 1) -> DataFrame:
    """(key, ids) with the first and the last id around; a k-mer that the vocabulary lacks has the id for unknown ones.

    The vocabulary is broadcast as a join's small side where Spark finds it small, and shuffled else.
    """
    each = rows.select(key, F.posexplode(kmers(F.col(sequence), k, stride)).alias("at", "kmer"))
    coded = each.join(vocabulary, "kmer", "left").select(key, "at", F.coalesce("id", F.lit(UNKNOWN)).alias("id"))
    ids = coded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("s"))
    inner = F.transform("s", lambda s: s["id"])
    return ids.select(key, F.concat(F.array(F.lit(BOS)), inner, F.array(F.lit(EOS))).alias("ids"))


def merged_kmers(tokens: Column, k: int) -> Column:
    """The text of k-mers at stride 1; null if two neighbours don't overlap in k - 1 characters."""
    fits = F.forall(
        F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
                   lambda a, b: F.substr(a, F.lit(2)) == F.substring(b, 1, k - 1)),
        lambda ok: ok,
    )
    last = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: F.substr(t, F.lit(k)))
    return F.when(F.size(tokens) == 0, "").when(fits, F.concat(tokens[0], F.array_join(last, "")))


@dataclass(frozen=True)
class Layout:
    """Disjoint ranges of ids: the sequence's from 0, the profile's behind them, the separator last."""

    sequence_size: int
    profile_size: int

    def __post_init__(self) -> None:
        if self.sequence_size <= SPECIALS or self.profile_size <= 0:
            raise ValueError("both vocabularies need ids of their own")

    @property
    def separator(self) -> int:
        return self.sequence_size + self.profile_size

    @property
    def size(self) -> int:
        return self.separator + 1

    def of_profile(self, ids: Column) -> Column:
        """Ids of the profile in their range; an id outside is an error."""
        fault = F.raise_error(F.lit("a profile id is outside its range")).cast("int")
        return F.transform(ids, lambda x: F.when((x >= 0) & (x < self.profile_size), x + self.sequence_size).otherwise(fault))

    def of_sequence(self, ids: Column) -> Column:
        fault = F.raise_error(F.lit("a sequence id is outside its range")).cast("int")
        return F.transform(ids, lambda x: F.when((x >= 0) & (x < self.sequence_size), x).otherwise(fault))


def trimmed(ids: Column) -> Column:
    """Without a first id for the beginning and a last one for the end."""
    begin = F.when(F.get(ids, F.lit(0)) == BOS, 1).otherwise(0)
    end = F.when(F.try_element_at(ids, F.lit(-1)) == EOS, 1).otherwise(0)
    return F.slice(ids, begin + 1, F.greatest(F.size(ids) - begin - end, F.lit(0)))


def fused(profile: Column, sequence: Column, layout: Layout) -> Column:
    """(ids, separator_at, sequence_start, sequence_end): beginning, profile, separator, sequence, end."""

    def of(p: Column) -> Column:
        def made(s: Column) -> Column:
            at = F.size(p) + 1
            ids = F.concat(F.array(F.lit(BOS)), p, F.array(F.lit(layout.separator)), s, F.array(F.lit(EOS)))
            return F.struct(ids.alias("ids"), at.alias("separator_at"), (at + 1).alias("sequence_start"), (at + 1 + F.size(s)).alias("sequence_end"))

        return let(layout.of_sequence(trimmed(sequence)), made)

    return let(layout.of_profile(trimmed(profile)), of)


def causal_labels(row: Column, on_prompt: bool = False, on_separator: bool = False, on_end: bool = True, ignored: int = -100) -> Column:
    """Labels of a fused row, shifted by one: those of the sequence, and by choice of separator, end and prompt."""
    ids = row["ids"]
    start = F.lit(1) if on_prompt else row["separator_at"] if on_separator else row["sequence_start"]
    end = row["sequence_end"] + 1 if on_end else row["sequence_end"]
    shifted = F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))
    return F.transform(shifted, lambda x, i: F.when((i + 1 >= start) & (i + 1 < end), x).otherwise(ignored))


def penalised(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of seen ids divided by the penalty if positive, else multiplied by it."""
    if penalty <= 0:
        raise ValueError("the penalty must be positive")
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


LOW = float("-inf")


def allowed(logits: Column, ids: Column) -> Column:
    return F.transform(logits, lambda x, i: F.when(F.array_contains(ids, i), x).otherwise(F.lit(LOW)))


def top_k(logits: Column, k: int) -> Column:
    """Values that reach the k-th largest stay, ties with it too; the rest is minus infinity."""
    if k <= 0:
        return logits
    least = lambda s: F.get(s, F.least(F.lit(k), F.size(s)) - 1)
    return let(F.sort_array(logits, asc=False), lambda s: F.transform(logits, lambda x: F.when(x >= least(s), x).otherwise(F.lit(LOW))))


def softmax(logits: Column) -> Column:
    def of(top: Column) -> Column:
        return let(F.transform(logits, lambda x: F.exp(x - top)), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))

    return let(F.array_max(logits), of)


def top_p(logits: Column, p: float) -> Column:
    """The largest values whose probabilities first reach ``p`` stay, one at least; of equals the first in order."""
    if p >= 1:
        return logits

    def of(probabilities: Column) -> Column:
        ranked = F.array_sort(F.transform(probabilities, lambda x, i: F.struct((-x).alias("less"), i.alias("i"))))

        def add(s: Column, x: Column) -> Column:
            # An id stays if the probabilities before it don't reach p.
            return F.struct((s["upto"] - x["less"]).alias("upto"), (s["n"] + (s["upto"] < p).cast("int")).alias("n"))

        def kept(r: Column) -> Column:
            count = F.aggregate(r, F.struct(F.lit(0.0).alias("upto"), F.lit(0).alias("n")), add)["n"]
            stays = lambda last: F.transform(probabilities, lambda x, i: F.struct((-x).alias("less"), i.alias("i")) <= last)
            return let(let(F.get(r, count - 1), stays), lambda k: F.zip_with(logits, k, lambda x, y: F.when(y, x).otherwise(F.lit(LOW))))

        return let(ranked, kept)

    return let(softmax(logits), of)


def greedy(logits: Column, seen: Column, penalty: float = 1.0) -> Column:
    """The id of the largest value after the penalty, the first of equals."""
    return let(penalised(logits, seen, penalty), lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))


def with_next_token(
    df: DataFrame, logits: Column, seen: Column, draw: Column, penalty: float = 1.0, temperature: float = 1.0, k: int = 0, p: float = 1.0,
    name: str = "token",
) -> DataFrame:
    """``df`` with the id that follows: penalty, temperature, top-k, top-p, then by ``draw``; temperature 0 is greedy.

    ``draw`` is a number in [0, 1), such as a hash of the row, so that a retry gives the same id. Each step is a column
    of its own, as one nested expression would take the analyzer long.
    """
    if temperature <= 0:
        return df.withColumn(name, greedy(logits, seen, penalty))
    at, number = free_name(df, "_logits"), free_name(df, "_draw")
    x = F.col(at)
    steps = df.withColumns({at: penalised(logits, seen, penalty), number: draw}).withColumn(at, F.transform(x, lambda v: v / temperature))
    for step in (top_k(x, k), top_p(x, p), softmax(x)):
        steps = steps.withColumn(at, step)

    def add(a: Column, v: Column) -> Column:
        upto = a["upto"] + v
        return F.struct(upto.alias("upto"), (a["n"] + (upto <= F.col(number)).cast("int")).alias("n"))

    n = F.aggregate(x, F.struct(F.lit(0.0).alias("upto"), F.lit(0).alias("n")), add)["n"]
    last = F.array_max(F.transform(x, lambda v, i: F.when(v > 0, i)))
    return steps.withColumn(name, F.least(n, last)).drop(at, number)
