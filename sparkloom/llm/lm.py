"""Language-model scoring: a gated recurrent network with class-factored softmax, trained and applied by Spark tasks.

1. Count: each task counts the words of its training documents; counts are summed by word in Spark. A histogram of the
   counts tells from which count on a word is among the ``HEAD`` most frequent ones; these go out to the tasks.
2. Encode: each document becomes network symbols (two bytes a token), its sums over head words, and the words beyond
   the head as a list. This table is written to the shared folder.
3. Train: documents are dealt to shards of about ``SHARD_TOKENS`` tokens by their hash, so that the model doesn't depend
   on how the table is laid out. There are ``ROUNDS`` rounds, each over another share of the shards, so that every
   training document is learnt from once. Each shard trains from the round's model by truncated backpropagation over
   whole documents; the models are averaged, weighted by tokens, block by block of the parameters in Spark. The driver
   holds one model of 0.6 MB.
4. Score: tasks run the network over whole documents, the state carried from window to window, and tell what a word
   beyond the head gains if it is unknown. These words meet their counts in a shuffle join, of which Spark splits skewed
   partitions.

The probability of a token is P(class | state) P(word | class, state) for the ``gru.SHORT`` most frequent words. All
further words belong to tail classes by their last bytes; the network gives the class's probability, and within it
words share by absolute discounting: (c - d) / N for a word of c occurrences, with d = n1 / (n1 + 2 n2) from the tail words
that occur once and twice. What is left of each class, d V / N, is the unknown word's, which is one as in the base: its
probability is the sum over the classes. So the probabilities of all words and of the unknown one sum to one, and the
tail is exact whatever its size.

Defined cases: a null text is empty and has its end token alone; an empty table gives an empty result; a text of any
length is learnt from and scored whole; null and repeated ids are rows each (a null id is never held out), and an id that
is no whole number comes back as null; words of equal counts are ranked by their bytes; without training documents every word is unknown; further columns, whatever their
names, don't matter: the operator returns its own.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .common import read_table, stored

#: Words whose counts the tasks hold, and the most bytes of one: at most 34 MB. Others meet their counts in a join.
HEAD = 262_144
HEAD_BYTES = 128
#: Parameter: a document is held out if crc32 of its id as text leaves this remainder.
FOLDS, HELD_OUT = 7, 2
RATES = (0.01, 0.006, 0.003)
ROUNDS = len(RATES)
SHARD_TOKENS = 8_000_000
#: A task flushes its word counts and scores when it holds so many words or tokens.
FLUSH_WORDS = 400_000
CHUNK_TOKENS = 2_000_000
BLOCKS, SLOTS = 32, 64
#: Copies of a training document that a task makes at a time.
COPIES = 256

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER, LOWER)
#: The end token; no word is empty.
END = b""


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, and the end token."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    found.append(END)
    return found


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % gru.TAILS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit() -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary())
        kinds = pa.array([tail_class(w) for w in counts], pa.int32())
        return pa.RecordBatch.from_arrays([words, kinds, pa.array(list(counts.values()), pa.int64())], names=["word", "kind", "n"])

    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) >= FLUSH_WORDS:
                yield emit()
                counts.clear()
    if counts:
        yield emit()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word as binary, kind, c): how often each token of the one column of ``texts`` occurs, and its tail class."""
    parts = texts.mapInArrow(_count, "word binary, kind int, n long")
    return parts.groupBy("word", "kind").agg(F.sum("n").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """The head in order of falling counts, all totals, and the tail classes' totals (words beyond the short list)."""

    words: list[bytes]
    counts: np.ndarray
    n: int
    v: int
    tail_n: np.ndarray
    tail_v: np.ndarray
    discount: float

    @property
    def short(self) -> int:
        return min(gru.SHORT, len(self.words))

    @property
    def unknown(self) -> np.ndarray:
        """P(unknown | tail class); an empty class is all unknown."""
        return np.where(self.tail_n > 0, self.discount * self.tail_v / np.maximum(self.tail_n, 1), 1.0)

    @property
    def symbol_counts(self) -> np.ndarray:
        found = np.concatenate([np.zeros(gru.SHORT), self.tail_n])
        found[: self.short] = self.counts[: self.short]
        return found

    def tables(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The head words, and in their order: symbol, log10(c + 1), and log10 of the share in the tail class.

        Behind the head there is a word of each tail class that's beyond the head; its share is known later.
        """
        rank, kinds = np.arange(len(self.words)), np.array([tail_class(w) for w in self.words], np.int64)
        tail = np.arange(gru.TAILS)
        symbol = np.concatenate([np.where(rank < self.short, rank, kinds + gru.SHORT), tail + gru.SHORT])
        share = np.log10(np.maximum(self.counts - self.discount, 1e-9) / np.maximum(self.tail_n[kinds], 1.0))
        inner = np.concatenate([np.where(rank < self.short, 0.0, share), np.zeros(gru.TAILS)])
        base = np.concatenate([np.log10(self.counts + 1.0), np.zeros(gru.TAILS)])
        return self.words, symbol.astype(np.uint16), base, inner


#: Counts up to this one have a step of the histogram each; above it a step is a hundredth of the count.
EXACT = 65_536


def _step(c: str) -> Column:
    above = F.lit(EXACT) * F.pow(F.lit(1.01), F.floor(F.log(F.col(c) / EXACT) / F.lit(math.log(1.01))))
    return F.when(F.col(c) <= EXACT, F.col(c)).otherwise(F.floor(above)).cast("long")


def least_count(counts: DataFrame, head: int) -> int:
    """A count that the ``head`` most frequent words reach, and few others; the histogram has some 70,000 rows at most."""
    steps = counts.groupBy(_step("c").alias("step")).agg(F.count("*").alias("words")).collect()
    for row in sorted(steps, key=lambda r: -r["step"]):
        head -= row["words"]
        if head <= 0:
            return row["step"]
    return 1


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    fits = counts.where(F.octet_length("word") <= HEAD_BYTES)
    frequent = fits.where(F.col("c") >= least_count(fits, head))
    top = frequent.orderBy(F.desc("c"), "word").limit(head).select("word", "c").toArrow()
    words, found = top.column("word").to_pylist(), np.array(top.column("c").to_pylist(), np.int64)
    # Totals of the classes, and how many words occur once and twice; the short list is taken out of them.
    rows = counts.groupBy("kind").agg(
        F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")
    ).collect()
    tail_n, tail_v = np.zeros(gru.TAILS), np.zeros(gru.TAILS)
    for row in rows:
        tail_n[row["kind"]], tail_v[row["kind"]] = row["n"], row["v"]
    n, v = int(tail_n.sum()), int(tail_v.sum())
    short = min(gru.SHORT, len(words))
    kinds = np.array([tail_class(w) for w in words[:short]], np.int64)
    tail_n -= np.bincount(kinds, found[:short], gru.TAILS)
    tail_v -= np.bincount(kinds, minlength=gru.TAILS)
    n1, n2 = (sum(r[k] for r in rows) - int((found[:short] == c).sum()) for k, c in (("n1", 1), ("n2", 2)))
    discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
    return Vocabulary(words, found, n, v, tail_n, tail_v, discount)


ENCODED = (
    "rid long, doc_id long, held_out boolean, h1 long, h2 long, n_tokens long, head_known long, head_log double, "
    "inner double, symbols binary, tail array<binary>, tail_at array<int>"
)


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Columns as in ``ENCODED`` for rows of rid, doc_id, held_out, h1, h2 and text."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocab.tables())

    class Index(dict):
        def __missing__(self, word: bytes) -> int:
            return len(self) + tail_class(word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, symbol, base, inner = shipped.value
        index, n_head = Index(zip(head, range(len(head)), strict=True)), len(head)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch, rows = whole.slice(k, 1024), []
                for text in batch.column("text"):
                    words = words_of(text.as_py())
                    at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                    beyond = np.flatnonzero(at >= n_head)
                    rows.append((
                        len(words), len(words) - len(beyond), float(base[at].sum()), float(inner[at].sum()),
                        symbol[at].tobytes(), [words[i] for i in beyond.tolist()], beyond,
                    ))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                made = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("rid", "doc_id", "held_out", "h1", "h2")], *made],
                    names=[x.split()[0] for x in ENCODED.split(", ")],
                )

    return docs.mapInArrow(run, ENCODED)


def training_shards(encoded: DataFrame, tokens: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(round, shard, h1, h2, nth, symbols) of the training documents; shards hold about so many tokens.

    Copies of a row are told apart by their number among its copies, so that many of them spread over the shards; they
    are counted first, in each task, and one of them is shuffled. More than ``COPIES`` of them are dealt out in runs of so
    many before they are made.
    """
    per_round = math.ceil(tokens / ROUNDS / shard_tokens) or 1
    each = encoded.where("NOT held_out").groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first("symbols").alias("symbols"))
    each = stored(each, "lm-distinct")
    few = each.where(F.col("copies") <= COPIES).withColumn("run", F.lit(0).cast("long"))
    many = each.where(F.col("copies") > COPIES).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    # With a number of partitions, as adaptive execution would join runs by their size before copies are made.
    n = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = few.unionByName(many.repartition(n, "h1", "h2", "run"))
    first = F.col("run") * COPIES + 1
    each = runs.withColumn("nth", F.explode(F.sequence(first, F.least("copies", first + COPIES - 1))))
    place = F.pmod(F.xxhash64(F.lit("shard"), "h1", "h2", "nth"), F.lit(ROUNDS * per_round))
    return each.select(
        (place % ROUNDS).cast("int").alias("round"), F.floor(place / ROUNDS).cast("int").alias("shard"), "h1", "h2", "nth", "symbols"
    )


def _mean(slots: DataFrame, *keys: str) -> DataFrame:
    """Weighted means of vectors of floats, as binary, by key; one vector at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight, first = None, 0, None
        for batch in batches:
            first = batch.slice(0, 1) if first is None else first
            for n, raw in zip(batch.column("weight").to_pylist(), batch.column("vector"), strict=True):
                part = np.frombuffer(raw.as_py(), np.float32) * float(n)
                total, weight = part if total is None else total + part, weight + n
        mean = pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([*[first.column(k) for k in keys], pa.array([weight]), mean], names=[*keys, "weight", "vector"])

    return slots.groupBy(*keys).applyInArrow(add, ", ".join(f"{k} int" for k in keys) + ", weight long, vector binary")


def train_round(shards: DataFrame, flat: np.ndarray, rate: float) -> np.ndarray:
    """The average of the models that training from ``flat`` makes of each shard, weighted by tokens."""
    shipped = shards.sparkSession.sparkContext.broadcast(flat)
    cuts = [gru.SIZE * k // BLOCKS for k in range(BLOCKS + 1)]

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        rows = rows.sort_by([(c, "ascending") for c in ("h1", "h2", "nth")])
        texts = [np.frombuffer(x.as_py(), np.uint16) for x in rows.column("symbols")]
        model, tokens = gru.train(shipped.value, texts, rate)
        return pa.table({
            "block": pa.array(range(BLOCKS), pa.int32()), "slot": pa.array([shard % SLOTS] * BLOCKS, pa.int32()),
            "weight": pa.array([tokens] * BLOCKS, pa.int64()),
            "vector": pa.array([model[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
        })

    schema = "block int, slot int, weight long, vector binary"
    models = shards.groupBy("shard").applyInArrow(run, schema)
    found = _mean(_mean(models, "block", "slot").select("block", "weight", "vector"), "block").collect()
    if not found:
        return flat
    parts = {r["block"]: np.frombuffer(r["vector"], np.float32) for r in found}
    return np.concatenate([parts[k] for k in range(BLOCKS)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
    """Row ids, symbols, words beyond the head and their places, in chunks of about ``CHUNK_TOKENS`` tokens."""
    found: tuple[list, list, list, list] = ([], [], [], [])
    held = 0
    for batch in batches:
        for rid, raw, tail, at in zip(*[batch.column(c) for c in ("rid", "symbols", "tail", "tail_at")], strict=True):
            text = np.frombuffer(raw.as_py(), np.uint16)
            for part, value in zip(found, (rid.as_py(), text, tail, np.asarray(at.as_py(), np.int64)), strict=True):
                part.append(value)
            held += len(text)
            if held >= CHUNK_TOKENS:
                yield found
                found, held = ([], [], [], []), 0
    if found[0]:
        yield found


def network_scores(encoded: DataFrame, flat: np.ndarray, unknown: np.ndarray) -> DataFrame:
    """(rid, network, tail, gain): log10 probability of each document's symbols, and what words beyond the head gain as
    unknown ones."""
    shipped = encoded.sparkSession.sparkContext.broadcast((flat, unknown))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shares = shipped.value
        for rids, texts, tails, places in _chunks(batches):
            found, gains = gru.score(model, texts, shares, places)
            columns = [
                pa.array(rids, pa.int64()), pa.array(found / math.log(10)), pa.array([t.as_py() for t in tails], pa.list_(pa.binary())),
                pa.array([g / math.log(10) for g in gains], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "network", "tail", "gain"])

    rows = encoded.select("rid", "symbols", "tail", "tail_at")
    return rows.mapInArrow(run, "rid long, network double, tail array<binary>, gain array<double>")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class Fitted:
    """A trained model with the table of counts, the encoded documents and the vocabulary."""

    counts: DataFrame
    vocab: Vocabulary
    encoded: DataFrame
    flat: np.ndarray


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", head: int = HEAD, shard_tokens: int = SHARD_TOKENS) -> Fitted:
    """Counts, encodes and trains; learns from the rows that aren't held out."""
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), k.try_cast("long").alias("doc_id"), held_out(k).alias("held_out"),
        F.xxhash64(k, t).alias("h1"), F.xxhash64(F.lit("row"), t, k).alias("h2"), t.alias("text"),
    )
    counts = stored(word_counts(rows.where("NOT held_out").select("text")), "word-counts")
    vocab = vocabulary(counts, head)
    encoded = stored(encode(rows, vocab), "lm-encoded")
    shards = stored(training_shards(encoded, vocab.n, shard_tokens), "lm-shards", "round")
    flat = gru.initial(vocab.symbol_counts)
    for nth, rate in enumerate(RATES):
        flat = train_round(shards.where(F.col("round") == nth).drop("round"), flat, rate)
    return Fitted(counts, vocab, encoded, flat)


def scores_of(fitted: Fitted) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, network_score) of the encoded rows."""
    vocab, encoded = fitted.vocab, fitted.encoded
    scored = stored(network_scores(encoded, fitted.flat, vocab.unknown), "lm-scored")
    of_class = F.element_at(F.array(*map(F.lit, np.maximum(vocab.tail_n, 1.0).tolist())), F.col("kind") + 1)
    tail = (
        scored.select("rid", F.explode(F.arrays_zip("tail", "gain")).alias("t"))
        .select("rid", F.col("t.tail").alias("word"), "t.gain")
        .join(fitted.counts, "word", "left")
        .groupBy("rid")
        .agg(
            F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("tail_log"),
            F.sum(F.coalesce(F.log10((F.col("c") - F.lit(vocab.discount)) / of_class), "gain")).alias("tail_inner"),
            F.count("c").alias("tail_known"),
        )
    )
    joined = (
        encoded.select("rid", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "inner")
        .join(scored.select("rid", "network"), "rid")
        .join(tail, "rid", "left")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("head_log") + zero("tail_log") - F.col("n_tokens") * F.lit(math.log10(vocab.n + vocab.v + 1))).alias("base_score"),
        (F.col("network") + F.col("inner") + zero("tail_inner")).alias("score"),
        F.col("network").alias("network_score"),
    )


def score_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", head: int = HEAD, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, network_score) for each row.

    ``network_score`` is the network's part of ``score``: that of words of the short list and of tail classes.
    """
    return scores_of(fit(docs, key, text, head, shard_tokens))


def op4_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
