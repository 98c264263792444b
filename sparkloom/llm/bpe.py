"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

Every text is cut into chunks of ``CHUNK`` characters that overlap:

1. each chunk is pre-tokenised from its own start, which may lie inside a pre-token;
2. the pre-token boundaries of a chunk's head are held against those of its predecessor's tail. The pattern looks ahead
   and never back, so from the first boundary that both have, both go on alike: there the chunks are stitched;
3. the pieces between one stitch and the next are encoded, and their ids follow one another.

A text of more than ``PART`` characters is dealt to several tasks in the same way: its parts overlap, each task cuts its
part into chunks, and parts are stitched at a common boundary. Where chunks don't resynchronise (a word longer than the
overlap, say), the first of them is taken up again from its last sure boundary with twice the length, so the work stays
in proportion to the text. Decoding concatenates the raw bytes of the ids.

Ids are kept as binary, little-endian unsigned 32-bit integers. Defined cases: a null text is an empty one and has no
ids; an empty table gives an empty result; repeated rows are encoded each (parts of equal long texts once); ids that the
vocabulary lacks fail to decode; further columns pass through, and new ones take a free name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, read_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK, OVERLAP = 2_048, 256
#: Characters of a text that one task takes at a time, and by which such parts overlap.
PART, PART_OVERLAP = 262_144, 8_192
#: The pattern looks two characters beyond a boundary, and beyond white space as far as that goes.
MARGIN = 3
NEVER = 1 << 62
CACHE = 100_000
#: Rows that a task holds as ids or decoded bytes at a time, so that its memory doesn't follow the size of Arrow batches.
ROWS = 128


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: again and again the pair of lowest rank, the leftmost of equals, becomes one part."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    return _merge_word(piece, ranks) if len(piece) <= 64 else _merge_long(piece, ranks)


def _merge_word(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By looking through all pairs for each merge, which is fastest for the length of words."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    rank = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while rank and (least := min(rank)) < NEVER:
        i = rank.index(least)
        parts[i] += parts.pop(i + 1)
        del rank[i]
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
    return [ranks[x] for x in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By a heap of pairs, for time that hardly grows faster than the length."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = after[i]
        if j >= n or after[j] != end:  # one of the two parts has changed since
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:end])) is not None:
            heapq.heappush(heap, (r, k, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class _Known(dict):
    """Ids of pre-tokens seen before, as bytes.

    When there are many, they become the old ones and the old ones are forgotten, unless met again; so memory stays
    bounded and frequent words stay known.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks
        self.old: dict[str, bytes] = {}

    def __missing__(self, token: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        if (found := self.old.get(token)) is None:
            found = array("I", merge_bytes(token.encode(), self.ranks)).tobytes()  # the machines are little-endian
        if len(token) <= 64:
            self[token] = found
        return found


def sure_end(text: str) -> int:
    """Boundaries up to this one don't depend on what follows a text that may have been cut off."""
    return min(len(text) - MARGIN, len(text.rstrip()) - 1)


def stitch(tokens: list[str], end: int, sure: int, later: list[str], start: int) -> tuple[int, int] | None:
    """Where two chunks go on alike: the first token of each behind the first boundary that they have in common.

    ``tokens`` end at ``end`` and their boundaries are sure up to ``sure``; ``later`` begin at ``start``.
    """
    at, tail = end, {}
    for i in range(len(tokens) - 1, -1, -1):
        at -= len(tokens[i])
        if at < start:
            break
        if at <= sure:
            tail[at] = i
    at = start
    for j, token in enumerate(later):
        if at in tail:
            return tail[at], j
        if at > sure:
            break
        at += len(token)
    return None


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known = _Known(ranks)
        self.stitched = self.taken_up = 0

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, from stitch to stitch."""
        n, end = len(text), min(len(text), CHUNK + OVERLAP)
        start, tokens, first = 0, self.split(text[:end]), 0
        while end < n:
            after = end - OVERLAP
            later_end = min(n, after + CHUNK + OVERLAP)
            later = self.split(text[after:later_end])
            sure = start + sure_end(text[start:end])
            if found := stitch(tokens, end, sure, later, after):
                self.stitched += 1
                yield tokens[first : found[0]]
                start, tokens, first, end = after, later, found[1], later_end
            else:
                self.taken_up += 1
                at, last = end, len(tokens)
                while last > first and (at > sure or last == len(tokens)):
                    last -= 1
                    at -= len(tokens[last])
                yield tokens[first:last]
                end = min(n, at + max(2 * (end - at), CHUNK + OVERLAP))
                start, tokens, first = at, self.split(text[at:end]), 0
        yield tokens[first:]

    def ids(self, tokens: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, tokens))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.ids, self.pieces(text)))

    def boundaries(self, text: str) -> list[int]:
        at, found = 0, []
        for piece in self.pieces(text):
            for token in piece:
                found.append(at)
                at += len(token)
        return found

    def encode_between(self, text: str, start: int, end: int) -> bytes:
        """The ids of the pre-tokens in [start, end), both boundaries; what follows is seen but not encoded."""
        at, found = start, []
        for piece in self.pieces(text[start:]):
            size = sum(map(len, piece))
            while piece and at + size > end:
                size -= len(piece.pop())
            found.append(self.ids(piece))
            at += size
            if at >= end:
                break
        return b"".join(found)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _mapped(df: DataFrame, work: Callable, schema: str, ranks) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        names = [x.strip().split()[0].strip("`") for x in schema.split(",")]
        for batch in _few(batches):
            for columns in work(encoder, batch):
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)


def _whole(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[list]:
    yield [batch.column(0), pa.array([encoder.encode(x.as_py()) for x in batch.column(1)], pa.binary())]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, value in zip(batch.column(0), batch.column(1), strict=True):
            text = value.as_py()
            starts = range(0, max(1, len(text) - PART_OVERLAP), PART)
            for k, s in enumerate(starts):
                last = k == len(starts) - 1
                piece = text[s:] if last else text[s : s + PART + PART_OVERLAP]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (key.as_py(), k, s, last, piece)], names=["key", "part", "at", "last", "text"]
                )


def _boundaries(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[list]:
    heads, tails = [], []
    for at, last, value in zip(batch.column("at"), batch.column("last"), batch.column("text"), strict=True):
        text, s = value.as_py(), at.as_py()
        found, sure = encoder.boundaries(text), sure_end(text)
        heads.append([s + b for b in found if b < PART_OVERLAP])
        tails.append([] if last.as_py() else [s + b for b in found if PART <= b <= sure])
    kind = pa.list_(pa.int64())
    yield [batch.column("key"), batch.column("part"), pa.array(heads, kind), pa.array(tails, kind)]


def _between(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[list]:
    ids = []
    for at, start, end, value in zip(*[batch.column(c) for c in ("at", "from", "to", "text")], strict=True):
        text, s = value.as_py(), at.as_py()
        ids.append(encoder.encode_between(text, start.as_py() - s, len(text) if end.as_py() is None else end.as_py() - s))
    yield [batch.column("key"), batch.column("part"), pa.array(ids, pa.binary())]


def encode_parts(texts: DataFrame, ranks) -> DataFrame:
    """(key, ids) of distinct (key, text), part by part."""
    parts = texts.mapInArrow(_parts, "key string, part long, at long, last boolean, text string").repartition("key", "part")
    bounds = _mapped(parts, _boundaries, "key string, part long, head array<bigint>, tail array<bigint>", ranks)
    row = W.partitionBy("key").orderBy("part")
    # The first common boundary of a part and its predecessor; the whole text is marked if any is missing.
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(row)))
    cuts = (
        bounds.withColumn("from", F.when(F.col("part") == 0, F.lit(0).cast("long")).otherwise(common))
        .withColumn("to", F.lead("from").over(row))
        .withColumn("lost", F.max(F.col("from").isNull()).over(W.partitionBy("key")))
        .select("key", "part", "from", "to", "lost")
    )
    stitched = parts.join(cuts.where(~F.col("lost")).drop("lost"), ["key", "part"])
    coded = _mapped(stitched, _between, "key string, part long, ids binary", ranks)
    joined = coded.groupBy("key").agg(F.expr("listagg(ids, X'') WITHIN GROUP (ORDER BY part)").alias("ids"))
    lost = cuts.where("lost").select("key").distinct()
    alone = _mapped(texts.join(lost, "key", "left_semi"), _whole, "key string, ids binary", ranks)
    return joined.unionByName(alone)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with a binary column ``ids``; ``path`` names another vocabulary file of ranks.

    ``keep_text`` false leaves out the text, which then needn't come back from the Python workers.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    out, at = free_name(docs, "ids"), docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]
    names = [*(docs.columns[i] for i in kept), out]
    fields = [docs.schema[i] for i in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{out}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in _few(batches):
            ids = pa.array([encoder.encode(x.as_py() or "") for x in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), ids], names=names)

    near = docs.where(~is_long(text)).mapInArrow(run, schema)
    return near.unionByName(_encode_long(docs, text, ranks, out, [docs.columns[i] for i in kept]))


def is_long(text: str) -> Column:
    """Whether a text is dealt to several tasks."""
    return F.coalesce(F.length(F.col(f"`{text}`")) > PART, F.lit(False))


def _encode_long(docs: DataFrame, text: str, ranks, out: str, kept: list[str]) -> DataFrame:
    """The rows of long texts, with the columns ``kept`` and ``out``; parts of equal texts are encoded once."""
    key, own = free_name(docs, "_key"), F.col(f"`{text}`")
    far = docs.where(is_long(text)).withColumn(key, F.sha2(own, 256))
    distinct = far.groupBy(F.col(key).alias("key")).agg(F.first(own).alias("text"))
    coded = encode_parts(distinct, ranks).select(F.col("key").alias(key), F.col("ids").alias(out))
    return far.select(key, *[F.col(f"`{c}`") for c in kept]).join(coded, key).drop(key)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with a binary column ``out``, or a free name like it: the bytes of the ids, one after the other."""
    out = free_name(df, out)
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = {i: b for b, i in ranks.value.items()}
        for batch in _few(batches):
            texts = [b"".join(map(raw.__getitem__, array("I", x.as_py() or b""))) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out]
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{out}` binary"])
    return df.mapInArrow(run, schema)


def id_list(ids: Column) -> Column:
    """The ids as an array of integers, from the binary form."""
    byte = lambda k: F.conv(F.hex(F.substring(ids, k, 1)), 16, 10).cast("long")
    return F.when(F.octet_length(ids) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.octet_length(ids) / 4 - 1),
            lambda i: byte(4 * i + 1) + 256 * byte(4 * i + 2) + 65_536 * byte(4 * i + 3) + 16_777_216 * byte(4 * i + 4),
        )
    )


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 for the text of each, in place of the text.

    A task encodes a text and decodes its ids at once, so that neither goes through the JVM. Ids of texts that several
    tasks share are put together first.
    """
    own = [c for c in docs.columns if c != text]
    names = [free_name(docs, x) for x in ("n_tokens", "ids_sha256", "decoded_sha256")]
    ranks, at = docs.sparkSession.sparkContext.broadcast(load_ranks(path)), docs.columns.index(text)
    kinds = dict(zip(names, ("bigint", "string", "string"), strict=True))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own] + [f"`{c}` {k}" for c, k in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, raw = Encoder(ranks.value), {i: b for b, i in ranks.value.items()}
        for batch in _few(batches):
            rows = []
            for x in batch.column(at):
                ids = encoder.encode(x.as_py() or "")
                back = b"".join(map(raw.__getitem__, array("I", ids)))
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            rest = [k for k in range(len(batch.schema)) if k != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), *made], names=[*own, *names])

    near = docs.where(~is_long(text)).mapInArrow(run, schema)
    ids = free_name(docs, "ids")
    done = decode(_encode_long(docs, text, ranks, ids, own), ids, path=path)
    digests = ((F.octet_length(F.col(ids)) / 4).cast("long"), F.sha2(F.col(ids), 256), F.sha2(F.col(done.columns[-1]), 256))
    far = done.select(*[F.col(f"`{c}`") for c in own], *[d.alias(n) for d, n in zip(digests, names, strict=True)])
    return near.unionByName(far)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
