"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is cut into e + 1 pieces: a passage within e edits of the item holds one
piece unchanged. All pieces go into one Aho-Corasick automaton; each of its hits in a document names a place where the
item may lie, and Myers' bit-parallel algorithm gives the smallest edit distance between the item and any passage
there. No candidate is capped: hits of one item on neighbouring diagonals share one verification, and an item is done in
a document once it is found without error.

Items are a query set: they go out in blocks of at most ``BLOCK_CHARS`` characters, one narrow pass over the documents
for each block, so what a task holds is bounded whatever the number of items. Documents are never shuffled.

Text is compared in lower case with runs of white space as one space. Defined cases: null or blank texts have no hits;
blank items match nothing; an item shorter than twice ``PIECE`` must occur exactly and between word limits; repeated
items or documents give their hits each; of passages at the same distance the first counts; empty tables of documents
give empty results and an empty table of items gives no hits; texts of any length are searched whole; further columns
pass through ``drop_contaminated``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Characters of an item for each piece, at least; so about 6 % of an item's characters may be edited.
PIECE = 16
BLOCK_CHARS = 4_000_000

HITS = "doc_id long, item_id long, distance int, budget int, passage_start int, passage_end int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, piece: int = PIECE) -> int:
    return max(0, length // piece - 1)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length, with their offsets."""
    n = errors + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern_bits: dict[str, int], length: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """The smallest distance between the pattern and any substring of ``text``, and where the first such one ends.

    If ``anchored``, only substrings at the start of the text count.
    """
    ones = (1 << length) - 1
    plus, minus, score, top = ones, 0, length, 1 << (length - 1)
    best, at = length, 0
    look = pattern_bits.get
    for j, c in enumerate(text):
        eq = look(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & ones)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, j + 1
        # A match may begin anywhere if the row above the pattern is all zero; else it counts up.
        ph = ((ph << 1) | anchored) & ones
        mh = (mh << 1) & ones
        plus = mh | (~(xv | ph) & ones)
        minus = ph & xv
    return best, at


def _bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        bits[c] |= 1 << i
    return dict(bits)


class Matcher:
    """The automaton of one block of items; made once in a task."""

    def __init__(self, items: list[tuple[int, str]], piece: int = PIECE) -> None:
        self.items = [(i, normal(t)) for i, t in items]
        self.errors = [budget(len(t), piece) for _, t in self.items]
        self.bits: dict[int, dict[str, int]] = {}
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(self.items):
            for offset, part in pieces(text, self.errors[k]) if text else ():
                where[part].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for part, places in where.items():
            self.automaton.add_word(part, (len(part), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def hits(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, start, end) of the best passage of each item in the text."""
        whole = normal(text)
        if self.empty or not whole:
            return []
        diagonals: dict[int, set[int]] = defaultdict(set)
        for end, (length, places) in self.automaton.iter(whole):
            for k, offset in places:
                diagonals[k].add(end + 1 - length - offset)
        return [found for k, at in diagonals.items() if (found := self._verify(whole, k, sorted(at)))]

    def _verify(self, whole: str, k: int, starts: list[int]) -> tuple[int, int, int, int, int] | None:
        item_id, item = self.items[k]
        errors, best = self.errors[k], None
        for start in starts:
            if whole.startswith(item, start) if start >= 0 else False:
                end = start + len(item)
                if errors or (not start or whole[start - 1] == " ") and (end == len(whole) or whole[end] == " "):
                    return item_id, 0, errors, start, end
        if not errors:
            return None
        bits = self.bits.get(k)
        if bits is None:
            bits = self.bits[k] = _bits(item)
        low, groups = starts[0], []
        for a, b in zip(starts, [*starts[1:], None], strict=True):
            if b is None or b > a + 2 * errors:
                groups.append((low, a))
                low = b
        for a, b in groups:
            left = max(0, a - errors)
            distance, end = myers(bits, len(item), whole[left : b + len(item) + errors])
            if distance <= errors and (best is None or distance < best[1]):
                best = item_id, distance, errors, left, left + end
        if best is None:
            return None
        # Backwards from its end, the passage is a match at the start of the text.
        _, distance, _, left, end = best
        _, length = myers(_bits(item[::-1]), len(item), whole[max(left, end - len(item) - errors) : end][::-1], anchored=True)
        return item_id, distance, errors, end - length, end


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[list]:
    """The items in blocks of about ``chars`` characters, one at a time on the driver."""
    rows = items.select(F.col(f"`{key}`").try_cast("long").alias("item"), F.col(f"`{text}`").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // chars + 1
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], r["text"]) for r in block.collect()]


def benchmark_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, budget, passage_start, passage_end): the best passage of each item in a document.

    Places are characters of the normalised text, the passage's start and the place behind its end.
    """
    context = docs.sparkSession.sparkContext
    narrow = docs.select(F.col(f"`{key}`").try_cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = None
    for block in item_blocks(items):
        shipped = context.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value)
            for batch in batches:
                rows = [
                    (doc.as_py(), *hit)
                    for doc, value in zip(batch.column(0), batch.column(1), strict=True)
                    for hit in matcher.hits(value.as_py())
                ]
                kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in HITS.split(", ")]
                )

        part = narrow.mapInArrow(search, HITS)
        found = part if found is None else found.union(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no passage within the budget of any item, in one narrow pass for each block."""
    context, at = docs.sparkSession.sparkContext, docs.columns.index(text)
    for block in item_blocks(items):
        shipped = context.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.hits(x.as_py()) for x in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op7_benchmark_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item within its error budget, with the item and the distance."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return benchmark_hits(docs, read_table(spark, sf_dir, "benchmark"))
