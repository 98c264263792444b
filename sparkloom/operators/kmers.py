"""Counts and first places of k-mers as a state that merges: of batches, of streams, and of what a job has done before.

Texts are counted in slices by numpy, so that what is shuffled is a row for each distinct k-mer of a slice and not one for
each character. A state is (kmer, n, row, at): merging two adds counts and takes the smaller first place, so the state
after any number of batches, in any order, is that of one pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import numbered

#: Characters of texts that are counted together; a longer text is taken alone.
SLICE = 1 << 21
#: Entries of a table of counts; k-mers of more kinds than that are sorted.
TABLE = 1 << 22


def letter_ranks(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Code points as numbers from 0 in their order, and how many there are."""
    there = np.zeros(int(codes.max(initial=0)) + 1, bool)
    there[codes] = True
    return (np.cumsum(there) - 1)[codes], int(there.sum())


def packed_windows(rank: np.ndarray, base: int, width: int) -> np.ndarray:
    """Each window's letters as the digits of one number; ``base ** width`` must fit into 62 bits."""
    n = len(rank) - width + 1
    found = np.zeros(n, np.int64)
    for k in range(width):
        found *= base
        found += rank[k : n + k]
    return found


def equal_windows(codes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` codes a number that equal windows share."""
    rank, base = letter_ranks(codes)
    if float(base) ** width < 2.0**62:
        return packed_windows(rank, base, width)
    size = 1
    while size < width:  # ranks of windows of doubled length
        step = min(size, width - size)
        pairs = rank[: len(rank) - step] * (int(rank.max(initial=0)) + 1) + rank[step:]
        rank, size = np.unique(pairs, return_inverse=True)[1].astype(np.int64), size + step
    return rank


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for k, n in enumerate(sizes):
        if k > first and total + n > SLICE:
            yield first, k
            first, total = k, 0
        total += n
    if sizes:
        yield first, len(sizes)


def count_slice(keys: list, texts: list[str], k: int) -> tuple[list[str], np.ndarray, list, np.ndarray]:
    """The distinct k-mers of some texts with their counts and their first places, by key and then by position."""
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i]))
    keys, texts = [keys[i] for i in order], [texts[i] for i in order]
    sizes = np.array([len(t) for t in texts], np.int64)
    whole = "".join(texts)
    if len(whole) < k:
        return [], np.empty(0, np.int64), [], np.empty(0, np.int64)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.flatnonzero(row[: len(codes) - k + 1] == row[k - 1 :])
    if not len(starts):
        return [], np.empty(0, np.int64), [], np.empty(0, np.int64)
    same = equal_windows(codes, k)[starts]
    if len(set(keys)) < len(keys):
        # Rows of one key count as one place after the other, whichever of them comes first.
        key_rank = np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:]))])
        order = np.lexsort((at[starts], key_rank[row[starts]]))
        starts, same = starts[order], same[order]
    size = int(same.max()) + 1
    if size <= TABLE:
        counts, place = np.bincount(same, minlength=size), np.zeros(size, np.int64)
        place[same[::-1]] = starts[::-1]  # of equal ones the first is written last
        first, counts = place[counts > 0], counts[counts > 0]
    else:
        _, found, counts = np.unique(same, return_index=True, return_counts=True)
        first = starts[found]
    return [whole[s : s + k] for s in first.tolist()], counts, [keys[r] for r in row[first].tolist()], at[first]


def kmer_state(rows: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(kmer, n, row, at): count and first place (key, position from 0) of each k-mer of ``k`` characters.

    Null texts and texts of fewer characters have none.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_key = batch.schema.field(0).type
            sizes = [len(t.as_py()) for t in batch.column(1)]
            for i, j in _slices(sizes):
                part = batch.slice(i, j - i)
                found, n, first, at = count_slice(part.column(0).to_pylist(), part.column(1).to_pylist(), k)
                columns = [pa.array(found, pa.string()), pa.array(n), pa.array(first, of_key), pa.array(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["kmer", "n", "row", "at"])

    whole = rows.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return merged(whole.mapInArrow(run, f"kmer string, n bigint, row {kind}, at bigint"))


def merged(*states: DataFrame) -> DataFrame:
    """One state of several; of one with repeated k-mers too."""
    every = states[0]
    for more in states[1:]:
        every = every.unionByName(more)
    found = every.groupBy("kmer").agg(F.sum("n").alias("n"), F.min(F.struct("row", "at")).alias("first"))
    return found.select("kmer", "n", "first.row", "first.at")


def numbered_kmers(state: DataFrame, start: int = 0) -> DataFrame:
    """(kmer, id): k-mers numbered from ``start`` in order of their first places; of rows with one key, by the k-mer."""
    ranked = numbered(state.select("kmer", "row", "at"), [], ["row", "at", "kmer"], "id")
    return ranked.select("kmer", (F.col("id") + start).cast("int").alias("id"))
