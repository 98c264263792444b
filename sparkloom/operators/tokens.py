"""Array operators over tokens: k-mers, windows, padding, masks, pair counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let


def kmers(text: Column, k: int, stride: int = 1) -> Column:
    """The k-mers of a text, and a last one at its end if the stride misses it; none if the text is shorter.

    Characters are taken apart once, as looking for a place in a text would start from its beginning each time.
    """

    def of(chars: Column) -> Column:
        last = F.size(chars) - k
        starts = F.when(last >= 0, F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
        return F.coalesce(
            F.transform(starts, lambda i: F.concat(*[F.get(chars, i + n) for n in range(k)])), F.array().cast("array<string>")
        )

    return let(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)), of)


def windows(tokens: Column, context: int, stride: int) -> Column:
    """Windows of context + 1 tokens at every stride, and one at the end if the stride misses it; a short input is one."""
    last = F.greatest(F.size(tokens) - (context + 1), F.lit(0))
    starts = F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, context + 1).alias("tokens")))


def adjacent_pairs(tokens: Column) -> Column:
    """(left, right) of all neighbours."""
    right = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    left = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.arrays_zip(left.alias("left"), right.alias("right"))


def padded(ids: Column, length: int, pad: int) -> Column:
    """Cut or filled to a length."""
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def masked_labels(ids: Column, start: Column, end: Column, ignored: int = -100) -> Column:
    """The ids shifted by one; those outside [start, end) count for nothing."""
    shifted = F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))
    return F.transform(shifted, lambda x, i: F.when((i + 1 >= start) & (i + 1 < end), x).otherwise(ignored))
