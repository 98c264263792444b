"""Fill-in-the-middle: a text as prefix, suffix and middle, cut between words, by one numpy kernel for a batch of rows.

The kernel works on the UTF-8 buffer that Arrow hands over, for all rows of a slice together: a table of 256 entries
classes each byte as white space or not; a byte begins a unit if it is white space behind a word, or a text's first; the
running count of such bytes, less its value at the row's start, is the row's own count; a search in that count finds
the places of all cuts. Pieces are slices of the same buffer, and Arrow joins them with their marks.

Units are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, so a unit's white space stands before its word. Draws
come from the id by SHA-256, so that a document is cut alike in any run, partition and engine.

Defined cases: a null text is an empty one; an empty text stays plain, and so does one that holds a mark, since it couldn't
be restored; white space alone is one unit; a null id is drawn for as an empty one; repeated rows are cut alike; an empty
table gives an empty result; a text of any length is cut whole, in memory in proportion to it; further columns pass
through, and the new one takes a free name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let, read_table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are transformed, and of these the percent in the order suffix, prefix, middle.
RATE, SPM = 50, 80
#: Bytes of text in a slice of a batch; a longer text is a slice of its own.
SLICE = 4 << 20
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
FORMS = pa.array(["plain", "psm", "spm"])
FIELDS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def slices(ends: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one row; ``ends`` are the offsets of the rows."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, last
        first = last


def marked(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which rows hold a mark."""
    found = np.zeros(len(start), dtype=bool)
    if len(data) < 3:
        return found
    middle = data[1:-1]
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & ((middle == ord("P")) | (middle == ord("S")) | (middle == ord("M"))))
    row = np.searchsorted(stop, at, "right")
    found[row[at + 3 <= stop[row]]] = True
    return found


def cuts(data: np.ndarray, start: np.ndarray, stop: np.ndarray, draws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the number of its units and the places of both cuts."""
    space = SPACE[data]
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[start[start < stop]] = True
    count = np.zeros(len(data) + 1, dtype=np.int64 if len(data) >= 1 << 31 else np.int32)
    np.cumsum(begins, out=count[1:])
    before = count[start]
    n = count[stop] - before
    a, b = (d % (n + 1) for d in draws)
    # The count behind a byte first reaches the row's start plus k + 1 with the unit after k others; else the row ends.
    first, second = (np.minimum(np.searchsorted(count[1:], before + k + 1), stop) for k in (np.minimum(a, b), np.maximum(a, b)))
    return n, first, second


def transform_rows(text: pa.Array, draws: list[np.ndarray], rate: int = RATE, spm: int = SPM) -> list[pa.Array]:
    """The columns of FIELDS for a slice of rows; ``text`` has no nulls."""
    text = text.cast(pa.large_string())
    rows = len(text)
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + rows + 1]
    low, raw = int(ends[0]), text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[low : int(ends[-1])] if raw else np.zeros(0, dtype=np.uint8)
    start, stop = ends[:-1] - low, ends[1:] - low
    n, first, second = cuts(data, start, stop, draws[:2])
    plain = (start == stop) | marked(data, start, stop) | (draws[2] % 100 >= rate)
    suffix_first = ~plain & (draws[3] % 100 < spm)
    first, second = np.where(plain, stop, first), np.where(plain, stop, second)
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    # Three pieces a row, one behind the other in the buffer that the texts came in.
    bounds = np.append(np.stack([start, first, second], axis=1).ravel(), stop[-1:] if rows else 0).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), 3 * rows, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    at = 3 * np.arange(rows)
    part = lambda k: pieces.take(pa.array(at + k))
    marks = pa.array(["", PREFIX, SUFFIX, MIDDLE], pa.large_string())
    mark = lambda k: marks.take(pa.array(np.where(plain, 0, k)))
    output = pc.binary_join_element_wise(
        mark(np.where(suffix_first, 2, 1)), part(np.where(suffix_first, 2, 0)), mark(np.where(suffix_first, 1, 2)),
        part(np.where(suffix_first, 0, 2)), mark(3), part(1), pa.scalar("", pa.large_string()),
    )
    form = FORMS.take(pa.array(np.where(plain, 0, 1 + suffix_first)))
    return [
        pa.array(n.astype(np.int64)), form, pa.array(chars[first] - chars[start], mask=plain),
        pa.array(chars[second] - chars[first], mask=plain), output.cast(pa.string()) if output.nbytes < 1 << 31 else output,
    ]


def draw(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from a key: the first 8-digit groups of the hex SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(
    df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = RATE, spm: int = SPM
) -> DataFrame:
    """``df`` with a struct column ``fim`` of n, form, prefix_chars, middle_chars and output."""
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def cut(texts: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        draws, made = [x.to_numpy(zero_copy_only=False) for x in (a, b, c, d)], []
        for i, j in slices(ends):
            columns = transform_rows(texts.slice(i, j - i), [x[i:j] for x in draws], rate, spm)
            made.append(pa.StructArray.from_arrays(columns, names=names))
        return pa.concat_arrays(made)

    cut_rows = F.arrow_udf(cut, f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")
    made = cut_rows(F.coalesce(F.col(f"`{text}`"), F.lit("")), *draw(F.col(f"`{key}`"), seed))
    return df.select(*[F.col(f"`{c}`") for c in df.columns], made.alias(free_name(df, "fim")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.

    The text holds no mark, and no mark ends as one begins, so the first of each mark behind the leading one is the one
    that was put there.
    """

    def parts(first: str) -> Column:
        return let(
            F.substr(output, F.lit(4)),
            lambda rest: let(
                F.substring_index(rest, first, 1),
                lambda head: let(
                    F.substr(rest, F.length(head) + 4),
                    lambda tail: let(
                        F.substring_index(tail, MIDDLE, 1),
                        lambda second: F.struct(head.alias("a"), second.alias("b"), F.substr(tail, F.length(second) + 4).alias("middle")),
                    ),
                ),
            ),
        )

    psm, spm = parts(SUFFIX), parts(PREFIX)
    return (
        F.when(form == "psm", let(psm, lambda x: F.concat(x["a"], x["middle"], x["b"])))
        .when(form == "spm", let(spm, lambda x: F.concat(x["b"], x["middle"], x["a"])))
        .otherwise(output)
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut, with digests of its output and of the text restored from that."""
    done = transformed(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    fim = F.col("fim")
    return done.select(
        "doc_id", *[fim[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2(fim["output"], 256).alias("output_sha256"), F.sha2(restored(fim["output"], fim["form"]), 256).alias("restored_sha256"),
    )


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
    ('0x' || h[25:32])::BIGINT AS h4 FROM d),
k AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
    WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
    ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
