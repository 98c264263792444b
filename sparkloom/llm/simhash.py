"""SimHash near-dedup with covering locality-sensitive hashing.

A document's 64-bit fingerprint is the bitwise majority over the hashes of its three-word shingles. Documents whose
fingerprints differ in at most ``RADIUS`` bits are linked, and links are closed into components.

Covering LSH: every bit position gets a vector of RADIUS + 1 bits, and for every non-zero vector v of that length there
is a table, whose key keeps the positions whose vector has odd inner product with v. For any two fingerprints at most
RADIUS bits apart, the RADIUS vectors of the differing positions leave a non-zero v orthogonal to all of them; in that
table the differing positions are masked out and the keys agree. So seven tables find every pair within two bits.

Equal fingerprints are one class from the start, whatever the size of a group of copies: tables hold distinct
fingerprints. Buckets of at most ``SMALL`` fingerprints are compared in place, inside one row. Larger buckets are not
compared pairwise: each fingerprint is sent to itself and to its one-bit neighbours, and two fingerprints meet there
exactly if they are at most two bits apart. A meeting point has at most 65 visitors, so no group is unbounded, nothing
is capped, and no link is lost.

Fingerprints are made in Arrow batches of whole texts, one document at a time. Defined cases: a null or blank text has
fingerprint zero and links like any other; fewer than three words are one shingle; a text of any length is taken whole;
repeated rows and null ids keep their rows; an id that is no whole number counts as null; a component's id is its
smallest id, null if all are null; an empty table gives an empty result; further columns, whatever their names, don't
matter to ``near_duplicates`` and pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, free_name, read_table, row_hash
from .components import connected_components

RADIUS = 2
SMALL = 64
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist(), strict=False)], dtype="<u8"
    )
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x.as_py()) for x in batch.column("text")], dtype=np.uint64).view(np.int64)
        rest = [k for k, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in rest), pa.array(found)], names=[*(batch.schema.names[k] for k in rest), "fp"]
        )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(id, ``carry``, fp): the fingerprint as a signed long for each row; ``carry`` names further columns of longs."""
    own = [F.col(f"`{c}`") for c in carry]
    narrow = docs.select(F.col(f"`{key}`").try_cast("long").alias("id"), *own, F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(_fingerprints, ", ".join(["id long", *(f"`{c}` long" for c in carry), "fp long"]))


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The masks of the tables, each the kept bits as a signed long.

    Position i has the vector of the bits of ``i mod (2^(radius + 1) - 1) + 1``, so that the non-zero vectors are
    spread evenly over positions.
    """
    n = 2 ** (radius + 1)
    masks = [sum(1 << i for i in range(bits) if ((i % (n - 1) + 1) & v).bit_count() % 2) for v in range(1, n)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """(u, v) links among distinct fingerprints ``fp`` that connect all pairs at most ``radius`` (1 or 2) bits apart."""
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    tables = F.array(*[
        F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for k, m in enumerate(covering_masks(radius))
    ])
    rows = distinct.select("fp", F.explode(tables).alias("b")).select("b", "fp")
    sizes = rows.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
    met = checkpointed(rows.join(sizes, "b"))
    lists = met.where(F.col("n") <= small).groupBy("b").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = F.flatten(
        F.transform(
            F.col("fps"),
            lambda a, i: F.transform(
                F.filter(F.col("fps"), lambda b, j: (j > i) & (_differing(a, b) <= radius)),
                lambda b: F.struct(a.alias("u"), b.alias("v")),
            ),
        )
    )
    pairs = lists.select(F.explode(near).alias("e")).select("e.u", "e.v")
    # Large buckets: fingerprints that meet at a one-bit neighbour (for radius 1, at the fingerprint itself as well as
    # at a neighbour, and then only those one bit apart are linked by way of the smaller one).
    crowd = met.where(F.col("n") > small).select("fp").distinct()
    places = F.concat(
        F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(_one(i)))
    )
    meetings = (
        crowd.select("fp", F.explode(places).alias("at"))
        .groupBy("at")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    crowded = meetings.select(F.explode(near).alias("e")).select("e.u", "e.v")
    return pairs.union(crowded).distinct()


def _one(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, carry: Sequence[str] = ()
) -> DataFrame:
    """(id, ``carry``, fp, root, component_id) for each row.

    Rows of one component have one ``root``, a fingerprint, and no other rows have it; ``component_id`` is the smallest
    id in the component, which tells components apart only where ids are unique.
    """
    found = checkpointed(fingerprints(docs, key, text, carry))
    classes = found.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(fingerprint_links(classes.select("fp"), radius))
    # Fingerprints without a link are components by themselves.
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(smallest, "root").select("fp", "root", "component_id")
    return found.join(by_class, "fp").select("id", *[F.col(f"`{c}`") for c in carry], "fp", "root", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", near: Callable = near_duplicates) -> DataFrame:
    """One row of each component that ``near`` finds, and with it all columns: no component is lost.

    It's the row of the smallest id, null ids last; of rows that tie in this, the one of the smallest hash of all its
    columns, so that the choice doesn't depend on the order of rows. Ids needn't be unique: rows that share an id but not
    a component all stay. Rows that are equal in every column count as one. They are dropped in each task before texts
    are shuffled, so a group of copies is never gathered.
    """
    a, b = free_name(docs, "_a"), free_name(docs, "_b")
    rows = docs.withColumns({a: row_hash(docs, "a"), b: row_hash(docs, "b")})
    found = near(rows.select(F.col(f"`{key}`"), F.col(f"`{text}`"), a, b), key, text, carry=(a, b))
    first = F.min(F.struct(F.col("id").isNull(), "id", a, b))
    stays = found.groupBy("root").agg(first.alias("m")).select(f"m.{a}", f"m.{b}")
    kept = rows.dropDuplicates([a, b]).join(stays, [a, b], "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
