"""A manifest of a dataset by Merkle trees, with a proof for every row.

Rows are leaves: the SHA-256 of their fields. The leaves of each group, in order, form a binary tree; a node without a
partner is hashed alone. The roots of the groups, in order, form a tree in the same way.

Trees are built by aligned blocks of ``2 ** HEIGHT`` nodes. One call walks a block in postorder: it gives the digest of
each subtree and, on its way back, appends the siblings to all leaves below. The roots of the blocks are the nodes of the
next walk over all groups, until a group has one node left; so a group of any size is spread over tasks, and a task
sees one block at a time. The paths of the upper levels then join the rows by their block. Verification is another way:
columns fold a leaf with the siblings of its path, without the tree.

A path's entries are ``L`` or ``R``, the side of the sibling, with its digest, or ``-`` where a node has no partner.

Defined cases: a null field is hashed as ``-``; null and empty texts differ; leaves that tie in the order are ordered by
their digest, and equal rows are a leaf each; null keys come first; a null group is one of its own, first by order; an
empty table gives an empty result; a text of any length is hashed whole; further columns pass through, and the new one
takes a free name.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import free_name, read_table, stored

#: Levels of a block.
HEIGHT = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as ``-`` if null, else its UTF-8 byte count, a colon and its value."""

    def part(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


def digest(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def walked(leaves: list[str], height: int) -> tuple[str, list[list[str]]]:
    """The root of a tree of so many levels over the leaves, at least one, and the path of each leaf."""
    paths: list[list[str]] = [[] for _ in leaves]

    def visit(first: int, level: int) -> str:
        if level == 0:
            return leaves[first]
        middle, last = first + (1 << level - 1), min(first + (1 << level), len(leaves))
        left = visit(first, level - 1)
        if middle >= last:
            for path in paths[first:last]:
                path.append("-")
            return digest(left)
        right = visit(middle, level - 1)
        for path in paths[first:middle]:
            path.append("R" + right)
        for path in paths[middle:last]:
            path.append("L" + left)
        return digest(left, right)

    return visit(0, height), paths


def _walk_blocks(nodes: DataFrame, group: list[str], height: int) -> DataFrame:
    """``nodes`` (group, k, digest, ..) with ``path``, and with ``root`` of the block in the row of its first node."""
    made = nodes.withColumn("block", F.shiftright("k", height))

    def walk(block: pa.Table) -> pa.Table:
        block = block.sort_by("k")
        leaves, alone = block["digest"].to_pylist(), block["block"][0].as_py() == 0
        # A first block that isn't full is its group's only one, whose tree ends as soon as a single node is left.
        root, paths = walked(leaves, (len(leaves) - 1).bit_length() if alone else height)
        block = block.append_column("path", pa.array(paths, pa.list_(pa.string())))
        return block.append_column("root", pa.array([root] + [None] * (len(leaves) - 1), pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema) + ", path array<string>, root string"
    return made.groupBy(*group, "block").applyInArrow(walk, schema)


def trees(nodes: DataFrame, group: list[str], height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Trees over numbered nodes (group, k, digest, ..).

    The first result has each node with its whole path and ``subroot``, less k and digest; the second has (group,
    subroot), a row for each group.
    """
    levels, below, extra = [], nodes, [c for c in nodes.columns if c not in (*group, "k", "digest")]
    while True:
        done = stored(_walk_blocks(below, group, height), "manifest-level")
        levels.append(done)
        roots = done.where(F.col("root").isNotNull())
        if roots.where("block > 0").isEmpty():
            break
        below = roots.select(*group, F.col("block").alias("k"), F.col("root").alias("digest"))
    subroots = roots.select(*group, F.col("root").alias("subroot"))
    upper = roots.select(*group, "block", F.array().cast("array<string>").alias("path"), F.col("root").alias("subroot"))
    for depth, level in reversed(list(enumerate(levels))):
        a, b = level.alias("a"), upper.alias("b")
        on = [F.col("a.block") == F.col("b.block")] + [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
        own = extra if depth == 0 else ["k"]
        upper = a.join(b, on).select(
            *[F.col(f"a.{c}") for c in (*group, *own)], F.concat("a.path", "b.path").alias("path"), "b.subroot"
        )
        if depth:
            upper = upper.withColumnRenamed("k", "block")
    return upper, subroots


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    sibling = lambda s: F.substr(s, F.lit(2))
    return F.aggregate(
        path,
        leaf,
        lambda node, s: F.sha2(
            F.when(F.startswith(s, F.lit("L")), F.concat(sibling(s), node)).when(F.startswith(s, F.lit("R")), F.concat(node, sibling(s))).otherwise(node),
            256,
        ),
    )


def proof_digest(path: Column) -> Column:
    siblings = F.transform(F.filter(path, lambda s: s != "-"), lambda s: F.substr(s, F.lit(2)))
    return F.sha2(F.array_join(siblings, ""), 256)


def manifest(df: DataFrame, leaf: Column, group: str, order: str, height: int = HEIGHT) -> DataFrame:
    """``df`` with a struct column ``merkle`` of leaf, subroot, root and path.

    Rows go through a shuffle with all columns of ``df``: leave out what isn't needed, such as hashed texts.
    """
    own = [f"own{k}" for k in range(len(df.columns))]
    rows = df.select(
        *[F.col(f"`{c}`").alias(o) for c, o in zip(df.columns, own, strict=True)], F.col(f"`{group}`").alias("part"),
        F.col(f"`{order}`").alias("at"), leaf.alias("digest"), F.monotonically_increasing_id().alias("place"),
    )
    # Stored, since dealing out by ranges reads its input twice: a leaf is hashed once.
    leaves = numbered(stored(rows, "manifest-leaves"), ["part"], ["at", "digest", "place"]).drop("at", "place").withColumn("leaf", F.col("digest"))
    paths, subroots = trees(leaves, ["part"], height)
    ranked = numbered(subroots, [], ["part"]).select("k", "part", F.col("subroot").alias("digest"))
    tops, root = trees(ranked, [], height)
    tops = tops.select("part", F.col("path").alias("top"), F.col("subroot").alias("root"))
    a, b = paths.alias("a"), tops.alias("b")
    merkle = F.struct(F.col("a.leaf"), F.col("a.subroot"), F.col("b.root"), F.concat("a.path", "b.top").alias("path"))
    return a.join(b, F.col("a.part").eqNullSafe(F.col("b.part"))).select(
        *[F.col(f"a.{o}").alias(c) for c, o in zip(df.columns, own, strict=True)], merkle.alias(free_name(df, "merkle"))
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what its proof says of a row that may have been tampered with."""
    docs = read_table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    fields = {c: F.col(c) for c in FIELDS}
    rows = docs.select(
        "doc_id", "lang", leaf_digest(list(fields.values())).alias("leaf"),
        F.when(changed, leaf_digest(list((fields | {"n_chars": F.col("n_chars") + 1}).values()))).alias("tampered"),
    )
    done = manifest(rows, F.col("leaf"), "lang", "doc_id")
    merkle = F.col("merkle")
    told = done.select(
        "doc_id", "lang", *[merkle[c].alias(c) for c in ("leaf", "subroot", "root")], proof_digest(merkle["path"]).alias("proof_sha256"),
        folded(F.coalesce("tampered", merkle["leaf"]), merkle["path"]).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    def part(x: str) -> str:
        return f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"

    def tree(name: str, source: str) -> str:
        return f"""{name} AS (SELECT 0 AS lvl, part, k, d, n FROM {source}
    UNION ALL SELECT lvl + 1, part, k // 2, sha256(string_agg(d, '' ORDER BY k)), (n + 1) // 2
    FROM {name} WHERE n > 1 GROUP BY lvl, part, k // 2, n)"""

    def paths(name: str, nodes: str, source: str) -> str:
        """For each leaf its siblings, level by level."""
        return f"""{name} AS (SELECT b.part, b.k, list(CASE WHEN s.d IS NULL THEN '-' WHEN s.k % 2 = 0 THEN 'L' || s.d ELSE 'R' || s.d END
        ORDER BY l.lvl) AS path
    FROM {source} b JOIN (SELECT DISTINCT part, lvl FROM {nodes} WHERE n > 1) l ON l.part = b.part
    LEFT JOIN {nodes} s ON s.part = b.part AND s.lvl = l.lvl AND s.k = xor(b.k >> l.lvl, 1) GROUP BY b.part, b.k)"""

    leaf = "sha256(" + " || ".join(map(part, FIELDS)) + ")"
    tampered = "sha256(" + " || ".join(part("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS) + ")"
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
        lambda i: [ascii((doc_id::VARCHAR)[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"""
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, lang, {leaf} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {tampered} END AS tampered FROM documents),
parts AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) AS part FROM docs GROUP BY lang),
leaves AS (SELECT doc_id, docs.lang, part, leaf, leaf AS d, tampered, n,
    row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k
    FROM docs JOIN parts ON docs.lang IS NOT DISTINCT FROM parts.lang),
{tree("nodes", "leaves")},
subroots AS (SELECT part AS lang_part, 1 AS part, part - 1 AS k, d, (SELECT count(*) FROM parts) AS n FROM nodes WHERE n = 1),
{tree("tops", "subroots")},
{paths("low", "nodes", "leaves")},
{paths("high", "tops", "subroots")},
told AS (SELECT doc_id, lang, leaf, s.d AS subroot, (SELECT d FROM tops WHERE n = 1) AS root, tampered,
    list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
    FROM leaves LEFT JOIN low ON low.part = leaves.part AND low.k = leaves.k JOIN subroots s ON s.lang_part = leaves.part
    LEFT JOIN high ON high.k = s.k),
folds AS (SELECT *, sha256(array_to_string(list_transform(list_filter(path, lambda s: s <> '-'), lambda s: s[2:]), '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(tampered, leaf), path), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:]
    ELSE a END)) AS folded_root FROM told)
SELECT doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""


SQL = _sql()
