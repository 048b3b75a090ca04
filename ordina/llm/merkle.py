"""Merkle manifest of documents as a persistent tree with path copying.

Every document is a leaf; the leaves of a language stand in the order of their ids. Two
neighbours become one node, the last of an odd number alone, until the language's
subroot is left; the subroots, in the order of the languages, make the root alike.

Aligned blocks of 1024 leaves, and of 1024 nodes above them, are the unit of storage and
of work: a block is one row, its nodes are made in one task, and what goes on upwards is
its top. A tampered leaf makes a version of the tree: inside its block only the ancestors
of the leaf are copied, all other nodes are those of the first version. The version is
continued where it began, along the siblings of its block in the levels above, which are
worked out once for each block and joined to it. So no task sees more than a block, a
language may hold all rows, and versions never meet in one place.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordina.llm.common import tidy
from ordina.operators.ranking import prefix_starts
from ordina.session import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10  # of a block
WIDTH = 1 << LEVELS
TAMPERED_EVERY = 7

# Where a node's sibling stands.
LEFT, RIGHT, NONE = b"LR-"


def field(value: Column) -> Column:
    """The value as its length in bytes, a colon and its text; null as `-`."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


# --- one block ---------------------------------------------------------------


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def nodes_of(leaves: list[bytes], height: int) -> list[list[bytes]]:
    """All levels of a block, its leaves first; the last one holds its top only."""
    levels = [leaves]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest(b"".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def siblings_of(levels: list[list[bytes]], at: int) -> tuple[bytes, list[bytes]]:
    """(sides, siblings) from the leaf `at` up to the top of its block."""
    sides, found = bytearray(), []
    for level in levels[:-1]:
        other = at ^ 1
        if other >= len(level):
            sides.append(NONE)
        else:
            sides.append(LEFT if other < at else RIGHT)
            found.append(level[other])
        at >>= 1
    return bytes(sides), found


def copied(node: bytes, sides: bytes, siblings: list[bytes]) -> list[bytes]:
    """New ancestors of a changed node, lowest first; everything beside them is shared."""
    path, at = [], 0
    for side in sides:
        if side == NONE:
            node = digest(node)
        else:
            node = digest(siblings[at] + node if side == LEFT else node + siblings[at])
            at += 1
        path.append(node)
    return path


def height_of(nodes: int) -> int:
    """Levels that a block adds above its row in a tree of so many nodes."""
    return min(LEVELS, (nodes - 1).bit_length())


def split(joined: bytes) -> list[bytes]:
    return [joined[i : i + 64] for i in range(0, len(joined), 64)]


def each_block(batches: Iterator[pa.RecordBatch], rows: str) -> Iterator[tuple[pa.RecordBatch, int, pa.StructArray]]:
    for batch in batches:
        inside, bounds = batch.column(rows).flatten(), np.cumsum([0, *batch.column(rows).value_lengths().to_pylist()])
        for i in range(batch.num_rows):
            yield batch, i, inside.slice(bounds[i], bounds[i + 1] - bounds[i])


def hexes(column: pa.Array) -> list[bytes | None]:
    return [None if x is None else x.hex().encode() for x in column.to_pylist()]


# --- the tree ----------------------------------------------------------------


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their partition and their place among its rows of the same language.

    Rows come sorted by language.
    """
    part, last, given = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        at = []
        for lang in batch.column("lang").to_pylist():
            given = 0 if lang != last else given + 1
            last = lang
            at.append(given)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())],
            [*batch.schema.names, "part", "at"],
        )


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, i, rows in each_block(batches, "leaves"):
        tree, block, n = (batch.column(c)[i].as_py() for c in ("tree", "block", "n"))
        top = nodes_of(hexes(rows.field("leaf")), height_of(n))[-1][0]
        yield pa.RecordBatch.from_pydict({"tree": [tree], "pos": [block], "n": [-(-n // WIDTH)], "node": [top]})


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's siblings inside its block, and the block's top."""
    for batch, i, rows in each_block(batches, "nodes"):
        tree, n = (batch.column(c)[i].as_py() for c in ("tree", "n"))
        levels = nodes_of(rows.field("node").to_pylist(), height_of(n))
        found = [siblings_of(levels, at) for at in range(len(rows))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([tree] * len(rows), pa.int64()),
                rows.field("pos"),
                pa.array([n] * len(rows), pa.int64()),
                pa.array([s for s, _ in found], pa.binary()),
                pa.array([b"".join(x) for _, x in found], pa.binary()),
                pa.array([levels[-1][0]] * len(rows), pa.binary()),
            ],
            ["tree", "pos", "n", "sides", "siblings", "top"],
        )


def _grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From nodes (tree, pos, n, node) up to one node a tree, all trees at once.

    Gives the steps of every round, lowest first, and the last nodes.
    """
    rounds = []
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        blocks = nodes.groupBy("tree", F.shiftright("pos", LEVELS).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("nodes"), F.first("n").alias("n")
        )
        steps = blocks.mapInArrow(tidy(_steps), "tree long, pos long, n long, sides binary, siblings binary, top binary")
        rounds.append(written(steps, "merkle-steps"))
        first = rounds[-1].where(F.col("pos") % WIDTH == 0)
        nodes = first.select("tree", F.shiftright("pos", LEVELS).alias("pos"), F.ceil(F.col("n") / WIDTH).alias("n"), F.col("top").alias("node"))
    return rounds, nodes


def _continued(steps: DataFrame, above: DataFrame) -> DataFrame:
    """`steps` with what `above` (up_tree, up_pos, up_sides, up_siblings, …) has beyond their blocks."""
    on = (F.col("tree") == F.col("up_tree")) & (F.shiftright("pos", LEVELS) == F.col("up_pos"))
    rest = [c for c in above.columns if c not in ("up_tree", "up_pos", "up_sides", "up_siblings")]
    return steps.join(above, on).select(
        F.col("tree").alias("up_tree"),
        F.col("pos").alias("up_pos"),
        F.concat("sides", "up_sides").alias("up_sides"),
        F.concat("siblings", "up_siblings").alias("up_siblings"),
        *rest,
    )


@dataclass
class Manifest:
    """A stored tree.

    blocks: (tree, block, n, lang, leaves: array of (pos, doc_id, leaf, copy)), a row for
    each block of leaves; n counts the language's leaves, copy is the leaf of the tampered
    document. paths: (up_tree, up_pos, up_sides, up_siblings, subroot, root), a row for
    each block with its siblings above.
    """

    blocks: DataFrame
    paths: DataFrame


def build(docs: DataFrame, tampered: Column | None = None, changes: dict[str, Column] | None = None) -> Manifest:
    """The manifest of `docs`, with a version for each row that is `tampered`.

    `changes` gives the altered columns of those rows. Other columns are ignored. Null
    ids come first; rows with equal ids are leaves of their own, in the order of their
    digests. A null language is a tree of its own before all others.
    """
    values = [F.col(c) for c in FIELDS]
    altered = [(changes or {}).get(c, v) for c, v in zip(FIELDS, values)]
    copy = F.when(tampered, F.unhex(leaf_of(altered))) if tampered is not None else F.lit(None).cast("binary")
    leaves = docs.select(
        F.col("lang").cast("string").alias("lang"),
        F.col("doc_id"),
        F.unhex(leaf_of(values)).alias("leaf"),
        copy.alias("copy"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = written(leaves, "merkle-leaves")
    kind = leaves.schema["doc_id"].dataType.simpleString()
    order = ["lang", "doc_id", "leaf", "row"]
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    numbered = ranged.mapInArrow(tidy(_numbered), f"lang string, doc_id {kind}, leaf binary, copy binary, part int, at long")
    numbered = written(numbered, "merkle-numbered")
    cells = numbered.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = written(cells.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0))), "merkle-cells")
    trees = prefix_starts(cells.groupBy("lang").agg(F.sum("rows").alias("n")), ["lang"], F.lit(1))
    trees = written(trees.select(F.col("lang").alias("of_lang"), "n", F.col("__start").alias("tree")), "merkle-trees")
    starts = cells.join(trees, F.col("lang").eqNullSafe(F.col("of_lang")))
    starts = written(starts.select("of_lang", F.col("part").alias("of_part"), "start", "n", "tree"), "merkle-starts")
    placed = numbered.join(starts, (F.col("part") == F.col("of_part")) & F.col("lang").eqNullSafe(F.col("of_lang")))
    placed = placed.withColumn("pos", F.col("start") + F.col("at"))
    blocks = placed.groupBy("tree", F.shiftright("pos", LEVELS).alias("block")).agg(
        F.first("n").alias("n"),
        F.first("lang").alias("lang"),
        F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", "copy"))).alias("leaves"),
    )
    blocks = written(blocks, "merkle-blocks")

    tops = blocks.select("tree", "block", "n", "leaves").mapInArrow(tidy(_tops), "tree long, pos long, n long, node binary")
    rounds, subroots = _grown(written(tops, "merkle-tops"))
    n_trees = trees.count()
    over = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("n"), "node")
    top_rounds, roots = _grown(over)
    nothing = F.lit(b"").cast("binary")
    above = roots.select(
        F.lit(0).cast("long").alias("up_tree"), F.col("pos").alias("up_pos"), nothing.alias("up_sides"), nothing.alias("up_siblings"), F.col("node").cast("string").alias("root")
    )
    for steps in reversed(top_rounds):
        above = _continued(steps, above)
    # From here on a tree's only node is the leaf of the tree above.
    subroot = subroots.select(F.col("tree").alias("of_tree"), F.col("node").cast("string").alias("subroot"))
    above = above.join(subroot, F.col("up_pos") == F.col("of_tree")).select(
        F.col("of_tree").alias("up_tree"), F.lit(0).cast("long").alias("up_pos"), "up_sides", "up_siblings", "subroot", "root"
    )
    for steps in reversed(rounds):
        above = _continued(steps, above)
    return Manifest(blocks, written(above, "merkle-paths"))


def _each_leaf(batch: pa.RecordBatch, i: int, rows: pa.StructArray) -> Iterator[tuple]:
    """(leaf, siblings, copied ancestors) of a block's leaves, up to the root."""
    n, sides, joined = (batch.column(c)[i].as_py() for c in ("n", "up_sides", "up_siblings"))
    leaves, above = hexes(rows.field("leaf")), split(joined)
    levels = nodes_of(leaves, height_of(n))
    beyond: dict[bytes, list[bytes]] = {}  # versions with one top go on alike
    for at, (leaf, copy) in enumerate(zip(leaves, hexes(rows.field("copy")))):
        within, inside = siblings_of(levels, at)
        path = copied(copy or leaf, within, inside)
        top = path[-1] if path else copy or leaf
        if top not in beyond:
            beyond[top] = copied(top, sides, above)
        yield leaf, copy, inside, joined, path, beyond[top]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, i, rows in each_block(batches, "leaves"):
        leaf, proof, folded = [], [], []
        for own, copy, inside, above, path, beyond in _each_leaf(batch, i, rows):
            leaf.append(own.decode())
            proof.append(digest(b"".join(inside) + above).decode())
            folded.append([copy or own, *path, *beyond][-1].decode())
        root = batch.column("root")[i].as_py()
        yield pa.RecordBatch.from_arrays(
            [
                rows.field("doc_id"),
                pa.array(leaf, pa.string()),
                pa.array([batch.column("subroot")[i].as_py()] * len(leaf), pa.string()),
                pa.array([root] * len(leaf), pa.string()),
                pa.array(proof, pa.string()),
                pa.array(folded, pa.string()),
                pa.array([x == root for x in folded], pa.bool_()),
                pa.array([batch.column("lang")[i].as_py()] * len(leaf), pa.string()),
            ],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "lang"],
        )


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, i, rows in each_block(batches, "leaves"):
        out = {"row": [], "level": [], "node": []}
        for at, (own, copy, _, _, path, beyond) in enumerate(_each_leaf(batch, i, rows)):
            if copy is None or copy == own:
                continue
            new = [copy, *path, *beyond]
            out["row"] += [at] * len(new)
            out["level"] += range(len(new))
            out["node"] += [x.decode() for x in new]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([batch.column("lang")[i].as_py()] * len(out["row"]), pa.string()),
                rows.field("doc_id").take(pa.array(out["row"], pa.int64())),
                rows.field("pos").take(pa.array(out["row"], pa.int64())),
                pa.array(out["level"], pa.int32()),
                pa.array(out["node"], pa.string()),
            ],
            ["lang", "doc_id", "pos", "level", "node"],
        )


def _on_blocks(tree: Manifest, run: Callable, schema: str) -> DataFrame:
    on = (F.col("tree") == F.col("up_tree")) & (F.col("block") == F.col("up_pos"))
    kind = tree.blocks.schema["leaves"].dataType.elementType["doc_id"].dataType.simpleString()
    return tree.blocks.join(tree.paths, on).mapInArrow(tidy(run), schema.format(kind))


def verify(tree: Manifest) -> DataFrame:
    """One row per document: what its version of the tree gives against the first root.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang). The proof is
    the digest of the siblings up to the root; folded_root the root of the document's
    version, the first one where nothing was changed.
    """
    return _on_blocks(
        tree,
        _verified,
        "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, lang string",
    )


def versions(tree: Manifest) -> DataFrame:
    """The nodes that versions do not share: (lang, doc_id, pos, level, node).

    Level 0 is the changed leaf, the last level the version's root; pos is the leaf's
    place in its language.
    """
    return _on_blocks(tree, _versions, "lang string, doc_id {}, pos long, level int, node string")


def audit(docs: DataFrame) -> DataFrame:
    """`verify` with every seventh document, by crc32 of its id, counting one character more.

    Null ids are never tampered with, a null count stays null. An empty table gives no
    rows; equal rows stay rows.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    return verify(build(docs, F.coalesce(hit, F.lit(False)), {"n_chars": more}))


CRC_SQL = """
crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
), crc AS (
  SELECT doc_id, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents), crc_table
)"""

ORACLE = f"""
WITH RECURSIVE {CRC_SQL}, leaves AS (
  SELECT row_number() OVER () AS r, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, lang,
         sha256(a || b || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || c) AS leaf,
         sha256(a || b || coalesce(strlen(CAST(n_chars + hit AS VARCHAR)) || ':' || (n_chars + hit), '-') || c) AS changed
  FROM (
    SELECT d.*, CASE WHEN crc % {TAMPERED_EVERY} = 0 THEN 1 ELSE 0 END AS hit,
           coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-')
             || coalesce(strlen(source) || ':' || source, '-') AS a,
           coalesce(strlen(lang) || ':' || lang, '-') AS b, coalesce(strlen(text) || ':' || text, '-') AS c
    FROM documents d LEFT JOIN crc ON d.doc_id IS NOT DISTINCT FROM crc.doc_id
  )
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY t) AS n
  FROM leaves
), nodes AS (
  SELECT t, 0 AS l, p, n, leaf AS h FROM placed
  UNION ALL
  SELECT t, l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM nodes WHERE n > 1 GROUP BY t, l, p // 2, n
), upper AS (
  SELECT 0 AS l, t AS p, count(*) OVER () AS n, h FROM nodes WHERE n = 1
  UNION ALL
  SELECT l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM upper WHERE n > 1 GROUP BY l, p // 2, n
), up AS (
  SELECT r, t, 0 AS l, p, n, changed AS h, '' AS siblings FROM placed
  UNION ALL
  SELECT u.r, u.t, u.l + 1, u.p // 2, (u.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN u.h WHEN u.p % 2 = 1 THEN s.h || u.h ELSE u.h || s.h END),
         u.siblings || coalesce(s.h, '')
  FROM up u LEFT JOIN nodes s ON s.t = u.t AND s.l = u.l AND s.p = xor(u.p, 1) WHERE u.n > 1
), over AS (
  SELECT r, 0 AS l, t AS p, (SELECT count(*) FROM nodes WHERE n = 1) AS n, h, siblings FROM up WHERE n = 1
  UNION ALL
  SELECT u.r, u.l + 1, u.p // 2, (u.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN u.h WHEN u.p % 2 = 1 THEN s.h || u.h ELSE u.h || s.h END),
         u.siblings || coalesce(s.h, '')
  FROM over u LEFT JOIN upper s ON s.l = u.l AND s.p = xor(u.p, 1) WHERE u.n > 1
)
SELECT d.doc_id, d.leaf, s.h AS subroot, root.h AS root, sha256(o.siblings) AS proof_sha256, o.h AS folded_root,
       o.h = root.h AS verified, d.lang
FROM placed d JOIN over o ON o.r = d.r AND o.n = 1 JOIN nodes s ON s.t = d.t AND s.n = 1
     JOIN (SELECT h FROM upper WHERE n = 1) root ON true"""

cloudpickle.register_pickle_by_value(sys.modules[__name__])
