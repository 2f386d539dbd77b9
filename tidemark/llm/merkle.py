"""Merkle manifest of a dataset: one tree per partition of the rows, one tree over their roots.

A tree is stored in blocks of aligned subtrees: 4096 leaves, twelve levels above them. Inside a block the nodes lie in van
Emde Boas order: a subtree is cut at half its height, its upper half comes first, then the lower subtrees from left to right,
each laid out in the same way. Addresses follow from level and number by arithmetic alone; construction writes through them,
and so does the retrieval of siblings. The roots of the blocks are the leaves of the next layer of blocks, and so on until one
block is left; 4096^3 leaves make three layers.

Ranks are counted in ranges of the order, so no window or task holds a whole partition. A task holds one block. Proofs go
down from the last layer: a block's path is its siblings in its parent block, then the parent's path.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize
from tidemark.llm.sharding import _numbered

#: Levels of a block above its leaves.
HEIGHT = 12
#: Rows aimed at in one range of the order.
RANGE_ROWS = 50_000


def address(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places of the nodes `number` at `depth` (0: the root) in a tree of so many levels in van Emde Boas order."""
    if levels <= 1:
        return np.zeros_like(number)
    top = levels // 2
    if depth < top:
        return address(top, depth, number)
    below = depth - top
    size = (1 << (levels - top)) - 1
    return (1 << top) - 1 + (number >> below) * size + address(levels - top, below, number & ((1 << below) - 1))


def node_hash(*children: bytes) -> bytes:
    """SHA-256 over the children's digests as hex text."""
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def build(leaves: list[bytes], height: int) -> bytes:
    """The nodes of one block, 32 bytes each, in van Emde Boas order; places without a node are zero."""
    nodes, level = bytearray(((1 << (height + 1)) - 1) * 32), leaves
    for up in range(height + 1):
        if up:
            level = [node_hash(*level[k : k + 2]) for k in range(0, len(level), 2)]
        for place, digest in zip(address(height + 1, height - up, np.arange(len(level))).tolist(), level, strict=True):
            nodes[place * 32 : place * 32 + 32] = digest
    return bytes(nodes)


def siblings(nodes: bytes, height: int, n: int, numbers: np.ndarray) -> list[list[bytes]]:
    """For each leaf number of a block with n leaves, level by level upwards: b"L" or b"R", the sibling's side, and its digest; empty
    where the node has none."""
    out: list[list[bytes]] = [[] for _ in numbers]
    for up in range(height):
        own = numbers >> up
        places, there = address(height + 1, height - up, own ^ 1), (own ^ 1) < -(-n >> up)
        for path, place, some, right in zip(out, places.tolist(), there.tolist(), (own & 1).tolist(), strict=True):
            path.append((b"L" if right else b"R") + nodes[place * 32 : place * 32 + 32] if some else b"")
    return out


def fold(leaf: bytes, path: list[bytes]) -> bytes:
    """The root that a leaf and its path give."""
    for step in path:
        leaf = node_hash(step[1:], leaf) if step[:1] == b"L" else node_hash(leaf, step[1:]) if step else node_hash(leaf)
    return leaf


def proof_hash(path: list[bytes]) -> str:
    return hashlib.sha256(b"".join(step[1:].hex().encode() for step in path)).hexdigest()


@dataclass
class Forest:
    """layers[k]: (tree, block, n, height, root, nodes), the blocks of layer k, stored; roots: (tree, root)."""

    layers: list[DataFrame]
    roots: DataFrame


BLOCKS = "tree string, block long, n int, height int, root binary, nodes binary"


def plant(leaves: DataFrame, bits: int = HEIGHT) -> Forest:
    """The forest over leaves (tree, rank: from 0 on without gaps, of: leaves of the tree, digest), in blocks of `bits` levels above
    their leaves, or of as many as the tree has left."""

    def built(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        height = min(bits, (group.column("of")[0].as_py() - 1).bit_length())
        nodes = build(group.column("digest").to_pylist(), height)
        row = {"tree": key[0].as_py(), "block": key[1].as_py(), "n": group.num_rows, "height": height, "root": nodes[:32], "nodes": nodes}
        schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("height", pa.int32()), ("root", pa.binary()), ("nodes", pa.binary())])
        return pa.Table.from_pylist([row], schema=schema)

    layers, level = [], leaves
    while True:
        blocks = level.select("tree", F.shiftright("rank", bits).alias("block"), "rank", "of", "digest").groupBy("tree", "block").applyInArrow(built, BLOCKS)
        layers.append(materialize(blocks, f"merkle-{len(layers)}"))
        of = F.expr(f"shiftright(of + {(1 << bits) - 1}, {bits})")
        sizes = level.select("tree", of.alias("of")).groupBy("tree").agg(F.max("of").alias("of"))
        # a tree that is down to one block has its root as the only leaf of the layers above
        level = layers[-1].select("tree", F.col("block").alias("rank"), F.col("root").alias("digest")).join(sizes, "tree")
        if (level.agg(F.max("of")).first()[0] or 1) <= 1:
            return Forest(layers, level.select("tree", F.col("digest").alias("root")))


PATHS = "tree string, block long, path array<binary>"


def climbed(children: DataFrame, parents: DataFrame, bits: int = HEIGHT) -> DataFrame:
    """(tree, block, path): children's (tree, parent, block) siblings in their parent block, then the path of that block, from
    parents (tree, parent, n, height, nodes, path)."""

    def run(key: tuple, own: pa.Table, above: pa.Table) -> pa.Table:
        block = above.select(["n", "height", "nodes", "path"]).to_pylist()[0]
        paths = siblings(block["nodes"], block["height"], block["n"], own.column("block").to_numpy() & ((1 << bits) - 1))
        return pa.table({"tree": own.column("tree"), "block": own.column("block"), "path": pa.array([p + block["path"] for p in paths], pa.list_(pa.binary()))})

    grouped = children.select("tree", "parent", "block").groupBy("tree", "parent")
    return grouped.cogroup(parents.groupBy("tree", "parent")).applyInArrow(run, PATHS)


def with_paths(forest: Forest, above: DataFrame, bits: int = HEIGHT) -> DataFrame:
    """The blocks of the first layer with their paths to the end; above: (tree, path), what follows each tree's root."""
    paths = forest.layers[-1].select("tree", "block").join(above, "tree")
    for k in range(len(forest.layers) - 1, 0, -1):
        parents = forest.layers[k].join(paths, ["tree", "block"]).withColumnRenamed("block", "parent")
        children = forest.layers[k - 1].select("tree", "block", F.shiftright("block", bits).alias("parent"))
        paths = climbed(children, parents, bits)
    return forest.layers[0].join(paths, ["tree", "block"])


def ranked(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """n rows with rank, from 0 on in the order within their tree, and of, the rows of the tree; the order is cut into ranges first."""
    cut = rows.repartitionByRange(max(1, -(-n // RANGE_ROWS)), "tree", *order).withColumn("__range", F.spark_partition_id())
    cut = materialize(cut, "merkle-ranges")
    return _numbered(cut, ["__range"], ["tree"], order, "rank", "of").withColumn("rank", F.col("rank") - 1).drop("__range")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of all fields, `-` for null, else UTF-8 length, colon, value."""
    said = (v.cast("string") for v in fields.values())
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said)), 256))


def leaves(rows: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", id_col: str = "doc_id", tampered: dict[str, Column] | None = None) -> DataFrame:
    """(tree, id, digest, other): stored; other is the digest with the columns of `tampered` in place of the rows' own. The tree's name is
    empty for null, else `=` and the value, so that null comes first."""
    own = {c: F.col(c) for c in fields}
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    other = F.when(F.lit(bool(tampered)), leaf_digest(own | (tampered or {})))
    return materialize(rows.select(name.alias("tree"), F.col(id_col).alias("id"), leaf_digest(own).alias("digest"), other.alias("other")), "merkle-leaves")


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", id_col: str = "doc_id", tampered: dict[str, Column] | None = None, bits: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row; `tampered`: columns as they are found when the
    proofs are checked.

    Leaves of a tree ascend by id, nulls first; rows with equal ids by digest, so equal rows have a leaf each and are
    interchangeable. A null tree is a tree of its own, before all others; null fields differ from empty ones; texts are hashed
    whole, however long. An empty table gives an empty result. Columns that aren't named as fields, tree or id are not read.
    """
    own = leaves(rows, fields, tree, id_col, tampered)
    stored = materialize(ranked(own, [F.col("id"), F.col("digest")], own.count()), "merkle-ranked")
    forest = plant(stored, bits)
    subroots = forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("digest"))
    subroots = materialize(subroots, "merkle-subroots")
    # the trees' own order: their ranges are cut like those of rows
    placed = materialize(ranked(subroots, [F.col("id")], subroots.count()), "merkle-trees")
    crown = plant(placed, bits)
    top = crown.roots.select("tree", F.array().cast("array<binary>").alias("path"))
    above = with_paths(crown, top, bits).withColumnRenamed("block", "parent")
    children = placed.select("tree", F.shiftright("rank", bits).alias("parent"), F.col("rank").alias("block"), "id", F.col("digest").alias("subroot"))
    by_tree = children.join(climbed(children, above, bits), ["tree", "block"]).join(crown.roots, "tree").select(F.col("id").alias("tree"), "path", "subroot", "root")
    by_tree = materialize(by_tree, "merkle-paths")
    blocks = with_paths(forest, by_tree.select("tree", "path"), bits).drop("root").join(by_tree.select("tree", "subroot", "root"), "tree")

    def proved(key: tuple, rows: pa.Table, blocks: pa.Table) -> pa.Table:
        block = blocks.select(["n", "height", "nodes", "path", "subroot", "root"]).to_pylist()[0]
        paths = siblings(block["nodes"], block["height"], block["n"], rows.column("rank").to_numpy() & ((1 << bits) - 1))
        paths = [p + block["path"] for p in paths]
        digests, others = rows.column("digest").to_pylist(), rows.column("other").to_pylist()
        return pa.table({
            "id": rows.column("id"),
            "leaf": [d.hex() for d in digests],
            "subroot": pa.array([block["subroot"].hex()] * len(paths), pa.string()),
            "root": pa.array([block["root"].hex()] * len(paths), pa.string()),
            "proof_sha256": [proof_hash(p) for p in paths],
            "folded_root": [fold(d if o is None else o, p).hex() for d, o, p in zip(digests, others, paths, strict=True)],
        })

    kind = dict(stored.dtypes)["id"]
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    numbered = stored.withColumn("block", F.shiftright("rank", bits)).groupBy("tree", "block")
    out = numbered.cogroup(blocks.groupBy("tree", "block")).applyInArrow(proved, schema)
    discard(own)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every document's leaf and proof; where 7 divides the CRC-32 of the id, one is added to n_chars before the check."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0, F.lit(False))
    out = manifest(docs, tampered={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return out.withColumnRenamed("id", "doc_id")


def _sql_field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR)) || ':' || ({value})::VARCHAR, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_field(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


#: CRC-32 bit by bit from the reflected polynomial; both kinds of trees level by level; proofs as joins, folded as lists.
ORACLE_SQL = f"""
WITH RECURSIVE steps(b, k, c) AS (
  SELECT b, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
hit AS (
  SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, false) AS hit
  FROM documents, crc_table
), leaf AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_sql_leaf("n_chars")} AS leaf, {_sql_leaf("n_chars + hit::BIGINT")} AS other FROM hit),
own AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
nodes(tree, up, i, n, h) AS (
  SELECT tree, 0, i, n, leaf FROM own
  UNION ALL
  SELECT tree, up + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, up, n, i // 2
), subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
crown(up, i, n, h) AS (
  SELECT 0, i, n, subroot FROM subroots
  UNION ALL
  SELECT up + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY up, n, i // 2
), low AS (
  SELECT o.tree, o.i, list(CASE WHEN s.h IS NULL THEN '' WHEN s.i % 2 = 0 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY l.up) AS path
  FROM own o JOIN (SELECT DISTINCT tree, up FROM nodes WHERE n > 1) l ON l.tree = o.tree
  LEFT JOIN nodes s ON s.tree = o.tree AND s.up = l.up AND s.i = xor(o.i >> l.up, 1) GROUP BY o.tree, o.i
), high AS (
  SELECT o.tree, list(CASE WHEN s.h IS NULL THEN '' WHEN s.i % 2 = 0 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY l.up) AS path
  FROM subroots o CROSS JOIN (SELECT DISTINCT up FROM crown WHERE n > 1) l
  LEFT JOIN crown s ON s.up = l.up AND s.i = xor(o.i >> l.up, 1) GROUP BY o.tree
), every AS (
  SELECT doc_id, leaf, other, subroot, (SELECT h FROM crown WHERE n = 1) AS root, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
  FROM own JOIN subroots USING (tree) LEFT JOIN low ON low.tree = own.tree AND low.i = own.i LEFT JOIN high ON high.tree = own.tree
), folded AS (
  SELECT *, list_reduce(list_prepend(other, path), lambda a, s: sha256(CASE s[1:1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root FROM every
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
