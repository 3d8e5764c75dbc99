"""Merkle manifest of a dataset by postorder traversal of aligned blocks.

Every row is a leaf; the leaves of a tree (all rows of one language, say) stand in the order of their ids. A task takes an
aligned block of 2^BLOCK_HEIGHT nodes and walks its subtree in postorder: each visit returns the digest of its subtree and,
while unwinding, appends that digest as a sibling to the nodes of the other half. The roots of the blocks are the nodes
of the next, equally distributed traversal, until each tree has one root; the roots of the trees form the last tree. On
the way back every block gets the siblings above its root, so a leaf's proof is complete where the leaf lies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.shared import written
from millrace.sources.tables import placed

#: Nodes of a block: 2 to this power. Any height gives the same digests.
BLOCK_HEIGHT = 10

PATHS = "tree string, place long, path array<string>, subroot string, root string"


def digest(*parts: str) -> str:
    """Lower-case hex SHA-256 of digests in hex, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(nodes: int) -> int:
    """Levels above `nodes` nodes until one is left."""
    return max(nodes - 1, 0).bit_length()


def traverse(nodes: list[str], levels: int) -> tuple[str, list[list[str]]]:
    """Digest of the subtree over nodes, `levels` high, and the siblings of each node from below.

    A sibling is "L" or "R", the side on which it stands, and its digest; "" where a run has only one node.
    """
    paths: list[list[str]] = [[] for _ in nodes]

    def visit(begin: int, level: int) -> str:
        if level == 0:
            return nodes[begin]
        middle, end = begin + (1 << (level - 1)), min(begin + (1 << level), len(nodes))
        left = visit(begin, level - 1)
        if middle >= end:
            for i in range(begin, end):
                paths[i].append("")
            return digest(left)
        right = visit(middle, level - 1)
        for i in range(begin, middle):
            paths[i].append("R" + right)
        for i in range(middle, end):
            paths[i].append("L" + left)
        return digest(left, right)

    return visit(0, levels), paths


def fold(node: str, path: list[str]) -> str:
    """The root that a node and its siblings lead to."""
    for s in path:
        node = digest(s[1:], node) if s[:1] == "L" else digest(node, s[1:])
    return node


def proof(path: list[str]) -> str:
    """SHA-256 of all siblings' digests in order."""
    return digest(*(s[1:] for s in path))


def field(value: Column) -> Column:
    """A value of a leaf: "-" for null, else its number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's values."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _mapped(rows: DataFrame, each: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Rows that `each` makes of a block's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time
                yield pa.RecordBatch.from_pylist(each(batch.slice(i, 1).to_pylist()[0]), schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(run, schema)


def _blocks(nodes: DataFrame) -> DataFrame:
    """Written rows (tree, block, levels, nodes) of nodes (tree, place, node): the nodes of an aligned block in order."""
    size = 1 << BLOCK_HEIGHT
    counts = nodes.groupBy(F.col("tree").alias("of")).agg(F.count("*").alias("total"))
    blocks = nodes.groupBy("tree", F.floor(F.col("place") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("nodes"))
    levels = F.when(F.col("total") > size, BLOCK_HEIGHT).otherwise(F.length(F.conv(F.col("total") - 1, 10, 2)) - (F.col("total") == 1).cast("int"))
    return written(blocks.join(counts, F.col("tree").eqNullSafe(F.col("of"))).select("tree", "block", levels.cast("int").alias("levels"), "nodes"), "blocks")


def _climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round from the leaves up, and the roots (tree, digest). most: nodes of the largest tree."""
    levels = []

    def root(block: dict) -> list[dict]:
        top, _ = traverse([n["node"]["digest"] for n in block["nodes"]], block["levels"])
        return [{"tree": block["tree"], "place": block["block"], "digest": top}]

    while True:
        levels.append(_blocks(nodes))
        roots = _mapped(levels[-1], root, "tree string, place long, digest string")
        most = -(-most >> BLOCK_HEIGHT)
        if most <= 1:
            return levels, written(roots.select("tree", "digest"), "roots")
        nodes = roots.select("tree", "place", F.struct("digest").alias("node"))


def _descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Rows (tree, place, path, subroot, root, node) of the lowest level's nodes, from what stands above the trees."""

    def open_up(block: dict) -> list[dict]:
        _, paths = traverse([n["node"]["digest"] for n in block["nodes"]], block["levels"])
        return [{"tree": block["tree"], "place": n["place"], "path": p + block["path"], "subroot": block["subroot"], "root": block["root"]} for n, p in zip(block["nodes"], paths, strict=True)]

    for blocks in reversed(levels[1:]):
        above = _mapped(_under(blocks, above), open_up, PATHS)
    return _under(levels[0], above)


def _under(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """blocks with path, subroot and root of the node that each is the subtree of."""
    above = above.withColumnRenamed("tree", "of")
    return blocks.join(above, F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("place"))).drop("of", "place")


def manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row: the manifest and its check.

    leaf is the digest of the row's fields; the leaves of a tree, those with one value of tree_col, ascend by id_col
    (null first, rows of one id by their leaf; repeated rows are leaves of their own), two by two under a digest, an odd
    last one alone under its own. The trees' roots stand in the order of tree_col's bytes, null first. claimed gives
    columns that are to be checked in place of docs' own; folded_root is what the claimed row and the siblings lead to, and
    verified whether that is root. Any column may be null and further columns are ignored; an empty text is "0:", a null
    "-". A text is hashed by Spark and not carried further; no task holds more than a block of 2^10 leaves. No rows in,
    no rows out.
    """
    own = [F.col(f"`{c}`") for c in fields]
    claimed = claimed or {}
    changed = leaf(*(claimed.get(c, F.col(f"`{c}`")) for c in fields)) if claimed else F.lit(None).cast("string")
    differs = F.lit(False)
    for c, value in claimed.items():
        differs |= ~value.eqNullSafe(F.col(f"`{c}`"))
    leaves = docs.select(F.col(f"`{tree_col}`").cast("string").alias("tree"), F.col(f"`{id_col}`").alias("doc_id"), leaf(*own).alias("digest"), F.when(differs, changed).alias("claimed"))
    ranged = placed(leaves, [F.col("doc_id").asc_nulls_first(), "digest"], within=["tree"])
    nodes = ranged.select("tree", "place", F.struct("digest", "claimed", "doc_id").alias("node"))
    most = ranged.agg(F.max("place")).first()[0]
    levels, roots = _climb(nodes, 0 if most is None else most + 1)

    # the trees' roots are the nodes of one more tree
    upper = placed(roots, [F.col("tree").asc_nulls_first()]).select(F.lit("").alias("tree"), "place", F.struct("digest", F.col("tree").alias("name")).alias("node"))
    trees = upper.agg(F.max("place")).first()[0]
    top, root = _climb(upper, 0 if trees is None else trees + 1)
    start = root.select("tree", F.lit(0).cast("long").alias("place"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))

    def tops(block: dict) -> list[dict]:
        _, paths = traverse([n["node"]["digest"] for n in block["nodes"]], block["levels"])
        return [{"tree": n["node"]["name"], "place": 0, "path": p + block["path"], "subroot": n["node"]["digest"], "root": block["root"]} for n, p in zip(block["nodes"], paths, strict=True)]

    above = written(_mapped(_descend(top, start), tops, PATHS), "tops")

    def ends(block: dict) -> list[dict]:
        _, paths = traverse([n["node"]["digest"] for n in block["nodes"]], block["levels"])
        out = []
        for n, p in zip(block["nodes"], paths, strict=True):
            node, whole = n["node"], p + block["path"]
            folded = fold(node["claimed"] or node["digest"], whole)
            out.append({"doc_id": node["doc_id"], "leaf": node["digest"], "subroot": block["subroot"], "root": block["root"], "proof_sha256": proof(whole), "folded_root": folded, "verified": folded == block["root"]})
        return out

    kind = leaves.schema["doc_id"].dataType.simpleString()
    return _mapped(_descend(levels, above), ends, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
