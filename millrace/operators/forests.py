"""Extremely randomised trees, grown level by level from class counts on both sides of random cuts.

A node tries a few columns, each at one cut drawn between the bounds that its ancestors' cuts leave of the column's range. In one pass
per level every task sends its rows down the trees so far and counts classes left and right of all cuts of the level's
nodes; tasks in a tree add these counts, whose size depends on trees, depth and classes alone. Rows are never moved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.discriminative import _prepared, mapped, tree_sum
from millrace.operators.neighbours import matrix
from millrace.sources.tables import discard


@dataclass
class Forest:
    """By tree and node (the children of i are 2i + 1 and 2i + 2): column or -1, cut, class counts; and what each column gained."""

    classes: list[str]
    column: np.ndarray
    cut: np.ndarray
    counts: np.ndarray
    importance: np.ndarray

    def nodes(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node of each row, as far down as the tree goes."""
        at = np.zeros(len(x), np.int64)
        while True:
            column = self.column[tree][at]
            goes = column >= 0
            if not goes.any():
                return at
            right = x[np.arange(len(x)), np.maximum(column, 0)] > self.cut[tree][at]
            at = np.where(goes, 2 * at + 1 + right, at)

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the shares of the classes where a row ends."""
        total = np.zeros((len(x), len(self.classes)))
        for t in range(len(self.column)):
            own = self.counts[t][self.nodes(x, t)]
            total += own / np.maximum(own.sum(1, keepdims=True), 1)
        return total / len(self.column)


def _impurity(counts: np.ndarray) -> np.ndarray:
    """Rows times Gini impurity."""
    n = counts.sum(-1)
    return n - (counts**2).sum(-1) / np.maximum(n, 1)


def extra_trees(rows: DataFrame, label: str, vector: str, trees: int = 20, depth: int = 8, tried: int | None = None, least: int = 2, seed: int = 42, most_bytes: int = 256 << 20) -> Forest:
    """A forest over all rows with a class and a vector. tried: columns of a node, the root of their number if not given.

    A node of fewer than `least` rows, of one class or without a cut that parts its rows stays a leaf. Counts of a level of over
    most_bytes are an error: fewer trees or levels are needed then.
    """
    rows = _prepared(rows, label, vector)
    classes = [r.label for r in rows.select("label").distinct().orderBy("label").collect()]
    if not classes:
        raise ValueError("no rows with a class and a vector")
    c, place = len(classes), {x: i for i, x in enumerate(classes)}
    at_ends = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
    d = len(at_ends)
    tried = min(d, tried or max(1, round(d**0.5)))
    if trees * (1 << depth) * tried * 2 * c * 8 > most_bytes:
        raise ValueError(f"counts of a level have over {most_bytes} bytes")
    n = (2 << depth) - 1
    forest = Forest(classes, np.full((trees, n), -1), np.zeros((trees, n)), np.zeros((trees, n, c)), np.zeros(d))
    low, high = np.zeros((trees, n, d)), np.zeros((trees, n, d))
    low[:, 0], high[:, 0] = [r.low for r in at_ends], [r.high for r in at_ends]
    random = np.random.default_rng(seed)
    open_nodes = np.zeros((trees, n), bool)
    open_nodes[:, 0] = True
    for level in range(depth):
        first, many = (1 << level) - 1, 1 << level
        here = slice(first, first + many)
        column = random.permuted(np.broadcast_to(np.arange(d), (trees, many, d)).copy(), axis=2)[:, :, :tried]
        a, b = (np.take_along_axis(x[:, here], column, 2) for x in (low, high))
        cut = a + random.random(a.shape) * (b - a)

        def each(batch: pa.RecordBatch, first: int = first, many: int = many, column: np.ndarray = column, cut: np.ndarray = cut) -> dict[str, np.ndarray]:
            x, y = matrix(batch.column("v")), np.array([place[v] for v in batch.column("label").to_pylist()])
            out = np.zeros((trees, many, tried, 2, c))
            for t in range(trees):
                at = forest.nodes(x, t) - first
                inside = np.flatnonzero((at >= 0) & open_nodes[t][np.clip(at + first, 0, n - 1)])
                own = at[inside]
                for f in range(tried):
                    side = (x[inside, column[t, own, f]] > cut[t, own, f]).astype(int)
                    np.add.at(out[t], (own, f, side, y[inside]), 1)
            return {"counts": out}

        counts = tree_sum(rows, each)["counts"].reshape(trees, many, tried, 2, c)
        whole = counts[:, :, 0].sum(2)
        forest.counts[:, here] = np.where(whole.sum(2, keepdims=True) > 0, whole, forest.counts[:, here])
        gain = _impurity(whole)[:, :, None] - _impurity(counts).sum(3)
        parted = (counts.sum(4) > 0).all(3)
        gain = np.where(parted, gain, -1.0)
        best = gain.argmax(2)
        top = np.take_along_axis(gain, best[:, :, None], 2)[:, :, 0]
        for t, i in zip(*np.nonzero((top > 1e-12) & (whole.sum(2) >= least) & open_nodes[:, here]), strict=True):
            node, f = first + i, best[t, i]
            at, where = column[t, i, f], cut[t, i, f]
            forest.column[t, node], forest.cut[t, node] = at, where
            forest.importance[at] += top[t, i]
            for side, child in enumerate((2 * node + 1, 2 * node + 2)):
                low[t, child], high[t, child] = low[t, node], high[t, node]
                (high if side == 0 else low)[t, child, at] = where
                forest.counts[t, child] = counts[t, i, f, side]
                open_nodes[t, child] = True
        if not open_nodes[:, 2 * first + 1 : 2 * (first + many) + 1].any():
            break
    discard(rows)
    forest.importance /= max(forest.importance.sum(), 1e-300)
    return forest


def decided(rows: DataFrame, vector: str, forest: Forest, out: str = "pred") -> DataFrame:
    """rows with the class of the highest mean share, the first name of equals; null vectors have none."""
    scored = mapped(rows, vector, "_shares", forest.chances)
    best = F.array_max(F.transform("_shares", lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    return scored.withColumn(out, F.get(F.array(*map(F.lit, forest.classes)), -best["i"])).drop("_shares")


def important(rows: DataFrame, vector: str, forest: Forest, most: int, out: str = "selected") -> DataFrame:
    """rows with the `most` columns that gained most, in their order."""
    columns = sorted(np.argsort(-forest.importance, kind="stable")[:most].tolist())
    return rows.withColumn(out, F.array(*(F.get(vector, F.lit(i)) for i in columns)))
