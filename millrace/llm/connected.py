"""Connected components by contraction: every node moves to its first neighbour in a random order, edges follow, until none is left.

The order is drawn anew each round, so that a long path shrinks by a constant share a round however its nodes are numbered.
The last LAST_EDGES links, a bounded remnant, are united in one task, which spares the rounds in which little is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import discard, written


#: So many links are united in one task, some 200 KB.
LAST_EDGES = 10_000


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Brings the ends of the links (a, b) under one label, the smallest; label[label[i]] is label[i] before and after."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nearer := label[label], label):
            label[:] = nearer


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the links (a, b) with the smallest node that it is linked to, directly or not."""
    held = [np.stack([batch.column(c).to_numpy() for c in ("a", "b")]) for batch in batches if batch.num_rows]
    if held:
        nodes, at = np.unique(np.concatenate(held, 1), return_inverse=True)
        label, at = np.arange(len(nodes)), at.reshape(2, -1)
        unite(label, at[0], at[1])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["a", "to"])


def components(edges: DataFrame) -> DataFrame:
    """node, root of the graph with edges (a, b) of longs; the root is the smallest node that can be reached.

    Each round is written to the shared folder; the driver only asks whether edges are left. Nodes that have no edge to
    another are not in the result.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels, turn, last = None, 0, False
    while count := edges.count():
        turn += 1
        drawn = lambda c, salt=turn: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("order"), F.col(c).alias("node"))
        last = count <= LAST_EDGES
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(drawn("b")).alias("first")).select("a", F.least("first", drawn("a"))["node"].alias("to"))
        move = written(edges.repartition(1).mapInArrow(_united, "a long, to long") if last else near, "moves")
        first, second = move.select(F.col("a").alias("x"), F.col("to").alias("p")), move.select(F.col("a").alias("y"), F.col("to").alias("q"))
        left = edges.limit(0)
        if not last:
            left = edges.join(first, F.col("a") == F.col("x")).join(second, F.col("b") == F.col("y")).where("p <> q")
            left = written(left.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
        if labels is None:
            labels = written(move.select(F.col("a").alias("node"), F.col("to").alias("at")), "labels")
        else:
            before, labels = labels, written(labels.join(first, F.col("at") == F.col("x"), "left").select("node", F.coalesce("p", "at").alias("at")), "labels")
            discard(before)
        discard(edges, move)
        edges = left
        if last:
            break
    if labels is None:
        return written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "components")
    smallest = labels.groupBy("at").agg(F.min("node").alias("root")).withColumnRenamed("at", "of")
    out = written(labels.join(smallest, F.col("at") == F.col("of")).select("node", "root"), "components")
    discard(labels, *([] if last else [edges]))
    return out
