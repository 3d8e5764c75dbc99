"""Discriminative learners on vector columns: linear discriminants, squared-hinge and RBF support vector machines, elimination.

What a learner needs of the rows are sums, of products, gradients and curvatures. Each task sums its rows and hands on one row per
class; tasks in a tree of fan FAN add those, so the driver gets one row per class however many partitions there are. The rows
themselves stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.neighbours import matrix
from millrace.sources.tables import discard, written

FAN, SLICE = 16, 4096
#: Longer vectors than this are learned by products with the curvature, not by the curvature itself.
DENSE = 512

SUMS = "name string, values array<double>"


def _row(names: list[str], values: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([v.ravel().tolist() for v in values], pa.list_(pa.float64()))], names=["name", "values"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for name, values in zip(batch.column("name").to_pylist(), batch.column("values"), strict=True):
            v = values.values.to_numpy()
            total[name] = total[name] + v if name in total else v.copy()
    if total:
        yield _row(list(total), list(total.values()))


def tree_sum(rows: DataFrame, each: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums by name, over all rows, of the arrays that `each` makes of slices of rows."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for name, v in each(batch.slice(at, SLICE)).items():
                    total[name] = total[name] + v if name in total else v
        if total:
            yield _row(list(total), list(total.values()))

    parts, n = rows.mapInArrow(first, SUMS), rows.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN)
        parts = parts.repartition(n).mapInArrow(_added, SUMS)
    return {r.name: np.array(r["values"]) for r in parts.collect()}


def _prepared(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Written rows (label as string, v) of those that have both."""
    kept = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return written(kept, "labelled")


def mapped(rows: DataFrame, vector: str, out: str, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """rows with the column `out`, vectors changed by slices; null vectors stay null."""
    rows = rows.drop(out) if out != vector else rows
    fields = [f for f in rows.schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), SLICE):
                part = batch.slice(at, SLICE)
                column = part.column(vector)
                there = np.flatnonzero(np.array(column.is_valid()))
                made: list = [None] * part.num_rows
                if len(there):
                    for i, v in zip(there.tolist(), change(matrix(column.take(pa.array(there)))).tolist(), strict=True):
                        made[i] = v
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(made, pa.list_(pa.float64()))], names=[*(f.name for f in fields), out])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return rows.mapInArrow(run, StructType([*fields, StructField(out, ArrayType(DoubleType()))]))


# --- linear discriminants --------------------------------------------------------------------------------------------


def discriminants(rows: DataFrame, label: str, vector: str, k: int | None = None, shrink: float = 1e-6) -> np.ndarray:
    """The k directions (columns) with the largest ratio of scatter between to scatter within classes, unit scatter within.

    k is at most the number of classes less one. Scatter within is shrunk towards its mean variance, so columns may depend on
    each other. The sign of a direction makes its largest entry positive. Rows without class or vector teach nothing.
    """

    def each(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        x, names = matrix(batch.column("v")), np.array(batch.column("label").to_pylist(), object)
        out = {"products": x.T @ x}
        for name in sorted(set(names)):
            own = x[names == name]
            out[f"class {name}"] = np.concatenate([[len(own)], own.sum(0)])
        return out

    prepared = _prepared(rows, label, vector)
    sums = tree_sum(prepared, each)
    discard(prepared)
    classes = [v for name, v in sorted(sums.items()) if name.startswith("class ")]
    if len(classes) < 2:
        raise ValueError("discriminants need two classes")
    n, means = np.array([c[0] for c in classes]), np.array([c[1:] / c[0] for c in classes])
    d, total = means.shape[1], np.array([c[1:] for c in classes]).sum(0)
    between = (means.T * n) @ means - np.outer(total, total) / n.sum()
    within = sums["products"].reshape(d, d) - (means.T * n) @ means
    within = within + np.eye(d) * (shrink * np.trace(within) / d + 1e-12)
    values, axes = np.linalg.eigh(within)
    white = axes / np.sqrt(np.maximum(values, 1e-300))
    ratio, turned = np.linalg.eigh(white.T @ between @ white)
    order = np.argsort(-ratio, kind="stable")[: min(k or len(classes) - 1, len(classes) - 1)]
    found = white @ turned[:, order] * np.sqrt(n.sum())
    return found * np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])


def projected(rows: DataFrame, vector: str, directions: np.ndarray, out: str) -> DataFrame:
    """rows with their vectors' products with the directions."""
    return mapped(rows, vector, out, lambda x: x @ directions)


# --- support vector machines -----------------------------------------------------------------------------------------


def _margins(batch: pa.RecordBatch, classes: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = matrix(batch.column("v"))
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    place = {c: i for i, c in enumerate(classes)}
    y = -np.ones((len(x), len(classes)))
    y[np.arange(len(x)), [place[c] for c in batch.column("label").to_pylist()]] = 1
    return x, y, 1 - y * (x @ weights.T)


def squared_hinge(rows: DataFrame, label: str, vector: str, c: float = 0.01, balanced: bool = True, tolerance: float = 1e-8, most_steps: int = 50) -> tuple[list[str], np.ndarray]:
    """Classes in order and their weights, one class against the rest; the last weight is the bias, a feature of 1.

    Each class minimises |w|^2 / 2 + c * sum of s * max(0, 1 - y w.x)^2 by Newton's method; balanced makes s rows over twice the
    rows of a row's side. Vectors of up to DENSE numbers use the curvature itself, longer ones conjugate gradients on its
    products. A step that does not lower the sum is halved. Stops where every gradient is below tolerance times the first.
    """
    rows = _prepared(rows, label, vector)
    counts = {r.label: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()}
    first = rows.select(F.size("v").alias("d")).first()
    classes, total = list(counts), sum(counts.values())
    if len(classes) < 2:
        raise ValueError("a machine needs two classes")
    d, k = first.d + 1, len(classes)
    own = np.array([counts[x] for x in classes], float)
    up, down = (total / (2 * own), total / (2 * (total - own))) if balanced else (np.ones(k), np.ones(k))

    def sums(w: np.ndarray, curved: bool = False, along: np.ndarray | None = None) -> dict[str, np.ndarray]:
        def each(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            x, y, short = _margins(batch, classes, w)
            s = np.where(y > 0, up, down) * (short > 0)
            if along is not None:
                return {"curve": 2 * c * ((s * (x @ along.T)).T @ x)}
            out = {"cost": c * (s * short**2).sum(0), "slope": -2 * c * ((s * short * y).T @ x)}
            if curved:
                out["curve"] = np.stack([2 * c * (x.T * s[:, j]) @ x for j in range(k)])
            return out

        found = tree_sum(rows, each)
        shapes = {"cost": (k,), "slope": (k, d), "curve": (k, d) if along is not None else (k, d, d)}
        return {name: v.reshape(shapes[name]) for name, v in found.items()}

    w = np.zeros((k, d))
    now, start = sums(w, d <= DENSE), None
    for _ in range(most_steps):
        slope, cost = now["slope"] + w, now["cost"] + (w * w).sum(1) / 2
        size = np.sqrt((slope**2).sum(1))
        start = size if start is None else start
        if (size <= tolerance * np.maximum(start, 1e-300)).all():
            break
        if d <= DENSE:
            step = np.stack([np.linalg.solve(now["curve"][j] + np.eye(d), -slope[j]) for j in range(k)])
        else:
            step, rest = np.zeros_like(w), -slope
            way, norm = rest.copy(), (rest**2).sum(1)
            for _ in range(25):
                if (np.sqrt(norm) <= 0.05 * size).all():
                    break
                bent = sums(w, along=way)["curve"] + way
                share = (norm / np.maximum((way * bent).sum(1), 1e-300))[:, None]
                step, rest = step + share * way, rest - share * bent
                norm, before = (rest**2).sum(1), norm
                way = rest + (norm / np.maximum(before, 1e-300))[:, None] * way
        scale = np.ones((k, 1))
        for _ in range(20):
            after = sums(w + scale * step, d <= DENSE)
            worse = after["cost"] + ((w + scale * step) ** 2).sum(1) / 2 > cost + 1e-12 * np.abs(cost)
            if not worse.any():
                break
            scale[worse] /= 2
        w, now = w + scale * step, after
    discard(rows)
    return classes, w


def decided(rows: DataFrame, vector: str, classes: list[str], weights: np.ndarray, out: str = "pred") -> DataFrame:
    """rows with the class whose side is the farthest, the first name of equals; null vectors have none."""
    scored = mapped(rows, vector, "_sides", lambda x: x @ weights[:, :-1].T + weights[:, -1])
    best = F.array_max(F.transform("_sides", lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    return scored.withColumn(out, F.get(F.array(*map(F.lit, classes)), -best["i"])).drop("_sides")


def rbf_features(rows: DataFrame, vector: str, landmarks: int = 100, gamma: float | None = None) -> tuple[Callable[[np.ndarray], np.ndarray], float]:
    """A map of vectors whose products are about exp(-gamma |x - y|^2), and the mean of what it misses of a row's own product, 1.

    The landmarks are the vectors of the least hashes, a documented bound of what the driver collects; gamma is one over
    the number of columns and the variance of all values if it is not given. The map is exact between landmarks.
    """
    from millrace.operators.neighbours import pivots

    given = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    points = pivots(given, landmarks)
    if gamma is None:
        s = tree_sum(given, lambda b: {"s": np.array([(x := matrix(b.column("v"))).size, x.sum(), (x * x).sum()])})["s"]
        gamma = 1 / (points.shape[1] * max(s[2] / s[0] - (s[1] / s[0]) ** 2, 1e-300))

    def kernel(x: np.ndarray) -> np.ndarray:
        return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * x @ points.T, 0))

    values, axes = np.linalg.eigh(kernel(points))
    good = values > 1e-10 * values.max()
    root = axes[:, good] / np.sqrt(values[good])
    missed = tree_sum(given, lambda b: {"m": np.array([len(x := matrix(b.column("v"))), (1 - ((kernel(x) @ root) ** 2).sum(1)).sum()])})["m"]
    return (lambda x: kernel(x) @ root), float(missed[1] / missed[0])


# --- elimination -----------------------------------------------------------------------------------------------------


def eliminated(rows: DataFrame, key: str, label: str, vector: str, least: int = 1, share: float = 0.5, folds: int = 5, c: float = 0.01) -> list[tuple[list[int], float]]:
    """Subsets of columns, from all to `least`, each with the share of rows that models of the other folds get right.

    Of each subset the columns with the least squared weights go, `share` of them at a time. A row's fold is a hash of its key.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold"))
    rows = written(rows, "folded")
    columns, out = list(range(rows.select(F.size("v").alias("d")).first().d)), []
    while True:
        own = rows.withColumn("v", F.array(*(F.get("v", F.lit(i)) for i in columns)))
        right = total = 0
        for fold in range(folds):
            classes, w = squared_hinge(own.where(F.col("fold") != fold), "label", "v", c)
            found = decided(own.where(F.col("fold") == fold), "v", classes, w).agg(F.count_if(F.col("pred") == F.col("label")), F.count("*")).first()
            right, total = right + found[0], total + found[1]
        out.append((columns, right / max(total, 1)))
        if len(columns) <= least:
            discard(rows)
            return out
        _, w = squared_hinge(own, "label", "v", c)
        weight = (w[:, :-1] ** 2).sum(0)
        keep = max(least, min(len(columns) - 1, int(len(columns) * (1 - share))))
        columns = [columns[i] for i in sorted(np.argsort(-weight, kind="stable")[:keep].tolist())]
