"""Agglomerative clustering by Ward's criterion, in rounds of reciprocal nearest neighbours.

A cluster is its count and centroid; they travel in packs of bounded size. In each round every cluster knows the one with which
it would merge at the least growth of the scatter, and pairs that choose each other merge at once; Ward's criterion allows that in
any order. Only clusters that are new, or whose choice has merged, are compared with all others: packs meet packs as tables are read,
so no vector is written for what it meets. A remnant of LAST clusters, a matrix of bounded size, is merged in one task. The
dendrogram is a table of pointers from a cluster to the one that took it in, which can be cut at any number of clusters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import vectors
from millrace.operators.neighbours import BLOCK, matrix
from millrace.sources.tables import discard, placed, written

#: So many clusters are merged in one task.
LAST = 2048

#: Bytes of the vectors of a pack, which has at most 8 * BLOCK clusters.
PACK = 4 << 20

#: Clusters of a pack, in the order of n: `other` is the choice of each, at `height`, which is infinite where it has to ask all others.
PACKS = "block long, asks long, ids array<long>, n array<long>, other array<long>, height array<double>, x binary"
#: Packs of those that stay, and what merges.
PARTS = f"{PACKS}, moved array<struct<into: long, at: double, id: long, n: long, centroid: array<double>>>"
#: Packs of new clusters; each took in `gone` at the height `at`.
MERGED = f"{PACKS}, gone array<long>, at array<double>"


def growth(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ward's distance between clusters (counts n and centroids x against m and y): sqrt(2 n m / (n + m)) times that of the centroids."""
    d = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)
    return np.sqrt(2 * n[:, None] * m[None] / (n[:, None] + m[None]) * d)


def _exact(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ward's distance between a row of x and the same row of y; the same both ways, so that the least of all is a choice of both."""
    parts = [((x[k : k + 8192] - y[k : k + 8192]) ** 2).sum(1) for k in range(0, max(len(x), 1), 8192)]
    return np.sqrt(2 * n * m / (n + m) * np.concatenate(parts))


class _Pack:
    """A pack's columns as arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int, suffix: str = ""):
        column = lambda name: batch.column(f"{name}{suffix}")[row]
        self.block = column("block").as_py()
        self.ids, self.n, self.other, self.height = (column(name).values.to_numpy() for name in ("ids", "n", "other", "height"))
        self.x = np.frombuffer(column("x").as_buffer(), np.float64).reshape(len(self.ids), -1)
        self.asks = np.isinf(self.height)


def _lists(*columns: np.ndarray) -> list[pa.Array]:
    """Each column as the only row of a list column."""
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns]


class _Filling:
    """Clusters gathered until they fill a pack; those of one task have blocks of their own, even or odd ones."""

    def __init__(self, most: int, odd: int):
        self.most, self.block, self.held, self.rows = most, TaskContext.get().partitionId() * (1 << 32) + odd, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Takes rows of x, ids, n, other, height and more columns; gives the full packs' columns."""
        limit = max(1, min(self.most, PACK // (8 * max(columns[0].shape[1], 1)))) if columns[0].ndim > 1 else self.most
        for a in range(0, len(columns[1]), limit):
            part = [c[a : a + limit] for c in columns]
            if self.rows + len(part[1]) > limit:
                yield self.rest()
            self.held.append(part)
            self.rows += len(part[1])

    def rest(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.rows = [], 0
        order = np.argsort(columns[2], kind="stable")  # counts that are equal stand together
        return [c[order] for c in columns]

    def row(self, columns: list[np.ndarray]) -> list[pa.Array]:
        """The columns of PACKS, and lists of further ones."""
        x, ids, n, other, height, *more = columns
        self.block += 2
        return [pa.array([self.block]), pa.array([int(np.isinf(height).sum())]), *_lists(ids, n, other, height), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), *_lists(*more)]


_NAMES = ["block", "asks", "ids", "n", "other", "height", "x"]


def _packed(most: int):
    """Packs of rows id, n, centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filling = _Filling(most, 0)
        pack = lambda columns: pa.RecordBatch.from_arrays(filling.row(columns), names=_NAMES)
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy()
                for full in filling.add(matrix(batch.column("centroid")), ids, batch.column("n").to_numpy(), ids, np.full(len(ids), np.inf)):
                    yield pack(full)
        if filling.rows:
            yield pack(filling.rest())

    return run


class _Known:
    """The best choice so far of a pack's clusters, by height and id."""

    def __init__(self, pack: _Pack):
        self.block, self.ids, self.height, self.other, self.fresh = pack.block, pack.ids.copy(), pack.height.copy(), pack.other.copy(), np.zeros(len(pack.ids), bool)

    def update(self, at: np.ndarray, other: np.ndarray, height: np.ndarray) -> None:
        order = np.lexsort((other, height, at))
        first = order[np.unique(at[order], return_index=True)[1]]
        at, other, height = at[first], other[first], height[first]
        better = (height < self.height[at]) | ((height == self.height[at]) & (other < self.other[at]))
        at = at[better]
        self.height[at], self.other[at], self.fresh[at] = height[better], other[better], True


def _meet(a: _Pack, b: _Pack, rows: np.ndarray, columns: np.ndarray, best: _Known, met: _Known, tile: int) -> None:
    """Clusters `rows` of a against `columns` of b, tile by tile; both learn what is nearer than what they know.

    Products in single precision find all that may be nearest, products in double where that leaves many; their distances are
    computed again from differences.
    """
    if not (len(rows) and len(columns)):
        return
    n, m = a.n[rows].astype(float), b.n[columns].astype(float)
    centre = a.x[rows].mean(0)
    u, v = a.x[rows] - centre, b.x[columns] - centre
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    left = np.hstack([-2 * u, uu[:, None], np.ones((len(u), 1))])
    right = np.hstack([v, np.ones((len(v), 1)), vv[:, None]])
    largest = max(uu.max(), vv.max())
    kinds = (np.float32, np.float64) if 1e-24 < largest < 1e24 else (np.float64,)
    sides = [(kind, left.astype(kind), right.astype(kind), (1 / n).astype(kind), (1 / m).astype(kind)) for kind in kinds[:1]]
    for p in range(0, len(u), tile // 2 or 1):
        r = slice(p, min(p + (tile // 2 or 1), len(u)))
        for q in range(0, len(v), tile):
            c = slice(q, min(q + tile, len(v)))
            own = None
            if a.block == b.block:
                k = np.searchsorted(columns[c], rows[r])
                there = (k < c.stop - c.start) & (columns[c][np.minimum(k, c.stop - c.start - 1)] == rows[r])
                own = np.flatnonzero(there), k[there]
            for kind in kinds:
                if len(sides) <= kinds.index(kind):
                    sides.append((kind, left, right, 1 / n, 1 / m))
                _, x, y, shares, others = sides[kinds.index(kind)]
                if shares[r.start] == shares[r.stop - 1] and others[c.start] == others[c.stop - 1]:
                    cost = (x[r] * (1 / (shares[r.start] + others[c.start]))) @ y[c].T
                else:
                    cost = x[r] @ y[c].T
                    cost /= shares[r][:, None] + others[c][None]
                if own is not None:
                    cost[own] = np.inf
                slack = 4 * (u.shape[1] + 8) * float(np.finfo(kind).eps) * (np.sqrt(uu[r].max()) + np.sqrt(vv[c].max())) ** 2 / (1 / n[r].max() + 1 / m[c].max()) + 1e-300
                found = []
                for axis, known, at in ((1, best, rows[r]), (0, met, columns[c])):
                    least = cost.min(axis).astype(float)
                    limit = np.minimum(known.height[at] ** 2 / 2, least + slack) + slack
                    some = np.flatnonzero((least <= limit) & np.isfinite(least))
                    near = cost[some] if axis else cost[:, some].T
                    k, other = np.nonzero(near <= limit[some][:, None])
                    found.append((some[k], other) if axis else (other, some[k]))
                if kind == kinds[-1] or sum(len(k) for k, _ in found) <= cost.size / 8:
                    break
            for (k, o), known, mine in zip(found, (best, met), (True, False), strict=True):
                for s in range(0, len(k), 1 << 16):
                    i, j = rows[r][k[s : s + (1 << 16)]], columns[c][o[s : s + (1 << 16)]]
                    height = _exact(a.n[i].astype(float), a.x[i], b.n[j].astype(float), b.x[j])
                    known.update(*((i, b.ids[j]) if mine else (j, a.ids[i])), height)


def _nearer(tile: int):
    """id, block, other, height, fresh: what a task's pairs of packs (columns named _a and _b) have nearer than what clusters know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Known] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = _Pack(batch, i, "_a"), _Pack(batch, i, "_b")
                best, met = (known[p.block] if p.block in known else known.setdefault(p.block, _Known(p)) for p in (a, b))
                _meet(a, b, np.flatnonzero(a.asks), np.arange(len(b.ids)), best, met, tile)
                if a.block != b.block:
                    _meet(a, b, np.flatnonzero(~a.asks), np.flatnonzero(b.asks), best, met, tile)
        for k in known.values():
            f = k.fresh
            yield pa.RecordBatch.from_arrays([pa.array(k.ids[f]), pa.array(np.full(f.sum(), k.block)), pa.array(k.other[f]), pa.array(k.height[f]), pa.array(f[f])], names=["id", "block", "other", "height", "fresh"])

    return run


def _chosen(packs: DataFrame, left: int) -> DataFrame:
    """Written rows id, block, other, height, fresh: the cluster that each would merge with, the first id of equals, and whether that is news.

    Every pack in which a cluster asks meets every other, read anew for each meeting: nothing is shuffled but the choices.
    """
    size, cores = int(str(packs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), packs.sparkSession.sparkContext.defaultParallelism
    few = packs.coalesce(max(min(math.ceil(math.sqrt(8 * cores)), 2 + left // (6 * BLOCK)), size >> 25))  # its square is the number of tasks; of some 32 MB at most
    side = lambda name: few.select(*(F.col(c).alias(f"{c}_{name}") for c in packs.columns))
    first = F.pmod(F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b")), F.lit(2)) == 0  # one of two orders, so that tasks have equal shares
    pairs = side("a").join(side("b").hint("shuffle_replicate_nl"), ((F.col("block_a") == F.col("block_b")) | ((F.col("block_a") < F.col("block_b")) == first)) & (F.col("asks_a") + F.col("asks_b") > 0))
    found = pairs.mapInArrow(_nearer(BLOCK), "id long, block long, other long, height double, fresh boolean")
    known = packs.select("block", F.explode(F.arrays_zip("ids", "other", "height")).alias("k")).select(F.col("k.ids").alias("id"), "block", "k.other", "k.height", F.lit(False).alias("fresh"))
    best = found.unionByName(known).repartition(1 + left // (32 * BLOCK), "id").groupBy("id", "block").agg(F.min(F.struct("height", "other")).alias("best"), F.max("fresh").alias("fresh"))
    return written(best.select("id", "block", "best.other", "best.height", "fresh"), "chosen")


def _parted(most: int):
    """PARTS of packs that met their changes (id, into, other, height): packs of those that stay, and what merges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filling = _Filling(most, 0)
        kind = pa.struct([("into", pa.int64()), ("at", pa.float64()), ("id", pa.int64()), ("n", pa.int64()), ("centroid", pa.list_(pa.float64()))])
        part = lambda columns, moved: pa.RecordBatch.from_arrays([*filling.row(columns), pa.ListArray.from_arrays(pa.array([0, len(moved)], pa.int32()), moved)], names=[*_NAMES, "moved"])
        for batch in batches:
            for i in range(batch.num_rows):
                pack, change = _Pack(batch, i), batch.column("changes")[i].values
                other, height = pack.other.copy(), pack.height.copy()
                into, moves = np.zeros(len(other), np.int64), np.zeros(len(other), bool)
                if len(change):
                    order = np.argsort(pack.ids)
                    at = order[np.searchsorted(pack.ids, change.field("id").to_numpy(), sorter=order)]
                    other[at], height[at] = change.field("other").to_numpy(), change.field("height").to_numpy()
                    into[at], moves[at] = change.field("into").to_numpy(), change.field("moves").to_numpy(zero_copy_only=False)
                x = pack.x[moves]
                if len(x):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    moved = pa.StructArray.from_arrays([pa.array(into[moves]), pa.array(height[moves]), pa.array(pack.ids[moves]), pa.array(pack.n[moves]), lists], fields=list(kind))
                    yield part([x[:0], pack.ids[:0], pack.n[:0], other[:0], height[:0]], moved)
                for full in filling.add(pack.x[~moves], pack.ids[~moves], pack.n[~moves], other[~moves], height[~moves]):
                    yield part(full, pa.array([], kind))
        if filling.rows:
            yield part(filling.rest(), pa.array([], kind))

    return run


def _merged(most: int):
    """MERGED packs of rows into, at, two: the two clusters (id, n, centroid) that merge, the least id first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filling = _Filling(most, 1)
        pack = lambda columns: pa.RecordBatch.from_arrays(filling.row(columns), names=[*_NAMES, "gone", "at"])
        for batch in batches:
            if batch.num_rows:
                two = batch.column("two").flatten()
                ids, n, x = two.field("id").to_numpy(), two.field("n").to_numpy(), matrix(two.field("centroid"))
                size = n[::2] + n[1::2]
                mean = (x[::2] * n[::2, None] + x[1::2] * n[1::2, None]) / size[:, None]
                for full in filling.add(mean, ids[::2], size, ids[::2], np.full(len(size), np.inf), ids[1::2], batch.column("at").to_numpy()):
                    yield pack(full)
        if filling.rows:
            yield pack(filling.rest())

    return run


def _round(packs: DataFrame, left: int) -> tuple[DataFrame, DataFrame]:
    """Tables of PARTS and MERGED: the packs of so many clusters after the merges of all pairs that choose each other."""
    chosen = _chosen(packs, left)
    into = F.least("id", "other")
    state = chosen.withColumn("moves", (F.count("*").over(Window.partitionBy(into, F.greatest("id", "other"))) == 2))
    lost = state.where("moves").select(F.col("id").alias("lost"))
    state = state.join(lost.hint("merge"), F.col("other") == F.col("lost"), "left")
    height = F.when(F.col("lost").isNotNull() & ~F.col("moves"), F.lit(float("inf"))).otherwise(F.col("height"))
    change = F.struct("id", into.alias("into"), "moves", "other", height.alias("height"))
    changes = written(state.groupBy("block").agg(F.collect_list(F.when(F.col("fresh") | F.col("lost").isNotNull(), change)).alias("changes")), "changes")
    met = packs.join(changes.withColumnRenamed("block", "of").hint("shuffle_replicate_nl"), F.col("block") == F.col("of")).drop("of")
    parts = written(met.mapInArrow(_parted(8 * BLOCK), PARTS), "parts")
    twos = parts.select(F.explode("moved").alias("m")).select("m.*").groupBy("into").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("id", "n", "centroid"))).alias("two"))
    merged = written(twos.select("at", "two").mapInArrow(_merged(8 * BLOCK), MERGED), "merges")
    discard(chosen, changes)
    return parts, merged


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges of a bounded number of clusters, by chains of nearest neighbours."""
    held = [_Pack(b, i) for b in batches for i in range(b.num_rows)]
    if not held:
        return
    ids, n, x = (np.concatenate([getattr(p, c) for p in held]) for c in ("ids", "n", "x"))
    order = np.argsort(ids)
    ids, n, x = ids[order], n[order].astype(float), x[order]
    alive, chain, out = np.ones(len(ids), bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        d = growth(n[a : a + 1], x[a : a + 1], n, x)[0]
        d[~alive] = np.inf
        d[a] = np.inf
        b = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[b]:
            b = chain[-2]
            low, high = min(a, b), max(a, b)
            out.append((int(ids[high]), int(ids[low]), float(d[b]), int(n[a] + n[b])))
            x[low] = (n[a] * x[a] + n[b] * x[b]) / (n[a] + n[b])
            n[low], alive[high] = n[a] + n[b], False
            chain = chain[:-2]
        else:
            chain.append(b)
    columns = list(zip(*out, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["id", "into", "height", "size"])


def _copies(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Clusters id, n, centroid of rows id, centroid, and the merges of equal vectors, which are all at no height, by id."""
    if rows.groupBy(F.xxhash64("centroid")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows.select("id", F.lit(1).cast("long").alias("n"), "centroid"), []
    clusters = written(rows.groupBy("centroid").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "centroid"), "distinct")
    first = clusters.where("n > 1").select(F.col("id").alias("into"), "centroid")
    more = placed(rows.join(first.hint("merge"), "centroid").where("id <> into").select("id", "into"), ["id"], within=["into"], out="before")
    return clusters, [written(more.select("id", "into", F.lit(0.0).alias("height"), (F.col("before") + 2).alias("size")), "merges")]


def ward(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, into, height, size: the dendrogram of rows with distinct whole-number keys; a row less than rows with a vector.

    A cluster is called by its least key; cluster `id` merges into `into` at that height, which then has `size` rows.
    """
    spark = rows.sparkSession
    start = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    clusters, merges = _copies(start.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("centroid")))
    tables, merged = [written(clusters.mapInArrow(_packed(8 * BLOCK), PACKS), "clusters")], []
    read = lambda kind, some: spark.read.schema(kind).parquet(*(t.written_to for t in some))
    count = lambda table, column: table.agg(F.sum(F.size(column))).first()[0] or 0
    left = count(tables[0], "ids")
    while left > LAST:
        stale = tables[0]
        tables = list(_round(read(PACKS, tables).where("size(ids) > 0"), left))
        discard(stale)
        merged.append(tables[1])
        less = count(tables[1], "gone")
        if not less:
            raise ValueError("no clusters merge: vectors hold values that are no finite numbers")
        left -= less
    merges.append(read(PACKS, tables).where("size(ids) > 0").coalesce(1).mapInArrow(_finished, "id long, into long, height double, size long"))
    if merged:
        rounds = read(MERGED, merged).select(F.explode(F.arrays_zip("gone", "ids", "at", "n")).alias("m"))
        merges.append(rounds.select(F.col("m.gone").alias("id"), F.col("m.ids").alias("into"), F.col("m.at").alias("height"), F.col("m.n").alias("size")))
    out = merges[0]
    for more in merges[1:]:
        out = out.unionByName(more)
    tree = written(out, "dendrogram")
    discard(*merged, *[t for t in tables if t not in merged], *[t for t in merges if hasattr(t, "written_to")])
    return tree


def cut(rows: DataFrame, dendrogram: DataFrame, key: str, k: int) -> DataFrame:
    """rows with `cluster`, the least key of theirs when the dendrogram is cut at k clusters; rows that it does not have keep null."""
    top = dendrogram.orderBy(F.desc("height"), F.desc("size"), F.desc("id")).limit(k - 1).select("id")
    kept = dendrogram.join(top, "id", "left_anti").select("id", "into")
    known = dendrogram.select("id").unionByName(dendrogram.select(F.col("into").alias("id"))).distinct()
    labels = written(known.join(kept, "id", "left").select("id", F.coalesce("into", "id").alias("root")), "labels")
    while True:  # each time pointers are twice as long
        further = labels.join(labels.select(F.col("id").alias("root"), F.col("root").alias("next")), "root")
        if further.where("next <> root").isEmpty():
            break
        longer = written(further.select("id", F.col("next").alias("root")), "labels")
        discard(labels)
        labels = longer
    return rows.join(labels.select(F.col("id").alias(key), F.col("root").alias("cluster")), key, "left")


def scores(rows: DataFrame, dendrogram: DataFrame, key: str, vector: str, sizes: list[int]) -> DataFrame:
    """k, score, clusters, rows: the Calinski-Harabasz score of each number of clusters."""
    parts = [vectors.calinski_harabasz(cut(rows, dendrogram, key, k), "cluster", vector).select(F.lit(k).alias("k"), "score", "clusters", "rows") for k in sizes]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def best_k(rows: DataFrame, key: str, vector: str, sizes: list[int]) -> int:
    """The number of clusters with the highest score, the least of equals."""
    found = scores(rows, ward(rows, key, vector), key, vector, sizes).collect()
    return max(found, key=lambda r: (r.score if r.score is not None else float("-inf"), -r.k)).k
