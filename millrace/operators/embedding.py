"""Embeddings learned by passes over the rows: CBOW word vectors, and hashed word and sub-word vectors shared by several classifiers.

In a pass every part of the rows goes on from the same parameters by itself; the changes of a parameter row are then averaged over the
parts that changed it, by how often they did. Parts are dealt by a hash of a key and gone through in its order, with random
numbers seeded by pass and part, so reruns agree. Parameters are tables of checked size that go to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.tables import discard, written

CHANGES = "name string, row long, part int, times double, change array<double>"
_KINDS = pa.schema([("name", pa.string()), ("row", pa.int64()), ("part", pa.int32()), ("times", pa.float64()), ("change", pa.list_(pa.float64()))])
#: A part has about so many rows at most.
PART_ROWS = 1 << 13


def _changes(name: str, rows: np.ndarray, part: int, times: np.ndarray, change: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 4096):
        own = slice(at, at + 4096)
        n = len(rows[own])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * change.shape[1]), pa.array(change[own].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(rows[own]), pa.array(np.full(n, part, np.int32)), pa.array(times[own]), lists], schema=_KINDS)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean change of each parameter row, weighted by times."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    for name in sorted(set(whole.column("name").unique().to_pylist())):
        own = whole.filter(pc.equal(whole.column("name"), name)).combine_chunks()
        row, part, times = (own.column(c).to_numpy() for c in ("row", "part", "times"))
        change = own.column("change").combine_chunks().flatten().to_numpy().reshape(len(row), -1)
        order = np.lexsort((part, row))  # added in the order of parts, whichever came first
        rows, edges = np.unique(row[order], return_index=True)
        total = np.add.reduceat(times[order], edges)
        yield from _changes(name, rows, -1, total, np.add.reduceat(change[order] * times[order][:, None], edges, 0) / total[:, None])


def train(rows: DataFrame, key: str, parameters: dict[str, np.ndarray], learn: Callable, passes: int, parts: int, seed: int, most_bytes: int = 256 << 20) -> dict[str, np.ndarray]:
    """Parameters after some passes. learn(batch, own, times, random, done) changes `own` in place, counts changes of rows in `times`; done is the share of passes done.

    There are `parts` parts, and more where these would have over PART_ROWS rows each. Parameters of more than most_bytes are an error.
    """
    size = sum(p.nbytes for p in parameters.values())
    if size > most_bytes:
        raise ValueError(f"parameters of {size} bytes are more than {most_bytes}")
    parts = max(parts, -(-rows.select(key).count() // PART_ROWS))
    kept = written(rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), "parts")
    dealt = kept.repartition(parts, "_part").sortWithinPartitions("_part", key)
    for turn in range(passes):
        given = rows.sparkSession.sparkContext.broadcast(parameters)

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, given=given) -> Iterator[pa.RecordBatch]:
            part, own, times, random = None, {}, {}, None

            def told() -> Iterator[pa.RecordBatch]:
                for name, t in times.items():
                    at = np.flatnonzero(t)
                    yield from _changes(name, at, int(part), t[at], own[name][at] - given.value[name][at])

            for batch in batches:
                which = batch.column("_part").to_numpy()
                edges = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a == b:
                        continue
                    if part != which[a]:
                        yield from told()
                        part, own = which[a], {k: v.copy() for k, v in given.value.items()}
                        times, random = {k: np.zeros(len(v)) for k, v in own.items()}, np.random.default_rng([seed, turn, int(part)])
                    learn(batch.slice(a, b - a), own, times, random, turn / passes)
            yield from told()

        changed = dealt.mapInArrow(run, CHANGES).repartition("name", "row").mapInArrow(_averaged, CHANGES)
        parameters = {k: v.copy() for k, v in parameters.items()}
        for batch in changed.select("name", "row", "change").toArrow().to_batches():
            for name in set(batch.column("name").to_pylist()):
                own = batch.filter(pc.equal(batch.column("name"), name))
                parameters[name][own.column("row").to_numpy()] += own.column("change").flatten().to_numpy().reshape(own.num_rows, -1)
        given.unpersist()
    discard(kept)
    return parameters


# --- word vectors ----------------------------------------------------------------------------------------------------


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share and other choice of each place, for draws in proportion to weights with one look-up."""
    share, other = weights / weights.sum() * len(weights), np.arange(len(weights))
    small, large = [i for i, s in enumerate(share) if s < 1], [i for i, s in enumerate(share) if s >= 1]
    while small and large:
        s, b = small.pop(), large.pop()
        other[s] = b
        share[b] -= 1 - share[s]
        (small if share[b] < 1 else large).append(b)
    share[small + large] = 1
    return share, other


def cbow(rows: DataFrame, key: str, words: str = "words", dims: int = 100, window: int = 5, negatives: int = 5, least: int = 5, passes: int = 5, rate: float = 0.05, parts: int = 8, seed: int = 42, most_words: int = 1_000_000) -> DataFrame:
    """word, vector of words that occur `least` times: each is told by the mean of those around it, against words drawn by count^0.75.

    Words that occur less often are skipped over. More than most_words words are an error.
    """
    counts = rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    known = counts.orderBy(F.desc("n"), "word").limit(most_words + 1).collect()
    if len(known) > most_words:
        raise ValueError(f"more than {most_words} words")
    if not known:
        return rows.sparkSession.createDataFrame([], "word string, vector array<float>")
    alias = alias_table(np.array([r.n for r in known]) ** 0.75)
    names = rows.sparkSession.sparkContext.broadcast([r.word for r in known])
    random = np.random.default_rng(seed)
    start = {"in": (random.random((len(known), dims)) - 0.5) / dims, "out": np.zeros((len(known), dims))}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as numbers of their known words."""
        place = {w: i for i, w in enumerate(names.value)}
        for batch in batches:
            ids = [[i for i in map(place.get, text or []) if i is not None] for text in batch.column(words).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(ids, pa.list_(pa.int32()))], names=[key, "_ids"])

    def learn(batch: pa.RecordBatch, own: dict, times: dict, random: np.random.Generator, done: float) -> None:
        now = rate * max(1 - done, 0.1)
        at, sizes = batch.column("_ids").flatten().to_numpy(), pc.list_value_length(batch.column("_ids")).to_numpy()
        text = np.repeat(np.arange(len(sizes)), sizes)
        for a in range(0, len(at), 64):
            middle, low = np.arange(a, min(a + 64, len(at))), max(a - window, 0)
            place = np.arange(low, min(middle[-1] + 1 + window, len(at)))
            there = (np.abs(middle[:, None] - place) <= window) & (middle[:, None] != place) & (text[middle][:, None] == text[place])
            some = there.any(1)
            middle, there = middle[some], there[some]
            if not len(middle):
                continue
            share = there / there.sum(1)[:, None]
            mean = share @ own["in"][at[place]]
            drawn = random.integers(0, len(alias[0]), (len(middle), negatives))
            drawn = np.where(random.random(drawn.shape) < alias[0][drawn], drawn, alias[1][drawn])
            told = np.concatenate([at[middle][:, None], drawn], 1)
            truth = (np.arange(1 + negatives) == 0) | (told == at[middle][:, None])
            out = own["out"][told]
            slope = (truth - 1 / (1 + np.exp(-np.clip((out @ mean[:, :, None])[..., 0], -30, 30)))) * now
            met, which = np.unique(told, return_inverse=True)
            pull = np.bincount(which.ravel() * len(middle) + np.repeat(np.arange(len(middle)), 1 + negatives), slope.ravel(), len(met) * len(middle)).reshape(len(met), -1)
            own["out"][met] += pull @ mean
            times["out"][met] += np.bincount(which.ravel(), minlength=len(met))
            np.add.at(own["in"], at[place], share.T @ (slope[:, None] @ out)[:, 0])
            np.add.at(times["in"], at[place], there.sum(0))

    texts = rows.select(key, words).mapInArrow(numbered, f"`{key}` {rows.schema[key].dataType.simpleString()}, _ids array<int>")
    found = train(texts, key, start, learn, passes, parts, seed)["in"]
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel().astype(np.float32)), dims).cast(pa.list_(pa.float32()))
    return rows.sparkSession.createDataFrame(pa.table({"word": [r.word for r in known], "vector": vectors}))


# --- classifiers that share their words ------------------------------------------------------------------------------


@dataclass
class Shared:
    """Vectors of hashed features, and for each label column its classes and their weights."""

    parameters: dict[str, np.ndarray]
    classes: dict[str, list[str]]


def features(terms: Column, size: int) -> Column:
    """Rows of the table of vectors that the terms fall into."""
    return F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(size)))


def _means(vectors: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean vector of each row's features, the flat features, and their numbers."""
    sizes = np.diff(ids.offsets.to_numpy())
    flat = ids.flatten().to_numpy()
    total = np.zeros((len(sizes), vectors.shape[1]))
    np.add.at(total, np.repeat(np.arange(len(sizes)), sizes), vectors[flat])
    return total / np.maximum(sizes, 1)[:, None], flat, sizes


def _bend(x: np.ndarray) -> float:
    """The largest eigenvalue of x' x: twice the bound of a softmax loss's curvature in weights of x; steps below 4 / _bend(x) never raise the loss."""
    return float(np.linalg.eigvalsh(x @ x.T if len(x) < x.shape[1] else x.T @ x)[-1])


def _missed(x: np.ndarray, w: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Probabilities of the classes, less one for the true one."""
    z = x @ w.T
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(x)), truth] -= 1
    return p


def fit_shared(rows: DataFrame, key: str, terms: str, heads: list[str], size: int = 1 << 16, dims: int = 32, passes: int = 5, rate: float = 0.5, parts: int = 8, seed: int = 42, most_classes: int = 10_000) -> Shared:
    """A table of `size` vectors for hashed terms, whose mean tells the class of every label column by a softmax of its own.

    Rows without a label teach the other columns. Terms that fall together share a vector. Over most_classes classes are an error.
    """
    classes = {}
    for h in heads:
        found = [r[0] for r in rows.where(F.col(h).isNotNull()).select(F.col(h).cast("string")).distinct().orderBy(h).limit(most_classes + 1).collect()]
        if len(found) > most_classes:
            raise ValueError(f"more than {most_classes} classes of {h}")
        classes[h] = found
    random = np.random.default_rng(seed)
    start = {"terms": (random.random((size, dims)) - 0.5) / dims, **{f"head {h}": np.zeros((len(classes[h]), dims)) for h in heads if classes[h]}}
    numbered = rows.select(key, features(F.col(terms), size).cast("array<int>").alias("_ids"), *(F.col(h).cast("string").alias(h) for h in heads)).where(F.size("_ids") > 0)

    def learn(batch: pa.RecordBatch, own: dict, times: dict, random: np.random.Generator, done: float) -> None:
        now = rate * (1 - done)
        flat, ends = batch.column("_ids").flatten().to_numpy(), np.cumsum(pc.list_value_length(batch.column("_ids")).to_numpy())
        label = {h: pc.fill_null(pc.index_in(batch.column(h), pa.array(classes[h], pa.string())), -1).to_numpy() for h in heads if classes[h]}
        times["terms"] += np.bincount(flat, minlength=size)
        for a in range(0, batch.num_rows, 32):
            to = ends[a : a + 32]
            sizes = np.diff(to, prepend=ends[a - 1] if a else 0)
            met, at = np.unique(flat[to[0] - sizes[0] : to[-1]], return_inverse=True)
            share = np.bincount(np.repeat(np.arange(len(to)), sizes) * len(met) + at, minlength=len(to) * len(met)).reshape(len(to), -1) / sizes[:, None]
            mean = share @ own["terms"][met]
            back, bend = np.zeros_like(mean), 0.0
            for h in label:
                some = np.flatnonzero(label[h][a : a + 32] >= 0)
                if not len(some):
                    continue
                w, seen, truth = own[f"head {h}"], mean[some], label[h][a : a + 32][some]
                # rows alike add up: a step of the whole rate may go beyond where they lead, and ever further
                w -= min(now, 3 / max(_bend(seen), 1e-12)) * _missed(seen, w, truth).T @ seen
                back[some] += _missed(seen, w, truth) @ w
                bend += _bend(w)
                times[f"head {h}"] += len(some)
            own["terms"][met] -= min(now, 3 / max(bend * _bend(share), 1e-12)) * share.T @ back

    return Shared(train(numbered, key, start, learn, passes, parts, seed), classes)


def predict_shared(rows: DataFrame, terms: str, model: Shared) -> DataFrame:
    """rows with pred_<label column>; rows without terms, and columns that had no classes, have none."""
    from pyspark.sql.types import StringType, StructField, StructType

    size, given = len(model.parameters["terms"]), rows.sparkSession.sparkContext.broadcast(model)
    named = [f"pred_{h}" for h in model.classes]
    rows = rows.drop(*named)
    fields = rows.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([x or [] for x in batch.column("_ids").to_pylist()], pa.list_(pa.int64()))
            mean, _, sizes = _means(given.value.parameters["terms"], ids)
            told = []
            for h, names in given.value.classes.items():
                best = (mean @ given.value.parameters[f"head {h}"].T).argmax(1) if names and len(mean) else np.zeros(len(mean), int)
                told.append(pa.array([names[b] if names and n else None for b, n in zip(best.tolist(), sizes.tolist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *told], names=[*(f.name for f in fields), *named])

    asked = rows.withColumn("_ids", features(F.col(terms), size))
    return asked.mapInArrow(run, StructType([*fields, *(StructField(n, StringType()) for n in named)]))
