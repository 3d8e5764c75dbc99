"""Vectors: TF-IDF, embeddings, nearest neighbours, cluster quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.corpus import bags
from millrace.sources.tables import distinct_keys, placed


def tfidf(words: DataFrame, key: str, min_df: int = 1, max_df: float = 1.0, most: int = 50_000) -> DataFrame:
    """key, word, weight = tf * (ln(n / df) + 1) of (key, word) rows; words within the df limits, the most frequent ones."""
    tf = words.groupBy(key, "word").agg(F.count("*").alias("tf"))
    n = words.select(key).distinct().agg(F.count("*").alias("n"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_df))
    top = df.orderBy(F.desc("all"), "word").limit(most)  # the vocabulary's size is a setting
    return tf.join(top.select("word", (F.log(F.col("n") / F.col("df")) + 1).alias("idf")), "word").select(key, "word", (F.col("tf") * F.col("idf")).alias("weight"))


def scaled(weights: DataFrame) -> DataFrame:
    """Weights per word from 0 to 1; words absent from a row count as 0."""
    top = weights.groupBy("word").agg(F.max("weight").alias("high"))
    return weights.join(top, "word").select(*(c for c in weights.columns if c != "weight"), (F.col("weight") / F.col("high")).alias("weight"))


def normed(weights: DataFrame, key: str) -> DataFrame:
    """Weights of each row over their Euclidean length."""
    length = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return weights.join(length, key).select(*(c for c in weights.columns if c != "weight"), (F.col("weight") / F.col("length")).alias("weight"))


def looked_up(rows: DataFrame, vectors: DataFrame, key: str, size: int) -> DataFrame:
    """rows with the vector of their key; zeros where there is none."""
    return rows.join(vectors, key, "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), size)))


def skip_pairs(words: Column, reach: int = 2) -> Column:
    """Pairs of words at most `reach` apart, as one term each."""

    def apart(j: int) -> Column:
        begins = F.when(F.size(words) > j, F.sequence(F.lit(0), F.size(words) - 1 - j)).otherwise(F.array().cast("array<int>"))
        return F.transform(begins, lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + j)))

    return F.flatten(F.array(*map(apart, range(1, reach + 1))))


def embed_text(words: DataFrame, vectors: DataFrame, key: str, how: str = "sum", weight: str | None = None) -> DataFrame:
    """key, vector: sum or mean of the vectors of a row's words, optionally weighted; words without a vector are left out."""
    each = words.join(vectors, "word").select(key, F.lit(1.0).alias("w") if weight is None else F.col(weight).alias("w"), F.posexplode("vector").alias("at", "x"))
    agg = F.sum(F.col("x") * F.col("w")) if how == "sum" else F.avg(F.col("x") * F.col("w"))
    parts = each.groupBy(key, "at").agg(agg.alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("vector"))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, at, sum, mean of each place of the vectors of a group."""
    return rows.select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.round(F.sum(F.col("x").cast("double")), 5).alias("sum"), F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


def sequence_matrix(words: DataFrame, vectors: DataFrame, key: str, column: str, last: int, dim: int, substitute: Column) -> DataFrame:
    """The vectors of the last words of a row, in order; unknown words have the substitute, missing ones zeros."""
    tail = words.select(key, F.posexplode(F.when(F.size(column) > last, F.slice(column, -last, last)).otherwise(F.col(column))).alias("at", "word"))
    found = tail.join(vectors, "word", "left").select(key, "at", F.coalesce("vector", substitute).alias("vector"))
    rows = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "vector"))), lambda p: p["vector"]).alias("m"))
    zero = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), dim), F.lit(last) - F.size("m"))
    return rows.select(key, F.concat("m", zero).alias("matrix"))


def word_indices(rows: DataFrame, key: str, column: str, vocabulary: DataFrame, length: int) -> DataFrame:
    """Indices of a row's first words in (word, index), padded with 0."""
    each = rows.select(key, F.posexplode(F.slice(column, 1, length)).alias("at", "word")).join(vocabulary, "word", "left")
    lists = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("index", F.lit(0)).alias("i")))), lambda p: p["i"]).alias("ids"))
    return lists.select(key, F.concat("ids", F.array_repeat(F.lit(0), F.lit(length) - F.size("ids"))).alias("ids"))


def vocabulary_matrix(vocabulary: DataFrame, vectors: DataFrame, substitute: Column) -> DataFrame:
    return vocabulary.join(vectors, "word", "left").select("word", "index", F.coalesce("vector", substitute).alias("vector"))


def substitutes(vocabulary: DataFrame, vectors: DataFrame, strategy: int, dims: int) -> DataFrame:
    """word, index, vector of a vocabulary; words that have no vector get zeros (0), numbers between 0 and 1 (1) or that of a word outside the vocabulary (2).

    Numbers come from hashes of word and place. With 2 no two words get one vector, in the order of their hashes; if there are
    too few words outside, the rest get zeros.
    """
    zeros = F.array_repeat(F.lit(0.0), dims)
    digits = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("word"), i.cast("string"))), 1, 8), 16, 10).cast("double")
    if strategy != 2:
        other = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: digits(i) / F.lit(float(1 << 32))) if strategy == 1 else zeros
        return vocabulary_matrix(vocabulary, vectors, other)
    lost = placed(vocabulary.join(vectors.select("word"), "word", "left_anti"), [F.md5("word"), "word"])
    free = placed(vectors.join(vocabulary.select("word"), "word", "left_anti").select(F.col("word").alias("w"), "vector"), [F.md5("w"), "w"]).select("vector", "place")
    known = vocabulary.join(vectors, "word").select("word", "index", "vector")
    return known.unionByName(lost.join(free, "place", "left").select("word", "index", F.coalesce("vector", zeros).alias("vector")))


def sentence_indices(rows: DataFrame, key: str, column: str, vocabulary: DataFrame, sentences: int, length: int) -> DataFrame:
    """key, ids: for the first sentences of a row (arrays of words) the indices of their first words in (word, index), both padded with 0."""
    each = rows.select(key, F.posexplode_outer(F.slice(column, 1, sentences)).alias("line", "words"))
    words = each.select(key, "line", F.posexplode_outer(F.slice("words", 1, length)).alias("at", "word")).join(vocabulary, "word", "left")
    lines = words.groupBy(key, "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("index", F.lit(0)).alias("i")))), lambda p: p["i"]).alias("ids"))
    pad = lambda ids, n, what: F.slice(F.concat(ids, F.array_repeat(what, n)), 1, n)
    lists = lines.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "ids"))), lambda s: pad(s["ids"], length, F.lit(0))).alias("ids"))
    return lists.select(key, pad("ids", sentences, F.array_repeat(F.lit(0), length)).alias("ids"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(queries: DataFrame, targets: DataFrame, key: str, target: str, vector: str = "vector", most_bytes: int = 64 << 20) -> DataFrame:
    """The target with the highest cosine above 0 for each query, the first in order of equals; "none" if none is above.

    A stated set of targets, whose size is checked before they are collected, goes to every task as a matrix; queries
    are compared with it in blocks, without a shuffle. Cosines are rounded to 6 places.
    """
    size = targets.agg(F.count("*").alias("n"), F.sum(F.size(vector)).alias("numbers")).first()
    if 8 * (size.numbers or 0) > most_bytes:
        raise ValueError(f"{size.n} targets have over {most_bytes} bytes and are not compared one by one")
    rows = targets.select(target, F.col(vector).cast("array<double>").alias("v")).orderBy(target).collect()
    names = [str(r[0]) for r in rows]
    matrix = np.array([r.v for r in rows], np.float64).reshape(len(rows), -1)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    given = queries.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = given.value
        for frame in batches:
            for begin in range(0, len(frame), 1024):
                part = frame.iloc[begin : begin + 1024]
                x = np.array(part["q"].tolist(), np.float64).reshape(len(part), -1)
                found, score = ["none"] * len(part), np.zeros(len(part))
                if names:
                    cosines = np.round(x @ matrix.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), 6)
                    best = cosines.argmax(1)
                    score = np.maximum(cosines[np.arange(len(part)), best], 0)
                    found = [names[b] if s > 0 else "none" for b, s in zip(best.tolist(), score.tolist(), strict=True)]
                yield pd.DataFrame({key: part[key], "nearest": found, "score": score})

    kind = queries.schema[key].dataType.simpleString()
    return queries.select(key, F.col(vector).alias("q")).mapInPandas(run, f"`{key}` {kind}, nearest string, score double")


def sparse_nearest(queries: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    """As nearest(), of sparse rows (key, word, weight): products over shared words only."""
    norm = lambda rows, k, name: rows.groupBy(k).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(name))
    dots = queries.select(key, "word", F.col("weight").alias("x")).join(targets.select(target, "word", F.col("weight").alias("y")), "word").groupBy(key, target).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dots.join(norm(queries, key, "a"), key).join(norm(targets, target, "b"), target).select(key, target, F.round(F.col("dot") / (F.col("a") * F.col("b")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), target))).where("rank = 1 AND score > 0").drop("rank")


def nearest_of_rows(rows: DataFrame, key: str, words: Column, targets: DataFrame, target: str, factors: DataFrame | None = None, most: int = 1 << 20) -> DataFrame:
    """sparse_nearest() of rows, each with an array of words; a word weighs its count, times its factor where there are (word, factor), without which it weighs nothing.

    Up to `most` rows (target, word, weight) go to every task, and rows are compared where they are read, without a
    shuffle; more, or keys that are null or come twice, are joined.
    """
    given = targets.select(F.col(target).alias("t"), "word", F.col("weight").cast("double").alias("y")).where("t IS NOT NULL AND word IS NOT NULL")
    if factors is not None:
        given = given.join(factors.select("word", F.col("factor").cast("double")).where("word IS NOT NULL"), "word", "full").select("t", "word", F.coalesce("y", F.lit(0.0)).alias("y"), "factor")
    found = given.limit(most + 1).toArrow()
    names = sorted(set(found.column("t").to_pylist()) - {None})
    if not names or found.num_rows > most or not distinct_keys(rows, key):
        counts = rows.select(key, F.explode(words).alias("word")).where("word IS NOT NULL").groupBy(key, "word").agg(F.count("*").alias("n"))
        weights = counts.withColumnRenamed("n", "weight") if factors is None else counts.join(factors, "word").select(key, "word", (F.col("n") * F.col("factor")).alias("weight"))
        return sparse_nearest(weights, targets, key, target)
    vocabulary = found.column("word").combine_chunks().dictionary_encode()
    word, place = vocabulary.indices.to_numpy(zero_copy_only=False), pc.index_in(found.column("t").combine_chunks(), value_set=pa.array(names, found.schema.field("t").type)).fill_null(0).to_numpy(zero_copy_only=False)  # a factor's word of no target weighs 0 in the first
    order = np.argsort(word, kind="stable")
    y, place = found.column("y").to_numpy()[order], place[order]
    begins = np.searchsorted(word[order], np.arange(len(vocabulary.dictionary) + 1))
    factor = None if factors is None else np.nan_to_num(found.column("factor").to_numpy()[order][begins[:-1]])
    length = np.sqrt(np.bincount(place, y * y, len(names)))
    told = rows.sparkSession.sparkContext.broadcast((names, vocabulary.dictionary, begins, place, y, factor, length))
    kind = found.schema.field("t").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, begins, place, y, factor, length = told.value
        names = pa.array(names, kind)
        for keys, row, code, n, dictionary in bags(batches):
            at = pc.fill_null(pc.index_in(dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)[code]
            x = n.astype(np.float64)
            if factor is not None:
                row, x, at = (c[at >= 0] for c in (row, x, at))
                x = x * factor[at]
            own = np.sqrt(np.bincount(row, x * x, len(keys)))
            row, x, at = (c[at >= 0] for c in (row, x, at))
            each = begins[at + 1] - begins[at]
            # some rows at a time, so that the products held are of bounded number
            work = np.cumsum(np.bincount(row, each, len(keys)) + len(names))
            first = np.searchsorted(row, np.arange(len(keys) + 1))
            a = 0
            while a < len(keys):
                b = max(int(np.searchsorted(work, (work[a - 1] if a else 0) + (1 << 21), side="right")), a + 1)
                part = slice(first[a], first[b])
                many = each[part]
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begins[at[part]], many)
                dots = np.bincount(np.repeat(row[part] - a, many) * len(names) + place[inside], np.repeat(x[part], many) * y[inside], (b - a) * len(names)).reshape(b - a, len(names))
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.floor(np.nan_to_num(dots / (own[a:b, None] * length)) * 1e6 + 0.5) / 1e6
                best = score.argmax(1)
                top = score[np.arange(b - a), best]
                hit = np.flatnonzero(top > 0)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(hit + a)), names.take(pa.array(best[hit])), pa.array(top[hit])], names=[key, target, "score"])
                a = b

    types = [rows.schema[key].dataType.simpleString(), targets.schema[target].dataType.simpleString()]
    return rows.select(F.col(key).alias("key"), words.alias("words")).mapInArrow(run, f"`{key}` {types[0]}, `{target}` {types[1]}, score double")


def taxonomy_paths(rows: DataFrame, levels: list[str]) -> DataFrame:
    return rows.select(F.concat_ws(" > ", *levels).alias("path")).distinct()


def cluster_purity(rows: DataFrame, cluster: str, levels: list[str]) -> DataFrame:
    return rows.groupBy(cluster).agg(F.count("*").alias("members"), *(F.count_distinct(c).alias(f"{c}_labels") for c in levels))


def calinski_harabasz(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """score, clusters, rows: between-cluster over within-cluster scatter, each over its degrees of freedom.

    From sums of values and squares per cluster and place, so one pass over the vectors.
    """
    cells = rows.select(cluster, F.posexplode(vector).alias("at", "x")).select(cluster, "at", F.col("x").cast("double").alias("x"))
    sums = cells.groupBy(cluster, "at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    places = sums.groupBy("at").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("c"), F.count("*").alias("k"))
    whole = places.agg(F.sum(F.col("c") - F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum(F.col("q") - F.col("c")).alias("within"), F.max("n").alias("n"), F.max("k").alias("k"))
    return whole.select(F.round(F.col("between") / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k"))), 5).alias("score"), F.col("k").alias("clusters"), F.col("n").alias("rows"))


def rank_weights(words: DataFrame, ranks: DataFrame, total: int) -> DataFrame:
    """words with `weight` = (total - position)^2 / total^2 of (word, position from 1), 0.5 for words without one."""
    n = float(total)
    return words.join(ranks, "word", "left").withColumn("weight", F.coalesce(F.pow(F.lit(n) - F.col("position"), 2) / (n * n), F.lit(0.5))).drop("position")
