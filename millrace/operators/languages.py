"""The language of short texts, by profiles of character triples fitted on labelled documents.

A triple of letters falls into one of BUCKETS counters by its code points; a language's profile holds the logarithm of each
bucket's smoothed share in thousandths, whole numbers. Texts are reduced to words by Column expressions; their triples are
counted and weighed in arrays, some SLICE bytes at a time, in place: nothing but the counts of a task is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
#: Bytes of text whose triples are held at a time (a longer text whole).
SLICE = 1 << 20


def even(text: Column) -> Column:
    """The text's words in small letters, a blank for whatever stands between them, one before and one after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def _triples(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of even() texts: the first row, where each row begins, and the bucket of the triple at each letter, BUCKETS where a row has no more."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        begun = ends[row - 1] if row else 0
        after = max(int(np.searchsorted(ends, begun + SLICE, side="right")), row + 1)
        part = texts.slice(row, after - row)
        codes = np.frombuffer("".join(part.to_pylist()).encode("utf-32-le"), np.uint32)
        stops = np.cumsum(pc.utf8_length(part).to_numpy(zero_copy_only=False).astype(np.int64))
        buckets = np.full(len(codes), BUCKETS, np.int64)
        buckets[:-2] = (codes[:-2] * np.uint32(961) + codes[1:-1] * np.uint32(31) + codes[2:]) % np.uint32(BUCKETS)
        buckets[stops - 1] = buckets[stops - 2] = BUCKETS  # an even text has two blanks at least
        yield row, np.concatenate([[0], stops[:-1]]), buckets
        row = after


def _counted(most: int):
    """Rows (l, b, n): how often a language's texts have a triple of a bucket, summed over a task unless it meets over `most` languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, n in sums.items():
                b = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(n[b])], names=["l", "b", "n"])

        for batch in batches:
            langs = batch.column("l").dictionary_encode()
            names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for row, begins, buckets in _triples(batch.column("t")):
                lang = np.repeat(of[row : row + len(begins)], np.diff(begins, append=len(buckets)))
                n = np.bincount(lang.astype(np.int64) * (BUCKETS + 1) + buckets, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)[:, :BUCKETS]
                for i in np.flatnonzero(n.any(1)).tolist():
                    sums[names[i]] = sums.get(names[i], 0) + n[i]
            if len(sums) > most:
                yield from told()
                sums = {}
        yield from told()

    return run


def profiles(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = 100) -> dict[str, list[int]]:
    """For each language 1000 ln((count + 0.5) / (all + 0.5 BUCKETS)) of every bucket, rounded, from all labelled rows.

    Rows without language or text teach nothing. The driver gets BUCKETS numbers per language; over `most` are an error.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), even(F.col(text)).alias("t"))
    counts = rows.mapInArrow(_counted(most), "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    counts = counts.limit(most * BUCKETS + 1).toPandas()
    if counts["l"].nunique() > most or len(counts) > most * BUCKETS:
        raise ValueError(f"more than {most} languages")
    out = {}
    for name, part in counts.groupby("l"):
        total = int(part["n"].sum())
        seen = dict(zip(part["b"].tolist(), part["n"].tolist(), strict=True))
        out[str(name)] = [_thousandths(seen.get(b, 0), total) for b in range(BUCKETS)]
    return dict(sorted(out.items()))


def _thousandths(n: int, total: int) -> int:
    import math

    return math.floor(1000 * math.log((n + 0.5) / (total + 0.5 * BUCKETS)) + 0.5)


def language(text: Column, known: dict[str, list[int]]) -> Column:
    """The language whose profile fits best, the first name of equals; null without a letter or a profile."""
    if not known:
        return F.lit(None).cast("string")
    names = sorted(known)
    weights = np.array([[*known[n], 0] for n in names], np.int64)

    def best(texts: pa.Array) -> pa.Array:
        found = np.zeros(len(texts), np.int64)
        for row, begins, buckets in _triples(texts):
            fits = np.stack([np.add.reduceat(w[buckets], begins) for w in weights])
            found[row : row + len(begins)] = fits.argmax(0)
        return pa.array(names, pa.string()).take(pa.array(found))

    return F.when(F.coalesce(text, F.lit("")).rlike(r"\p{L}"), F.arrow_udf(best, "string")(even(text)))


def spoken(text: Column, known: dict[str, list[int]], lang: str = "en") -> Column:
    """Whether the text is in that language."""
    return F.coalesce(language(text, known) == lang, F.lit(False))
