"""Audit of how the sources of a language differ in their words, by integer dictionaries.

Occurrences are counted per (language, source, term) with sums formed in the tasks that read the texts. The terms of a
language that enough of its documents hold are its dictionary: sorted by their UTF-8 bytes and dealt in chunks, in which a
term's id is its place in the chunk's sorted array. A chunk becomes dense vectors of counts, one per source, from which
smoothed probabilities and their differences are taken in whole numbers; ids keep the order of bytes, which breaks ties.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import pieces, written
from millrace.sources.tables import placed

#: Bytes that end a term become spaces, capitals small letters; bytes of characters beyond ASCII stay.
TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
#: Entries that a task counts before it hands them on.
HELD = 1 << 18
#: Sources of a language that meet in one matrix, and the cells of such a matrix.
BLOCK, CELLS = 256, 1 << 20
#: Numerator of a probability of 1.
UNIT = 1_000_000_000

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("times", pa.int64()), ("docs", pa.int64())])
CHUNKS = "lang string, low long, high long, total long, terms array<string>, overall array<long>, own array<long>, ids array<int>, times array<long>"
FOUND = "lang string, part string, source string, item string, value long, terms long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums per (lang, source, term); a row without a term for every (lang, source)."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def emptied() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            terms = list(times)
            for a in range(0, len(terms) + 1, 1 << 16):
                part = terms[a : a + (1 << 16)]
                names = [t.decode("utf-8", "replace") for t in part] + [None] * (a == 0)
                n = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(names, pa.string()), pa.array([times[t] for t in part] + [0] * (a == 0), pa.int64()), pa.array([docs[t] for t in part] + [0] * (a == 0), pa.int64())], schema=COUNTS)
        held.clear()

    for batch in (b for whole in batches for b in pieces(iter([whole]), "text")):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            words = (text or "").encode("utf-8", "replace").translate(TERMS).split()
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            times.update(words)
            docs.update(set(words))
        if sum(len(times) + 1 for times, _ in held.values()) > HELD:
            yield from emptied()
    yield from emptied()


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the dictionaries from cells sorted by (lang, low, high, term): sorted terms and, per cell, source, id and count."""
    key, rows, terms = None, [], 0

    def chunk() -> pa.RecordBatch:
        words = [r[0] for r in rows]
        kept = sorted(set(words))
        ids = np.searchsorted(np.array(kept, object), np.array(words, object)).astype(np.int32)
        overall = np.zeros(len(kept), np.int64)
        overall[ids] = [r[3] for r in rows]
        values = [key[0], key[1], key[2], key[3], [w.decode("utf-8", "surrogatepass") for w in kept], overall.tolist(), [r[1] for r in rows], ids.tolist(), [r[2] for r in rows]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["lang", "low", "high", "total", "terms", "overall", "own", "ids", "times"])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("lang", "low", "high", "total", "term", "number", "times", "overall"))
        for lang, low, high, total, term, number, times, overall in zip(*columns, strict=True):
            word = term.encode("utf-8", "surrogatepass")
            new = not rows or rows[-1][0] != word
            if rows and (key != (lang, low, high, total) or new and terms >= max(1, CELLS // (2 * BLOCK))):
                yield chunk()
                rows, terms, new = [], 0, True
            key = (lang, low, high, total)
            terms += new
            rows.append((word, number, times, overall))
    if rows:
        yield chunk()


def chances(counts: np.ndarray, whole: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 5) / (whole + 5 * terms)), by long division in steps of 1000: exact up to 9 * 10^15 tokens."""
    below = (whole + 5 * terms).astype(np.int64)
    if below.size and int(below.max()) > (2**63 - 1) // 1000:
        raise ValueError("more tokens than whole numbers of 64 bits can divide")
    rest, out = counts.astype(np.int64) + 5, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def _compared(top: int):
    """Rows of differences of a chunk: summed over its terms for each pair of sources, and the first `top` terms of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n, v = len(row["terms"]), row["vocabulary"]
                members = sorted(row["members"], key=lambda m: m["number"])
                numbers = np.array([m["number"] for m in members], np.int64)
                names = [m["source"] for m in members]
                at = np.searchsorted(numbers, np.array(row["own"], np.int64)) * n + np.array(row["ids"], np.int64)
                # one cell of a source and term has one count, below 2^53
                dense = np.bincount(at, np.array(row["times"], np.float64), len(members) * n).astype(np.int64).reshape(len(members), n)
                p = chances(dense, np.array([m["tokens"] for m in members], np.int64)[:, None], v)
                inside, same = numbers // BLOCK == row["low"], row["low"] == row["high"]
                out = []
                for a in np.flatnonzero(inside):
                    others = np.flatnonzero(numbers > numbers[a]) if same else np.flatnonzero(~inside)
                    for b, value in zip(others.tolist(), np.abs(p[others] - p[a]).sum(1).tolist(), strict=True):
                        out += [(row["lang"], "pair", names[a], names[b], value, n), (row["lang"], "pair", names[b], names[a], value, n)]
                if same:
                    q = chances(np.array(row["overall"], np.int64), np.array([row["total"]], np.int64), v)
                    for a in range(len(members)):
                        more = np.flatnonzero((dense[a] > 0) & (p[a] > q))
                        f = (p[a] - q)[more]
                        best = np.lexsort((more, -f))[:top]
                        out += [(row["lang"], "term", names[a], row["terms"][j], value, 0) for j, value in zip(more[best].tolist(), f[best].tolist(), strict=True)]
                kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "part", "source", "item", "value", "terms"])

    return run


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other and from the whole.

    Null lang, source and text are ''. A term is a run of ASCII letters and characters beyond ASCII, capitals A-Z made small.
    A language keeps the terms of at least least_docs of its rows. With count the occurrences of a kept term in a group, N
    their sum and V the kept terms, p = 1 + floor(10^9 (count + 5) / (N + 5 V)). Part "pair": for each other source the
    sum of |p - q| over all kept terms, 0 if there are none. Part "term": the top kept terms that the source has and
    whose p exceeds the language's. rank counts from 1 by falling value, then by the item's bytes. Whole numbers
    throughout. Repeated rows count each; further columns are ignored; no rows in, no rows out. One text is held whole
    by a task; sources beyond BLOCK meet in blocks, so a matrix has at most CELLS cells.
    """
    empty = F.lit("")
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`"), empty).alias("lang"), F.coalesce(F.col(f"`{source_col}`"), empty).alias("source"), F.col(f"`{text_col}`").alias("text"))
    partial = texts.mapInArrow(_counted, "lang string, source string, term string, times long, docs long")
    cells = written(partial.groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs")), "cells")

    of_term = Window.partitionBy("lang", "term")
    kept = cells.where("term IS NOT NULL").withColumns({"overall": F.sum("times").over(of_term), "holders": F.sum("docs").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    kept = written(kept.where(F.col("holders") >= least_docs).select("lang", "source", "term", "times", "overall", "first"), "kept")

    # per source its tokens and its number in the language, per language its terms and tokens
    tokens = kept.groupBy("lang", "source").agg(F.sum("times").alias("tokens"))
    groups = placed(cells.where("term IS NULL").select("lang", "source").join(tokens, ["lang", "source"], "left").fillna(0, ["tokens"]), ["source"], within=["lang"], out="number")
    langs = groups.groupBy("lang").agg(F.floor((F.max("number") / BLOCK)).alias("last"), F.sum("tokens").alias("total")).join(kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("vocabulary")), "lang", "left").fillna(0, ["vocabulary"])
    groups = written(groups.join(langs, "lang"), "groups")

    # every block of sources meets every other; a language of up to BLOCK sources has one meeting
    meeting = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda b: F.struct(F.least(F.col("block"), b).alias("low"), F.greatest(F.col("block"), b).alias("high"))))
    met = groups.withColumn("block", F.floor(F.col("number") / BLOCK)).withColumn("m", meeting).select("*", "m.low", "m.high")
    members = met.groupBy("lang", "low", "high", "vocabulary").agg(F.collect_list(F.struct("number", "source", "tokens")).alias("members"))
    dealt = kept.join(met.select("lang", "source", "number", "low", "high", "total"), ["lang", "source"])
    dealt = dealt.repartitionByRange("lang", "low", "high", "term").sortWithinPartitions("lang", "low", "high", "term")
    chunks = dealt.select("lang", "low", "high", "total", "term", "number", "times", "overall").mapInArrow(_chunked, CHUNKS)
    found = written(chunks.join(members, ["lang", "low", "high"]).mapInArrow(_compared(top), FOUND), "found")

    # what no source of a meeting has, all its sources share; their chances differ by their sizes alone
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    least = F.when(F.col("vocabulary") > 0, F.expr(f"1 + ({5 * UNIT}L DIV (tokens + 5 * vocabulary))")).otherwise(0)
    ends = groups.select("lang", "source", "vocabulary", least.alias("least"))
    pairs = ends.join(ends.select("lang", F.col("source").alias("item"), F.col("least").alias("other")), "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    value = F.coalesce("value", F.lit(0)) + (F.col("vocabulary") - F.coalesce("terms", F.lit(0))) * F.abs(F.col("least") - F.col("other"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = ["lang", "source", "part", "item", "value"]
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(ranked))
    terms = found.where("part = 'term'").select(*out).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
