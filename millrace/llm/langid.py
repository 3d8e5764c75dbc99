"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton. A text is cut greedily into the longest
phrases that occur in a language's sample; phrases times log2(sample length), per symbol, estimate the cross entropy,
and the language with the least wins. The automata are small tables that every Python worker builds once from the
broadcast samples; many texts walk through them at a time, one table look-up per symbol and language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from millrace.llm.shared import pieces

UNDETERMINED = "und"
#: Long texts are walked in stretches of so many symbols side by side; where a stretch's own parse differs from that of the
#: whole text, it is mended, so the number changes no result.
STRETCH = 1024
#: Symbols of a text that are held at a time; and those of a slice of texts, times the languages.
WINDOW, WALKED = 1 << 20, 1 << 22


def symbols(texts: list[str], letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row and where each begins: 0 for a run of non-letters, 1.. for `letters`, then one for all others."""
    joined = "\n".join(t.lower() for t in texts) + "\n"
    coded = _letter_table(letters)[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(coded), bool)
    keep[1:] = (coded[1:] != 0) | (coded[:-1] != 0)
    begins = np.cumsum([0, *(len(t.lower()) + 1 for t in texts)])
    return coded[keep], np.concatenate([[0], np.cumsum(keep)])[begins]


@lru_cache(2)
def _letter_table(letters: str) -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        if chr(code).isalpha():
            table[code] = len(letters) + 1
    for i, c in enumerate(letters):
        table[ord(c)] = i + 1
    return table


def automaton(sample: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sample.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


@lru_cache(1)
def _tables(model: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One flat table for all languages, each language's start in it, and log2 of each sample's length.

    An entry is four times the place of the next state's row, plus the phrases that ended: 1 if the match could not go
    on, and 1 for a symbol that the sample lacks, a phrase by itself.
    """
    letters, samples = model
    width, parts, starts, at = len(letters) + 2, [], [], 0
    for _, sample in samples:
        moves = automaton(np.frombuffer(sample, np.uint8))
        afresh = np.full(width, 2)
        for c, s in moves[0].items():
            afresh[c] = s * width * 4 + 1
        table = np.tile(afresh, (len(moves), 1))
        table[0] = np.where(afresh == 2, 1, 0)
        for s, out in enumerate(moves):
            for c, to in out.items():
                table[s, c] = to * width * 4
        parts.append((table + at * 4).astype(np.int32).ravel())
        starts.append(at)
        at += table.size
    return np.concatenate(parts), np.array(starts, np.int32), np.array([math.log2(len(s) + 1) for _, s in samples])


def phrases(coded: np.ndarray, begins: np.ndarray, model: tuple) -> np.ndarray:
    """Number of phrases per language (rows) and text (columns), each text parsed as one from its first to its last symbol."""
    _, starts, _ = _tables(model)
    out, sizes = np.zeros((len(starts), len(begins) - 1), np.int64), np.diff(begins)
    for i in np.flatnonzero(sizes > WINDOW):
        state = starts[:, None]
        for at in range(int(begins[i]), int(begins[i + 1]), WINDOW):
            end = min(at + WINDOW, int(begins[i + 1]))
            count, state = _parsed(coded, np.array([at]), np.array([end - at]), state, model)
            out[:, i] += count[:, 0]
        out[:, i] += (state != starts[:, None])[:, 0]
    rest = np.flatnonzero(sizes <= WINDOW)
    count, state = _parsed(coded, begins[:-1][rest], sizes[rest], np.repeat(starts[:, None], len(rest), 1), model)
    out[:, rest] = count + (state != starts[:, None])
    return out


def _parsed(coded: np.ndarray, begins: np.ndarray, sizes: np.ndarray, state: np.ndarray, model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that ended in each text, and the states at its end, from the states before it; by language and text.

    Every stretch is first parsed from the start. Then each goes on from the state in which the one before it ends, until
    both parses are in one state: from there they are the same. A stretch that ends in another state than before has its
    successor mended again.
    """
    table, starts, _ = _tables(model)
    cuts = np.maximum(-(-sizes // STRETCH), 1)
    text = np.repeat(np.arange(len(sizes)), cuts)
    part = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin, size = begins[text] + part * STRETCH, np.minimum(STRETCH, sizes[text] - part * STRETCH)
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    # stretches by falling size; which one follows each, or -1
    follows = np.where(np.arange(len(text)) + 1 < np.repeat(np.cumsum(cuts), cuts), np.roll(place, -1), -1)[order]
    last, first = place[np.cumsum(cuts) - 1], place[np.cumsum(cuts) - cuts]
    begin, size, text = begin[order], size[order], text[order]
    end = np.repeat(starts[:, None], len(text), 1)
    end[:, first] = state
    low = int(begins.min()) if len(begins) else 0
    steps = np.zeros((len(starts), int((begins + sizes).max()) - low if len(begins) else 0), np.int32)
    count = np.zeros(end.shape, np.int64)
    active = np.searchsorted(-size, -np.arange(1, STRETCH + 1), side="right")
    for t in range(int(size[0]) if len(size) else 0):
        k = active[t]
        at = begin[:k] + t
        step = table[end[:, :k] + coded[at]]
        steps[:, at - low] = step
        count[:, :k] += step & 3
        end[:, :k] = step >> 2

    change, alone = np.zeros_like(count), end.copy()
    lang, lane = (x.ravel() for x in np.meshgrid(np.arange(len(starts)), np.flatnonzero(follows >= 0), indexing="ij"))
    while len(lane):
        came, lane = end[lang, lane], follows[lane]
        left, gain, told = np.arange(len(lane)), np.zeros(len(lane), np.int64), alone[lang, lane]
        for t in range(STRETCH):
            at = begin[lane[left]] + t
            step, known = table[came[left] + coded[at]], steps[lang[left], at - low]
            gain[left] += (step & 3) - (known & 3)
            came[left] = step >> 2
            ends = t + 1 == size[lane[left]]
            apart = came[left] != known >> 2
            told[left[apart & ends]] = came[left[apart & ends]]
            left = left[apart & ~ends]
            if not len(left):
                break
        change[lang, lane] = gain
        other = (told != end[lang, lane]) & (follows[lane] >= 0)
        end[lang, lane] = told
        lang, lane = lang[other], lane[other]
    total = np.zeros((len(starts), len(sizes)), np.int64)
    for i in range(len(starts)):
        total[i] = np.bincount(text, count[i] + change[i], len(sizes)).astype(np.int64)
    return total, end[:, last]


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", docs_per_lang: int = 64, chars_per_doc: int = 2048, symbols_per_lang: int = 32768, max_letters: int = 60, max_langs: int = 100, max_symbols: int = 1 << 19) -> tuple:
    """(letters, ((lang, sample), ...)): at most docs_per_lang labelled texts of each language, those with the smallest hashes of their ids.

    The driver gets max_langs * docs_per_lang beginnings of chars_per_doc characters at most; more languages are an
    error. Languages share max_symbols evenly where that leaves less than symbols_per_lang for each; a worker's table
    takes some 500 bytes for each of them at 60 letters. Letters beyond the max_letters most frequent of the sample share one symbol, so
    scripts of thousands of letters are told apart by their script alone. Rows without language or text teach nothing.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    ranked = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("rank") <= docs_per_lang)
    picked = ranked.limit(max_langs * docs_per_lang + 1).collect()
    if len(picked) > max_langs * docs_per_lang:
        raise ValueError(f"more than {max_langs} languages")
    wanted = rows.where(F.col("doc_id").isin([r.doc_id for r in picked])) if picked else rows.limit(0)
    found = wanted.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id", F.substring("text", 1, chars_per_doc).alias("text")).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r.lang, str(r.doc_id))):
        texts.setdefault(r.lang, []).append(r.text)
    often: dict[str, int] = {}
    for t in texts.values():
        for c in "".join(t).lower():
            if c.isalpha():
                often[c] = often.get(c, 0) + 1
    letters = "".join(sorted(often, key=lambda c: (-often[c], c))[:max_letters])
    samples = []
    for lang, t in texts.items():
        coded, begins = symbols(t, letters)
        each = min(symbols_per_lang, max_symbols // len(texts)) // len(t)
        sample = np.concatenate([coded[a : min(b, a + each)] for a, b in zip(begins[:-1], begins[1:], strict=True)])
        if (sample > 0).any():
            samples.append((lang, sample.tobytes()))
    return letters, tuple(samples)


def predict(texts: list[str | None], model: tuple) -> tuple[list[str], list[float]]:
    """Language and score of each text: the margin 1 - best / second best of the normalised phrase numbers."""
    letters, samples = model
    coded, begins = symbols([t or "" for t in texts], letters)
    size = np.diff(begins)
    lettered = np.diff(np.concatenate([[0], np.cumsum(coded > 0)])[begins]) > 0
    if not samples:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    rate = phrases(coded, begins, model) * _tables(model)[2][:, None] / np.maximum(size, 1)
    best = rate.argmin(0)
    ranked = np.sort(rate, 0)
    margin = 1 - ranked[0] / np.maximum(ranked[1], 1e-12) if len(samples) > 1 else np.ones(len(texts))
    names = [lang for lang, _ in samples]
    return [names[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, np.clip(margin, 0, 1), 0.0).tolist()


def identify(docs: DataFrame, model: tuple, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """docs with all its columns (repeated rows too), and lang_col, score_col; columns of these names are replaced.

    Null texts and texts without a letter are "und" with score 0, as is everything if no language was learned. Ties go to the language first in order.
    """
    docs = docs.drop(lang_col, score_col)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, max(WALKED // max(len(given.value[1]), 4), 1)):
            names, scores = predict(batch.column(text_col).to_pylist(), given.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_col, score_col])

    schema = StructType([*docs.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Of three documents about one: crc32 of the id as text leaves 1. Null ids are not held out, and teach nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
