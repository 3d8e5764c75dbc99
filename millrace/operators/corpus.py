"""Corpus statistics: word and document frequencies, weights, bins, dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources.tables import distinct_keys, written


def word_rows(rows: DataFrame, words: Column, *keys: str) -> DataFrame:
    """A row per word that is not empty, with the keys."""
    return rows.select(*keys, F.explode(words).alias("word")).where("word <> ''")


def words_of(column: str) -> Column:
    """The normal words of a text that are not empty, in place."""
    return F.array_remove(T.normal_words(F.col(column)), "")


def bags(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Rows (key, words) counted some `most` words at a time (a row whole): keys; of each row's distinct words its place, the word's number and count; the words by number."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(sizes), 0
        while a < len(sizes):
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")), a + 1)
            flat = pc.list_flatten(batch.column("words").slice(a, b - a)).dictionary_encode()
            codes = pc.fill_null(flat.indices, len(flat.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            wide = len(flat.dictionary) + 1
            cells, n = np.unique(np.repeat(np.arange(b - a), sizes[a:b]) * wide + codes, return_counts=True)
            real = cells % wide < wide - 1  # a null is no word
            yield batch.column("key").slice(a, b - a), cells[real] // wide, cells[real] % wide, n[real], flat.dictionary
            a = b


def word_frequency(rows: DataFrame, column: str = "text") -> DataFrame:
    return word_rows(rows, T.normal_words(F.col(column))).groupBy("word").agg(F.count("*").alias("freq"))


def term_and_document_frequency(rows: DataFrame, key: str, column: str = "text") -> DataFrame:
    """word, tf, df; counts within a document first, so that no distinct count is shuffled."""
    per = word_rows(rows, T.normal_words(F.col(column)), key).groupBy("word", key).agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def total(frequencies: DataFrame, column: str) -> DataFrame:
    return frequencies.agg(F.sum(column).alias("total"))


def corpus_tfidf(frequencies: DataFrame, documents: DataFrame) -> DataFrame:
    """word, tfidf = share of all words times ln(documents / df)."""
    sums = frequencies.agg(F.sum("tf").alias("total"))  # one row each
    return frequencies.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(documents.agg(F.count("*").alias("n")))).select("word", (F.col("tf") / F.col("total") * F.log(F.col("n") / F.col("df"))).alias("tfidf"))


def weirdness(frequencies: DataFrame, reference: DataFrame) -> DataFrame:
    """word, weirdness: its share here over its share in a reference (word, freq); unseen words count as the rarest there."""
    here, there = frequencies.agg(F.sum("tf").alias("total")), reference.agg(F.sum("freq").alias("ref_total"), F.min("freq").alias("ref_min"))
    joined = frequencies.join(reference, "word", "left").crossJoin(F.broadcast(here)).crossJoin(F.broadcast(there))
    return joined.select("word", ((F.col("tf") / F.col("total")) / (F.coalesce("freq", "ref_min") / F.col("ref_total"))).alias("weirdness"))


def overlap_frequency(rows: DataFrame, names: Column, categories: Column) -> DataFrame:
    """How often words of a name, with repeats, occur in its category."""
    return word_rows(rows, F.filter(names, lambda w: F.array_contains(categories, w))).groupBy("word").agg(F.count("*").alias("freq"))


def out_of_dictionary(rows: DataFrame, dictionary: DataFrame, column: str = "text") -> DataFrame:
    """Words, those that a dictionary (word) lacks, and their share."""
    words = word_rows(rows, T.normal_words(F.col(column))).groupBy("word").agg(F.count("*").alias("freq"))
    known = words.join(dictionary.select("word").distinct().withColumn("known", F.lit(1)), "word", "left")
    missing = F.sum(F.when(F.col("known").isNull(), F.col("freq")).otherwise(0))
    return known.agg(F.sum("freq").alias("words"), missing.alias("missing"), (missing / F.sum("freq")).alias("ratio"))


def instance_stats(rows: DataFrame, key: str, dictionary: DataFrame, column: str = "text", most: int = 100_000) -> DataFrame:
    """Per row: blank-separated tokens, cleaned words, words of the dictionary.

    A dictionary of `most` words at most goes to every task, which sums its rows' words as they come; with a larger one counts meet it by a join.
    """
    base = rows.select(key, F.size(F.split(F.trim(F.col(column)), r"\s+")).cast("long").alias("tokens"))
    listed = written(dictionary.select("word").distinct().withColumn("known", F.lit(1)), "dictionary")
    words = word_rows(rows, T.normal_words(F.col(column)), key)
    if listed.count() <= most:
        known = words.withColumn("n", F.lit(1).cast("long")).join(F.broadcast(listed), "word", "left")
    else:
        known = words.groupBy(key, "word").agg(F.count("*").alias("n")).join(listed, "word", "left")
    per = known.groupBy(key).agg(F.sum("n").alias("clean"), F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("known"))
    return base.join(per, key, "left").select(key, "tokens", F.coalesce("clean", F.lit(0)).alias("clean"), F.coalesce("known", F.lit(0)).alias("known"))


def pair_stats(pairs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """side, tokens, clean, known: mean numbers per row of tokens, words of letters, and words of a dictionary, of both sides of pairs."""
    stacked = pairs.select(F.monotonically_increasing_id().alias("row"), F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("text")) for c in ("left", "right")))).alias("c")).select("row", "c.side", "c.text")
    tokens = stacked.groupBy("side").agg(F.count("*").alias("rows"), F.sum(F.size(T.tokens(F.trim("text")))).alias("tokens"))
    words = word_rows(stacked, T.letters_only(F.col("text")), "side").groupBy("side", "word").agg(F.count("*").alias("n"))
    known = words.join(dictionary.select("word").distinct().withColumn("is_known", F.lit(1)), "word", "left")
    sums = known.groupBy("side").agg(F.sum("n").alias("clean"), F.sum(F.when(F.col("is_known") == 1, F.col("n")).otherwise(0)).alias("known"))
    mean = lambda c: (F.coalesce(c, F.lit(0)) / F.col("rows")).alias(c)
    return tokens.join(sums, "side", "left").select("side", *map(mean, ("tokens", "clean", "known")))


def side_stats(pairs: DataFrame) -> DataFrame:
    """Largest, smallest and mean number of words of the two sides of pairs."""
    sides = pairs.select(F.explode(F.array("left", "right")).alias("text"))
    n = F.size(F.split(F.trim("text"), r"\s+"))
    return sides.agg(F.max(n).alias("most"), F.min(n).alias("least"), F.avg(n).alias("mean"))


def with_bins(rows: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """rows with `bin`: of so many equal bins, closed on the right, from the least to the largest value; all values equal: bin 1."""
    edges = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    at = F.ceil((F.col(column) - F.col("low")) * F.lit(float(bins)) / (F.col("high") - F.col("low")))
    bin_no = F.when(F.col("high") == F.col("low"), 1).otherwise(F.least(F.lit(bins), F.greatest(F.lit(1), at)))
    return rows.crossJoin(F.broadcast(edges)).withColumn("bin", bin_no.cast("long")).drop("low", "high")


def histogram(rows: DataFrame, column: str, bins: int = 100) -> DataFrame:
    return with_bins(rows, column, bins).groupBy("bin").agg(F.count("*").alias("n"))


def heat_map(rows: DataFrame, key: str, binned: DataFrame, bins: int, column: str = "text") -> DataFrame:
    """bin, share: the mean over rows of the share of their words in each bin of (word, bin); empty bins are 0."""
    return heat_of_counts(word_counts(rows, key, column), key, binned, bins)


def word_counts(rows: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, word, n of each row's words, written: the table that frequencies and heat maps share.

    Rows of distinct keys are counted where they are read, without a shuffle.
    """
    if not distinct_keys(rows, key):
        return written(word_rows(rows, T.normal_words(F.col(column)), key).groupBy(key, "word").agg(F.count("*").alias("n")), "word_counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, row, code, n, words in bags(batches):
            for a in range(0, len(row), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[part])), words.take(pa.array(code[part])), pa.array(n[part])], names=[key, "word", "n"])

    kind = rows.schema[key].dataType.simpleString()
    return written(rows.select(F.col(key).alias("key"), words_of(column).alias("words")).mapInArrow(run, f"`{key}` {kind}, word string, n long"), "word_counts")


def heat_of_counts(counts: DataFrame, key: str, binned: DataFrame, bins: int, complete: bool = False, most: int = 100_000) -> DataFrame:
    """As heat_map(), of word_counts(). complete says that every word has a bin.

    Then those beyond the first bin, the frequent ones, go to every task where they are `most` at most, which is checked,
    and the counts need not be moved to meet all words.
    """
    common = written(binned.where("bin <> 1").select("word", "bin"), "common") if complete else None
    if common is not None and common.count() <= most:
        told = counts.join(F.broadcast(common), "word", "left").withColumn("bin", F.coalesce("bin", F.lit(1).cast("long")))
    else:
        told = counts.join(binned.select("word", "bin"), "word")
    cells = told.groupBy(key, "bin").agg(F.sum("n").alias("n"))
    # a row's cells are at most `bins`, so they are gathered by row rather than joined with its sum
    whole = cells.groupBy(key).agg(F.sum("n").alias("all"), F.collect_list(F.struct("bin", "n")).alias("cells"))
    each = whole.select("all", F.explode("cells").alias("c")).select("c.bin", (F.col("c.n") / F.col("all")).alias("share"), "all")
    share = each.groupBy("bin").agg(F.sum("share").alias("sum"))
    rows_n = whole.agg(F.count("*").alias("rows"))
    calendar = counts.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    return calendar.join(share, "bin", "left").crossJoin(F.broadcast(rows_n)).select("bin", F.coalesce(F.col("sum") / F.col("rows"), F.lit(0.0)).alias("share"))


def unique_words_by_class(rows: DataFrame, levels: list[str], names: str, categories: str) -> DataFrame:
    """level, label, name_words, category_words, ratio: distinct words per class at each level."""
    stacked = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("label")) for c in levels))).alias("c"), names, categories)
    words = lambda c, name: word_rows(stacked.select("c.level", "c.label", c), T.normal_words(F.col(c)), "level", "label").groupBy("level", "label").agg(F.count_distinct("word").alias(name))
    both = words(names, "name_words").join(words(categories, "category_words"), ["level", "label"], "left")
    return both.select("level", "label", "name_words", F.coalesce("category_words", F.lit(0)).alias("category_words"), (F.coalesce("category_words", F.lit(0)) / F.col("name_words")).alias("ratio"))


def unique_word_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """side, words, distinct_words, median number of words per row, of text columns."""
    stacked = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("text")) for c in columns))).alias("c")).select("c.side", T.normal_words(F.col("c.text")).alias("w"))
    sizes = stacked.groupBy("side").agg(F.expr("percentile(size(filter(w, x -> x <> '')), 0.5)").alias("median_words"))
    words = word_rows(stacked, F.col("w"), "side").groupBy("side").agg(F.count("*").alias("words"), F.count_distinct("word").alias("distinct_words"))
    return words.join(sizes, "side")


def mean_ratio(ratios: DataFrame) -> DataFrame:
    return ratios.groupBy("level", "variant").agg(F.avg("ratio").alias("ratio"))


def label_dictionary(rows: DataFrame, label: str, column: str = "text") -> DataFrame:
    """label, word, score: a word's share that falls to the label, times its share within the label; words of one label only are left out."""
    words = word_rows(rows, T.normal_words(F.col(column)), label).groupBy(label, "word").agg(F.count("*").alias("n"))
    words = written(words, "label_words")
    of_word = words.groupBy("word").agg(F.sum("n").alias("of_word"), F.count("*").alias("labels")).where("labels > 1")
    of_label = words.groupBy(F.col(label).alias("__label")).agg(F.sum("n").alias("of_label"))
    shares = words.join(of_word, "word").join(of_label, F.col(label).eqNullSafe(F.col("__label")))
    shares = shares.withColumn("share", F.col("n") / F.col("of_word")).withColumn("within", F.col("n") / F.col("of_label"))
    return shares.select(label, "word", (F.col("share") * F.col("within")).alias("score"))


def dictionary_features(rows: DataFrame, key: str, dictionary: DataFrame, column: str = "text", most_labels: int = 1000) -> DataFrame:
    """Per row and label of (label, word, score): sum, number, largest score and presence of the dictionary's words; more than most_labels labels are an error."""
    words = word_rows(rows, T.normal_words(F.col(column)), key).distinct()
    hits = words.join(dictionary, "word").groupBy(key, "label").agg(F.sum("score").alias("sum"), F.count("*").alias("n"), F.max("score").alias("max"))
    labels = [r.label for r in dictionary.select("label").distinct().limit(most_labels + 1).collect()]
    if len(labels) > most_labels:
        raise ValueError(f"more than {most_labels} labels make no features")
    grid = rows.select(key).distinct().withColumn("label", F.explode(F.array(*map(F.lit, labels)) if labels else F.array().cast(f"array<{dictionary.schema['label'].dataType.simpleString()}>")))
    return grid.join(hits, [key, "label"], "left").select(key, "label", F.coalesce("sum", F.lit(0.0)).alias("sum"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("max", F.lit(0.0)).alias("max"), F.when(F.col("n") > 0, 1).otherwise(0).alias("present"))


def hashtag_conditions(rows: DataFrame, key: str, conditions: DataFrame, column: str = "text") -> DataFrame:
    """Per row: how many conditions of (tag, condition) its hashtags name."""
    tags = rows.select(key, F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"#(\w+)"), F.lit(1))).alias("tag")).distinct()
    return tags.join(conditions, "tag").groupBy(key).agg(F.count_distinct("condition").alias("conditions"))


def keywords(rows: DataFrame, key: str, k: int = 5, column: str = "text") -> DataFrame:
    """The k most frequent words of each row, of two letters at least, ties in alphabetical order."""
    words = word_rows(rows, T.without_stop_words(T.letters_only(F.col(column))), key).where(F.length("word") > 1).groupBy(key, "word").agg(F.count("*").alias("n"))
    ranked = words.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k)
    return ranked.select(key, "rank", "word", "n")


def keywords_by_rank(rows: DataFrame, key: str, ranks: DataFrame, k: int = 3, column: str = "text") -> DataFrame:
    """Words of each row that come first in a ranked list (word, rank); "unknown" if none is in it."""
    words = word_rows(rows, T.letters_only(F.col(column)), key).distinct().join(ranks.select("word", "rank"), "word")
    first = words.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("rank", "word"))).where(F.col("at") <= k)
    picked = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("keywords"))
    return rows.select(key).join(picked, key, "left").select(key, F.coalesce("keywords", F.lit("unknown")).alias("keywords"))


def keywords_by_votes(rows: DataFrame, key: str, first: DataFrame, second: DataFrame, k: int = 3, column: str = "text") -> DataFrame:
    """Words of each row with the least sum of their positions in two ranked lists (word, rank), a missing one counting 0; "unknown" if there is no word."""
    words = word_rows(rows, T.letters_only(F.col(column)), key).distinct()
    voted = words.join(first.select("word", F.col("rank").alias("a")), "word", "left").join(second.select("word", F.col("rank").alias("b")), "word", "left")
    return keywords_by_rank(rows, key, voted.select("word", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("rank")).distinct(), k, column)


def best_category_part(rows: DataFrame, key: str, host: str, parts: str) -> DataFrame:
    """Of several elements the one with the highest mean idf of its words within the host, the last of equals.

    idf = ln((1 + n) / (1 + df)) + 1 over the host's rows, words of two characters at least.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\b\w\w+\b"), F.lit(0)))
    n = rows.groupBy(host).agg(F.count("*").alias("n"))
    df = rows.select(host, F.explode(words(F.array_join(parts, " "))).alias("word")).groupBy(host, "word").agg(F.count("*").alias("df"))
    idf = df.join(n, host).select(host, "word", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    each = rows.select(key, host, F.posexplode(parts).alias("at", "part"))
    scored = each.select(key, host, "at", "part", F.explode_outer(F.regexp_extract_all(F.lower("part"), F.lit(r"\b\w\w+\b"), F.lit(0))).alias("word")).join(idf, [host, "word"], "left")
    means = scored.groupBy(key, "at", "part").agg(F.coalesce(F.avg("idf"), F.lit(0.0)).alias("score"))
    return means.groupBy(key).agg(F.max_by("part", F.struct("score", "at")).alias("category"))
