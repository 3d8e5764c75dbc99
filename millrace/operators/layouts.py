"""Repairs and layouts of gold-standard tables, and text columns made of several fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.constants import GOLD_LAYOUT

def gold_layout(rows: DataFrame) -> DataFrame:
    """The older layout's columns in the newer's order and names; what the older one lacks is "N/A"."""
    return rows.select(*(F.lit("N/A").alias(new) if old is None else F.col(old).alias(new) for new, old in GOLD_LAYOUT))


def joined_texts(rows: DataFrame, fields: list[str], out: str = "text") -> DataFrame:
    """rows with their fields joined by ". "; a missing field is an empty one."""
    return rows.withColumn(out, F.concat_ws(". ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields)))


def merged_label_last(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """Rows of left that right has too: left's columns, right's, and left's trimmed label last."""
    rest = [c for c in left.columns if c != label]
    more = [c for c in right.columns if c != key]
    return left.join(right, key).select(*rest, *more, F.trim(label).alias(label))


def short_categories(rows: DataFrame, category: str, most_words: int = 5) -> DataFrame:
    """rows whose missing categories, and those of more words, are empty."""
    fine = F.size(F.split(category, " ")) <= most_words
    return rows.withColumn(category, F.when(F.col(category).isNotNull() & fine, F.col(category)).otherwise(F.lit("")))


def without_header_lines(lines: DataFrame, mark: str = "INDEX", number: str = "line_no") -> DataFrame:
    """Text lines (number, value) without those that repeat the header; the first line of all stays."""
    return lines.where((F.col(number) == 1) | ~F.col("value").startswith(mark))


def title_facet(offers: DataFrame, cluster: str, title: str, most: int = 100) -> DataFrame:
    """cluster, titles: a cluster's distinct titles, the commonest first, equals in order of the title; at most so many."""
    counts = offers.where(F.col(title).isNotNull()).groupBy(cluster, title).agg(F.count("*").alias("n"))
    # the commonest of each range are gathered before those of the whole cluster
    best = lambda df, *by: df.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(title).alias("t")))), 1, most).alias("top"))
    parts = best(counts.withColumn("part", F.pmod(F.xxhash64(title), F.lit(64))), cluster, "part")
    again = parts.select(cluster, F.explode("top").alias("x")).select(cluster, (-F.col("x.n")).alias("n"), F.col("x.t").alias(title))
    return best(again, cluster).select(cluster, F.transform("top", lambda x: x["t"]).alias("titles"))


def export_minima(records: DataFrame, name: str = "name", text: str = "text", full: bool = False) -> DataFrame:
    """records whose name or description is long enough, each judged alone: what is too short is null.

    The full form asks more, and cuts descriptions to 250 words.
    """
    clean = lambda c: T.basic_clean(F.col(c))
    if full:
        fine, good = T.large_enough(clean(name), 15, 3), (F.length(clean(text)) > 20) & (F.size(T.tokens(clean(text))) >= 50)
        value = T.first_words(clean(text), 250)
    else:
        fine, good, value = T.large_enough(clean(name), 10, 2), T.large_enough(clean(text), 20, 5), clean(text)
    out = records.withColumn(name, F.when(fine, clean(name))).withColumn(text, F.when(good, value))
    return out.where(F.col(name).isNotNull() | F.col(text).isNotNull())


def category_set(rows: DataFrame, category: str, stem: bool = True) -> DataFrame:
    """Distinct categories, a missing one as NONE; with stems, of three characters at least."""
    whole = F.coalesce(F.col(category), F.lit("NONE"))
    value = F.trim(T.lemma_of_last(F.lower(whole))) if stem else whole
    found = rows.select(value.alias("category")).distinct()
    return found.where(F.length("category") > 2) if stem else found


def examples(rows: DataFrame, keywords: DataFrame, key: str, name: str, category: str) -> DataFrame:
    """Name, category and keywords of each row, side by side."""
    return rows.join(keywords, key, "left").select(key, name, category, F.coalesce("keywords", F.lit("")).alias("keywords"))


def copied_column(rows: DataFrame, to: str, source: str) -> DataFrame:
    """rows, in their order of columns, with one column's values in place of another's."""
    return rows.select(*(F.col(f"`{source}`").alias(c) if c == to else F.col(f"`{c}`") for c in rows.columns))
