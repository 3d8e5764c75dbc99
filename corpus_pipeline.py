"""A corpus pipeline of five of the training-data operators.

Every stage reads what the one before it kept; run() writes each stage's rows to the shared folder and reads them again,
so a lost executor repeats no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, line_dedup, mixing, ngram_join, pieces
from millrace.llm.queries import PIECES_MODEL
from millrace.llm.shared import discard, new_names, written
from millrace.sources.tables import spread


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: null texts and texts without a letter go. Learns from labelled documents."""
    model = langid.fit(docs.where(~langid.held_out()))
    lang, score = new_names(docs, "lang_pred", "score")
    known = langid.identify(docs, model, lang_col=lang, score_col=score)
    return known.where(F.col(lang) != langid.UNDETERMINED).drop(lang, score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has; n_chars follows, and documents of which only blank lines are left go."""
    (dropped,) = new_names(docs, "dropped")
    cleaned = line_dedup.line_dedup(docs, count_col=dropped)
    cleaned = cleaned.where((F.col(dropped) == 0) | F.col("text").rlike(r"(?U)\S"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.drop(dropped)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target asks."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of documents with ids and their number, the training data themselves; by the best path over the file's pieces."""
    coded = pieces.encode(docs, PIECES_MODEL, kind="unigram")
    return coded.withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixture),
    ("SentencePiece encoding", encoding),
]

#: Language ID, line dedup, near duplicates and encoding are beyond SQL; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            discard(before)
        before = docs
    return docs
