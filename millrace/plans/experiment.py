"""One experiment: settings in, score report out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import learning


def fields_of(spec: str) -> list[tuple[str, int | None]]:
    """"Name,20|Description,100" or "4-5,name|6,desc": columns, joined by dashes, and how many words of each."""
    out = []
    for part in spec.split("|"):
        name, _, most = part.partition(",")
        out.append((name, int(most) if most.strip().isdigit() else None))
    return out


def run_levels(settings: dict[str, str], levels: list[str], train: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """Reports of one model per class column, with the column's name as `level`."""
    reports = [run(settings | {"class_fieldname": level}, train, test).withColumn("level", F.lit(level)) for level in levels]
    return reduce(DataFrame.unionByName, reports)


def run(settings: dict[str, str], train: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """Scores of settings["algorithm"] (svm, rf, nb, lr, fasttext) on class_fieldname, by holdout, or by n_fold folds of train over settings["key"]."""
    truth = settings["class_fieldname"]
    fields = fields_of(settings["text_fieldnames"])
    name = settings.get("algorithm", "lr")
    stages, words = learning.hashed(), lambda df: learning.word_columns(df, fields)
    if name == "fasttext":  # a linear model of word n-grams and parts of words
        name, plain = "lr", words
        words = lambda df: plain(df).withColumn("words", learning.subword_terms(F.col("words")))
    if test is not None:
        return learning.holdout_scores(words(train), words(test), name, truth, stages)
    found = learning.cross_validated(words(train), name, truth, settings["key"], stages, int(settings.get("n_fold", "10")))
    return learning.scoring.report(found)
