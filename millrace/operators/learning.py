"""Classifiers on Spark ML: features, models by name, cross-validation, prediction with a saved model."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, HashingTF, IndexToString, MinMaxScaler, NGram, StandardScaler, StringIndexer, VectorSlicer, Word2Vec
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import gold, scoring


def word_columns(rows: DataFrame, fields: list[tuple[str, int | None]], out: str = "words") -> DataFrame:
    """rows with the first words of each field, field after field."""
    parts = []
    for field, most in fields:
        words = T.letters_only(F.coalesce(F.concat_ws(" ", *(F.col(c) for c in field.split("-"))), F.lit("")))
        parts.append(words if most is None else F.slice(words, 1, most))
    return rows.withColumn(out, F.concat(*parts))


def hashed(words: str = "words", out: str = "features", size: int = 1 << 14, grams: int = 1) -> list:
    """Stages that make hashed counts of words, and of word n-grams if there is more than one."""
    if grams == 1:
        return [HashingTF(inputCol=words, outputCol=out, numFeatures=size)]
    return [NGram(n=grams, inputCol=words, outputCol="grams"), HashingTF(inputCol="grams", outputCol=out, numFeatures=size)]


def subword_terms(words: Column, low: int = 4, high: int = 10, grams: int = 3) -> Column:
    """Word n-grams of one to `grams` words, and the words' beginnings, middles and ends of low to high characters, marked by < and >."""
    none = F.array().cast("array<string>")
    span = lambda size, first, make: F.when(size >= first, F.transform(F.sequence(F.lit(1), size - first + 1), make)).otherwise(none)

    def gram(n: int) -> Column:
        return span(F.size(words), n, lambda i: F.array_join(F.slice(words, i, n), " "))

    def part(word: Column, n: int) -> Column:
        return span(F.length(word) + 2, n, lambda i: F.substring(F.concat(F.lit("<"), word, F.lit(">")), i, F.lit(n)))

    parts = F.flatten(F.transform(words, lambda w: F.concat(*(part(w, n) for n in range(low, high + 1)))))
    return F.concat(*(gram(n) for n in range(1, grams + 1)), parts)


def classifier(name: str, features: str = "features", classes: int = 2, width: int = 0):
    """svm (one against the rest, hinge loss, rows weighted so that classes count alike), rf (20 trees), nb, lr (also for log-loss descent), mlp in place of networks."""
    columns = {"featuresCol": features, "labelCol": "label"}
    made = {
        "svm": lambda: OneVsRest(classifier=LinearSVC(regParam=0.01, maxIter=30, **columns), weightCol="weight", **columns),
        "rf": lambda: RandomForestClassifier(numTrees=20, seed=42, **columns),
        "nb": lambda: NaiveBayes(**columns),
        "lr": lambda: LogisticRegression(maxIter=50, regParam=0.001, **columns),
        "mlp": lambda: MultilayerPerceptronClassifier(layers=[width, max(16, classes * 2), classes], seed=42, **columns),
    }
    return made[name]()


def reduced(kind: str, k: int, features: str = "features", out: str = "reduced") -> list:
    """Scaling and reduction stages: pca, scale, minmax."""
    return {
        "pca": [StandardScaler(inputCol=features, outputCol="scaled", withMean=False), PCA(k=k, inputCol="scaled", outputCol=out)],
        "scale": [StandardScaler(inputCol=features, outputCol=out, withMean=False)],
        "minmax": [MinMaxScaler(inputCol=features, outputCol=out)],
    }[kind]


def fit(rows: DataFrame, name: str, truth: str, stages: list, features: str = "features", width: int = 0, most_labels: int = 10_000) -> PipelineModel:
    """A model that predicts names of classes, as `pred`, for any row; classes are indexed for fitting alone.

    Rows without a class teach nothing. More than most_labels classes are an error.
    """
    known = rows.where(F.col(truth).isNotNull())
    if known.select(truth).distinct().limit(most_labels + 1).count() > most_labels:
        raise ValueError(f"more than {most_labels} classes")
    index = StringIndexer(inputCol=truth, outputCol="label", stringOrderType="alphabetAsc").fit(known)
    back = IndexToString(inputCol="prediction", outputCol="pred", labels=index.labels)
    indexed = balanced(index.transform(known)) if name == "svm" else index.transform(known)
    return Pipeline(stages=[*stages, classifier(name, features, len(index.labels), width), back]).fit(indexed)


def balanced(rows: DataFrame) -> DataFrame:
    """rows with `weight`: all rows over the number of classes and the rows of the class."""
    counts = rows.groupBy(F.col("label").alias("__label")).agg(F.count("*").alias("__n"))
    sums = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__classes"))
    counts = counts.crossJoin(sums).select("__label", (F.col("__all") / F.col("__classes") / F.col("__n")).alias("weight"))
    return rows.join(counts, F.col("label") == F.col("__label")).drop("__label")


def holdout_scores(train: DataFrame, test: DataFrame, name: str, truth: str, stages: list, **options) -> DataFrame:
    """The report over every row of test that has a class, also one that train lacks."""
    found = fit(train, name, truth, stages, **options).transform(test)
    return scoring.report(found.select("pred", F.col(truth).alias("truth")))


def cross_validated(rows: DataFrame, name: str, truth: str, key: str, stages: list, k: int = 10, **options) -> DataFrame:
    """Predictions of each fold by a model of the others."""
    folded = gold.folds(rows, truth, key, k)
    parts = [fit(folded.where(F.col("fold") != i), name, truth, stages, **options).transform(folded.where(F.col("fold") == i)).select(key, "fold", "pred", F.col(truth).alias("truth")) for i in range(k)]
    return reduce(DataFrame.unionByName, parts)


def important(model: PipelineModel, most: int, features: str = "features", out: str = "selected") -> VectorSlicer:
    """Keeps the features that a fitted forest finds most important."""
    forest = next(s for s in model.stages if hasattr(s, "featureImportances"))
    weights = forest.featureImportances.toArray()
    return VectorSlicer(inputCol=features, outputCol=out, indices=[int(i) for i in weights.argsort()[::-1][:most]])


def word_vectors(rows: DataFrame, words: str = "words", size: int = 300, window: int = 10, least: int = 5) -> DataFrame:
    """word, vector by skip-gram."""
    return Word2Vec(inputCol=words, vectorSize=size, windowSize=window, minCount=least, seed=42).fit(rows).getVectors().select("word", F.col("vector"))


def predict(path: str, rows: DataFrame) -> DataFrame:
    """rows with the predictions of a saved model."""
    return PipelineModel.load(path).transform(rows)
