"""Scores of classifiers and reports of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_scores(rows: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """label, p, r, f1, support for all labels of truth and prediction."""
    cells = rows.groupBy(F.col(pred).alias("pred"), F.col(truth).alias("truth")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("pred").alias("label"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("support"), F.when(F.col("pred") == F.col("truth"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("truth").alias("label"), F.lit(0).cast("long").alias("predicted"), F.col("n").alias("support"), F.lit(0).cast("long").alias("hit")))).alias("c")).select("c.*")
    sums = sides.groupBy("label").agg(F.sum("predicted").alias("predicted"), F.sum("support").alias("support"), F.sum("hit").alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return sums.select("label", p.alias("p"), r.alias("r"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support", "hit", "predicted")


def report(rows: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Lines of the score report: each label, then macro, weighted and micro means and the accuracy."""
    scores = label_scores(rows, pred, truth)
    kept = scores.select(F.col("label").cast("string").alias("line"), "p", "r", "f1", "support")
    sums = scores.agg(
        F.avg("p").alias("mp"), F.avg("r").alias("mr"), F.avg("f1").alias("mf"), F.sum("support").alias("n"), F.sum("hit").alias("hit"), F.sum("predicted").alias("predicted"),
        (F.sum(F.col("p") * F.col("support")) / F.sum("support")).alias("wp"), (F.sum(F.col("r") * F.col("support")) / F.sum("support")).alias("wr"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
    )
    acc = F.col("hit") / F.col("n")
    line = lambda name, p, r, f: F.struct(F.lit(name).alias("line"), p.alias("p"), r.alias("r"), f.alias("f1"), F.col("n").alias("support"))
    tail = sums.select(F.explode(F.array(line("mac avg", F.col("mp"), F.col("mr"), F.col("mf")), line("macro avg weighted", F.col("wp"), F.col("wr"), F.col("wf")), line("micro avg", acc, acc, acc), line("accuracy", acc, acc, acc))).alias("l")).select("l.*")
    out = kept.unionByName(tail)
    return out.select("line", *(F.round(c, 6).alias(c) for c in ("p", "r", "f1")), "support")


def kappa(rows: DataFrame, a: str, b: str, number: str | None = None, skip: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """n, agreement, kappa of two columns of labels, without the rows whose number is in a range of skip (its end left out)."""
    for begin, end in skip:
        rows = rows.where((F.col(number) < begin) | (F.col(number) >= end))
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    of_a, of_b = cells.groupBy("a").agg(F.sum("n").alias("x")), cells.groupBy("b").agg(F.sum("n").alias("y"))
    chance = of_a.join(of_b, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("both"))
    po, pe = F.col("same") / F.col("total"), F.col("both") / (F.col("total") * F.col("total"))
    return total.crossJoin(chance).select(F.col("total").alias("n"), F.round(po, 6).alias("agreement"), F.round(F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(1.0)), 6).alias("kappa"))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, change, pred: rows newly right, and newly wrong with their prediction, of two runs (key, pred, truth)."""
    both = before.select(key, F.col("pred").alias("old"), "truth").join(after.select(key, F.col("pred").alias("new")), key)
    was, now = F.col("old") == F.col("truth"), F.col("new") == F.col("truth")
    return both.where(was != now).select(key, F.when(now, "newly right").otherwise("newly wrong").alias("change"), F.when(~now, F.col("new")).alias("pred"))


def score_lines(lines: DataFrame) -> DataFrame:
    """setting, measure, p, r, f1 of report files (file, value): the lines of macro, weighted and micro means and accuracy."""
    name = r"^(mac avg|macro avg weighted|micro avg|accuracy[^,=]*)[,=]\s*"
    rest = F.split(F.regexp_replace("value", name, ""), ",")
    number = lambda i: F.get(rest, F.lit(i)).try_cast("double")
    return lines.where(F.col("value").rlike(name)).select("file", F.trim(F.regexp_extract("value", name, 1)).alias("measure"), number(0).alias("p"), F.coalesce(number(1), number(0)).alias("r"), F.coalesce(number(2), number(0)).alias("f1"))


def score_pivot(scores: DataFrame, row: str, column: str, columns: list[str], value: str = "f1") -> DataFrame:
    """A row per feature set, a column per level and algorithm."""
    return scores.groupBy(row).pivot(column, columns).agg(F.first(value))


def broken_features(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a feature that is no number."""
    return rows.where(F.exists(vector, F.isnan))
