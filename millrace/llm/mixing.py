"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target by weight, and its documents are repeated at the rate
target / source size: floor(rate) copies, and one more where a number drawn from a hash of seed and id lies below the
fraction. Nothing depends on the order or the number of partitions, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import written

TOKEN = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, most_sources: int = 1_000_000) -> DataFrame:
    """source, source_size, target of rows (source, size); one row per source, of which more than most_sources are an error.

    Sources in code-point order, null last, take the weights in turn and share budget times all sizes. No target
    exceeds `most` times its source; what is above is reshared by weight until none is. That fixed point is
    min(most * size, weight * level): going up the sources by most * size / weight, the level is the first share of
    what those before leave over that its own source need not be cut to. The windows see those rows in one task.
    """
    per = written(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    if per.count() > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("left", F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("share", F.col("left") / F.col("left_weight"))
    per = per.withColumn("level", F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "share"))).over(everything)["share"])
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(F.col("level"), F.lit(float("inf"))))
    return per.select("source", "source_size", F.round(target, 6).alias("target"))


def mix_plan(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """All columns of docs in a struct `row`, with size, source_size, target, copies; one row per row of docs.

    Null text has size 0; a source of size 0 has target 0 and no copies; null is a source of its own. Rows with the
    same id draw the same number. No rows in, no rows out.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(TOKEN)), F.lit(0)).cast("long").alias("size"),
    )
    sized = docs.select(F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(TOKEN)), F.lit(0)).cast("long").alias("size"))
    targets = written(source_targets(sized, weights, budget, most), "targets").withColumnRenamed("source", "of")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(f"row.{id_col}").cast("string"), F.lit("")))), 1, 13)
    draw = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))
    return rows.withColumn("copies", (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as the plan says, with the columns of docs."""
    plan = mix_plan(docs, **options).where("copies > 0")
    return plan.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
