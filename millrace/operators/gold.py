"""Gold standards: corrections, taxonomies, annotation files, samples, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import placed, sized


def hash_rank(*keys: str, seed: int = 42) -> Column:
    """A random-looking order that any run and engine repeats."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def apply_corrections(original: DataFrame, correction: DataFrame, key: str, levels: list[str], strict: bool = False) -> DataFrame:
    """original with the correction's levels where the last level differs, case ignored; rows without a correction go, or if strict are an error."""
    if strict:
        found = correction.select(F.col(key).alias("_key"), F.lit(True).alias("_found")).distinct()
        missing = F.raise_error(F.concat(F.lit("no correction of "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(original.schema[key].dataType)
        checked = original.join(found, F.col(key) == F.col("_key"), "left")
        original = checked.select(*(F.when(F.col("_found").isNull(), missing).otherwise(F.col(c)).alias(c) if c == key else F.col(c) for c in original.columns))
    fixed = correction.select(key, *(F.col(c).alias(f"new_{c}") for c in levels))
    differs = F.lower(levels[-1]) != F.lower(f"new_{levels[-1]}")
    rest = [c for c in original.columns if c not in levels]
    return original.join(fixed, key).select(*rest, *(F.when(differs, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in levels))


def upper_levels(rows: DataFrame, label: str, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """rows with lvl2 and lvl1 of their label from (label, lvl2, lvl1) tables, the first that has it; others go."""
    one = primary.select(F.col("label").alias(label), F.struct("lvl2", "lvl1").alias("a"))
    two = fallback.select(F.col("label").alias(label), F.struct("lvl2", "lvl1").alias("b"))
    found = rows.join(one, label, "left").join(two, label, "left").withColumn("up", F.coalesce("a", "b")).where("up IS NOT NULL")
    return found.select(*rows.columns, "up.lvl2", "up.lvl1")


def map_categories(rows: DataFrame, category: str, name: str, by_category: list[DataFrame], by_name: DataFrame) -> DataFrame:
    """rows with `mapped`: what each (key, value) table has for the category, joined by semicolons; else for the name; else the category."""
    out = rows
    for i, table in enumerate(by_category):
        out = out.join(table.select(F.col("key").alias(category), F.col("value").alias(f"m{i}")), category, "left")
    out = out.join(by_name.select(F.col("key").alias(name), F.col("value").alias("mn")), name, "left")
    several = F.nullif(F.concat_ws(";", *(F.col(f"m{i}") for i in range(len(by_category)))), F.lit(""))
    return out.select(*rows.columns, F.coalesce(several, F.col("mn"), F.col(category)).alias("mapped"))


def valid_annotations(rows: DataFrame, label: str) -> DataFrame:
    return rows.where((F.coalesce(F.trim(label), F.lit("")) != "") & F.col(label).contains("_"))


def first_label(rows: DataFrame, name: str, label: str, order: str) -> DataFrame:
    """name, label, conflict: the first label of a name, and whether others follow."""
    return rows.groupBy(name).agg(F.min_by(label, order).alias(label), (F.count_distinct(label) > 1).alias("conflict"))


def taxonomy(rows: DataFrame, levels: list[str]) -> DataFrame:
    return rows.select(*levels).distinct().orderBy(*levels)


def disjoint(rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    return rows.join(taken, key, "left_anti")


def sample_groups(rows: DataFrame, label: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """Rows of n groups (runs of one product) per label."""
    groups = rows.select(label, group).distinct()
    picked = groups.withColumn("nth", F.row_number().over(Window.partitionBy(label).orderBy(hash_rank(group, seed=seed), group))).where(F.col("nth") <= n).drop("nth")
    return rows.join(picked, [label, group], "left_semi")


def class_frequency(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def frequent_classes(rows: DataFrame, label: str, least: int = 2) -> DataFrame:
    return sized(rows, label, "class_size").where(F.col("class_size") >= least).select(*rows.columns)


def with_description(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.length(F.trim(F.coalesce(column, F.lit("")))) >= 3)


def _shuffled(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """rows with __nth, their place within the label in the order of a hash of the key."""
    return placed(rows.withColumn("__hash", hash_rank(key, seed=seed)), ["__hash", key], [label], "__nth").drop("__hash")


def stratified_sample(rows: DataFrame, label: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """The share of each class, rounded up, exactly."""
    ranked = sized(_shuffled(rows, label, key, seed), label, "__size")
    return ranked.where(F.col("__nth") < F.ceil(F.col("__size") * fraction)).select(*rows.columns)


def folds(rows: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """rows with `fold`, as even as can be within each class."""
    return _shuffled(rows, label, key, seed).select(*rows.columns, (F.col("__nth") % k).alias("fold"))


def holdout(rows: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """rows with `split`: about the fraction is test, by a hash of the key."""
    draw = F.conv(F.substring(hash_rank(key, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(draw < fraction, "test").otherwise("train"))


def line_sample(rows: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    return holdout(rows, key, fraction, seed).where("split = 'test'").drop("split")


def split_by_clusters(rows: DataFrame, test_clusters: DataFrame, key: str = "cluster_id") -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside the test clusters."""
    return rows.join(test_clusters, key, "left_anti"), rows.join(test_clusters, key, "left_semi")


def isolated_classes(rows: DataFrame, label: str) -> DataFrame:
    """Labels that occur once, and only in one split."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"), F.min("split").alias("split"))
    return counts.where("n = 1").select(label, "split")


def join_by_position(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Columns of two frames side by side, by their places in stated orders of keys."""
    return placed(a, [order_a]).join(placed(b, [order_b]), "place")


def append_generated(rows: DataFrame, generated: DataFrame, key: Column, sentences: int = 5) -> DataFrame:
    """rows with the first sentences of the text generated for their cleaned name; rows without one stay."""
    from millrace.functions.text import first_sentences

    texts = generated.groupBy("name").agg(F.min("text").alias("generated"))
    return rows.withColumn("__name", key).join(texts.withColumnRenamed("name", "__name"), "__name", "left").drop("__name").withColumn("generated", first_sentences(F.col("generated"), sentences))
