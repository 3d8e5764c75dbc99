"""Writers: rolling shards, batches, training files, upserts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import discard, placed, sized, written


def rolling_csv(rows: DataFrame, path: str, most_rows: int = 100_000) -> None:
    rows.write.option("maxRecordsPerFile", most_rows).csv(path)


def shards_by_words(rows: DataFrame, text: str, key: str, words_per_shard: int) -> DataFrame:
    """rows with `shard`: a shard ends once it has so many words, in the order of key.

    Partial sums per range of keys come first, so that the running sum needs no task that sees all rows.
    """
    dealt = rows.withColumn("words", F.size(F.split(F.trim(F.col(text)), r"\s+")).cast("long")).repartitionByRange(key).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "ranges")  # both branches see the same ranges
    sums = dealt.groupBy("range").agg(F.sum("words").alias("of_range"))
    before = sums.select("range", F.coalesce(F.sum("of_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    running = F.sum("words").over(Window.partitionBy("range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("within", running).join(F.broadcast(before), "range")  # a row per range of the shuffle
    return out.withColumn("shard", F.floor((F.col("before") + F.col("within") - F.col("words")) / words_per_shard)).drop("range", "within", "before")


def write_shards(sharded: DataFrame, column: str, path: str) -> None:
    sharded.select("shard", column).write.partitionBy("shard").text(path)


def word_log(rows: DataFrame, key: str, name: str, description: str) -> DataFrame:
    """Key and word counts of name and description, where there is a description."""
    count = lambda c: F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", 0).otherwise(F.size(F.split(F.trim(F.col(c)), r"\s+"))).cast("long")
    return rows.select(key, count(name).alias("name_words"), count(description).alias("desc_words")).where("desc_words > 0")


def in_batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with `batch`: so many distinct values of the order's columns each, counted from 0."""
    numbered = placed(rows.select(*order).distinct(), order, out="batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))
    return rows.join(numbered, order)


def slice_lines(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """rows with `part`, dealt in turn by a number key."""
    return rows.withColumn("part", F.pmod(F.col(key), F.lit(parts)).cast("long"))


def fasttext_lines(rows: DataFrame, label: str, text: str) -> DataFrame:
    """Training lines "__label__X<TAB>text" of labels with two rows at least; blanks in labels are bars."""
    counted = sized(rows.select(label, text), label, "n").where("n > 1")
    return counted.select(F.concat(F.lit("__label__"), F.replace(F.col(label), F.lit(" "), F.lit("|")), F.lit("\t"), F.col(text)).alias("line"))


def predictions(rows: DataFrame, pred: str = "pred", truth: str | None = "truth") -> DataFrame:
    if truth is None:
        return rows.select(F.col(pred).alias("pred"))
    return rows.select(F.col(pred).alias("pred"), F.col(truth).alias("truth"), F.when(F.col(pred) == F.col(truth), "ok").otherwise("wrong").alias("flag"))


def embedding_lines(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.concat_ws(" ", "word", F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")).alias("line"))


def repair_cells(rows: DataFrame) -> DataFrame:
    """Strings without quotes at their ends."""
    return rows.select(*(F.regexp_replace(c, '"+$', "").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))


def per_cluster(rows: DataFrame, path: str) -> None:
    """A folder per cluster; clusters without rows have none."""
    rows.write.partitionBy("cluster_id").csv(path)


def compact(spark, path: str, out: str, file_bytes: int = 256 << 20) -> None:
    """Writes a Parquet table anew in files of about file_bytes each, as many as its size asks for."""
    total = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0] or 0
    spark.read.parquet(path).repartition(max(1, -(-total // file_bytes))).write.parquet(out)


def upsert(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest non-null value of each field per key; order says what is later."""
    when = F.struct(*order)
    fields = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in fields))


def last_write(rows: DataFrame, keys: list[str], value: Column, order: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias("value"))


def merge_entities(batch: DataFrame, path: str, key: str, order: list[str], buckets: int = 64) -> None:
    """Brings a batch into a stored table of entities, field by field: of each field the latest non-null value stays.

    Entities lie in folders by a hash of their key; only the folders that the batch touches are read and written anew, by
    dynamic overwrite from a finished table, so a run that breaks off can be repeated. Each field is kept with what `order`
    said of it, so batches may come in any order and more than once; of one moment the larger value stays. Null keys
    are an entity of their own. An empty batch changes nothing.
    """
    spark = batch.sparkSession
    fields = [c for c in batch.columns if c != key and c not in order]
    said = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.struct(*order).alias("when"), F.col(c).alias("value")))
    came = written(batch.groupBy(key).agg(*(F.max(said(c)).alias(c) for c in fields)).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "batch")
    touched, new = [r.bucket for r in came.select("bucket").distinct().collect()], came
    if not touched:
        return
    try:
        new = spark.read.schema(came.schema).parquet(path).where(F.col("bucket").isin(touched)).select(came.columns).unionByName(came)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    merged = written(new.groupBy(key, "bucket").agg(*(F.max(c).alias(c) for c in fields)), "merged")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    discard(came, merged)


def stored_entities(spark, path: str, key: str) -> DataFrame:
    """The entities of merge_entities, with the values of their fields."""
    rows = spark.read.parquet(path).drop("bucket")
    return rows.select(key, *(F.col(f"{c}.value").alias(c) for c in rows.columns if c != key))
