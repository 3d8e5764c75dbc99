"""Tables that an operator writes on its way, and places of rows in an order that no single task sees whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_folder(spark, name: str) -> str:
    """A path for a table below spark.checkpoint.dir, which driver and executors share.

    Only where the setting is missing (local tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in a new folder.

    It cuts the lineage: what it holds is the same for all who read it, and survives lost executors.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes what `written` has stored, once nothing that is still to run reads it."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def spread(rows: DataFrame, least: int = 1 << 20, per_core: int = 8 << 20) -> DataFrame:
    """A table as it is read, but a small one of few row groups dealt to all cores.

    A row group is read by one task, so a file of one keeps one core busy. Tables of many files, or of over per_core bytes
    for each core, have splits enough and are not touched; below that the shuffle is of bounded size.
    """
    cores, plan = rows.sparkSession.sparkContext.defaultParallelism, rows._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    small = least < size < per_core * cores and plan.toRdd().getNumPartitions() < 2 * cores
    return rows.repartition(2 * cores) if small else rows


def placed(rows: DataFrame, order: list[str | Column], within: list[str] | None = None, out: str = "place") -> DataFrame:
    """rows with their place, from 0, in an order of columns, counted anew for each value of the columns `within`.

    Rows are dealt by ranges and written; places are counted inside each range and moved on by the counts of the ranges
    before, so a value with a large share of all rows is numbered by many tasks.
    """
    within = within or []
    ranged = written(rows.repartitionByRange(*within, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__range", *within).orderBy(*order)) - 1)
    counts = ranged.groupBy("__range", *within).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__before", before).where("__before > 0")
    counts = counts.select(F.col("__range").alias("__r"), "__before", *(F.col(c).alias(f"__{c}") for c in within))
    same = F.col("__range") == F.col("__r")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    found = inside.join(counts, same, "left").withColumn(out, (F.col("__in") + F.coalesce("__before", F.lit(0))).cast("long"))
    return found.select(*rows.columns, out)


def sized(rows: DataFrame, label: str, out: str) -> DataFrame:
    """rows with the number of rows that have the same label, by partial counts and a join, which Spark splits where a label is hot."""
    counts = rows.groupBy(label).agg(F.count("*").alias(out)).withColumnRenamed(label, "__label")
    return rows.join(counts, F.col(label).eqNullSafe(F.col("__label"))).drop("__label")


def distinct_keys(rows: DataFrame, key: str) -> bool:
    """Whether no key is null or comes twice; what rows with one key share can then be told where they are read."""
    return rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col(key).isNull() | (F.col("__n") > 1)).isEmpty()
