"""Incremental ingest of quad files: each micro-batch becomes entities that are appended, and read back as the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import entities


def ingest_quads(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Follows a folder of quad files; appends (id, fields, batch) of English entities to Parquet files below table.

    The order of lines within a file decides about repeated fields. Each file is taken once, whatever fails between.
    """
    lines = spark.readStream.format("text").load(folder).select("value", F.col("_metadata.file_path").alias("file"))

    def append(batch: DataFrame, number: int) -> None:
        quads = entities.with_fields(entities.parse_quads(batch.withColumn("line_no", F.monotonically_increasing_id())))
        found = entities.english_entities(entities.assemble(quads)).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").parquet(f"{table}/number={number}")  # a batch that is repeated replaces itself

    return lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """id, fields: of each field the value of the last batch that had it."""
    rows = spark.read.parquet(table).select("id", "batch", F.explode("fields").alias("field", "value"))
    newest = rows.groupBy("id", "field").agg(F.max_by("value", "batch").alias("value"))
    return newest.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
