"""Helpers of the training-data operators: the shared folder, written tables, slices of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The ASCII capitals; lower-casing in the contracts touches only these.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing (local tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="millrace-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def new_names(table: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes for the table to have none of them, in any case."""
    taken, out = {c.lower() for c in table.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: cuts lineage, survives lost executors. options are the writer's."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes what `written` has stored, once nothing that is still to run reads it."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about `most` bytes in column `text` (one row at least): bounds memory. At the end an idle worker gives back what it does not use."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > begin and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)
    pa.default_memory_pool().release_unused()
