"""Exact deduplication by Grace hashing.

Equal contents are found by a hash table with open addressing that compares whole contents. A task whose distinct
contents outgrow the table's limit deals its records to spill files by bits of their digest and goes on with each file in
turn, recursively. The spill files are scratch of one task attempt: nobody else reads them and they go with it, so a
lost executor only repeats the task.

Before the shuffle every input partition collapses its own copies in the same way; a text that makes up a third of all
rows thus crosses the network once per partition. Members find their class by a join on the digest, which adaptive
execution may split where one digest is hot.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import new_names, pieces

_HEAD = struct.Struct("<32s?qqI")


class ContentTable:
    """Open addressing with linear probing: content -> (largest id, number of rows)."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.entries: list[list] = []  # digest, content, largest id, rows
        self.bytes = 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if entry[0] == digest and entry[1] == content:
                break
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: bytes, largest: int | None, rows: int) -> None:
        at = self._slot(digest, content)
        if (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            entry[2] = largest if entry[2] is None else entry[2] if largest is None else max(entry[2], largest)
            entry[3] += rows
            return
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, largest, rows])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for i, entry in enumerate(self.entries):
                self.slots[self._slot(entry[0], entry[1])] = i


def _put(file, digest, content, largest, rows) -> None:
    file.write(_HEAD.pack(digest, largest is None, largest or 0, rows, len(content)))
    file.write(content)


def _spilled(file) -> Iterator[tuple]:
    file.seek(0)
    while head := file.read(_HEAD.size):
        digest, missing, largest, rows, n = _HEAD.unpack(head)
        yield digest, file.read(n), None if missing else largest, rows


def grace(records: Iterator[tuple], limit: int, fan_out: int = 16, depth: int = 0) -> Iterator[list]:
    """One [digest, content, largest id, rows] for each distinct content; holds about `limit` bytes of contents.

    A bucket that can't be divided further (digest used up) is finished in the table whatever its size.
    """
    table, files = ContentTable(), None
    for record in records:
        if files is None:
            table.add(*record)
            if table.bytes > limit and depth < 30 and len(table.entries) > 1:
                files = [tempfile.TemporaryFile() for _ in range(fan_out)]
                for entry in table.entries:
                    _put(files[entry[0][8 + depth % 24] % fan_out], *entry)
                table = ContentTable()
        else:
            _put(files[record[0][8 + depth % 24] % fan_out], *record)
    yield from table.entries
    for file in files or ():
        with file:
            yield from grace(_spilled(file), limit, fan_out, depth + 1)


def _collapse(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in pieces(batches, "content"):
                yield from zip(*(batch.column(c).to_pylist() for c in ("digest", "content", "largest", "rows")), strict=True)

        out: list[list] = []
        size = 0
        schema = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("largest", pa.int64()), ("rows", pa.int64())])

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for entry in grace(records(), limit):
            out.append(entry)
            size += len(entry[1])
            if size > 4 << 20:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 96 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs; equal texts form a group.

    The row with the largest id of a group stays. Null text counts as empty. A null id never wins against another
    (a group of only null ids has keep_id null and keeps those rows). Rows that repeat both id and text are each
    returned, counted in group_size, and all kept or all dropped. No rows in, no rows out. Other columns of docs are not
    looked at, so their names can't clash. Two different texts with the same SHA-256 raise an error.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("content"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("content", 256)))
    schema = "digest binary, content binary, largest long, rows long"
    one = rows.select("digest", "content", F.col("doc_id").alias("largest"), F.lit(1).cast("long").alias("rows"))
    local = one.mapInArrow(_collapse(table_bytes), schema)
    classes = local.repartition("digest").mapInArrow(_collapse(table_bytes), schema).select("digest", "largest", "rows")
    # one digest must be one class; a second content under it would double the members' rows, so stop instead
    classes = classes.groupBy("digest").agg(F.max("largest").alias("keep_id"), F.sum("rows").alias("group_size"), F.count("*").alias("contents"))
    classes = classes.select(
        F.lower(F.hex("digest")).alias("text_sha256"),
        "keep_id",
        F.when(F.col("contents") > 1, F.raise_error(F.lit("two different texts share a SHA-256 digest"))).otherwise(F.col("group_size")).cast("long").alias("group_size"),
    )
    members = rows.select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"))
    return members.join(classes, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    here, sha = new_names(docs, "id", "sha")
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(here), F.col("text_sha256").alias(sha)).distinct()
    mine = [F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(here)), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256) == F.col(sha)]
    return docs.join(kept, mine[0] & mine[1], "left_semi")
