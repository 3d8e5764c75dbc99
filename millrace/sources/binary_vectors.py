"""Word vectors in the binary form: a line with the number of words and columns, then word, blank, floats and a newline for each.

The reader is a data source whose tasks take byte ranges. As words differ in length, a task looks for the first newline in its
range that is followed by CHAIN records in a row, or by records up to the end of the file, and owns the records that begin
inside the range. Files without newlines after the floats cannot be cut and are read by one task each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records that must follow each other where a task begins; bytes of a word at most; rows of a batch.
CHAIN, LONGEST, ROWS = 8, 1000, 4096

SCHEMA = "word string, vector array<float>"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write(vectors: DataFrame, path: str, word: str = "word", vector: str = "vector") -> int:
    """Writes a file per partition into the folder, and returns the number of words.

    A task writes under a name of its own and moves the finished file to its place, so one that is repeated leaves the same
    file; it holds its partition until it knows the number of words. Vectors have one length; null or empty words or
    vectors, words with blanks or newlines and those of over LONGEST bytes are an error.
    """
    rows = vectors.select(F.col(word).cast("string").alias("word"), F.col(vector).cast("array<float>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, columns = [], 0, None
        for batch in batches:
            for w, v in zip(batch.column("word").to_pylist(), batch.column("vector"), strict=True):
                name = (w or "").encode()
                if not name or not v.is_valid or re.search(rb"[\s\x00-\x1f]", name) or len(name) > LONGEST:
                    raise ValueError(f"no word or vector that the form can hold: {w!r}")
                values = v.values.to_numpy(zero_copy_only=False).astype("<f4")
                columns = len(values) if columns is None else columns
                if not columns or len(values) != columns:
                    raise ValueError(f"vectors of {columns} and {len(values)} columns")
                held.append(name + b" " + values.tobytes() + b"\n")
                count += 1
        if count:
            context = TaskContext.get()
            system, folder = _opened(path)
            own = f"{folder}/.part-{context.partitionId():05d}-{context.taskAttemptId()}"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(own) as out:
                out.write(b"%d %d\n" % (count, columns))
                for record in held:
                    out.write(record)
            system.move(own, f"{folder}/part-{context.partitionId():05d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _record(data: bytes, at: int, columns: int, newline: bool) -> tuple[bytes, int, int] | None:
    """Word, begin of the floats and begin of the next record of one that begins here, if one does and is whole."""
    blank = data.find(b" ", at, at + LONGEST + 1)
    if blank <= at:
        return None
    word, end = data[at:blank], blank + 1 + 4 * columns
    if re.search(rb"[\x00-\x1f]", word) or end + newline > len(data) or newline and data[end : end + 1] != b"\n":
        return None
    try:
        word.decode()
    except UnicodeDecodeError:
        return None
    return word, blank + 1, end + newline


def first_record(data: bytes, columns: int, last: bool) -> int | None:
    """Where the first record begins after a newline in data; last: data go to the end of the file."""
    at = data.find(b"\n")
    while at >= 0:
        begin = after = at + 1
        for _ in range(CHAIN):
            found = _record(data, after, columns, True)
            if found is None:
                break
            after = found[2]
        else:
            return begin
        if last and after == len(data) and after > begin:
            return begin
        at = data.find(b"\n", begin)
    return None


class _Range(InputPartition):
    def __init__(self, file: str, begin: int, end: int, size: int) -> None:
        self.file, self.begin, self.end, self.size = file, begin, end, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("split", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        system, folder = _opened(self.path)
        info = system.get_file_info(folder)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        out: list[InputPartition] = []
        for f in sorted(files, key=lambda f: f.path):
            with system.open_input_file(f.path) as file:
                head = file.read(64 + LONGEST)
                columns, start = _head(head)
                first = head.find(b" ", start)
                file.seek(first + 1 + 4 * columns)
                cuts = file.read(1) == b"\n"
            split = self.split if cuts else max(f.size, 1)
            out += [_Range(f.path, at, min(at + split, f.size), f.size) for at in range(0, f.size, split)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, _Range)
        if not partition.file:
            return
        system, _ = _opened(self.path)
        with system.open_input_file(partition.file) as file:
            columns, start = _head(file.read(64))
            # what a task needs beyond its range to know its first record and to finish its last
            more = (CHAIN + 1) * (LONGEST + 2 + 4 * columns)
            begin = max(partition.begin - 1, 0)
            file.seek(begin)
            data = file.read(min(partition.end + more, partition.size) - begin)
        last = begin + len(data) == partition.size
        if partition.begin == 0:
            at: int | None = start
            newline = _newline(data, start, columns)
        else:
            at, newline = first_record(data, columns, last), True
        words, places = [], []
        while at is not None and begin + at < partition.end and (begin + at >= partition.begin):
            found = _record(data, at, columns, newline)
            if found is None:
                raise ValueError(f"no record at byte {begin + at} of {partition.file}")
            words.append(found[0].decode())
            places.append(found[1])
            at = found[2]
            if len(words) == ROWS:
                yield _batch(data, words, places, columns)
                words, places = [], []
        if words:
            yield _batch(data, words, places, columns)


def _head(data: bytes) -> tuple[int, int]:
    """Number of columns, and where the first record begins."""
    line, newline, _ = data.partition(b"\n")
    if not newline or not re.fullmatch(rb"\d+ [1-9]\d*\r?", line):
        raise ValueError("no head line with the numbers of words and columns")
    return int(line.split()[1]), len(line) + 1


def _newline(data: bytes, start: int, columns: int) -> bool:
    end = data.find(b" ", start) + 1 + 4 * columns
    return data[end : end + 1] == b"\n"


def _batch(data: bytes, words: list[str], places: list[int], columns: int) -> pa.RecordBatch:
    values = np.frombuffer(b"".join(data[p : p + 4 * columns] for p in places), "<f4")
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * columns), pa.array(values))
    return pa.RecordBatch.from_arrays([pa.array(words), lists], names=["word", "vector"])


class WordVectors(DataSource):
    """spark.read.format("wordvectors").option("split", bytes).load(path) once it is registered; read() does both."""

    @classmethod
    def name(cls) -> str:
        return "wordvectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """word, vector of a file or of the files of a folder, by ranges of about `split` bytes."""
    spark.dataSource.register(WordVectors)
    return spark.read.format("wordvectors").option("split", split).load(path)
