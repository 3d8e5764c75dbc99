"""WARC archives: a writer with one gzip member per record, and a reader that splits them.

Writing uses Spark's own committed writer: a record is a line of the text format whose separator is the byte 0. A gzip
member ends in the top byte of its length, 0 below 16 MB (larger ones are followed by an empty member), so the
separator is the member's own last byte and the files are plain concatenated members.

Reading deals byte ranges to tasks. A task looks for the gzip magic, takes a candidate for a member only if its first
bytes inflate to a WARC header, and owns the records that start inside its range; the last may end beyond it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import pieces

MAGIC = b"\x1f\x8b\x08"
_EMPTY = zlib.compressobj(1, zlib.DEFLATED, 31)
_EMPTY = _EMPTY.compress(b"") + _EMPTY.flush()


def roles(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """page_id, url, payload (binary), digest, refers_to: of equal payloads of `least` bytes the smallest id is referred to.

    Repeated rows of that id are all responses; rows without an id are responses that nobody refers to. Null bodies are empty.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # short payloads meet nobody: a key of their own spreads them
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.col("digest")).otherwise(F.concat(F.lit("short "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("smallest"), F.count("*").alias("n"))
    # another expression than the grouping's, so that the join has its own exchange, which Spark can split where it is hot
    first = first.where("n > 1").select(F.concat("digest", F.lit("")).alias("key"), "smallest")
    rows = rows.join(first, "key", "left")
    return rows.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("smallest"), F.col("smallest")).alias("refers_to"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "payload", 4 << 20):
        out = []
        for page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            block = http if refers is not None else http + payload
            head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>"]
            if url is not None:
                head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
            if refers is not None:
                head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
            z = zlib.compressobj(1, zlib.DEFLATED, 31)
            member = z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()
            out.append((member if not member[-1] else member + _EMPTY)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write_warc(records: DataFrame, path: str) -> None:
    """Writes the rows of roles() as WARC files below path. Null ids and urls are left out of the headers; a table without rows gives no records."""
    records.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _parsed(record: bytes) -> tuple:
    """record_id, type, url, refers_to, digest, payload_bytes, payload of one inflated record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1])
    url = fields.get("WARC-Target-URI")
    page = lambda name: (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) and int(m[1])
    kind = fields["WARC-Type"]
    return page("WARC-Record-ID"), kind, url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), page("WARC-Refers-To"), fields["WARC-Payload-Digest"].removeprefix("sha256:"), length, payload if kind == "response" else None


def records_in(read, begin: int, end: int, size: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The inflated records whose members start in [begin, end); read(at, n) gives bytes of the file of `size` bytes."""
    at, data, base = begin, b"", begin
    while at < end:
        # the magic may lie across the end of what has been read
        if at + 3 > base + len(data) and base + len(data) < size:
            data, base = data[at - base :] + read(base + len(data), chunk), at
            continue
        found = data.find(MAGIC, at - base)
        if found < 0:
            at = max(at, base + len(data) - 2)
            if base + len(data) >= size:
                return
            continue
        at = base + found
        if at >= end:
            return
        z, out, fed, bad = zlib.decompressobj(31), [], at, False
        got = 0  # bytes so far, of which the first seven are looked at once
        while not z.eof:
            part = data[fed - base :] if fed < base + len(data) else read(fed, chunk)
            if not part:
                bad = True  # cut off
                break
            fed += len(part)
            try:
                out.append(z.decompress(part))
            except zlib.error:
                bad = True
                break
            before, got = got, got + len(out[-1])
            if before < 7 <= got and not b"".join(out).startswith(b"WARC/1."):
                bad = True
                break
        if bad or got < 7:
            at += 1
            continue
        yield b"".join(out)
        at = fed - len(z.unused_data)
        if at > base + len(data):
            data, base = b"", at


def read_warc(spark: SparkSession, path: str, split: int = 8 << 20, task_bytes: int = 128 << 20) -> DataFrame:
    """page_id, record_type, url, refers_to, payload_digest, payload_bytes, payload (null in a revisit), one row per record.

    Ranges of `split` bytes are dealt to tasks of about task_bytes each, but to two tasks a core at least where there are
    so many ranges. Order is not kept. Bytes that belong to no valid member are skipped, and so is a member that is cut off.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("begin"))
    total = files.agg(F.sum("length"), F.sum(F.ceil(F.col("length") / split))).first()
    tasks = min(total[1] or 1, max(2 * spark.sparkContext.defaultParallelism, (total[0] or 0) // task_bytes))
    ranges = ranges.repartition(int(tasks), "path", "begin")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for uri, size, begin in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "begin")), strict=True):
                system, inner = _filesystem(uri)
                with system.open_input_file(inner) as file:
                    rows, held = [], 0
                    for record in records_in(lambda at, n, f=file, s=size: f.read_at(min(n, s - at), at) if at < s else b"", begin, min(begin + split, size), size):
                        rows.append(_parsed(record))
                        held += len(record)
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                    if rows:
                        yield pack(rows)

    return ranges.mapInArrow(scan, "page_id long, record_type string, url string, refers_to long, payload_digest string, payload_bytes long, payload binary")
