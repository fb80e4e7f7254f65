"""Byte logs: framed, checksummed records, written from an op log and read back with a status for each.

A log file is a sequence that only a scan from its start can frame, so a file is one task's work and
parallelism comes from files (or segments). The native form of an op log is a Parquet table.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.errors import LogError
from keelson.functions.encoding import record, record_length
from keelson.operators.prefix import running_sum
from keelson.operators.schema import DELETE, PUT

DECODED = "pos bigint, op tinyint, key binary, value binary, status string, error string"
#: Stands for the last byte of a log that has none.
EMPTY = -1


def decode(data: bytes) -> Iterator[tuple[int, int | None, bytes | None, bytes | None, str, str | None]]:
    """(pos, op, key, value, status, error) of each record, from the start of a log.

    A log that ends within a checksum ends cleanly. One that ends later in a record gives an "io"
    row and ends. A record that isn't valid gives a "corrupted" row, and reading goes on after it.
    """
    at = pos = 0
    while at + 4 <= len(data):
        if at + 8 > len(data):
            yield pos, None, None, None, "io", "ends within a length"
            return
        crc, n = struct.unpack_from("<II", data, at)
        payload = data[at + 8 : at + 8 + n]
        if len(payload) < n:
            yield pos, None, None, None, "io", "ends within a record"
            return
        at += 8 + n
        fault, op, key, value = None, None, None, None
        if zlib.crc32(payload) != crc:
            fault = f"checksum is {zlib.crc32(payload)}, not {crc}"
        elif n < 9:
            fault = "record too short"
        else:
            op, k, v = struct.unpack_from("<BII", payload)
            if op not in (PUT, DELETE):
                fault = f"unknown operation {op}"
            elif 9 + k + (v if op == PUT else 0) > n:
                fault = "lengths don't fit the record"
            else:
                key, value = payload[9 : 9 + k], payload[9 + k : 9 + k + v] if op == PUT else None
        yield (pos, None, None, None, "corrupted", fault) if fault else (pos, op, key, value, "ok", None)
        pos += 1


def decode_column(df: DataFrame, name: str, content: str) -> DataFrame:
    """(name, pos, op, key, value, status, error) of each record in a binary column of whole logs."""
    kind = df.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int8(), pa.binary(), pa.binary(), pa.string(), pa.string())
        for b in batches:
            for k, data in enumerate(b.column(1).to_pylist()):
                rows = list(decode(data or b""))
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k] * len(rows), pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[name, "pos", "op", "key", "value", "status", "error"])

    return df.select(name, content).mapInArrow(run, f"{name} {kind}, {DECODED}")


def read_log(spark: SparkSession, path: str, fail_fast: bool = False) -> DataFrame:
    """Records of all log files at a path. fail_fast: a record that isn't "ok" ends the query."""
    rows = decode_column(spark.read.format("binaryFile").load(path).select("path", "content"), "path", "content")
    if fail_fast:
        rows = rows.where(F.when(F.col("status") == "ok", True).otherwise(F.raise_error(F.concat_ws(": ", "path", "status", "error")).cast("boolean")))
    return rows


def records(ops: DataFrame) -> DataFrame:
    """ops with `record`, the framed bytes."""
    return ops.withColumn("record", record(F.col("op"), F.col("key"), F.col("value")))


def segments(ops: DataFrame, per_segment: int = 1000) -> DataFrame:
    """(segment, content): whole logs of so many sequence numbers each."""
    framed = records(ops).select(F.floor((F.col("seq") - 1) / per_segment).alias("segment"), "seq", "record")
    # Each segment is bounded, so its records fit in one row.
    joined = F.array_sort(F.collect_list(F.struct("seq", "record")))
    content = F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["record"])), ""))
    return framed.groupBy("segment").agg(joined.alias("r")).select("segment", content.alias("content"))


def write_log(segments_df: DataFrame, folder: str) -> None:
    """(segment, content) as log files, one for each segment, on any file system that Spark knows.

    Tasks write the bytes; the driver, as the single writer of a log, only gives whole files their names.
    Spark has no sink for bare bytes, but its text sink writes a row's bytes as they are and a separator
    after them. Here that is the content's own last byte: contents are dealt by it, one job for each that
    occurs. LogError if a file is there already or a segment comes twice; then none is named.
    """
    spark = segments_df.sparkSession
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = as_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    # Spark's readers pass over names that begin so.
    staging = f"{folder}/_writing-{uuid.uuid4().hex}"
    dealt, logs = f"{staging}/dealt", f"{staging}/logs"
    rows = segments_df.select("segment", F.coalesce("content", F.lit(b"")).alias("content"))
    last_byte = F.conv(F.hex(F.substring("content", -1, 1)), 16, 10).cast("int")
    try:
        rows.withColumn("last", F.coalesce(last_byte, F.lit(EMPTY))).write.partitionBy("last").parquet(dealt)
        named: list[tuple[str, str | None]] = []
        for status in fs.listStatus(as_path(dealt)):
            _, found, last = status.getPath().getName().partition("last=")
            if not found:
                continue
            part = spark.read.schema(rows.schema).parquet(f"{dealt}/last={last}")
            if int(last) == EMPTY:
                named += [(f"{r['segment']:012d}.log", None) for r in part.select("segment").toLocalIterator()]
            else:
                text = F.substring("content", F.lit(1), F.octet_length("content") - 1).cast("string").alias("text")
                # A file for each row, so that a segment that comes twice is seen.
                sink = part.select("segment", text).write.partitionBy("segment").option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
                sink.text(f"{logs}/{last}", compression="none", lineSep=chr(int(last)))
                for piece in fs.listStatus(as_path(f"{logs}/{last}")):
                    _, found, number = piece.getPath().getName().partition("segment=")
                    if found:
                        named += [(f"{int(number):012d}.log", file.getPath().toString()) for file in fs.listStatus(piece.getPath())]
        taken = {status.getPath().getName() for status in fs.listStatus(as_path(folder))}
        for name, _ in named:
            if name in taken:
                raise LogError("io", f"{folder}/{name} exists")
            taken.add(name)
        for name, file in sorted(named):
            to = as_path(f"{folder}/{name}")
            if file is None:
                fs.create(to, False).close()
            elif not fs.rename(as_path(file), to):
                raise LogError("io", f"{folder}/{name} can't be named")
    finally:
        fs.delete(as_path(staging), True)


def offsets(ops: DataFrame) -> DataFrame:
    """(seq, offset): bytes in the log up to and with each operation."""
    return running_sum(ops.select("seq", record_length(F.col("key"), F.col("value")).alias("n")), "seq", "n", "offset").select("seq", "offset")


def encode(op: int, key: bytes, value: bytes | None = None) -> bytes:
    payload = struct.pack("<BII", op, len(key), len(value or b"")) + key + (value or b"")
    return struct.pack("<II", zlib.crc32(payload), len(payload)) + payload


class LogFile:
    """One byte log on a local path, for small writers and exchange; jobs write Parquet."""

    def __init__(self, path: str, create: bool = False):
        try:
            self.file = open(path, "ab" if create else "r+b")  # noqa: SIM115
        except OSError as fault:
            raise LogError("io", str(fault)) from fault
        self.file.seek(0, 2)

    def append(self, op: int, key: bytes, value: bytes | None = None) -> None:
        if max(len(key), len(value or b"")) >= 1 << 31:
            raise LogError("io", "key or value too long")
        self.file.write(encode(op, key, value))

    def offset(self) -> int:
        """The log's length, whatever opened it."""
        return self.file.tell()

    def sync(self) -> None:
        import os

        self.file.flush()
        os.fsync(self.file.fileno())

    def truncate(self) -> None:
        self.file.flush()
        self.file.truncate(0)
        self.file.seek(0)

    def close(self) -> None:
        self.file.close()
