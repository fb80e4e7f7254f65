"""Sorted pages of at most 4096 bytes: packing, bytes, scans and lookups.

Packing is a greedy fold over a run's keys in order, so runs are packed in parallel and a run by one
task; a run is bounded by the target file size. Values must not be null: pages have no tombstones.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.errors import PageError
from keelson.operators.schema import PAGE_SIZE

#: Fixed value: entries between restart points.
RESTART_EVERY = 16


class PageBuilder:
    """One page under construction; entries should come in key order, without repeats."""

    def __init__(self):
        self.body, self.restarts, self.since = bytearray(), [0], 0

    def add(self, key: bytes, value: bytes) -> bool:
        """Append an entry; false if it doesn't fit beside its restart point and the trailer."""
        entry = 8 + len(key) + len(value)
        if len(self.body) + entry + 4 * (len(self.restarts) + 1) + 4 > PAGE_SIZE:
            return False
        if self.since == RESTART_EVERY:
            self.restarts.append(len(self.body))
            self.since = 0
        self.body += struct.pack("<II", len(key), len(value)) + key + value
        self.since += 1
        return True

    def size(self) -> int:
        return len(self.body) + 4 * len(self.restarts) + 4

    def is_empty(self) -> bool:
        return not self.body

    def finish(self) -> bytes:
        return bytes(self.body) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))


class Page:
    """A finished page's bytes."""

    def __init__(self, data: bytes):
        if len(data) < 4:
            raise PageError("too short for a trailer")
        (n,) = struct.unpack_from("<I", data, len(data) - 4)
        self.end = len(data) - 4 - 4 * n
        if n == 0 or self.end < 0:
            raise PageError("restart points out of range")
        self.data, self.restarts = data, list(struct.unpack_from(f"<{n}I", data, self.end))

    def entry(self, at: int) -> tuple[bytes, bytes, int]:
        if at + 8 > self.end:
            raise PageError("entry out of range")
        k, v = struct.unpack_from("<II", self.data, at)
        if at + 8 + k + v > self.end:
            raise PageError("entry beyond its page")
        return self.data[at + 8 : at + 8 + k], self.data[at + 8 + k : at + 8 + k + v], at + 8 + k + v

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        at = 0
        while at < self.end:
            key, value, at = self.entry(at)
            yield key, value

    def get(self, key: bytes) -> bytes | None:
        """A key's value; entries are read from the last restart point that doesn't come after it."""
        if self.end == 0:
            return None
        low, high = 0, len(self.restarts)
        while high - low > 1:
            middle = (low + high) // 2
            if self.entry(self.restarts[middle])[0] <= key:
                low = middle
            else:
                high = middle
        at = self.restarts[low]
        while at < self.end:
            own, value, at = self.entry(at)
            if own >= key:
                return value if own == key else None
        return None


def pack(entries: DataFrame, run: str = "run") -> DataFrame:
    """(run, block, entries, restarts, size, first_key, last_key, bytes) of runs of (key, value), packed in key order."""
    kind = entries.schema[run].dataType.simpleString()

    def fold(table: pa.Table) -> pa.Table:
        name = table.column(run)[0].as_py()
        rows = sorted(zip(table.column("key").to_pylist(), table.column("value").to_pylist(), strict=True))
        out, page, keys = [], PageBuilder(), []

        def close() -> None:
            out.append((name, len(out), len(keys), len(page.restarts), page.size(), keys[0], keys[-1], page.finish()))

        for key, value in rows:
            if value is None:
                raise PageError("a page can't hold a tombstone")
            if not page.add(key, value):
                if keys:
                    close()
                page, keys = PageBuilder(), []
                if not page.add(key, value):
                    raise PageError(f"entry of {len(key) + len(value)} bytes is too large for a page")
            keys.append(key)
        if keys:
            close()
        fields = [table.schema.field(run), pa.field("block", pa.int32()), *(pa.field(n, pa.int64()) for n in ("entries", "restarts", "size")), *(pa.field(n, pa.binary()) for n in ("first_key", "last_key", "bytes"))]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))

    return entries.select(run, "key", "value").groupBy(run).applyInArrow(fold, f"{run} {kind}, block int, entries bigint, restarts bigint, size bigint, first_key binary, last_key binary, bytes binary")


def unpack(pages: DataFrame, run: str = "run") -> DataFrame:
    """(run, block, key, value) of all entries."""
    kind = pages.schema[run].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, *e) for k, data in enumerate(b.column(2).to_pylist()) for e in Page(data)]
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())], names=[run, "block", "key", "value"])

    return pages.select(run, "block", "bytes").mapInArrow(read, f"{run} {kind}, block int, key binary, value binary")


def lookup(pages: DataFrame, probes: DataFrame, run: str = "run") -> DataFrame:
    """(run, key, found, value) for each row of probes (run, key): a page is read only if its key bounds hold the probe.

    Probes that are repeated are looked up once.
    """
    kind = pages.schema[run].dataType.simpleString()
    asked = probes.select(run, "key").distinct()
    near = pages.select(run, "first_key", "last_key", "bytes").join(asked, run).where((F.col("key") >= F.col("first_key")) & (F.col("key") <= F.col("last_key"))).select(run, "key", "bytes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Page(data).get(key) for key, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], names=[run, "key", "value"])

    hits = near.mapInArrow(read, f"{run} {kind}, key binary, value binary").where("value is not null").select(F.col(run).alias("__run"), F.col("key").alias("__key"), "value")
    return probes.select(run, "key").join(hits, F.col(run).eqNullSafe(F.col("__run")) & F.col("key").eqNullSafe(F.col("__key")), "left").select(run, "key", F.col("value").isNotNull().alias("found"), "value")


def write_pages(pages: DataFrame, path: str) -> None:
    """Page bytes and their bounds to storage; unpack() and lookup() take what is read back."""
    pages.write.mode("errorifexists").parquet(path)
