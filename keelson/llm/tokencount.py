"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

A first pass over all texts keeps in each task the chunks that are frequent there (a bounded
summary by frequent-item counters: an item seen in more than 1/size of a task's chunks is in it) and
sends one row a task. Rows merge in a tree of bounded summaries. The result, at most `frequent`
hashes and lengths, is broadcast. The second pass looks chunks up there first, then in the
worker's own cache, and encodes what neither has.

Nulls: a null text is an empty one and has no tokens. Rows are never joined, so repeated ids, ties
and other columns don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import bpe
from keelson.llm.common import extended, text_bytes
from keelson.llm.textvec import U64, buffers, segment_hashes, slices

FREQUENT = 1 << 16
FAN_IN = 32


def merged(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A summary of at most so many entries: the next count is taken off all, as frequent-item counters do."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, inverse, counts)
    if len(distinct) > size:
        off = np.partition(total, len(total) - size - 1)[len(total) - size - 1]
        keep = total > off
        distinct, total = distinct[keep], total[keep] - off
    return distinct, total


def tokenizer_paths(json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> tuple:
    return json_path, ranks_path, pattern


def frequent_chunks(df: DataFrame, text_col: str, paths: tuple, size: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the corpus's frequent chunks and their numbers of tokens; at most so many."""
    schema = "part long, hashes binary, counts binary, lengths binary"

    def packed(part: int, h: np.ndarray, n: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (h, n, lengths.astype("<i4")))], names=["part", "hashes", "counts", "lengths"])

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        h, n = np.zeros(0, U64), np.zeros(0, np.int64)
        seen: dict[int, bytes] = {}
        for b in slices(batches, "__bytes", 2 << 20):
            data, offs = buffers(b.column(0))
            starts, ends, _, ok = bpe.chunks(data, offs)
            ok &= ends - starts <= bpe.LONGEST_CACHED
            own, at, count = np.unique(segment_hashes(data, starts[ok], ends[ok]), return_index=True, return_counts=True)
            h, n = merged(np.concatenate([h, own]), np.concatenate([n, count]), size)
            often = count > 1
            where = np.flatnonzero(ok)[at[often]]
            fresh = np.isin(own[often], h)
            raw = data.tobytes()
            for k, a, e in zip(own[often][fresh].tolist(), starts[where][fresh].tolist(), ends[where][fresh].tolist(), strict=True):
                seen.setdefault(k, raw[a:e])
            if len(seen) > 2 * size:
                stay = set(h.tolist())
                seen = {k: x for k, x in seen.items() if k in stay}
        have = np.array([k in seen for k in h.tolist()], bool)
        h, n = h[have], n[have]
        encoder, _ = bpe.worker(paths)
        lengths = np.array([len(x) for x in encoder.many([seen[k] for k in h.tolist()])], np.int64) if len(h) else n
        yield packed(TaskContext.get().partitionId(), h, n, lengths)

    def join(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py() // FAN_IN
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
        h, n, lengths = read("hashes", U64), read("counts", np.int64), read("lengths", "<i4")
        own, at = np.unique(h, return_index=True)
        top, total = merged(h, n, size)
        return pa.Table.from_batches([packed(part, top, total, lengths[at][np.searchsorted(own, top)])])

    out = df.select(text_bytes(text_col).alias("__bytes")).mapInArrow(summary, schema)
    parts = df.sparkSession.sparkContext.defaultParallelism
    parts = max(parts, out.rdd.getNumPartitions())
    while True:
        out = out.groupBy((F.col("part") / FAN_IN).cast("long")).applyInArrow(lambda _, t: join(t), schema)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    rows = out.collect()
    if not rows:
        return np.zeros(0, U64), np.zeros(0, np.int32)
    return np.frombuffer(rows[0].hashes, U64), np.frombuffer(rows[0].lengths, "<i4")


def token_counts(df: DataFrame, paths: tuple, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(id, n_bytes, n_tokens): tokens of each whole text, without begin, end or padding."""
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(frequent_chunks(df, text_col, paths, frequent))
    schema = extended(df.select(F.col(id_col)).schema, n_bytes="bigint", n_tokens="bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = table.value
        for b in slices(batches, "__bytes", 4 << 20):
            data, offs = buffers(b.column(1))
            sizes, _ = bpe.encode(data, offs, paths, known, lengths)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), pa.array(sizes)], names=[id_col, "n_bytes", "n_tokens"])

    return df.select(F.col(id_col), text_bytes(text_col).alias("__bytes")).mapInArrow(count, schema)
