"""Keyed state: an op log reduced to the newest entry of each key, with point reads, scans and size accounting.

Writes append to the log; nothing is resolved before a read. The newest version is chosen by the
greatest sequence number, with a hash aggregation that sums up each task's rows first, so keys
that many operations share don't skew it. Tombstones stay visible until `live` drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.operators.config import EngineConfig
from keelson.operators.prefix import running_sum
from keelson.operators.schema import DELETE, OPLOG, PUT

#: Fixed value: what an entry takes beyond its key and value.
OVERHEAD = 24


def latest(ops: DataFrame) -> DataFrame:
    """(key, value, seq): the newest operation of each key; a null value is a tombstone."""
    newest = F.max_by(F.struct("value", "seq"), "seq").alias("e")
    return ops.groupBy("key").agg(newest).select("key", "e.value", "e.seq")


def live(entries: DataFrame) -> DataFrame:
    return entries.where("value is not null")


def scan(entries: DataFrame) -> DataFrame:
    """All entries in key order, tombstones too."""
    return entries.orderBy("key")


def key_range(df: DataFrame, start: bytes, end: bytes) -> DataFrame:
    """Rows with start <= key < end; none if end doesn't come after start. Applied to a log, it prunes before the reduction."""
    return df.where((F.col("key") >= F.lit(start)) & (F.col("key") < F.lit(end)))


def get_many(ops: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, state, value, seq) for each row of probes (key): state is absent, tombstone or live.

    Only probed keys are reduced: the log is filtered by a semi join first.
    """
    return resolved(latest(ops.join(probes.select("key").distinct(), "key", "left_semi")), probes)


def resolved(found: DataFrame, probes: DataFrame) -> DataFrame:
    """Each probe's entry among those found, with its state; a null key is absent."""
    state = F.when(F.col("seq").isNull(), "absent").when(F.col("value").isNull(), "tombstone").otherwise("live")
    return probes.select("key").join(found, "key", "left").select("key", state.alias("state"), "value", "seq")


def snapshot(ops: DataFrame, seq: int) -> DataFrame:
    """The entries as they were after an operation."""
    return latest(ops.where(F.col("seq") <= seq))


def counts(ops: DataFrame) -> DataFrame:
    """One row: keys with an entry (tombstones too), last sequence number, live entries, tombstones, whether there is none."""
    entries = latest(ops)
    n = F.count("*")
    return entries.agg(n.alias("len"), F.coalesce(F.max("seq"), F.lit(0)).alias("seq_num"), F.count("value").alias("live"), (n - F.count("value")).alias("tombstones"), (n == 0).alias("is_empty"))


def size_changes(ops: DataFrame) -> DataFrame:
    """ops with `delta`: what each operation adds to the accounted size.

    A key's first operation adds key, value and overhead; a later put what its value is longer than
    the one before it (a tombstone counts 0); a later delete nothing.
    """
    by_key = Window.partitionBy("key").orderBy("seq")
    value = F.coalesce(F.octet_length("value"), F.lit(0))
    before = F.coalesce(F.lag(F.octet_length("value")).over(by_key), F.lit(0))
    first = F.octet_length("key") + value + OVERHEAD
    return ops.withColumn("delta", F.when(F.row_number().over(by_key) == 1, first).otherwise(F.greatest(F.lit(0), value - before)).cast("bigint"))


def sizes(ops: DataFrame) -> DataFrame:
    """(seq, size) after each operation."""
    return running_sum(size_changes(ops).select("seq", "delta"), "seq", "delta", "size").select("seq", "size")


def first_full(ops: DataFrame, max_size: int) -> DataFrame:
    """(first_full_seq): the operation after which the size reaches max_size; null if none does."""
    return sizes(ops).where(F.col("size") >= max_size).agg(F.min("seq").alias("first_full_seq"))


class KeyedState:
    """A log that grows by puts and deletes, for interactive use and tests; a job reads its log from a source.

    Single writer. Each write takes the next sequence number, deletes of unknown keys too.
    """

    def __init__(self, spark: SparkSession, max_size: int = EngineConfig.memtable_size, ops: DataFrame | None = None):
        self.spark, self.max_size = spark, max_size
        self.ops = ops if ops is not None else spark.createDataFrame([], OPLOG)
        self._last = self.ops.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] if ops is not None else 0

    def apply(self, operations: list[tuple[bytes, bytes | None]]) -> None:
        """Append operations in order: (key, value), a value of None deletes."""
        rows = [(self._last + k, PUT if value is not None else DELETE, key, value) for k, (key, value) in enumerate(operations, 1)]
        self._last += len(rows)
        self.ops = self.ops.unionByName(self.spark.createDataFrame(rows, OPLOG))

    def put(self, key: bytes, value: bytes) -> None:
        self.apply([(key, value)])

    def delete(self, key: bytes) -> None:
        self.apply([(key, None)])

    def get(self, key: bytes) -> tuple[str, bytes | None, int | None]:
        """(state, value, seq) of one key."""
        row = get_many(self.ops, self.spark.createDataFrame([(key,)], "key binary")).first()
        return row["state"], None if row["value"] is None else bytes(row["value"]), row["seq"]

    def iter(self) -> DataFrame:
        return scan(latest(self.ops))

    def range(self, start: bytes, end: bytes) -> DataFrame:
        return scan(latest(key_range(self.ops, start, end)))

    def size(self) -> int:
        return size_changes(self.ops).agg(F.coalesce(F.sum("delta"), F.lit(0))).first()[0]

    def is_full(self) -> bool:
        return self.size() >= self.max_size

    def len(self) -> int:
        return self.ops.select("key").distinct().count()

    def is_empty(self) -> bool:
        return self.ops.isEmpty()

    def seq_num(self) -> int:
        return self._last
