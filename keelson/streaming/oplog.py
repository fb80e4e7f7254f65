"""An op log as a stream of Parquet files: newest versions kept up to date, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keelson.operators.schema import OPLOG


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(OPLOG).parquet(path)


def latest_stream(ops: DataFrame) -> DataFrame:
    """(key, value, seq) of a stream; for update or complete output."""
    newest = F.max_by(F.struct("value", "seq"), "seq").alias("e")
    return ops.groupBy("key").agg(newest).select("key", "e.value", "e.seq")


def to_runs(ops: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's newest entries as a run in a folder named by the batch: a retried batch writes the same run again."""

    def write(batch: DataFrame, number: int) -> None:
        latest_stream(batch).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
