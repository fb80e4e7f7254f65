"""Native storage: op logs and sorted runs as Parquet, with key bounds that scans can prune by."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_ops(ops: DataFrame, path: str) -> None:
    ops.write.mode("append").parquet(path)


def write_run(entries: DataFrame, path: str, partitions: int | None = None) -> None:
    """Entries in key order, files by key range; Parquet keeps bounds and a Bloom filter of the keys.

    The job's commit makes the run durable; a catalogue should name it only afterwards.
    """
    ranged = entries.repartitionByRange(partitions, "key") if partitions else entries.repartitionByRange("key")
    ranged.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").mode("errorifexists").parquet(path)


def write_runs(entries: DataFrame, path: str, parts: int) -> None:
    """Entries as so many runs by key range, in folders part=0, part=1 and so on of the path; one job."""
    ranged = entries.repartitionByRange(parts, "key") if parts > 1 else entries.coalesce(1)
    cut = ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "key")
    cut.write.partitionBy("part").option("parquet.bloom.filter.enabled#key", "true").mode("errorifexists").parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name in the place that the cluster names in spark.checkpoint.dir; where all runs on one machine and it is unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='keelson-')}/{label}"


def read_runs(spark: SparkSession, paths: list[str], start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """Entries of runs; the bounds are on a stored column, so they reach the scan."""
    df = spark.read.parquet(*paths)
    if start is not None:
        df = df.where(F.col("key") >= F.lit(start))
    return df.where(F.col("key") < F.lit(end)) if end is not None else df
