"""Runs over time: replay, flush, merged reads, leveled compaction and reads by filter. These are extensions of our own design."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.hashing import bit_positions, filter_size
from keelson.operators.config import EngineConfig
from keelson.operators.manifest import Manifest, RunMeta, overlaps, zone_map
from keelson.operators.schema import ENTRY
from keelson.operators.state import latest, resolved
from keelson.sources import tables


def replay(records: DataFrame) -> DataFrame:
    """The op log of decoded records (pos, op, key, value, status): a record's sequence number is its place."""
    return records.where("status = 'ok'").select((F.col("pos") + 1).alias("seq"), "op", "key", "value")


def merge_read(runs: list[DataFrame]) -> DataFrame:
    """(key, value, seq): the newest entry of each key over runs of entries."""
    every = runs[0].select("key", "value", "seq")
    for r in runs[1:]:
        every = every.unionByName(r.select("key", "value", "seq"))
    return latest(every)


def flush(ops: DataFrame, manifest: Manifest, path: str, config: EngineConfig = EngineConfig()) -> RunMeta | None:
    """Write an op log's newest entries as a run of level 0 with its filter, then add it to the catalogue; none for an empty log."""
    found = write(latest(ops), manifest, path, 0, 1, config)
    for meta in found:
        manifest.add(0, meta)
    return found[0] if found else None


def write(entries: DataFrame, manifest: Manifest, path: str, level: int, parts: int, config: EngineConfig) -> list[RunMeta]:
    """Entries as runs by key range, each with the filter of its keys beside it. The catalogue isn't changed."""
    spark, first = entries.sparkSession, manifest.take_id()
    where = f"{path}/run-{first}"
    tables.write_runs(entries, where, parts)
    zones = zone_map(spark.read.parquet(where), "part").orderBy("min_key").collect()
    out = []
    for k, z in enumerate(zones):
        number = first if k == 0 else manifest.take_id()
        out.append(RunMeta(number, level, f"{where}/part={z['part']}", z["size"], z["num_entries"], bytes(z["min_key"]), bytes(z["max_key"])))
    if out:
        sized = [(z["part"], meta.id, *filter_size(meta.num_entries, config.bloom_bits_per_key)) for z, meta in zip(zones, out, strict=True)]
        about = spark.createDataFrame(sized, "part int, run bigint, n_bits bigint, num_hashes int")
        # One row for each run.
        keys = spark.read.parquet(where).select("key", "part").join(F.broadcast(about), "part")
        bits = keys.select("run", "n_bits", "num_hashes", F.explode(bit_positions(F.col("key"), F.col("n_bits"), sized[0][3])).alias("bit_pos")).distinct()
        bits.withColumn("id", F.col("run")).write.partitionBy("id").parquet(f"{where}-filter")
    return out


def filter_path(meta: RunMeta) -> str:
    return f"{meta.path.rpartition('/')[0]}-filter/id={meta.id}"


def pick(manifest: Manifest, config: EngineConfig) -> int | None:
    """The level that most exceeds its bound: the first by number of runs, others by size; none if none does."""
    score = {k: (len(runs) / config.l0_compaction_trigger if k == 0 else sum(r.size for r in runs) / config.max_level_size(k)) for k, runs in enumerate(manifest.levels[:-1])}
    best = max(score, key=lambda k: (score[k], -k), default=None)
    return best if best is not None and score[best] >= 1 else None


def compact(spark: SparkSession, manifest: Manifest, config: EngineConfig, path: str, level: int | None = None) -> list[RunMeta]:
    """Merge runs of a level with the next level's overlapping ones into runs of about the target size there.

    Of level 0, whose runs overlap, all go; of a deeper level the one that was there longest. The last
    level can't be merged further: ValueError. Tombstones go only if no deeper level may hold their
    key. The new runs are whole before the catalogue changes, which it does once.
    """
    level = pick(manifest, config) if level is None else level
    if level is None or not manifest.level(level):
        return []
    if level + 1 >= len(manifest.levels):
        raise ValueError(f"level {level} is the last")
    upper = manifest.level(level) if level == 0 else manifest.level(level)[:1]
    low, high = min(r.min_key for r in upper), max(r.max_key for r in upper)
    inputs = upper + manifest.overlapping(level + 1, low, high)
    merged = merge_read([spark.read.parquet(r.path) for r in inputs])
    low, high = min(r.min_key for r in inputs), max(r.max_key for r in inputs)
    if not any(manifest.overlapping(k, low, high) for k in range(level + 2, len(manifest.levels))):
        merged = merged.where("value is not null")
    parts = -(-sum(r.size for r in inputs) // config.target_file_size)
    out = write(merged, manifest, path, level + 1, max(1, parts), config)
    manifest.swap(inputs, out)
    return out


def read(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """(key, value, seq): the newest entry of each key over all runs of a catalogue."""
    paths = [r.path for runs in manifest.levels for r in runs]
    return latest(spark.read.parquet(*paths).select("key", "value", "seq")) if paths else spark.createDataFrame([], ENTRY)


def candidates(spark: SparkSession, manifest: Manifest, probes: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(key, run): the runs that may hold a probed key, by their key bounds and then by their stored filters."""
    runs = [r for rows in manifest.levels for r in rows]
    if not runs:
        return probes.select("key").where("false").withColumn("run", F.lit(0).cast("bigint"))
    sized = [(r.id, *filter_size(r.num_entries, config.bloom_bits_per_key), r.min_key, r.max_key) for r in runs]
    hashes = sized[0][2]
    about = spark.createDataFrame(sized, "run bigint, n_bits bigint, num_hashes int, min_key binary, max_key binary")
    asked = probes.select("key").where("key is not null").distinct().select("key", F.col("key").alias("lo"), F.col("key").alias("hi"))
    near = overlaps(about, asked).select("key", "run", "n_bits")
    bits = near.select("key", "run", F.explode(bit_positions(F.col("key"), F.col("n_bits"), hashes)).alias("bit_pos"))
    # A key's hashes may meet in one bit.
    bits = bits.groupBy("key", "run", "bit_pos").agg(F.count("*").alias("n"))
    filters = spark.read.parquet(*(filter_path(r) for r in runs)).select("run", "bit_pos")
    return bits.join(filters, ["run", "bit_pos"]).groupBy("key", "run").agg(F.sum("n").alias("n")).where(F.col("n") == hashes).select("key", "run")


def point_read(spark: SparkSession, manifest: Manifest, probes: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(key, state, value, seq) for each row of probes (key), from just the runs whose bounds and filter may hold it."""
    wanted = candidates(spark, manifest, probes, config).persist()
    # Run numbers only: as many as the catalogue has runs.
    numbers = {r["run"] for r in wanted.select("run").distinct().collect()}
    paths = [r.path for rows in manifest.levels for r in rows if r.id in numbers]
    entries = spark.read.parquet(*paths).select("key", "value", "seq") if paths else spark.createDataFrame([], ENTRY)
    return resolved(latest(entries.join(wanted.select("key").distinct(), "key", "left_semi")), probes)
