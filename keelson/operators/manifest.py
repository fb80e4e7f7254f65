"""The catalogue of sorted runs: a small versioned document on the driver, and its runs as a DataFrame."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.errors import CatalogueError
from keelson.operators.config import EngineConfig
from keelson.operators.schema import RUNMETA


@dataclass(frozen=True)
class RunMeta:
    id: int
    level: int
    path: str
    size: int
    num_entries: int
    min_key: bytes
    max_key: bytes


@dataclass
class Manifest:
    """Levels of runs. `version` counts changes; ids and log numbers are given out once each."""

    max_levels: int = 5
    version: int = 1
    next_id: int = 1
    wal_seq: int = 1
    levels: list[list[RunMeta]] = field(default_factory=list)

    def __post_init__(self):
        self.levels = self.levels or [[] for _ in range(self.max_levels)]

    @classmethod
    def of(cls, config: EngineConfig) -> Manifest:
        return cls(config.max_levels)

    def add(self, level: int, run: RunMeta) -> None:
        """Append a run to a level. A level that isn't there: nothing changes."""
        if not 0 <= level < len(self.levels):
            return
        if run.level != level:
            raise ValueError(f"run {run.id} says level {run.level}, not {level}")
        self.levels[level].append(run)
        self.version += 1

    def remove(self, runs: list[RunMeta]) -> None:
        """Drop runs by level and id; one change, whether or not any is there."""
        gone = {(r.level, r.id) for r in runs}
        self.levels = [[r for r in rows if (k, r.id) not in gone] for k, rows in enumerate(self.levels)]
        self.version += 1

    def swap(self, removed: list[RunMeta], added: list[RunMeta]) -> None:
        """Put runs in the place of others, in one change. Nothing changes if one of them can't be added."""
        for run in added:
            if not 0 <= run.level < len(self.levels):
                raise ValueError(f"run {run.id} says level {run.level}, of {len(self.levels)}")
        gone = {(r.level, r.id) for r in removed}
        self.levels = [[r for r in rows if (k, r.id) not in gone] + [r for r in added if r.level == k] for k, rows in enumerate(self.levels)]
        self.version += 1

    def level(self, level: int) -> list[RunMeta]:
        return list(self.levels[level]) if 0 <= level < len(self.levels) else []

    def overlapping(self, level: int, low: bytes, high: bytes) -> list[RunMeta]:
        """Runs of a level whose closed key interval meets [low, high], in the order they were added."""
        return [r for r in self.level(level) if r.max_key >= low and r.min_key <= high]

    def take_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def take_wal_seq(self) -> int:
        self.wal_seq += 1
        return self.wal_seq - 1

    def to_json(self) -> str:
        rows = [{"level": k, "sstables": [asdict(r) | {"min_key": list(r.min_key), "max_key": list(r.max_key)} for r in runs]} for k, runs in enumerate(self.levels)]
        return json.dumps({"version": self.version, "levels": rows, "next_sstable_id": self.next_id, "wal_seq": self.wal_seq}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        try:
            d = json.loads(text)
            levels = [[RunMeta(**{**{k: s[k] for k in RunMeta.__dataclass_fields__}, "min_key": bytes(s["min_key"]), "max_key": bytes(s["max_key"])}) for s in x["sstables"]] for x in d["levels"]]
            out = cls(len(levels), int(d["version"]), int(d["next_sstable_id"]), int(d["wal_seq"]), levels)
        except (KeyError, TypeError, ValueError) as fault:
            raise CatalogueError("serialization", str(fault)) from fault
        if not levels:
            raise CatalogueError("corrupted", "no levels")
        return out

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """Write beside the place, sync, and rename, so a reader sees the old document or the new one.

        With a session the path may be on any file system that Spark knows; without, it is a local one.
        """
        if spark is not None:
            return self._save_shared(path, spark)
        path = os.path.abspath(path)
        beside = os.path.splitext(path)[0] + ".tmp"
        with open(beside, "w") as f:
            f.write(self.to_json())
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
        folder = os.open(os.path.dirname(path), os.O_RDONLY)
        try:
            os.fsync(folder)
        finally:
            os.close(folder)

    def _save_shared(self, path: str, spark: SparkSession) -> None:
        fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        place, beside = fs.Path(path), fs.Path(path + ".tmp")
        out = place.getFileSystem(conf).create(beside, True)
        try:
            out.write(bytearray(self.to_json().encode()))
            out.hsync()
        finally:
            out.close()
        rename = getattr(fs, "Options$Rename")
        over = spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        fs.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf).rename(beside, place, over)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Manifest:
        """A saved catalogue; with a session from any file system that Spark knows."""
        try:
            if spark is not None:
                return cls.from_json(spark.read.text(path, wholetext=True).first()[0])
            with open(path) as f:
                return cls.from_json(f.read())
        except (OSError, AnalysisException) as fault:
            raise CatalogueError("io", str(fault)) from fault

    def runs(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(asdict(replace(r)).values()) for runs in self.levels for r in runs]
        return spark.createDataFrame(rows, RUNMETA)


def zone_map(entries: DataFrame, run: str) -> DataFrame:
    """(run, num_entries, size, min_key, max_key) of runs of (key, value)."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return entries.groupBy(run).agg(F.count("*").alias("num_entries"), F.sum(size).cast("bigint").alias("size"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


#: Bins of an interval join over keys.
BINS = 256


def overlaps(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """Runs that meet probes (lo, hi) of closed intervals, as an interval join.

    Keys are binned between evenly spaced least keys of the runs; each side goes to all bins that it
    touches, and a pair counts in the first bin that both touch. An interval whose end precedes its start meets nothing.
    """
    ranked = runs.select("min_key", F.ntile(BINS).over(Window.orderBy("min_key")).alias("t"))
    # At most BINS keys.
    edges = [bytes(r["k"]) for r in ranked.groupBy("t").agg(F.min("min_key").alias("k")).where("k is not null").orderBy("k").collect()]

    def place(key: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= key)) if edges else F.lit(0)

    def binned(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
        first = place(F.col(low))
        return df.where(F.col(low) <= F.col(high)).withColumn(name, first).withColumn("__bin", F.explode(F.sequence(F.col(name), place(F.col(high)))))

    pairs = binned(runs, "min_key", "max_key", "__a").join(binned(probes, "lo", "hi", "__b"), "__bin")
    meet = (F.col("max_key") >= F.col("lo")) & (F.col("min_key") <= F.col("hi")) & (F.col("__bin") == F.greatest("__a", "__b"))
    return pairs.where(meet).drop("__bin", "__a", "__b")


def without(runs: DataFrame, removed: DataFrame) -> DataFrame:
    return runs.join(removed.select("level", "id"), ["level", "id"], "left_anti")
