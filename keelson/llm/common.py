"""What the operators share: remainders that hold rows out, and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: list[str] = []
_scopes: list[list[Tables]] = []


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def held_out(id_col: str, modulus: int) -> Column:
    """True where that remainder is 2. A null id has no remainder: false, and it is never learned from."""
    return F.coalesce(remainder(id_col, modulus) == 2, F.lit(False))


def learned_from(id_col: str, modulus: int) -> Column:
    return F.coalesce(remainder(id_col, modulus) != 2, F.lit(False))


def text_bytes(text_col: str) -> Column:
    """The text's UTF-8 bytes; null: none."""
    return F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="keelson-"))
    return f"file://{_own[0]}"


class Tables:
    """Intermediate Parquet tables in the shared folder; they survive lost executors and cut lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        if _scopes:
            _scopes[-1].append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that are begun within go at its end: what depends on them must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for tables in _scopes.pop():
            tables.drop()


def digests(text_col: str) -> list[Column]:
    """Two 64-bit hashes of a text, which together stand for it beside its row's id; a null text is as an empty one."""
    text = text_bytes(text_col)
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def own_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns named by their place, so that no name clashes with one that an operator uses; and the new names by the old."""
    new = [f"__own{k}" for k in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new, strict=True))


def atomic(df: DataFrame, names: list[str]) -> list[str]:
    """Those of the columns that can be hashed whatever they hold."""
    hashed = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DatetimeType)
    return [n for n in names if isinstance(df.schema[n].dataType, hashed)]


def extended(schema: T.StructType, **columns: str) -> T.StructType:
    """A schema with more columns, their types as DDL."""
    return T.StructType([*schema.fields, *(T.StructField(k, T.DataType.fromDDL(v)) for k, v in columns.items())])
