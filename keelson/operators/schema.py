"""Schemas of the data model. Keys are opaque bytes in unsigned order; a null value is a tombstone, an empty one is live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 4096
PUT, DELETE = 1, 2

OPLOG = "seq bigint not null, op tinyint not null, key binary not null, value binary"
ENTRY = "key binary not null, value binary, seq bigint not null"
RUNMETA = "id bigint, level int, path string, size bigint, num_entries bigint, min_key binary, max_key binary"
_META = "id:bigint,level:int,path:string,size:bigint,num_entries:bigint,min_key:array<int>,max_key:array<int>"
MANIFEST = f"version bigint, levels array<struct<level:int,sstables:array<struct<{_META}>>>>, next_sstable_id bigint, wal_seq bigint"


def utf8(column: Column) -> Column:
    return F.encode(column, "UTF-8")


def bytes_of(numbers: Column) -> Column:
    """An array of byte values as binary."""
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def violations(ops: DataFrame) -> DataFrame:
    """Rows of an op log that break its rule: a put has a value, a delete has none, sequence numbers are positive."""
    good = (F.col("seq") > 0) & F.col("key").isNotNull() & F.col("op").isin(PUT, DELETE) & ((F.col("op") == PUT) == F.col("value").isNotNull())
    return ops.where(~F.coalesce(good, F.lit(False)))
