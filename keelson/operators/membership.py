"""Membership filters without false negatives, as relations of set bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.hashing import bit_positions, filter_size, positions

#: Bytes of a filter that is sent to all tasks.
BITMAP = 64 << 20


def build(keys: DataFrame, num_keys: int, bits_per_key: int, filter_id: int = 0) -> DataFrame:
    """(filter_id, n_bits, num_hashes, bit_pos): the set bits of a filter over `key`."""
    bits, hashes = filter_size(num_keys, bits_per_key)
    positions = keys.select(F.explode(bit_positions(F.col("key"), bits, hashes)).alias("bit_pos")).distinct()
    return positions.select(F.lit(filter_id).cast("bigint").alias("filter_id"), F.lit(bits).cast("bigint").alias("n_bits"), F.lit(hashes).alias("num_hashes"), "bit_pos")


def probe(keys: DataFrame, member: DataFrame) -> DataFrame:
    """keys with may_contain: whether all bits of `key` are set in the filter, which says itself how many bits and hashes it has.

    A null key is in no filter, and an empty filter holds nothing. A filter of up to BITMAP bytes goes to
    all tasks as a bitmap that one expression tests; a larger one is joined by bit.
    """
    about = member.select("n_bits", "num_hashes").first()
    if about is None:
        return keys.withColumn("may_contain", F.lit(False))
    bits, hashes = about
    if bits // 8 > BITMAP:
        asked = keys.select("key").where("key is not null").distinct().withColumn("bit_pos", F.explode(bit_positions(F.col("key"), bits, hashes)))
        hit = asked.join(member.select("bit_pos", F.lit(True).alias("set")), "bit_pos", "left")
        found = hit.groupBy("key").agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("__may"))
        return keys.join(found, "key", "left").select(*(keys[c] for c in keys.columns), F.coalesce("__may", F.lit(False)).alias("may_contain"))
    bitmap = keys.sparkSession.sparkContext.broadcast(to_bytes(member))

    @F.pandas_udf("boolean")
    def test(column: pd.Series) -> pd.Series:
        data = np.frombuffer(bitmap.value, np.uint8)
        known = column.notna().to_numpy()
        at = positions([bytes(k) for k in column[known]], bits, hashes)
        out = np.zeros(len(column), bool)
        out[known] = (data[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)
        return pd.Series(out)

    return keys.withColumn("may_contain", test("key"))


def to_bytes(member: DataFrame) -> bytes:
    """A filter's bits as bytes, the least bit first, as filters are stored; its size is bounded by n_bits."""
    rows = member.groupBy((F.col("bit_pos") / 8).cast("bigint").alias("byte"), "n_bits").agg(F.bit_or(F.expr("shiftleft(1, cast(bit_pos % 8 as int))")).alias("v")).collect()
    out = bytearray(rows[0]["n_bits"] // 8 if rows else 0)
    for r in rows:
        out[r["byte"]] = r["v"]
    return bytes(out)


def from_bytes(spark, data: bytes, num_hashes: int, filter_id: int = 0) -> DataFrame:
    """The relation of a stored filter; how many hashes it uses is not in its bytes."""
    if not data:
        raise ValueError("a filter has one byte at least")
    rows = [(filter_id, len(data) * 8, num_hashes, 8 * k + b) for k, x in enumerate(data) for b in range(8) if x >> b & 1]
    return spark.createDataFrame(rows, "filter_id bigint, n_bits bigint, num_hashes int, bit_pos bigint")
