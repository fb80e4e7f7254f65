"""Hashes and sizes of membership filters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a's start and prime, the second hash's start, and the hashes' share of bits for each key.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SECOND_START = 0x9E3779B97F4A7C15
HASHES_PER_BIT = 0.69


def key_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit hashes of keys, byte by byte over all keys at once."""
    size = np.array([len(k) for k in keys], np.int64)
    width = int(size.max()) if len(size) else 0
    grid = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), np.uint8).reshape(len(keys), width).astype(np.uint64)
    one, two = np.full(len(keys), FNV_START, np.uint64), np.full(len(keys), SECOND_START, np.uint64)
    for j in range(width):
        inside, byte = j < size, grid[:, j]
        one = np.where(inside, (one ^ byte) * np.uint64(FNV_PRIME), one)
        two = np.where(inside, ((two << np.uint64(5)) | (two >> np.uint64(59))) + byte, two)
    return one, np.where(two == 0, np.uint64(1), two)


def positions(keys: list[bytes], n_bits: int | np.ndarray, num_hashes: int) -> np.ndarray:
    """The bits that keys set, by double hashing; n_bits may differ by key."""
    one, two = key_hashes(keys)
    steps = np.arange(num_hashes, dtype=np.uint64)
    bits = np.asarray(n_bits, np.uint64)
    return ((one[:, None] + steps * two[:, None]) % (bits[:, None] if bits.ndim else bits)).astype(np.int64)


def bit_positions(key: Column, n_bits: int | Column, num_hashes: int) -> Column:
    """positions() of a column; n_bits may be a column, for keys that are looked for in several filters."""

    @F.pandas_udf("array<bigint>")
    def of(keys: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series(list(positions([bytes(k) for k in keys], bits.to_numpy(), num_hashes)))

    return of(key, n_bits if isinstance(n_bits, Column) else F.lit(n_bits))


def filter_size(num_keys: int, bits_per_key: int) -> tuple[int, int]:
    """(bits, hashes) of a filter: at least 64 bits, in whole bytes; from 1 to 30 hashes."""
    bits = max(num_keys * bits_per_key, 64)
    return -(-bits // 8) * 8, min(max(math.ceil(bits_per_key * HASHES_PER_BIT), 1), 30)


def bits_per_key(fp_rate: Column) -> Column:
    """Bits for each key that give a rate of false positives."""
    return F.ceil(-F.ln(fp_rate) / F.pow(F.ln(F.lit(2.0)), F.lit(2.0))).cast("bigint")


def bits_per_key_for(fp_rate: float) -> int:
    return math.ceil(-math.log(fp_rate) / math.log(2) ** 2)
