"""Byte layouts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a log record beside its key and value: checksum, length, operation and two lengths.
RECORD_OVERHEAD = 17


def le32(number: Column) -> Column:
    """A number below 2^32 as four bytes, least first."""
    big = F.lpad(F.hex(number.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*(F.substring(big, k, 2) for k in (7, 5, 3, 1))))


def length(column: Column) -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0))


def record_payload(op: Column, key: Column, value: Column) -> Column:
    """What a record's checksum covers: operation, lengths, key and value."""
    return F.concat(F.unhex(F.lpad(F.hex(op.cast("bigint")), 2, "0")), le32(length(key)), le32(length(value)), key, F.coalesce(value, F.lit(b"")))


def record(op: Column, key: Column, value: Column) -> Column:
    """A framed log record: CRC-32 and length of the payload, then the payload."""
    payload = record_payload(op, key, value)
    return F.concat(le32(F.crc32(payload)), le32(F.octet_length(payload)), payload)


def record_length(key: Column, value: Column) -> Column:
    return (F.lit(RECORD_OVERHEAD) + length(key) + length(value)).cast("bigint")
