"""Schema of a version log and expressions over its columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row for each version; a null value is a tombstone.
SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)

#: Bytes that a version takes besides its key and value: seq, kind and two lengths.
OVERHEAD = 17
MAX_LENGTH = (1 << 32) - 1


def encoded_size(key: Column, value: Column) -> Column:
    """Bytes of a version, as the flush threshold and the size tiers count them."""
    return F.lit(OVERHEAD) + F.length(key) + F.coalesce(F.length(value), F.lit(0))


def size_tier(size: Column) -> Column:
    """Bit width of a byte size."""
    return F.when(size == 0, F.lit(0)).otherwise(F.length(F.bin(size)))


def in_range(key: Column, start: object | None, end: object | None) -> Column | None:
    """start <= key < end; None is unbounded. None if there is no bound."""
    found = None
    if start is not None:
        found = key >= F.lit(start)
    if end is not None:
        below = key < F.lit(end)
        found = below if found is None else found & below
    return found
