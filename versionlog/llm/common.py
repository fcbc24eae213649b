"""Helpers shared by the operators: tables, checkpoints, Arrow text batches, hashing."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if path is None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "versionlog-checkpoints"))
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names; other columns never clash."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their UTF-8 bytes as one array: (first, end, bytes, offsets).

    A run holds at most ``max_bytes`` unless a single text is longer. Null texts are empty.
    """
    col = batch.column(column)
    if len(col) == 0:
        return
    col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    _, off_buf, data_buf = col.buffers()
    offs = np.frombuffer(off_buf, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    first, n = 0, len(col)
    while first < n:
        end = int(np.searchsorted(offs, offs[first] + max_bytes, side="right")) - 1
        end = min(max(end, first + 1), n)
        lo, hi = int(offs[first]), int(offs[end])
        yield first, end, data[lo:hi], offs[first : end + 1] - lo
        first = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on a uint64 array."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: One fixed 64-bit value for each byte.
BYTE_CODE = mix64((np.arange(1, 257, dtype=np.uint64)) * U64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (or of the inverse of the base)."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, U64(_INVERSE if inverse else _BASE), dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 24:
            _powers[inverse] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with len+1 entries such that ``span_hash`` can hash any span of ``data``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes [start, end), the same wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), True)[start]


def batches_of(schema: pa.Schema, **columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def extended(schema: StructType, ddl: str) -> StructType:
    """A schema with more fields at its end."""
    return StructType(list(schema.fields) + StructType.fromDDL(ddl).fields)
