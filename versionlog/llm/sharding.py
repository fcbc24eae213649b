"""Sharding by a Feistel permutation of global row numbers (law ``rows``).

Rows are numbered 0..N-1 in the order of (id, text checksum, size), nulls first. A keyed
Feistel network permutes [0, 4**h), the smallest such domain that holds N, and walks cycles
until it is back inside [0, N). With p the permuted number, the shard is p modulo the number
of shards and the slot is p divided by it, so shard and slot of any row number can be
computed without the data, slots are gapless and shard sizes differ by one at most.

The result depends only on the set of rows, the seed and the number of shards. Null texts
count as empty; rows that are equal in id, size and checksum are interchangeable, and each
gets its own place. Null ids come first. An empty table gives an empty result. Of a text, however
long, only size and checksum are shuffled; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import U64, cut, extended, mix64

ROUNDS = 6
_IN_PARTITION = (1 << 33) - 1


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Images of row numbers under the keyed permutation of [0, n)."""
    half = max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)
    mask, shift = U64((1 << half) - 1), U64(half)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed & (1 << 64) - 1))

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for key in keys:
            left, right = right, left ^ (mix64(right + key) & mask)
        return (left << shift) | right

    out = network(x.astype(np.uint64))
    outside = np.flatnonzero(out >= U64(n))
    while len(outside):
        out[outside] = network(out[outside])
        outside = outside[out[outside] >= U64(n)]
    return out.astype(np.int64)


def place(row: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers."""
    p = permute(row, n, seed)
    return p % shards, p // shards


def number_rows(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``df`` with a gapless global number ``row`` in the given order, and the row count.

    One range shuffle; only one count for each partition reaches the driver.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(sorted_.withColumn("__mid", F.monotonically_increasing_id()))
    part = F.shiftright("__mid", 33)
    counts = held.groupBy(part.alias("p")).count().orderBy("p").collect()
    base, total = {}, 0
    for r in counts:
        base[r["p"]] = total
        total += r["count"]
    spark = df.sparkSession
    bases = spark.createDataFrame(list(base.items()) or [(0, 0)], "__p long, __base long")
    # as many rows as partitions
    rows = held.join(F.broadcast(bases), part == F.col("__p")).withColumn(
        "row", F.col("__base") + F.col("__mid").bitwiseAND(F.lit(_IN_PARTITION))
    )
    return rows.drop("__p", "__base", "__mid"), total


def assign_shards(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 20240229
) -> DataFrame:
    """id, size, text_crc32, row, shard and slot of every row."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("__id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows, n = number_rows(narrow, "__id", "text_crc32", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, slot = place(batch.column("row").to_numpy(zero_copy_only=False), n, shards, seed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard, pa.int32()), pa.array(slot)], names=[*batch.schema.names, "shard", "slot"]
            )

    return rows.mapInArrow(run, extended(rows.schema, "shard int, slot long")).withColumnRenamed("__id", id_col)


def digest(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the registered query."""
    return placed.select(
        F.col(f"`{id_col}`"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
