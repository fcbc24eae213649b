"""Gapless numbering of the rows of a DataFrame."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_IN_PARTITION = (1 << 33) - 1


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; a folder of our own only where none is set (tests)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared if shared is not None else os.path.join(tempfile.gettempdir(), "versionlog-checkpoints"))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: str, base: int, column: str = "seq") -> tuple[DataFrame, int]:
    """``df`` with numbers base, base + 1, ... in the order of a column, and how many rows.

    One range shuffle; a count for each partition is all that reaches the driver.
    """
    held = checkpointed(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__mid", F.monotonically_increasing_id()))
    part = F.shiftright("__mid", 33)
    first, total = [], 0
    for r in held.groupBy(part.alias("p")).count().orderBy("p").collect():
        first.append((r["p"], base + total))
        total += r["count"]
    bases = df.sparkSession.createDataFrame(first or [(0, base)], "__p long, __base long")
    rows = held.join(F.broadcast(bases), part == F.col("__p"))  # a row for each partition
    rows = rows.withColumn(column, F.col("__base") + F.col("__mid").bitwiseAND(F.lit(_IN_PARTITION)))
    return rows.drop("__mid", "__p", "__base"), total
