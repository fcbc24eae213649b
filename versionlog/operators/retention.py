"""Which versions a merge keeps, and which run of segments to merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versionlog.functions.versions import encoded_size, size_tier


def retained(log: DataFrame, horizon: int | None = None, drop_tombstones: bool = False, *, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """Versions that readers at or above ``horizon`` may still need.

    Of each key all versions with seq >= horizon stay, and the newest one below it. Without a
    horizon (no snapshot is open) that is the newest version. If the merge includes the
    oldest data, tombstones with no kept value at or below them go too.
    """
    if horizon is None:  # one version for each key: an aggregate, with no sort of all versions
        top = log.groupBy(key).agg(F.max(F.struct(F.col(seq).alias("seq"), F.col(value).alias("value"))).alias("top"))
        kept = top.select(key, F.col("top.seq").alias(seq), F.col("top.value").alias(value))
        return kept.where(F.col(value).isNotNull()) if drop_tombstones else kept
    below = F.col(seq) < horizon
    # The part below the horizon shrinks to a row for each key before anything is sorted.
    older = log.where(below).groupBy(key).agg(F.max(F.struct(F.col(seq).alias("seq"), F.col(value).alias("value"))).alias("top"))
    older = older.select(key, F.col("top.seq").alias(seq), F.col("top.value").alias(value))
    kept = log.where(~below).select(key, seq, value).unionByName(older)
    if not drop_tombstones:
        return kept
    # An aggregate and a join, not a window: a hot key's versions are never sorted in one task.
    first = kept.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(seq).alias("__first"))
    return kept.join(first, key).where(F.col(seq) >= F.col("__first")).select(key, seq, value)


def merge_run(segments: DataFrame, threshold: int = 4, *, order: str = "seg", size: str = "bytes") -> DataFrame:
    """First maximal run of ``threshold`` or more neighbours in one size tier: (start_seg, end_seg).

    ``segments`` has a row for each segment, so one task orders them.
    """
    tiers = segments.select(F.col(order).alias("seg"), size_tier(F.col(size)).alias("tier"))
    nth = F.row_number().over(Window.partitionBy("tier").orderBy("seg"))
    runs = tiers.withColumn("island", F.col("seg") - nth).groupBy("tier", "island").agg(
        F.count(F.lit(1)).alias("n"), F.min("seg").alias("start_seg"), (F.max("seg") + 1).alias("end_seg")
    )
    return runs.where(F.col("n") >= threshold).orderBy("start_seg").limit(1).select("start_seg", "end_seg")


def pick_run(sizes: Sequence[int], threshold: int) -> tuple[int, int] | None:
    """The same on the driver, for the sizes that a manifest holds: [start, end)."""
    start = 0
    for i in range(1, len(sizes) + 1):
        if i == len(sizes) or sizes[i].bit_length() != sizes[start].bit_length():
            if i - start >= max(threshold, 2):
                return start, i
            start = i
    return None


def segment_stats(log: DataFrame, *, seg: str = "seg", key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """What a manifest holds of each segment."""
    return log.groupBy(seg).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min(key).alias("min_key"),
        F.max(key).alias("max_key"),
        F.min(seq).alias("min_seq"),
        F.max(seq).alias("max_seq"),
        F.sum(encoded_size(F.col(key), F.col(value))).cast("long").alias("bytes"),
        F.count(F.when(F.col(value).isNull(), 1)).alias("tombstones"),
    )
