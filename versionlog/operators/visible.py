"""Visibility: which version of each key a reader sees.

A log is any DataFrame with a key, a seq and a value column. The visible version of a key
under a bound is the one with the greatest seq below the bound; if its value is null, the
key is absent. Bounds and ranges are applied below the aggregate, so they reach the scan;
tombstones are removed above it, or deleted keys would come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versionlog.functions.versions import in_range


def latest(log: DataFrame, bound: int | None = None, *, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """Newest version of each key below ``bound``, tombstones included."""
    if bound is not None:
        log = log.where(F.col(seq) < bound)
    # Partial aggregates keep one row for each key and task, so a hot key is not a hot task.
    top = log.groupBy(key).agg(F.max(F.struct(F.col(seq).alias("seq"), F.col(value).alias("value"))).alias("top"))
    return top.select(key, F.col("top.seq").alias(seq), F.col("top.value").alias(value))


def live(log: DataFrame, bound: int | None = None, *, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """(key, value) of every key that is present under ``bound``."""
    found = latest(log, bound, key=key, seq=seq, value=value)
    return found.where(F.col(value).isNotNull()).select(key, value)


def scan(
    log: DataFrame,
    start: object | None = None,
    end: object | None = None,
    limit: int | None = None,
    bound: int | None = None,
    *,
    key: str = "key",
    seq: str = "seq",
    value: str = "value",
) -> DataFrame:
    """Present keys of [start, end) in ascending order; ``limit`` counts present keys only."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    wanted = in_range(F.col(key), start, end)
    found = live(log if wanted is None else log.where(wanted), bound, key=key, seq=seq, value=value)
    found = found.orderBy(key)
    return found if limit is None else found.limit(limit)


def get(log: DataFrame, wanted: object, bound: int | None = None, *, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """(key, value) of one key: no row if it is absent."""
    return live(log.where(F.col(key) == F.lit(wanted)), bound, key=key, seq=seq, value=value)


def multi_get(log: DataFrame, wanted: DataFrame, bound: int | None = None, *, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """(key, value) of the keys in ``wanted`` that are present."""
    keys = wanted.select(F.col(wanted.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    return live(log.join(keys, key, "left_semi"), bound, key=key, seq=seq, value=value)


def as_of(
    log: DataFrame, probes: DataFrame, *, key: str = "key", seq: str = "seq", value: str = "value", bound: str = "bound", block: int = 1 << 16
) -> DataFrame:
    """Each distinct (key, bound) of ``probes`` with the value visible to it, or null.

    Probes and versions are sorted together, and a probe takes the last version before it. The
    seqs are dealt into blocks of ``block``, so a hot key is sorted in many tasks; a probe with
    nothing before it in its block takes the newest version of the blocks before, of which a
    key has one row for each block.
    """
    asked = probes.select(F.col(key).alias("__k"), F.col(bound).alias("__at")).distinct()
    versions = log.select(F.col(key).alias("__k"), F.col(seq).alias("__at"), F.struct(F.col(seq).alias("s"), F.col(value).alias("v")).alias("__of"))
    met = asked.select("__k", "__at", F.lit(None).cast(versions.schema["__of"].dataType).alias("__of"), F.lit(0).alias("__is"))
    met = met.unionByName(versions.withColumn("__is", F.lit(1))).withColumn("__block", F.floor(F.col("__at") / block))  # a version at the bound comes after it
    here = Window.partitionBy("__k", "__block").orderBy("__at", "__is").rowsBetween(Window.unboundedPreceding, 0)
    near = met.withColumn("__near", F.last("__of", ignorenulls=True).over(here)).where("__is = 0").select("__k", "__at", "__block", "__near")
    # of each key one row for a block that holds versions or probes of it
    tops = met.groupBy("__k", "__block").agg(F.max("__of").alias("__top"))
    before = Window.partitionBy("__k").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__k", "__block", F.last("__top", ignorenulls=True).over(before).alias("__far"))
    same = near["__k"].eqNullSafe(tops["__k"]) & near["__block"].eqNullSafe(tops["__block"])
    found = near.join(tops, same).select(near["__k"].alias(key), near["__at"].alias(bound), F.coalesce("__near", "__far").alias("__of"))
    return found.select(key, bound, F.when(F.col(key).isNotNull(), F.col("__of.v")).alias(value))


def versions_of(log: DataFrame, wanted: object, *, key: str = "key", seq: str = "seq") -> DataFrame:
    """All versions of one key, newest first."""
    return log.where(F.col(key) == F.lit(wanted)).orderBy(F.desc(seq))


def every_version(log: DataFrame, *, key: str = "key", seq: str = "seq") -> DataFrame:
    """All versions by key, newest first within a key."""
    return log.orderBy(key, F.desc(seq))


def changes(log: DataFrame, older: int | None, newer: int | None = None, *, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """Keys whose visible value differs between two bounds: (key, before, after)."""
    a = live(log, older, key=key, seq=seq, value=value).select(F.col(key), F.col(value).alias("before"))
    b = live(log, newer, key=key, seq=seq, value=value).select(F.col(key), F.col(value).alias("after"))
    return a.join(b, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select(key, "before", "after")
