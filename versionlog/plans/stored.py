"""Catalog queries that go through a real store: puts, commits, merges, snapshots, checkpoints, streams.

Each query builds a store from the whole version log of ``events`` in the shared folder, and
removes it when the result is written. The log's seqs are the event ids, which start at 0
without gaps, so the store gives every version the same seq and the SQL of the plain queries
holds. Operations that are single by nature (put, delete, a batch built by hand) are given the
last events of the log; the others reach the store as bulk commits.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.errors import StoreError
from versionlog.operators.numbering import checkpointed
from versionlog.operators.retention import retained
from versionlog.plans import catalog
from versionlog.plans.store import Options, Store, WriteBatch
from versionlog.sources import manifest

#: The bound of the snapshot queries, and how many events are written one by one.
HALF, TAIL = 5000, 200


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a store needs a mounted one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:  # tests
        shared = os.path.join(tempfile.gettempdir(), "versionlog-stores")
    found = urlparse(shared)
    if found.scheme not in ("", "file"):
        raise StoreError(f"{shared} is not a mounted folder")
    return os.path.join(found.path, f"store-{uuid.uuid4().hex}")


def _kept(result: DataFrame, *roots: str) -> DataFrame:
    """The result, written, without the stores it was read from."""
    out = checkpointed(result)
    for root in roots:
        shutil.rmtree(root, ignore_errors=True)
    return out


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.event_log(spark, sf_dir).select(F.col("seq").alias("op_index"), F.col("k").alias("key"), F.col("v").alias("value"))


def _filled(spark: SparkSession, sf_dir: str, **options: object) -> Store:
    store = Store.open(spark, folder(spark), Options(**options))  # type: ignore[arg-type]
    ops = _ops(spark, sf_dir)
    for low in range(0, HALF, HALF // 4):
        store.write_dataframe(ops.where((F.col("op_index") >= low) & (F.col("op_index") < low + HALF // 4)))
    return store


def _finish(store: Store, spark: SparkSession, sf_dir: str) -> Store:
    store.write_dataframe(_ops(spark, sf_dir).where(F.col("op_index") >= HALF))
    return store


def _text(view: DataFrame) -> DataFrame:
    return view.select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


def _but_the_tail(spark: SparkSession, sf_dir: str, **options: object) -> tuple[Store, list]:
    """A store with all events but the last in one commit, and those."""
    ops = _ops(spark, sf_dir)
    first = max(0, ops.agg(F.count(F.lit(1)).alias("n")).first()["n"] - TAIL)
    store = Store.open(spark, folder(spark), Options(**options))  # type: ignore[arg-type]
    store.write_dataframe(ops.where(F.col("op_index") < first))
    return store, ops.where(F.col("op_index") >= first).orderBy("op_index").collect()  # TAIL rows


def live_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _finish(_filled(spark, sf_dir), spark, sf_dir) as store:
        store.flush()
        return _kept(_text(store.view()), store.root)


def scan_at_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _filled(spark, sf_dir) as store:
        snap = store.snapshot()
        _finish(store, spark, sf_dir).flush()
        return _kept(_text(store.scan_frame(b"u00010", b"u00050", 25, snap)), store.root)


def checkpoint_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = folder(spark)
    with _finish(_filled(spark, sf_dir), spark, sf_dir) as store:
        store.checkpoint(target)
        store.put(b"u00001", b"later")
    with Store.open(spark, target) as copy:
        return _kept(_text(copy.view()), target, store.root)


def reopened_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _finish(_filled(spark, sf_dir), spark, sf_dir) as store:
        root = store.root
    wanted = spark.createDataFrame([(k.encode(),) for k in catalog.KEYS], "key binary")
    with Store.open(spark, root) as again:
        return _kept(_text(again.multi_get(wanted)), root)


def batch_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last events as one batch of single operations."""
    store, tail = _but_the_tail(spark, sf_dir)
    with store:
        batch = WriteBatch()
        for r in tail:
            if r["value"] is None:
                batch.delete(r["key"].encode())
            else:
                batch.put(r["key"].encode(), r["value"].encode())
        store.write_batch(batch)
        return _kept(_text(store.view()), store.root)


def _written_singly(store: Store, tail: list) -> Store:
    for r in tail:
        if r["value"] is None:
            store.delete(r["key"].encode())
        else:
            store.put(r["key"].encode(), r["value"].encode())
    return store


def replayed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last events put and deleted one by one, and read from the log of commits after a reopen."""
    with _written_singly(*_but_the_tail(spark, sf_dir)) as store:
        root = store.root
    with Store.open(spark, root) as again:
        return _kept(_text(again.view()), root)


def maintained_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a small buffer and maintenance after each write."""
    store, tail = _but_the_tail(spark, sf_dir, flush_threshold_bytes=2048, compaction_threshold=3)
    with store:
        for r in tail:
            _written_singly(store, [r])
            while store.pending_work():
                store.maintain()
        return _kept(_text(store.view()), store.root)


def adopted_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory whose manifests are gone: its segments are taken in."""
    with _written_singly(*_but_the_tail(spark, sf_dir)) as store:
        store.flush_only()
        root = store.root
    shutil.rmtree(f"{root}/{manifest.FOLDER}")
    os.remove(f"{root}/{manifest.POINTER}")
    with Store.open(spark, root) as again:
        return _kept(_text(again.view()), root)


def snapshot_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many versions a merge of everything leaves of each key once no snapshot is open, and the lowest horizon before."""
    with _filled(spark, sf_dir) as store:
        snap = store.snapshot()
        store.snapshot().close()
        horizon = store.min_horizon()
        _finish(store, spark, sf_dir)
        snap.close()
        kept = retained(store.log(), store.min_horizon(), drop_tombstones=True)
        counts = kept.groupBy(F.col("key").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"))
        return _kept(counts.withColumn("horizon", F.lit(horizon).cast("long")), store.root)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _finish(_filled(spark, sf_dir), spark, sf_dir) as store:
        found = store.versions_of(b"u00042").select(F.col("key").cast("string").alias("k"), "seq", F.col("value").cast("string").alias("v"))
        return _kept(found, store.root)


def stream_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table read as a stream."""
    from versionlog.streaming import ingest

    root = folder(spark)
    source = f"{root}-input"
    _ops(spark, sf_dir).coalesce(1).sortWithinPartitions("op_index").write.parquet(source)
    stream = spark.readStream.schema("op_index long, key string, value string").parquet(source)
    with Store.open(spark, root) as store:
        ingest(stream, store, "events", f"{root}-progress").awaitTermination()
        return _kept(_text(store.view()), root, source, f"{root}-progress")


_WANTED = catalog._live_sql(None, f"k IN {catalog.KEYS}")
_ALL = {
    "store_live_after_merge": (live_after_merge, catalog._live_sql()),
    "store_scan_at_snapshot": (scan_at_snapshot, catalog._live_sql(HALF, "k >= 'u00010' AND k < 'u00050'") + " ORDER BY k LIMIT 25"),
    "store_checkpoint_view": (checkpoint_view, catalog._live_sql()),
    "store_reopened_multi_get": (reopened_multi_get, _WANTED),
    "store_batch_view": (batch_view, catalog._live_sql()),
    "store_replayed_view": (replayed_view, catalog._live_sql()),
    "store_maintained_view": (maintained_view, catalog._live_sql()),
    "store_adopted_view": (adopted_view, catalog._live_sql()),
    "store_snapshot_released": (
        snapshot_released,
        f"""SELECT k, CAST(1 AS BIGINT) AS n, seq, CAST(least({HALF}, (SELECT count(*) FROM log)) AS BIGINT) AS horizon FROM (
            SELECT k, seq, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) t WHERE rn = 1 AND v IS NOT NULL""",
    ),
    "store_version_history": (history, "SELECT k, seq, v FROM log WHERE k = 'u00042'"),
    "store_stream_view": (stream_view, catalog._live_sql()),
}
QUERIES: dict[str, catalog.Query] = {name: query for name, (query, _) in _ALL.items()}
ORACLES: dict[str, str] = {name: f"WITH {catalog._LOG} {sql}" for name, (_, sql) in _ALL.items()}
