"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and timed on the second run, written to Spark's no-op sink.
"""

from __future__ import annotations

import itertools
import json
import os
import random
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


def store_figures(spark, folder: str) -> dict[str, float]:
    """Shapes of the published numbers: puts, flushed point reads, scans, a merge and a bulk commit."""
    from versionlog.plans.store import Options, Store

    found = {}

    def timed(name, call):
        start = time.perf_counter()
        call()
        found[name] = round(time.perf_counter() - start, 4)

    with Store.open(spark, f"{folder}/store", Options(sync_mode="none", flush_threshold_bytes=1 << 30)) as store:
        keys = [b"key%012d" % i for i in range(5_000)]
        timed("store_put_5k", lambda: [store.put(k, b"v" * 49) for k in keys])
        timed("store_get_buffered_5k", lambda: [store.get(k) for k in keys])
        timed("store_flush_5k", store.flush_only)
        ops = spark.range(1_000_000).selectExpr("id as op_index", "format_string('key%012d', id) as key", "repeat('v', 49) as value")
        timed("store_bulk_commit_1m", lambda: store.write_dataframe(ops))
        store.get(b"key000000000000")  # warm
        timed("store_get_flushed_1", lambda: store.get(b"key000000500000"))
        timed("store_get_absent_1", lambda: store.get(b"key000000500000x"))
        picked = random.Random(1).choices(range(1_000_000), k=20_000)
        timed("store_get_flushed_20k", lambda: [store.get(b"key%012d" % i) for i in picked])
        timed("store_get_absent_20k", lambda: [store.get(b"key%012d" % (1_000_000 + i)) for i in picked])
        wanted = spark.range(0, 1_000_000, 50).selectExpr("format_string('key%012d', id) as key").selectExpr("cast(key as binary) as key")
        timed("store_multi_get_20k", lambda: store.multi_get(wanted).write.format("noop").mode("overwrite").save())
        timed("store_scan_limit_10", lambda: store.scan(b"key000000400000", None, 10))
        timed("store_live_view_1m", lambda: store.view().write.format("noop").mode("overwrite").save())
    after_merge(spark, f"{folder}/merged", timed)
    mixes(spark, f"{folder}/mixes", timed)
    return found


def after_merge(spark, root: str, timed) -> None:
    """Point reads over what merging eight flushes of 5000 keys leaves."""
    from versionlog.plans.store import Options, Store

    with Store.open(spark, root, Options(sync_mode="none", flush_threshold_bytes=1 << 30)) as store:
        for part in range(8):
            ops = spark.range(5_000).selectExpr("id as op_index", f"format_string('key%012d', id + {part * 5_000}) as key", "repeat('v', 49) as value")
            store.write_dataframe(ops)
        timed("store_merge_8x5k", store.flush)
        timed("store_get_after_merge_413", lambda: [store.get(b"key%012d" % i) for i in range(0, 40_000, 97)])


def mixes(spark, root: str, timed) -> None:
    """YCSB A, B and C: 20000 operations on 20000 flushed keys, uniform and Zipf (s = 1)."""
    from versionlog.plans.store import Options, Store

    n, r = 20_000, random.Random(7)
    zipf = list(itertools.accumulate(1 / k for k in range(1, n + 1)))
    for name, reads in (("a", 0.5), ("b", 0.95), ("c", 1.0)):
        for kind, weights in (("uniform", None), ("zipf", zipf)):
            with Store.open(spark, f"{root}-{name}-{kind}", Options(sync_mode="none", flush_threshold_bytes=1 << 30)) as store:
                store.write_dataframe(spark.range(n).selectExpr("id as op_index", "format_string('key%012d', id) as key", "repeat('v', 49) as value"))
                steps = [(b"key%012d" % i, r.random() < reads) for i in r.choices(range(n), cum_weights=weights, k=n)]

                def run(steps=steps, store=store):
                    for key, read in steps:
                        if read:
                            store.get(key)
                        else:
                            store.put(key, b"w" * 49)

                timed(f"ycsb_{name}_{kind}_20k", run)


def main() -> None:
    from pyspark.sql import SparkSession

    from versionlog.plans import catalog

    cpus, data = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    folder = tempfile.mkdtemp(prefix="versionlog-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{folder}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    figures: dict[str, float] = {}
    try:
        for name, query in catalog.QUERIES.items():
            for _ in range(2):
                start = time.perf_counter()
                query(spark, data).write.format("noop").mode("overwrite").save()
                figures[name] = round(time.perf_counter() - start, 4)
        total = round(sum(figures.values()), 4)
        figures |= store_figures(spark, folder)
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "catalog_total", "value": total, "unit": "sec", "queries": figures, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
