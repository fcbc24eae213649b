import math
import random

import duckdb
import numpy as np
import pytest

from versionlog.llm import registry, topk


def brute(rows, k=10, every=100):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for p, (q, a) in enumerate(good):
        if q % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for r, (c, b) in enumerate(good) if r != p and len(a) == len(b))
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40}])
def test_embeddings(spark, options):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    got = topk.top_k(spark.read.parquet(path), **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.sql(registry.ORACLES["op6_topk"]).fetchall())


@pytest.mark.parametrize("options", [{}, {"shard_rows": 7}])
def test_odd_vectors_ties_and_repeats(spark, options):
    r = random.Random(4)
    rows = [(i, [r.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(4)]) for i in range(60)]
    rows += [(0, [1.0, 1.0, 1.0, 1.0]), (100, [0.5, 0.5, 0.5, 0.5]), (100, [0.5, 0.5, 0.5, 0.5]), (200, [1.0, 2.0]), (201, [3.0, 4.0])]
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0]), (302, [math.nan] * 4), (303, [math.inf, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (400, []), (401, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as uid", "2 as shard", "3 as floor")
    assert sorted(tuple(x) for x in topk.top_k(df, **options).collect()) == brute(rows)


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_tree_boxes_are_tight_and_prune():
    g = np.random.default_rng(1)
    centres = g.integers(-4000, 4000, (20, 8))
    vectors = (centres[g.integers(0, 20, 4000)] + g.integers(-20, 20, (4000, 8))).astype(np.int64)
    tree = topk.build(vectors)
    for n in range(len(tree.start)):
        part = vectors[tree.order[tree.start[n] : tree.end[n]]]
        assert (part.min(axis=0) == tree.low[n]).all() and (part.max(axis=0) == tree.high[n]).all()
    assert sorted(tree.order.tolist()) == list(range(4000))


def test_each_shard_builds_its_tree_once_for_all_batches(monkeypatch):
    import pyarrow as pa

    g = np.random.default_rng(3)
    built, build = [], topk.build
    monkeypatch.setattr(topk, "build", lambda v: built.append(len(v)) or build(v))
    rows = [(2, s, asked, 100 * s + i, 100 * s + i, g.integers(-9, 9, 2).tolist(), None) for s in (0, 1) for asked, n in ((0, 30), (1, 20)) for i in range(n)]
    names = ["dim", "shard", "asked", "uid", "vec_id", "v", "floor"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    one = pa.Table.from_batches(topk._searcher(10)([whole])).to_pylist()
    few = pa.Table.from_batches(topk._searcher(10)(iter([whole.slice(i, 7) for i in range(0, whole.num_rows, 7)]))).to_pylist()
    assert built == [30, 30, 30, 30]
    assert sorted(map(str, one)) == sorted(map(str, few)) and len(one) == 40 * 10
