"""Exact top-k inner-product search with a KD-tree for each shard.

Vectors are dealt into shards of bounded size. A shard's tree is split at the median of its
widest dimension, and each node has the tight bounding box of its vectors. A query visits
nodes best first by the largest inner product its box allows, and stops when no box left can
reach the query's k-th score. A query first searches its own shard; the k-th score found
there is propagated to the searches of all other shards, which prune with it from the start.

Queries are a stated set of rows. They are sent to the shards: a task reads a shard's vectors,
builds its tree, and streams the queries past it, so vectors are shuffled once in each of the
two passes and memory holds one shard and one batch of queries. Results are exact; ties go to
the smaller id. Vectors that are null, hold null or non-finite components, or have a null id
take no part; a query is compared with the vectors of its own length only. Rows that repeat an
id are vectors of their own. An empty table has no results; other columns are not read, whatever
their names. There are no texts here; a vector may have any length.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versionlog.llm.common import cut, pick

_FOUND = "uid long, query_id long, vec_id long, score long"


@dataclass
class Tree:
    """Nodes as arrays; a leaf has no children and the rows order[start:end]."""

    low: np.ndarray
    high: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    order: np.ndarray


def build(vectors: np.ndarray, leaf: int = 64) -> Tree:
    order = np.arange(len(vectors))
    low, high, start, end, child = [], [], [], [], []

    def add(s: int, e: int) -> int:
        part = vectors[order[s:e]]
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        start.append(s)
        end.append(e)
        child.append((-1, -1))
        return len(start) - 1

    todo = [add(0, len(vectors))] if len(vectors) else []
    while todo:
        node = todo.pop()
        s, e = start[node], end[node]
        width = high[node] - low[node]
        if e - s <= leaf or not len(width) or width.max() == 0:
            continue
        axis, mid = int(width.argmax()), (s + e) // 2
        rows = order[s:e]
        order[s:e] = rows[np.argpartition(vectors[rows, axis], mid - s)]
        child[node] = (add(s, mid), add(mid, e))
        todo += child[node]
    return Tree(np.array(low), np.array(high), np.array(start), np.array(end), np.array(child), order)


def search(
    tree: Tree, vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray, query: np.ndarray, own: int, k: int, bounds: np.ndarray, floor: float
) -> list[tuple[int, int]]:
    """The best (score, -id) of one query with at least ``floor``, unsorted, k at most."""
    best: list[tuple[int, int]] = []
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < floor:
            break
        left, right = tree.child[node]
        if left >= 0:
            heapq.heappush(heap, (-bounds[left], left))
            heapq.heappush(heap, (-bounds[right], right))
            continue
        rows = tree.order[tree.start[node] : tree.end[node]]
        score = vectors[rows] @ query
        for i in np.flatnonzero(score >= floor):
            row = rows[i]
            if uids[row] == own:
                continue
            found = (int(score[i]), -int(ids[row]))
            if len(best) < k:
                heapq.heappush(best, found)
            elif found > best[0]:
                heapq.heapreplace(best, found)
        if len(best) == k:
            floor = max(floor, best[0][0])
    return best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _searcher(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads rows sorted by (dim, shard, asked): of each shard first its vectors, then the queries sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, tree = None, [], None
        vectors = ids = uids = low = high = np.zeros(0)

        def answered(part: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple[int, int, int, int]] = []
            asked = _matrix(part.column("v"), here[0])
            floors, own, names = (part.column(c).to_pylist() for c in ("floor", "uid", "vec_id"))
            for i in range(0, len(asked), 256):
                block = asked[i : i + 256].astype(float)
                up, down = np.maximum(block, 0), np.minimum(block, 0)
                bounds = up @ high.T + down @ low.T
                bounds += 1 + (up @ np.abs(high).T - down @ np.abs(low).T) * 1e-12  # of rounding
                for j in range(len(block)):
                    q = i + j
                    floor = -math.inf if floors[q] is None else floors[q]
                    for score, minus in search(tree, vectors, ids, uids, asked[q], own[q], k, bounds[j], floor):
                        out.append((own[q], names[q], -minus, score))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "query_id", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "shard", "asked")], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if here != (now := tuple(keys[a, :2].tolist())):
                    here, held, tree = now, [], None
                part = batch.slice(a, b - a)
                if not keys[a, 2]:
                    held.append((_matrix(part.column("v"), here[0]), *(part.column(c).to_numpy(zero_copy_only=False).copy() for c in ("vec_id", "uid"))))
                    continue
                if tree is None and held:
                    vectors, ids, uids = (np.concatenate(x) for x in zip(*held, strict=True))
                    held, tree = [], build(vectors)
                    low, high = tree.low.astype(float), tree.high.astype(float)
                if tree is not None:
                    yield answered(part)

    return run


def top_k(
    embeddings: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    every: int = 100,
    scale: int = 1024,
    shard_rows: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with an id divisible by ``every``."""
    rows = pick(embeddings, vec_id=id_col, raw=vector_col)
    real = F.transform("raw", lambda x: x.cast("double"))
    finite = ~F.exists(real, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("raw").isNotNull()).where(finite)
    rows = rows.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(real, lambda x: F.floor(x * scale).cast("long")).alias("v"),
    )
    rows = cut(rows.withColumn("dim", F.size("v")))
    total = rows.count()
    shards = max(1, math.ceil(total / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    queries = dealt.where(F.col("vec_id") % every == 0)
    held = dealt.select("dim", "shard", F.lit(0).alias("asked"), "uid", "vec_id", "v", F.lit(None).cast("long").alias("floor"))

    def searched(sent: DataFrame) -> DataFrame:
        met = held.unionByName(sent.select("dim", "shard", F.lit(1).alias("asked"), "uid", "vec_id", "v", "floor"))
        return met.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asked").mapInArrow(_searcher(k), _FOUND)

    found = cut(searched(queries.withColumn("floor", F.lit(None).cast("long"))))  # in the query's own shard
    if shards > 1:
        floors = found.groupBy("uid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        away = queries.join(floors, "uid", "left").withColumn("home", F.col("shard"))
        away = away.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
        found = found.unionByName(searched(away))

    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
