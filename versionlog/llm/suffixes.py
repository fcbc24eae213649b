"""Removal of long repeated byte strings by bucket-pointer refinement.

A window is a string of ``length`` bytes (400). Bytes covered by a window that also starts
anywhere else, in the same text or another, are removed; windows never cross texts and are
judged on the input. The work is split so that no bucket has to hold the corpus:

1. *Buckets.* A window's bucket is the smallest hash of its q-grams, which depends on the
   window's bytes alone, so equal windows share a bucket wherever they stand. Consecutive
   windows of one bucket are a run; a text has one run for every 180 bytes or so, and only
   runs are shuffled. Buckets with one run that cannot repeat itself are dropped.
2. *Equal runs.* Runs with equal bytes are counted by a cryptographic digest of their bytes
   (BLAKE2b, 128 bits, beside the bucket and the size; partial sums first, so a group of copies
   is no hot key). All windows of a run that occurs twice are repeated.
3. *Refinement.* In the buckets that also have runs of their own, one run of each kind is
   taken with its bytes. Suffixes start in buckets of 8-grams. A step sorts the suffixes of the
   buckets that still hold more than one by the bucket identifiers at a later offset, which
   splits these buckets in place; suffixes alone in a bucket are settled and leave, and the next
   step works recursively on the rest with the updated identifiers, which name twice the
   bytes. It ends at ``length``. Identifiers stand for exact bytes, so no hash decides here.
4. *Large buckets.* A bucket whose runs hold over ``bucket_bytes`` is not refined in one
   task: its windows are counted by the same digest, with partial sums, over all tasks.

Null texts are empty; texts shorter than ``length`` lose nothing, since no window fits in them.
Rows that repeat are texts of their own, so both lose what they share. Null ids are allowed. An
empty table gives an empty result. Very long texts are read in segments, whole. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versionlog.llm.common import cut, extended, mix64, prefix_hash, span_hash

LENGTH, Q = 400, 32
SEGMENT = 4 << 20
MAX_RUN = 1 << 14
BATCH = 1 << 20


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values, in time that does not depend on w."""
    n = len(values) - w + 1
    padded = np.full(-(-len(values) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def digest_of(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def runs(data: np.ndarray, length: int, q: int) -> Iterator[tuple[int, bytes, int, int, bool]]:
    """(bucket, digest, first window, windows, whether it may repeat itself) of one text's runs."""
    w = length - q + 1
    for base in range(0, len(data) - length + 1, SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        prefix = prefix_hash(part)
        at = np.arange(len(part) - q + 1)
        grams = mix64(span_hash(prefix, at, at + q))
        bucket = sliding_min(grams, w)
        first = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
        last = np.concatenate([first[1:], [len(bucket)]])
        if (last - first).max() > MAX_RUN:
            first = np.concatenate([np.arange(a, b, MAX_RUN) for a, b in zip(first, last, strict=True)])
            last = np.concatenate([first[1:], [len(bucket)]])
        raw, values = part.tobytes(), bucket[first].view(np.int64).tolist()
        for value, a, b in zip(values, first.tolist(), last.tolist(), strict=True):
            own = int(np.count_nonzero(grams[a : b - 1 + w] == bucket[a])) > 1
            yield value, digest_of(raw[a : b - 1 + length]), base + a, b - a, own


_RUNS = "th long, bucket long, code binary, first long, size int, own boolean"


def _runs_of(docs: DataFrame, length: int, q: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column("text")):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.is_valid and text.as_buffer().size else None
                if data is None or len(data) < length:
                    continue
                of = list(runs(data, length, q))
                row += [i] * len(of)
                found += of
            columns = list(zip(*found, strict=True)) or [[]] * 5
            taken = batch.select(["id", "th"]).take(pa.array(row, pa.int64()))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_())
            arrays = [*taken.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "th", "bucket", "code", "first", "size", "own"])

    return docs.mapInArrow(run, extended(docs.select("id").schema, _RUNS))


def refine(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers at depth ``length`` of all suffixes of ``data`` that are long enough.

    A bucket is named by a place of its own among the suffixes in order, so the parts of a
    bucket that is split take names that no other bucket has.
    """
    depth = min(8, length)
    grams = np.zeros(len(data) - depth + 1, dtype=np.uint64)
    for j in range(depth):
        grams = grams << np.uint64(8) | data[j : j + len(grams)]
    order = np.argsort(grams)
    names, shared = _named(grams[order], np.arange(len(order)))
    bucket = np.empty(len(grams), dtype=np.int64)
    bucket[order] = names
    open_ = order[shared]  # suffixes that share their bucket
    while depth < length:
        step = min(depth, length - depth)
        open_ = open_[open_ + step < len(bucket)]  # the others are too short for a window
        if not len(open_):
            break
        own = bucket[open_]
        pair = own.astype(np.uint64) * np.uint64(len(bucket)) + bucket[open_ + step].astype(np.uint64)
        by = np.argsort(pair)
        open_, own = open_[by], own[by]
        places = np.arange(len(own))
        heads, _ = _named(own, places)
        firsts, shared = _named(pair[by], places)
        bucket[open_] = own + (firsts - heads)  # a part is named by the place of its first suffix
        open_ = open_[shared]  # a suffix alone in its bucket is settled
        depth += step
    return bucket[: max(len(data) - length + 1, 0)]


def _named(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted values: the place of the first equal one, and whether there are others."""
    split = np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]
    names = np.maximum.accumulate(np.where(split, places, 0)) if len(values) else places
    return names, ~(split & np.concatenate([split[1:], [True]])[: len(values)])


def repeated(texts: list[bytes], sizes: np.ndarray, weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each run, which of its windows start more than once among all runs given."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    ids = refine(data, length)
    where = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes, strict=True)])
    names = ids[where]
    twice = np.bincount(names, weights=np.repeat(weights, sizes))[names] >= 2
    return np.split(twice, np.cumsum(sizes)[:-1])


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) of the runs of true flags."""
    steps = np.diff(flags.astype(np.int8), prepend=0, append=0)
    first = np.flatnonzero(steps == 1)
    return list(zip(first.tolist(), (np.flatnonzero(steps == -1) - first).tolist(), strict=True))


def _refined(parts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the runs that occur once: (id, th, first, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_bytes, open_bucket = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            sizes = rows["size"].to_numpy().astype(np.int64)
            weights = rows["m"].to_numpy()
            out, row = [], []
            for i, flags in enumerate(repeated(rows["bytes"].to_pylist(), sizes, weights, length)):
                if weights[i] == 1:
                    of = _spans(flags)
                    out += of
                    row += [i] * len(of)
            if out:
                first = rows["first"].to_numpy()[row] + [a for a, _ in out]
                taken = rows.select(["id", "th"]).take(pa.array(row, pa.int64())).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(first, pa.int64()), pa.array([n for _, n in out], pa.int32())], names=["id", "th", "first", "size"]
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and held_bytes >= BATCH and bucket[a] != open_bucket:
                    yield from close()
                    held, held_bytes = [], 0
                open_bucket = bucket[a]
                piece = batch.slice(a, b - a)
                held.append(piece)
                held_bytes += int(sum(len(x) for x in piece.column("bytes").to_pylist()))
        if held:
            yield from close()

    dealt = parts.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, extended(parts.select("id").schema, "th long, first long, size int"))


def _counted(parts: DataFrame, length: int) -> DataFrame:
    """The same for large buckets: windows by hash, counted with partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("bytes")[i].as_py()
                n = batch.column("size")[i].as_py()
                codes = pa.array([digest_of(data[a : a + length]) for a in range(n)], pa.binary())
                taken = batch.select(["id", "th", "bucket", "m"]).take(pa.array([i] * n, pa.int64()))
                first = pa.array(np.arange(n) + batch.column("first")[i].as_py(), pa.int64())
                yield pa.RecordBatch.from_arrays([*taken.columns, first, codes], names=["id", "th", "bucket", "m", "first", "code"])

    windows = parts.mapInArrow(run, extended(parts.select("id").schema, "th long, bucket long, m long, first long, code binary"))
    key = ["bucket", "code"]
    twice = windows.groupBy(*key).agg(F.sum("m").alias("n")).where("n >= 2").select(*key)
    found = windows.where("m = 1").join(twice, key, "left_semi")
    # neighbours are one entry, not one for each byte; a text's windows are sorted, never gathered
    place = F.row_number().over(Window.partitionBy("id", "th").orderBy("first"))
    found = found.select("id", "th", "first").distinct().withColumn("island", F.col("first") - place)
    return found.groupBy("id", "th", "island").agg(F.min("first").alias("first"), F.count(F.lit(1)).cast("int").alias("size")).drop("island")


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    q: int = Q,
    bucket_bytes: int = 4 << 20,
    bucket_rows: int = 1 << 15,
) -> DataFrame:
    """id, n_bytes, removed (array of start and end) and kept (the remaining bytes)."""
    if not 1 <= q <= length:
        raise ValueError("q must be from 1 to length")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    found = _runs_of(rows, length, q)
    multi = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).where("n > 1 or own").select("bucket")
    found = cut(found.join(multi, "bucket", "left_semi")).withColumn("run", F.monotonically_increasing_id())
    same = ["bucket", "code", "size"]
    kinds = cut(found.groupBy(*same).agg(F.count(F.lit(1)).alias("m"), F.min("run").alias("run"), F.max("own").alias("own")))
    whole = found.join(kinds.where("m > 1").select(*same), same, "left_semi").select("id", "th", "first", "size")
    size = F.sum(F.col("size") + F.lit(length - 1))
    buckets = kinds.groupBy("bucket").agg(
        F.max(F.col("m") == 1).alias("mixed"), F.count(F.lit(1)).alias("k"), F.max("own").alias("any_own"), size.alias("bytes")
    )
    buckets = buckets.where("mixed and (k > 1 or any_own)")
    buckets = buckets.select("bucket", ((F.col("bytes") > bucket_bytes) | (F.col("k") > bucket_rows)).alias("large"))
    needed = kinds.join(buckets, "bucket").select("run", "m", "large").join(found.select("run", "id", "th", "bucket", "first", "size"), "run")
    wanted = needed.groupBy("id", "th").agg(F.collect_list(F.struct("bucket", "first", "size", "m", "large")).alias("runs"))

    def of_text(lists: DataFrame) -> F.Column:
        return rows["id"].eqNullSafe(lists["id_"]) & (rows["th"] == lists["th_"])

    def keyed(lists: DataFrame) -> DataFrame:
        return lists.withColumnRenamed("id", "id_").withColumnRenamed("th", "th_").hint("shuffle_hash")

    wanted = keyed(wanted)
    taken = rows.join(wanted, of_text(wanted)).select("id", "th", "text", F.explode("runs").alias("r"))
    parts = taken.select("id", "th", "r.bucket", "r.first", "r.size", "r.m", "r.large", F.expr("substring(text, cast(r.first as int) + 1, r.size + " + str(length - 1) + ")").alias("bytes"))
    parts = cut(parts)
    edges = _refined(parts.where("not large").drop("large"), length)
    counted = _counted(parts.where("large").drop("large"), length)
    windows = whole.unionByName(edges).unionByName(counted)
    lists = keyed(cut(windows.groupBy("id", "th").agg(F.collect_list(F.struct("first", "size")).alias("runs"))))
    held = rows.join(lists, of_text(lists), "left").select("id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, of in zip(batch.column("text"), batch.column("runs"), strict=True):
                data = text.as_py()
                sizes.append(len(data))
                gone: list[list[int]] = []
                for r in sorted((r["first"], r["size"]) for r in of.as_py() or []):
                    a, b = r[0], r[0] + r[1] + length - 1
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(b, gone[-1][1])
                    else:
                        gone.append([a, b])
                bounds = [0, *(x for pair in gone for x in pair), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
                removed.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"]
            )

    schema = extended(rows.select("id").schema, "n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    return held.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the registered query."""
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col(f"`{id_col}`"), "n_bytes", total.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


#: DuckDB SQL for the registered query, over the bytes in hexadecimal: every window is counted.
ORACLE = f"""
WITH d AS (
    SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), windows AS (
    SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS code
    FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH} + 1)) AS i FROM d WHERE len(h) >= {2 * LENGTH})
), twice AS (
    SELECT doc_id, i FROM windows SEMI JOIN (SELECT code FROM windows GROUP BY code HAVING count(*) > 1) USING (code)
), steps AS (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS begins FROM twice
), spans AS (
    SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b
    FROM (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM steps) GROUP BY doc_id, span
), gaps AS (
    SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
    UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS h
    FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), counts AS (
    SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
