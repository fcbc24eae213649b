"""Quality classification by the perplexity of an interpolated modified Kneser-Ney model.

The model is over the bytes of UTF-8 texts, of order 5 unless told otherwise, and is trained
on all trusted text but a fifth of the trusted documents. That fifth (by a hash of the id)
sets the thresholds: for each language a quantile of its perplexities. A document is
rejected if its perplexity is above its language's threshold; for this, a short text's
perplexity is drawn towards the mean of its language. Apart from that, a document is marked as
toxic if it holds a word that tells toxic texts (``toxic.py``): a mean over all bytes cannot show
a few insults in a long text.

Counts are sharded by the two bytes before the last byte of an n-gram. An n-gram of order 5,
its context, and the n-grams and contexts of orders 4 and 3 that it backs off to all hold
these two bytes, so one join with one shard gives the interpolated probability. Orders 2
and 1 have at most 2**16 entries and go to every task. Documents are scored in blocks of a
few MB: a block asks each shard for the block's distinct n-grams (not its occurrences). The
number of shards grows with the model, so a shard's part of it fits in a task, which reads that
part once and then streams the blocks' questions past it. The answers (fixed-point logs, 2 bytes
each) are joined back to the block's texts, and sums of integers give each document's
perplexity, the same in every run.

A block is formed twice, once to ask and once to score, so the input must give the same rows
in the same order both times, as a stored table does; if not, the job fails rather than
lose a row. Null and empty texts have no perplexity and are never rejected; so are texts in a
language without trusted text. A null language is a language of its own. Rows that repeat
are scored alike. Very long texts are counted and scored whole, in pieces. An empty table gives
an empty result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versionlog.llm import toxic
from versionlog.llm.common import cut, extended, mix64, text_slices

U64 = np.uint64
#: Logs of probabilities are kept as multiples of 1 / SCALE nats, in 16 bits.
SCALE = 2048
#: Bytes of text that are asked about at once, and of which n-grams are formed at once.
BLOCK, PIECE = 4 << 20, 1 << 20


def grams_of(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte; before a text stand zero bytes."""
    out = data.astype(np.uint64)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, order):
        earlier = np.zeros(len(data), dtype=np.uint64)
        earlier[back:] = data[:-back] if len(data) > back else 0
        earlier[place < back] = 0
        out |= earlier << U64(8 * back)
    return out


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return (mix64((grams >> U64(8)) & U64(0xFFFF)) % U64(shards)).astype(np.int64)


def _pieces(data: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first byte, n-grams) of at most PIECE bytes at a time, so that memory stays bounded."""
    size = min(PIECE, BLOCK)
    for a in range(0, len(data), size):
        b = min(a + size, len(data))
        start = max(0, a - order + 1)
        inner = offsets[(offsets > start) & (offsets < b)] - start
        yield a, grams_of(data[start:b], np.concatenate([[0], inner, [b - start]]), order)[a - start :]


def distinct(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    parts = [np.unique(g) for _, g in _pieces(data, offsets, order)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts or [np.zeros(0, np.uint64)]))


def counted(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams and how often each occurs."""
    parts = [np.unique(g, return_counts=True) for _, g in _pieces(data, offsets, order)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(grams)
    grams = grams[by]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(counts[by], first)


@dataclass
class Discounts:
    """Modified Kneser-Ney discounts of one order."""

    values: tuple[float, float, float]

    @classmethod
    def of(cls, n1: int, n2: int, n3: int, n4: int) -> Discounts:
        """From how many n-grams have a count of 1, 2, 3 and 4."""
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        ratio = [(n1, n2), (n2, n3), (n3, n4)]
        found = [i + 1 - (i + 2) * y * (b / a) if a else (i + 1) / 2 for i, (a, b) in enumerate(ratio)]
        return cls(tuple(min(max(d, 0.1), i + 0.9) for i, d in enumerate(found)))

    def taken(self, counts: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.values])[np.minimum(counts, 3)]


@dataclass
class Level:
    """n-grams of one order (sorted) with their counts, and their contexts."""

    grams: np.ndarray
    counts: np.ndarray
    discounts: Discounts

    def __post_init__(self) -> None:
        context = self.grams >> U64(8)
        self.contexts, at = np.unique(context, return_inverse=True)
        n = len(self.contexts)
        self.totals = np.bincount(at, weights=self.counts, minlength=n)
        self.spare = np.bincount(at, weights=self.discounts.taken(self.counts), minlength=n)

    def interpolate(self, asked: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams, given those of the next lower order."""
        if not len(self.grams):
            return lower
        at = np.minimum(np.searchsorted(self.grams, asked), len(self.grams) - 1)
        count = np.where(self.grams[at] == asked, self.counts[at], 0)
        context = asked >> U64(8)
        of = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        kept = count - self.discounts.taken(count)
        return np.where(self.contexts[of] == context, (kept + self.spare[of] * lower) / self.totals[of], lower)


@dataclass
class Model:
    """counts: (ord, gram, n) of orders 3 and up; pairs: probabilities of orders 2 and 1 (256 x 256)."""

    order: int
    counts: DataFrame
    discounts: dict[int, Discounts]
    pairs: np.ndarray


def _spread(grams: DataFrame) -> Discounts:
    row = grams.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    return Discounts.of(*row)


def fit(trusted: DataFrame, *, text_col: str = "text", order: int = 5) -> Model:
    """Count all of ``trusted``; lower orders count distinct left extensions."""
    if not 3 <= order <= 7:
        raise ValueError("order must be from 3 to 7")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text", BLOCK):
                grams, n = counted(data, offsets, order)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

    texts = trusted.select(F.col(f"`{text_col}`").alias("text"))
    level = texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    levels, discounts = [], {}
    for k in range(order, 0, -1):
        level = cut(level)
        discounts[k] = _spread(level)
        levels.append(level.select(F.lit(k).alias("ord"), "gram", "n"))
        level = level.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    few = {k: levels[order - k].collect() for k in (1, 2)}  # at most 2**8 and 2**16 rows
    lower = np.full(256, 1 / 256)
    for k in (1, 2):
        rows = sorted((r["gram"], r["n"]) for r in few[k])
        known = Level(np.array([g for g, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64), discounts[k])
        asked = np.arange(256**k, dtype=np.uint64)
        lower = known.interpolate(asked, lower[(asked & U64(255)).astype(np.int64)])
    counts = levels[0]
    for more in levels[1 : order - 2]:
        counts = counts.unionByName(more)
    return Model(order, counts, discounts, lower)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=kind)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(name, ids and languages, bytes, offsets) of runs of rows; the name depends on the bytes."""
    for batch in batches:
        for first, end, data, offsets in text_slices(batch, "text", BLOCK):
            rows = batch.select(["id", "lang", "th"]).slice(first, end - first)
            code = xxhash.xxh3_64(data.tobytes())
            code.update(offsets.tobytes())
            code.update(repr((rows.column("id").slice(0, 64).to_pylist(), rows.column("id")[-1].as_py())).encode())
            name = code.intdigest()
            yield name - (name >> 63 << 64), rows, data, offsets


#: Rows of the model that a shard holds on average (some 40 bytes each in its task), and the most shards.
SHARD_ROWS, LEAST_SHARDS, MOST_SHARDS = 1 << 20, 64, 1024


def score(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", shards: int | None = None, lanes: int | None = None
) -> DataFrame:
    """(id, lang, th, n_bytes, cost): th is the XXH64 of the text, cost the sum of SCALE times the negative logs.

    ``shards`` follow from the size of the model. A shard's questions are read in ``lanes``, each
    with a copy of the shard: one unless the cluster has more cores than there are shards.
    """
    order, levels, pairs = model.order, model.discounts, model.pairs
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("text"))
    if shards is None:
        shards = min(max(LEAST_SHARDS, -(-model.counts.count() // SHARD_ROWS)), MOST_SHARDS)
    if lanes is None:
        lanes = max(1, spark.sparkContext.defaultParallelism // shards)
    shared = spark.sparkContext.broadcast(pairs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, data, offsets in _blocks(batches):
            grams = distinct(data, offsets, order)
            shard = shard_of(grams, shards)
            by = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[by], np.arange(shards + 1))
            parts = [grams[by[bounds[s] : bounds[s + 1]]] for s in range(shards)]
            used = [s for s in range(shards) if len(parts[s])]
            blobs = [_pack(np.diff(parts[s], prepend=U64(0))) for s in used]
            arrays = [pa.array(used, pa.int32()), pa.array([name % lanes] * len(used), pa.int32()), pa.array([name] * len(used), pa.int64()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["shard", "lane", "block", "asked"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads rows sorted by shard and lane: first the shard's counts, then its questions."""
        here, held, steps = None, [], None

        def level(k: int, known: np.ndarray) -> Level:
            of = known[known[:, 0] == k]
            return Level(of[:, 1].view(np.uint64), of[:, 2], levels[k])  # sorted by gram, which is not negative

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "lane", "ord")], axis=1).astype(np.int64)
            edges = np.concatenate([[0], np.flatnonzero((keys[1:, :2] != keys[:-1, :2]).any(axis=1)) + 1, [len(keys)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if here != (now := tuple(keys[a, :2].tolist())):
                    here, held, steps = now, [], None
                first = a + int(np.searchsorted(keys[a:b, 2], order + 1))  # questions stand after all orders
                if first > a:
                    part = batch.slice(a, first - a)
                    held.append(np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ord", "gram", "n")], axis=1))
                if first == b:
                    continue
                if steps is None:
                    known = np.concatenate(held) if held else np.zeros((0, 3), np.int64)
                    steps, held = [(k, level(k, known)) for k in range(3, order + 1)], []
                for i in range(first, b):
                    grams = np.cumsum(_unpack(batch.column("asked")[i].as_py(), np.uint64), dtype=np.uint64)
                    p = shared.value[(grams & U64(0xFFFF)).astype(np.int64)]
                    for k, step in steps:
                        p = step.interpolate(grams & U64((1 << 8 * k) - 1), p)
                    blob = _pack(np.minimum(np.round(-np.log(p) * SCALE), 65535).astype(np.uint16))
                    yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), batch.column("shard").slice(i, 1), pa.array([blob], pa.binary())], names=["block", "shard", "answer"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, of, data, offsets in _blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, of.schema) as out:
                out.write_batch(of)
            arrays = [pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([_pack(offsets)], pa.binary()), pa.array([_pack(data)], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "of", "offsets", "data"])

    def total(held: pa.Table, answers: pa.Table) -> pa.Table:
        blobs = dict(zip(answers["shard"].to_pylist(), answers["answer"].to_pylist(), strict=True))
        out = []
        for i in range(held.num_rows):
            of = pa.ipc.open_stream(held["of"][i].as_py()).read_all()
            offsets, data = _unpack(held["offsets"][i].as_py(), np.int64), _unpack(held["data"][i].as_py(), np.uint8)
            grams = distinct(data, offsets, order)
            cost, shard = np.zeros(len(grams), np.int64), shard_of(grams, shards)
            for s in np.unique(shard).tolist():
                if s not in blobs:
                    raise RuntimeError("a block has no answers: the input gave other rows the second time")
                cost[shard == s] = _unpack(blobs[s], np.uint16)
            sums = np.zeros(len(data) + 1, np.int64)
            for a, part in _pieces(data, offsets, order):
                kinds, at = np.unique(part, return_inverse=True)
                sums[a + 1 : a + 1 + len(part)] = cost[np.searchsorted(grams, kinds)][at]
            np.cumsum(sums, out=sums)
            out.append(of.append_column("n_bytes", pa.array(np.diff(offsets))).append_column("cost", pa.array(sums[offsets[1:]] - sums[offsets[:-1]])))
        if not out:
            raise RuntimeError("answers without a block: the input gave other rows the second time")
        return pa.concat_tables(out)

    cd = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    table = spark.createDataFrame(
        [(i, int(s)) for i, s in enumerate(shard_of(np.arange(1 << 16, dtype=np.uint64) << U64(8), shards))], "cd int, shard int"
    )
    known = model.counts.withColumn("cd", cd.cast("int")).join(F.broadcast(table), "cd")  # 2**16 rows
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))) if lanes > 1 else F.lit(0)
    known = known.select("shard", lane.alias("lane"), "ord", "gram", "n", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("asked"))
    asked = rows.mapInArrow(ask, "shard int, lane int, block long, asked binary")
    asked = asked.select("shard", "lane", F.lit(order + 1).alias("ord"), F.lit(None).cast("long").alias("gram"), F.lit(None).cast("long").alias("n"), "block", "asked")
    met = known.unionByName(asked).repartition(shards * lanes, "shard", "lane").sortWithinPartitions("shard", "lane", "ord", "gram")
    answers = met.mapInArrow(answer, "block long, shard int, answer binary")
    blocks = rows.mapInArrow(texts, "block long, of binary, offsets binary, data binary")
    schema = extended(rows.select("id", "lang", "th").schema, "n_bytes long, cost long")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, schema)


def _adjusted(prior_bytes: int) -> F.Column:
    """Cost per byte in nats, as if ``prior_bytes`` of the language's mean cost were added.

    A text of a few bytes says little, and this keeps it near the mean.
    """
    return (F.col("cost") / SCALE + F.lit(prior_bytes) * F.col("mean")) / (F.col("n_bytes") + F.lit(prior_bytes))


def thresholds(scored: DataFrame, quantile: float, margin: float, prior_bytes: int) -> DataFrame:
    """(lang, mean, limit): the mean cost of each language's texts, and ``quantile`` of their
    adjusted costs, in steps of 1/1000 nat, plus ``margin``."""
    scored = scored.where("n_bytes > 0")
    means = scored.groupBy(F.col("lang").alias("__lang")).agg((F.sum("cost") / F.sum("n_bytes") / SCALE).alias("mean"))
    means = F.broadcast(means)  # a row for each language
    known = scored.join(means, F.col("lang").eqNullSafe(F.col("__lang")))
    bins = known.groupBy("lang", "mean", F.floor(_adjusted(prior_bytes) * 1000).alias("bin")).count()
    by = Window.partitionBy("lang", "mean")  # a language has as many rows as steps: 32000 at most
    bins = bins.withColumn("up", F.sum("count").over(by.orderBy("bin"))).withColumn("all", F.sum("count").over(by))
    return bins.where(F.col("up") >= F.lit(quantile) * F.col("all")).groupBy("lang", "mean").agg(((F.min("bin") + 1) / 1000 + margin).alias("limit"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "quality",
    toxic_col: str = "toxic",
    order: int = 5,
    quantile: float = 0.995,
    margin: float = 0.1,
    prior_bytes: int = 200,
    held_out: int = 5,
    broadcast_rows: int = 1 << 20,
) -> DataFrame:
    """id, lang, n_bytes, text_xxh64, perplexity, threshold, rejected and toxic of every row.

    Trusted are the documents whose label is 1. One in ``held_out`` of them sets the
    thresholds and is not counted; with too few trusted documents to set any aside, all do both.
    ``rejected`` is the verdict of the perplexity alone, ``toxic`` that of the words learned from ``toxic_col``.
    """
    trusted = cut(labels.where(F.col(f"`{label_col}`") == 1).select(F.col(f"`{id_col}`").alias("__t")).where("__t is not null").distinct())
    n = trusted.count()
    held = F.pmod(F.xxhash64("__t"), F.lit(held_out)) == 0
    inner, outer = (trusted.where(~held), trusted.where(held)) if n >= 20 * held_out else (trusted, trusted)

    def among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
        side = F.broadcast(ids) if n <= broadcast_rows else ids.hint("shuffle_hash")
        return rows.join(side, F.col(column) == F.col("__t"), "left_semi")

    plain = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    model = fit(among(plain, inner, "__id"), text_col="__text", order=order)
    scored = cut(score(docs, model, id_col=id_col, text_col=text_col, lang_col=lang_col))
    limits = thresholds(among(scored, outer, "id"), quantile, margin, prior_bytes)
    marked = scored.join(F.broadcast(limits.withColumnRenamed("lang", "__lang")), F.col("lang").eqNullSafe(F.col("__lang")), "left")  # a row for each language
    found = None
    if toxic_col in labels.columns:
        found = toxic.holders(docs, toxic.lexicon(docs, labels, id_col=id_col, text_col=text_col, label_col=toxic_col), id_col=id_col, text_col=text_col)
    if found is None:
        marked = marked.withColumn("toxic", F.lit(False))
    else:
        found = found.select(F.col("id").alias("__i"), F.col("th").alias("__h"))
        marked = marked.join(found, F.col("id").eqNullSafe(F.col("__i")) & (F.col("th") == F.col("__h")), "left").withColumn("toxic", F.col("__h").isNotNull())
    own = F.when(F.col("n_bytes") > 0, F.col("cost") / F.col("n_bytes") / SCALE)
    judged = F.when(F.col("n_bytes") > 0, _adjusted(prior_bytes))
    return marked.select(
        F.col("id").alias(id_col),
        F.col("lang").alias(lang_col),
        "n_bytes",
        F.col("th").alias("text_xxh64"),
        F.exp(own).alias("perplexity"),
        F.exp("limit").alias("threshold"),
        F.coalesce(judged > F.col("limit"), F.lit(False)).alias("rejected"),
        "toxic",
    )

