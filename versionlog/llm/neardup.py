"""Near-duplicates by shingle similarity, with SimHash fingerprints as the index.

Two texts are linked if their sets of word shingles (five words) have a Jaccard similarity of
0.8 or more; classes are the connected components. SimHash finds the pairs to look at:

1. Equal texts are one node. Each node has several independent 64-bit SimHash fingerprints
   of its word pairs, which change less under an edit than longer shingles do.
2. Each fingerprint is entered in the byte-position index of ``simhash``, and lists are read by
   its search: shared positional bytes are tallied, pairs under the minimum are dropped, the
   rest are verified by their differing bits, and a list of n members gives fewer than n links
   (to the first member of each class). They only have to bring similar texts into one loose
   group; links are contracted to about one for each node before classes are formed.
3. A loose group's shingle sets meet in one task, where all its pairs that can be similar are
   verified exactly. A group of over ``group_limit`` texts or ``group_bytes`` of shingles is
   split into blocks of about half that size, and each two blocks meet in a task of their own, so
   all pairs are verified and no task holds a group of unbounded size. Texts without enough
   shared shingles for any link are left out first, sizes too far apart never meet, and what
   links of step 2 join already is skipped: pairs in a task, and the meetings of blocks that
   hold nothing else.

With eight fingerprints a pair of similarity 0.8 shares a list with a probability of 0.98,
and closer pairs more often. A list of over ``list_limit`` members is dealt into blocks of about
half as many, and each two blocks are one shorter list, so all its pairs are still compared.

Null texts count as empty; all empty texts are one node. Ids may be null or repeat; rows equal
in id and text are one row for ``keep_one``. An empty table gives an empty one. Texts are read
whole. Other columns may have any name and are kept as they are.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import U64, cut, mix64
from versionlog.llm.components import components
from versionlog.llm.simhash import SEED, TRIPLES, links_of_lists

PRINTS, PROBE_WORDS = 8, 2
#: Most differing bits of a candidate pair in one fingerprint. A pair of similarity 0.8 that
#: shares a list differs in 3.9 of the other 40 bits on average, and in over 9 in 1 of 100.
REACH = 9
#: Positional bytes that a pair shares at least: those of the key of a list.
LEAST = 3


def shingle_codes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words (of the whole text if it has fewer)."""
    tokens = text.lower().split()
    n = len(tokens)
    flat = b" ".join(tokens)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], dtype=np.uint64)
    size = np.fromiter(map(len, tokens), np.int64, n) + 1
    end = np.cumsum(size)
    start = (end - size)[: n - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[s:e], SEED) for s, e in zip(start, (end[words - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def prints_of(codes: np.ndarray, count: int) -> np.ndarray:
    """``count`` independent SimHash fingerprints of one multiset of codes."""
    salts = mix64(np.arange(1, count + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
    votes = np.zeros(64 * count, dtype=np.int64)
    for i in range(0, len(codes), 1 << 12):
        salted = mix64(codes[i : i + (1 << 12), None] ^ salts)
        votes += np.unpackbits(salted.view(np.uint8).reshape(len(salted), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(votes * 2 > len(codes), bitorder="little").view(np.uint64)


def _key(of: F.Column, positions: tuple[int, ...]) -> F.Column:
    out = F.lit(0).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned(of, 8 * p).bitwiseAND(F.lit(255)))
    return out


def candidates(nodes: DataFrame, list_limit: int, broadcast_rows: int = 1 << 20) -> DataFrame:
    """Distinct links (a, b), a < b, that connect all nodes within reach; ``nodes`` has node and prints."""
    each = nodes.select("node", F.posexplode("prints").alias("no", "fp"))
    keys = F.array(*[F.shiftleft(_key(F.col("fp"), t), 8).bitwiseOR(F.lit(8 * i)) for i, t in enumerate(TRIPLES)])
    postings = each.select("node", "fp", "no", F.explode(keys).alias("key"))
    postings = postings.select("node", "fp", (F.col("key") + F.col("no").cast("long") * F.lit(1 << 40)).alias("key"))
    long_ = postings.groupBy("key").count().where(F.col("count") > list_limit)
    long_ = cut(long_.select("key", F.ceil(F.col("count") * 2 / list_limit).alias("blocks")))

    def searched(rows: DataFrame, limit: int | None) -> DataFrame:
        dealt = rows.repartition("key").sortWithinPartitions("key", "node")
        return dealt.mapInArrow(links_of_lists(limit, REACH, LEAST), "a long, b long")

    found = searched(postings.select("key", "fp", "node"), list_limit)
    many = long_.count()
    if many:
        side = F.broadcast(long_) if many <= broadcast_rows else long_
        # a member meets each other block of its list, and the other members of its own block there
        placed = postings.join(side, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("block"))
        placed = placed.select("key", "fp", "node", "block", F.explode(others).alias("other"))
        parts = placed.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp", "node")
        found = found.unionByName(searched(parts, None))
    return found.distinct()


def contracted(pairs: DataFrame) -> DataFrame:
    """Links with the same classes as ``pairs`` (a < b), about one for each node.

    A node keeps the link to its smallest partner, and its other partners are linked to that
    one; most of these links are the same for all members of a group. A node has at most one
    partner here for each of its lists (or blocks of a list), so the sets are small.
    """
    of = pairs.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("partners"))
    own = of.select(F.col("partners")[0].alias("a"), "b")
    others = of.where(F.size("partners") > 1).select(F.col("partners")[0].alias("a"), F.explode(F.expr("slice(partners, 2, size(partners) - 1)")).alias("b"))
    return own.unionByName(others.distinct())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def verified(sets: list[np.ndarray], similarity: float, label: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links over all pairs of one group that are similar enough, found exactly.

    Sets of one ``label`` count as linked already; with ``side`` only sets of different sides
    are compared.

    Two such sets share one of their rarest shingles: a set of n shingles is entered under
    its n - ceil(similarity * n) + 1 rarest ones and compared with the sets it meets there,
    unless links join them already.
    """
    n = len(sets)
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    if not label.any():
        return []
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(n), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by = np.lexsort((code, count[code], owner))  # of each set, its rarest shingles first
    early = np.arange(len(by)) - starts[owner[by]] < (sizes - np.ceil(similarity * sizes - 1e-9) + 1)[owner[by]]
    keys_of = np.split(code[by][early], np.searchsorted(owner[by][early], np.arange(1, n)))
    entered: dict[int, array] = {}
    members: dict[int, list[int]] = {}
    for i, of in enumerate(label.tolist()):
        members.setdefault(of, []).append(i)
    out = []
    for i in np.argsort(sizes, kind="stable").tolist():
        met = np.zeros(n, dtype=bool)
        for key in keys_of[i].tolist():
            if (held := entered.setdefault(key, array("q"))):
                met[np.frombuffer(held, np.int64)] = True
            held.append(i)
        if side is not None:
            met &= side != side[i]
        met &= (label != label[i]) & (sizes >= similarity * sizes[i] - 1e-9)
        near = np.flatnonzero(met)
        for at in range(0, len(near), 64):
            part = near[at : at + 64]
            part = part[label[part] != label[i]]
            if not len(part):
                continue
            flags = np.isin(np.concatenate([sets[j] for j in part]), sets[i])
            both = np.add.reduceat(flags, np.concatenate([[0], np.cumsum(sizes[part])[:-1]]), dtype=np.int64)
            for j in part[both >= similarity * (sizes[i] + sizes[part] - both) - 1e-9].tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    few, many = sorted((int(label[i]), int(label[j])), key=lambda x: len(members[x]))
                    label[members[few]] = many
                    members[many] += members.pop(few)
    return out


def block_links(sets: DataFrame, known: DataFrame, similarity: float, group_limit: int, group_bytes: int) -> DataFrame:
    """Links (a, b) over all similar pairs of each group, found in tasks of bounded size.

    ``sets`` has node, root and shingles; ``known`` has (node, label) of nodes linked already.
    """

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, roots = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root"))
            for node, root, held in zip(nodes, roots, batch.column("shingles"), strict=True):
                code = np.frombuffer(held.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), x)) for x in (node, root)] + [pa.array(code)], names=["node", "root", "code"])

    size = (F.length("shingles") / 8).cast("long")
    # a set with a similar one shares this part of its shingles; those of one text alone are not shared
    alone = sets.mapInArrow(codes, "node long, root long, code long").groupBy("root", "code").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("own"))
    alone = alone.where("k = 1").groupBy("own").agg(F.count(F.lit(1)).alias("alone"))
    shared = sets.join(alone, sets["node"] == alone["own"], "left").where(size - F.coalesce("alone", F.lit(0)) >= F.lit(similarity) * size - 1e-6)
    labelled = shared.join(known.withColumnRenamed("node", "own_"), F.col("node") == F.col("own_"), "left")
    # classes of sizes: similar sets are of one class or of two next to each other
    width = max(-1.01 * math.log(similarity), 0.01)
    labelled = cut(labelled.select("node", "root", "shingles", F.coalesce("label", "node").alias("label"), F.floor(F.log(size) / width).alias("class")))
    placed, tasks = dealt(labelled.withColumn("bytes", F.length("shingles")).drop("shingles"), group_limit, group_bytes)
    sides = tasks.select(F.col("x").alias("block"), "x", "y", F.lit(0).alias("side"))
    sides = sides.unionByName(tasks.where("x <> y").select(F.col("y").alias("block"), "x", "y", F.lit(1).alias("side")))
    met = placed.join(sides, "block").join(labelled.select("node", "shingles", "label"), "node")

    def check(group: pa.Table) -> pa.Table:
        names, side = group["node"].to_numpy(), group["side"].to_numpy()
        held = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        inner = group["x"][0] == group["y"][0]
        links = np.array(verified(held, similarity, group["label"].to_numpy(), None if inner else side), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(names[links[:, 0]], pa.int64()), "b": pa.array(names[links[:, 1]], pa.int64())})

    return met.groupBy("x", "y").applyInArrow(check, "a long, b long")


def dealt(sets: DataFrame, group_limit: int, group_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(node, block) of every set, and (x, y) of every two blocks that have to meet, x = y for one alone.

    ``sets`` has node, root, class, label and bytes. A label that fills a block has blocks of its
    own, and these never meet each other: a group that links have joined but for a few sets
    costs these few against the rest, not the square of its blocks.
    """
    fill = F.greatest(F.col("n") / (group_limit / 2), F.col("bytes") / (group_bytes / 2))
    kinds = sets.groupBy("root", "class", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    kinds = cut(kinds.withColumn("owner", F.when(fill >= 1, F.col("label")).otherwise(-1)))  # nodes are not negative
    shares = kinds.groupBy("root", "class", "owner").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    shares = cut(shares.select("root", "class", "owner", F.ceil(fill).alias("k")))
    blocks = shares.select("root", "class", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("no"))
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()))
    of = kinds.join(shares, ["root", "class", "owner"]).select("root", "class", "label", "owner", "k")
    placed = sets.join(of, ["root", "class", "label"]).withColumn("no", F.pmod(F.xxhash64("node"), "k"))
    placed = placed.join(blocks, ["root", "class", "owner", "no"]).select("node", "block")
    step = blocks.select("root", "owner", F.col("block").alias("x"), F.posexplode(F.array("class", F.col("class") + 1)).alias("up", "class"))
    other = blocks.select("root", "class", F.col("owner").alias("owner_"), F.col("block").alias("y"))
    tasks = step.join(other, ["root", "class"]).where("(up = 1 or x <= y) and (owner = -1 or owner <> owner_)")
    return placed, cut(tasks.select("x", "y"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 5,
    similarity: float = 0.8,
    list_limit: int = 2048,
    group_limit: int = 4096,
    group_bytes: int = 64 << 20,
    broadcast_rows: int = 1 << 20,
) -> DataFrame:
    """(id, digest, component_id, component_digest): a row for each row of ``docs``.

    ``digest`` is the MD5 of the text; the component is named by its smallest (id, digest).
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))

    def print_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = [prints_of(shingle_codes(t.as_py(), PROBE_WORDS), PRINTS).view(np.int64).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.list_(pa.int64()))], names=["digest", "prints"])

    ids = cut(rows.select("id", "digest"))
    printed = rows.select("digest", "text").mapInArrow(print_, "digest binary, prints array<long>")
    # prints depend on the text alone, so any row of a digest will do
    nodes = cut(printed.groupBy("digest").agg(F.first("prints").alias("prints")).withColumn("node", F.monotonically_increasing_id()))
    pairs = cut(candidates(nodes.select("node", "prints"), list_limit, broadcast_rows))
    loose = cut(components(cut(contracted(pairs))))
    wanted = cut(loose.join(nodes.select("node", "digest"), "node"))
    small = wanted.count() <= broadcast_rows

    def sets_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = [np.unique(shingle_codes(t.as_py(), words_per_shingle)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), pa.array(found, pa.binary())], names=["node", "root", "shingles"])

    met = rows.select("digest", "text").join(F.broadcast(wanted) if small else wanted.hint("shuffle_hash"), "digest")
    sets = met.select("node", "root", "text").mapInArrow(sets_, "node long, root long, shingles binary")
    sets = cut(sets.groupBy("node", "root").agg(F.first("shingles").alias("shingles")))  # a set for each text, not for each copy
    groups = sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    large = cut(groups.where((F.col("n") > group_limit) | (F.col("bytes") > group_bytes)).select("root"))

    def check(group: pa.Table) -> pa.Table:
        names = group["node"].to_numpy()
        held = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        links = np.array(verified(held, similarity), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(names[links[:, 0]], pa.int64()), "b": pa.array(names[links[:, 1]], pa.int64())})

    links = sets.join(large, "root", "left_anti").groupBy("root").applyInArrow(check, "a long, b long")
    if not large.isEmpty():
        side = sets.join(large, "root", "left_semi").select("node", "shingles")
        left = side.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = side.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs_ = zip(batch.column("x"), batch.column("y"), strict=True)
                good = [jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= similarity - 1e-12 for x, y in pairs_]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        wide = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        sure = cut(wide.mapInArrow(one, "a long, b long"))
        known = components(sure).withColumnRenamed("root", "label")
        whole = sets.join(large, "root", "left_semi")
        links = links.unionByName(sure).unionByName(block_links(whole, known, similarity, group_limit, group_bytes))
    roots = components(cut(links))
    least = ids.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest")).alias("least"))
    named = nodes.select("node", "digest").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    named = cut(named.join(least, "digest"))
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    classes = named.join(first, "root").select("digest", F.col("first.id").alias("component_id"), F.col("first.digest").alias("component_digest"))
    return ids.join(classes, "digest").select("id", "digest", "component_id", "component_digest")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` without all but one row of each class: the one with the smallest id."""
    classes = cut(near_duplicates(docs, id_col=id_col, text_col=text_col, **options))  # type: ignore[arg-type]
    first = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("component_digest"))
    kept = classes.where(first).groupBy("id", "digest").count()
    repeats = not kept.where(F.col("count") > 1).isEmpty()
    kept = kept.select(F.col("id").alias("__id"), F.col("digest").alias("__digest")).hint("shuffle_hash")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = docs.withColumn("__own", F.unhex(F.md5(text.cast("binary"))))
    out = marked.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest")), "left_semi")
    if repeats:  # rows equal in id and text
        out = out.dropDuplicates([id_col, "__own"])
    return out.drop("__own")
