"""SimHash near-duplicates through an inverted index on byte positions.

A text's fingerprint has a bit set if it is set in over half the XXH64 values of the text's
word shingles. Two fingerprints of 8 bytes that differ in at most 3 bits share at least 5
bytes by position. Of any 5 positions at least 3 fall into one half, so such a pair meets in
a posting list of the index, whose keys are the triples of positional bytes within a half (8
triples, 24 bits each). In a list, the shared positional bytes of each pair are tallied, pairs
with fewer than the guaranteed 5 are dropped, and only the rest are verified by their bits.

Equal fingerprints are one node from the start. A list gives the links of a spanning forest
only, so copies are never expanded into all pairs. A list longer than ``list_limit`` is split
by two further bytes (10 ways, each pair of the list meets in at least one); such a part
shares 5 bytes, so it has at most 2**24 distinct members, and a long part is searched by
looking up each member's neighbours instead of comparing all pairs.

Null and empty texts have fingerprint zero and are linked like any other. Rows with a null id
are classed with the others; a component of such rows only has a null id. Rows repeated in the
input are repeated in the result, an empty table gives an empty one, and other columns of the
input are not read, whatever their names. A text is hashed whole, in parts of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import U64, cut, extended, pick
from versionlog.llm.components import components

SEED, MAX_BITS, LEAST_SHARED = 42, 3, 5
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    n = len(words)
    if n == 0:
        return 0
    flat = b" ".join(words)
    if n <= words_per_shingle:
        return xxhash.xxh64_intdigest(flat, SEED)
    size = np.fromiter(map(len, words), np.int64, n) + 1
    end = np.cumsum(size)
    start = (end - size)[: n - words_per_shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    codes = np.array([digest(flat[s:e], SEED) for s, e in zip(start, (end[words_per_shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(codes), 1 << 14):
        part = codes[i : i + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(counts * 2 > len(codes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    rows = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            prints = np.array([fingerprint(t.as_py() or b"", words_per_shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, extended(rows.select("id").schema, "fp long"))


def _byte(position: int) -> F.Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def _key(positions: tuple[int, ...]) -> F.Column:
    out = F.lit(0).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(p))
    return out


def shared_bytes(differ: np.ndarray) -> np.ndarray:
    """Tally of the positional bytes that two prints share, from their differing bits."""
    spread = differ | differ >> U64(4)
    spread |= spread >> U64(2)
    spread |= spread >> U64(1)
    return 8 - np.bitwise_count(spread & U64(0x0101010101010101))


def _within(x: np.ndarray, y: np.ndarray, reach: int, least: int) -> np.ndarray:
    """Places of the pairs that share ``least`` bytes (count filter) and differ in ``reach`` bits at most."""
    differ = x ^ y
    kept = np.flatnonzero(shared_bytes(differ) >= least)
    return kept[np.bitwise_count(differ[kept]) <= reach]


def spanning(prints: np.ndarray, reach: int = MAX_BITS, least: int = LEAST_SHARED) -> np.ndarray:
    """(member, first member) of the classes that pairs within reach form, as places in ``prints``.

    A class grows from its first member; a member found is compared with those still left only,
    so a group of near copies takes few comparisons and gives one link for each member.
    """
    n = len(prints)
    first = np.arange(n)
    left = np.arange(n)
    while len(left) > 1:
        seed, left = int(left[0]), left[1:]
        todo = [seed]
        while todo and len(left):
            at = _within(prints[left], prints[todo.pop()], reach, least)
            if len(at):
                found = left[at]
                first[found] = seed
                todo += found.tolist()
                left = np.delete(left, at)
    member = np.flatnonzero(first != np.arange(n))
    return np.stack([member, first[member]], axis=1)


def _forest(n: int, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of each pair (smallest index of a class)."""
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def list_links(prints: np.ndarray, reach: int = MAX_BITS, least: int = LEAST_SHARED, names: np.ndarray | None = None) -> np.ndarray:
    """Links (member, representative) of a spanning forest of one list, by name (by print if there are none)."""
    names = prints if names is None else names
    n = len(prints)
    flips = 1 + 64 + 64 * 63 // 2 + 64 * 63 * 62 // 6
    if n <= flips // 8 or reach > MAX_BITS:
        pairs = spanning(prints, reach, least)
    else:
        # so long a list is a part, whose key is the guaranteed minimum of shared bytes:
        # the tally is reached, and neighbours differ within the other bits only
        label = np.arange(n)
        free = int(np.bitwise_or.reduce(prints ^ prints[0]))
        bits = [1 << i for i in range(64) if free >> i & 1]
        order = np.argsort(prints)
        known = prints[order]
        for size in range(1, reach + 1):
            for chosen in combinations(bits, size):
                near = known ^ np.uint64(sum(chosen))
                at = np.minimum(np.searchsorted(known, near), n - 1)
                hit = np.flatnonzero((known[at] == near) & (at > np.arange(n)))
                if len(hit):
                    label = _forest(n, order[hit], order[at[hit]], label)
        member = np.flatnonzero(label != np.arange(n))
        pairs = np.stack([member, label[member]], axis=1)
    return names[pairs]


def _short_links(key: np.ndarray, prints: np.ndarray, names: np.ndarray, most: int, reach: int, least: int) -> list[np.ndarray]:
    """Links of sorted lists that have at most ``most`` + 1 members: neighbours by distance."""
    out = []
    for d in range(1, most + 1):
        same = np.flatnonzero(key[d:] == key[:-d])
        if not len(same):
            break
        good = same[_within(prints[same], prints[same + d], reach, least)]
        out.append(np.stack([names[good + d], names[good]], axis=1))
    return out


def links_of_lists(limit: int | None, reach: int = MAX_BITS, least: int = LEAST_SHARED):
    """Reads (key, fp) or (key, fp, node) sorted by key, gives links (a, b) with a < b of nodes (of
    prints if there is no node); lists over ``limit`` are left to a finer index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last, still open list
        open_key, held_n = None, 0

        def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            links = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
            if len(links):
                links = np.unique(np.sort(links, axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

        def close() -> list[np.ndarray]:
            if held_n < 2 or (limit is not None and held_n > limit):
                return []
            prints, names = (np.concatenate(x) for x in zip(*held, strict=True))
            return [list_links(prints, reach, least, names)]

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy(zero_copy_only=False)
            signed = batch.column("fp").to_numpy(zero_copy_only=False)
            prints = signed.view(np.uint64)
            names = batch.column("node").to_numpy(zero_copy_only=False) if "node" in batch.schema.names else signed
            edges = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
            parts: list[np.ndarray] = []
            if open_key is not None and key[0] != open_key:
                parts += close()
                held, held_n, open_key = [], 0, None
            size = ends - starts
            whole = np.ones(len(starts), dtype=bool)
            whole[0], whole[-1] = open_key is None, False
            small = whole & (size > 1) & (size <= 9)
            if limit is not None:
                small &= size <= limit
            if small.any():
                pickable = np.repeat(small, size)
                parts += _short_links(key[pickable], prints[pickable], names[pickable], 8, reach, least)
            for i in np.flatnonzero(whole & (size > 9)):
                if limit is None or size[i] <= limit:
                    parts.append(list_links(prints[starts[i] : ends[i]], reach, least, names[starts[i] : ends[i]]))
            # the first run continues the open list, the last run stays open
            for i in dict.fromkeys((0, len(starts) - 1)):
                if whole[i]:
                    continue
                if open_key is not None and key[starts[i]] != open_key:
                    parts += close()
                    held, held_n = [], 0
                open_key = key[starts[i]]
                held_n += int(size[i])
                if limit is None or held_n <= limit:
                    held.append((prints[starts[i] : ends[i]].copy(), names[starts[i] : ends[i]].copy()))
                else:
                    held = []
            yield from emit(parts)
        if open_key is not None:
            yield from emit(close())

    return run


def links(prints: DataFrame, list_limit: int = 2048) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within reach of each other."""
    index = F.array(*[F.shiftleft(_key(t), 4).bitwiseOR(F.lit(i)) for i, t in enumerate(TRIPLES)])
    postings = prints.select("fp", F.explode(index).alias("key"))
    lists = postings.repartition("key").sortWithinPartitions("key")
    near = lists.mapInArrow(links_of_lists(list_limit), "a long, b long")
    long_ = postings.groupBy("key").count().where(F.col("count") > list_limit).select("key")
    finer = []
    for i, t in enumerate(TRIPLES):
        for pair in combinations([p for p in range(8) if p not in t], 2):
            finer.append((i, _key((*t, *pair)), len(finer)))
    cases = F.array(
        *[
            F.array(*[F.shiftleft(k, 7).bitwiseOR(F.lit(n)) for j, k, n in finer if j == i])
            for i in range(len(TRIPLES))
        ]
    )
    parts = postings.join(long_, "key").select("fp", F.explode(F.element_at(cases, (F.col("key").bitwiseAND(F.lit(15)) + 1).cast("int"))).alias("key"))
    parts = parts.repartition("key").sortWithinPartitions("key").mapInArrow(links_of_lists(None), "a long, b long")
    return near.unionByName(parts)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, list_limit: int = 2048
) -> DataFrame:
    """id, fp (signed long) and component_id (smallest id within reach) of every row."""
    marked = cut(fingerprints(docs, id_col=id_col, text_col=text_col, words_per_shingle=words_per_shingle))
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select("fp"), list_limit))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the registered query."""
    return rows.select(F.col(f"`{id_col}`"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
