"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters or digits and of all code points from U+0080, with A-Z
lower-cased. Every run of ``window`` words of a benchmark item is a window; an item with
fewer words, but at least one, is one window. Of each window's k-grams the one with the
smallest hash is its fingerprint. A document keeps the smallest k-gram hash of each sliding
window, so every shared span of ``window`` words shares a fingerprint with the item; hits
are extended to the windows around them by comparing the words themselves, so hashes
never decide a result.

Null and empty texts have no words and are never contaminated. Null items are ignored;
items with equal texts all count. Rows repeated in the input are repeated in the result; an
empty table of documents gives an empty result, an empty benchmark no hits. Texts of any length
are read whole, in slices of bounded memory. Columns that are kept may have any name but those
of ``names`` (give others if they clash).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import U64, cut, extended, mix64, pick, prefix_hash, span_hash, text_slices

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_EMPTY = hashlib.sha256(b"").hexdigest()
_SLICE = 2 << 20


@dataclass
class Words:
    """Words of a run of texts: their bytes, bounds, hashes and the text each belongs to."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    code: np.ndarray

    def window(self, i: int, n: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i : i + n], self.end[i : i + n], strict=True))


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = _LOWER[data]
    is_word = np.zeros(len(low) + 2, dtype=bool)
    is_word[1:-1] = _WORD[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(is_word[1:] & (~is_word[:-1] | edge))
    end = np.flatnonzero(is_word[:-1] & (~is_word[1:] | edge))
    prefix = prefix_hash(low)
    code = mix64(span_hash(prefix, start, end) + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(low, start, end, row, code)


def gram_hash(code: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    weight = 0x9E3779B97F4A7C15
    for j in range(k):
        out += code[j : j + n] * U64(weight)
        weight = weight * 0xD1342543DE82EF95 % (1 << 64) | 1
    return mix64(out)


def smallest(hashes: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive hashes."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, w):
        np.minimum(out, hashes[j : j + n], out=out)
    return out


#: Bytes that ``Fingerprints`` hold for each byte of benchmark text, at most: the text itself, and
#: for each window (one for every two bytes) its mark, hash, item, first and last byte.
HELD_PER_BYTE = 1 + (8 + 8 + 4 + 8 + 8) / 2
#: Marks are looked up in a table of so many bits before they are shuffled (2 MB).
SCREEN_BITS = 24


@dataclass
class Windows:
    """Windows of one length, sorted by hash, as places in the text of all items."""

    marks: np.ndarray
    code: np.ndarray
    item: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Fingerprints:
    """Windows of benchmark items in arrays, with the fingerprints to look for."""

    def __init__(self, window: int, k: int) -> None:
        self.window, self.k = window, k
        self.names: list[str] = []
        self.text = b""
        self.by_length: dict[int, Windows] = {}

    def fingerprint(self, code: np.ndarray, length: int) -> np.ndarray:
        """Of each window of ``length`` words: its smallest k-gram hash."""
        k = min(self.k, length)
        return smallest(gram_hash(code, k), length - k + 1)

    def add(self, rows: list[tuple[str, bytes]]) -> Fingerprints:
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        texts, at = [], 0
        for item, text in rows:
            data = np.frombuffer(text, dtype=np.uint8)
            words = split_words(data, np.array([0, len(data)]))
            n = len(words.start)
            if n == 0:
                continue
            size = words.end - words.start + 1
            start = at + np.cumsum(size) - size
            texts.append(words.window(0, n) + b" ")
            at += len(texts[-1])
            length = min(self.window, n)
            heads = np.arange(n - length + 1)
            held = (self.fingerprint(words.code, length), gram_hash(words.code, length), np.full(len(heads), len(self.names), np.int32), start[heads], start[heads + length - 1] + size[heads + length - 1] - 1)
            found.setdefault(length, []).append(held)
            self.names.append(item)
        self.text = b"".join(texts)
        for length, parts in found.items():
            marks, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(columns[0], kind="stable")
            self.by_length[length] = Windows(np.unique(marks), *(c[by] for c in columns))
        return self

    def look(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the items of each text."""
        hit = np.zeros(len(words.start) + 1, dtype=np.int64)
        items: dict[int, set[str]] = {}
        for length, known in self.by_length.items():
            if len(words.start) < length:
                continue
            marks = self.fingerprint(words.code, length)
            inside = words.row[: len(marks)] == words.row[length - 1 :]
            screen = np.zeros(1 << 16, dtype=bool)
            screen[(known.marks >> U64(48)).astype(np.int64)] = True
            maybe = np.flatnonzero(inside & screen[(marks >> U64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known.marks, marks[maybe]), len(known.marks) - 1)
            maybe = maybe[known.marks[at] == marks[maybe]]
            if not len(maybe):
                continue
            code = gram_hash(words.code, length)[maybe]
            first, last = np.searchsorted(known.code, code), np.searchsorted(known.code, code, side="right")
            some = np.flatnonzero(last > first)
            for i, a, b in zip(maybe[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
                span = words.window(i, length)  # the words themselves decide
                holders = {self.names[known.item[j]] for j in range(a, b) if self.text[known.start[j] : known.end[j]] == span}
                if holders:
                    hit[i] += 1
                    hit[i + length] -= 1
                    items.setdefault(int(words.row[i]), set()).update(holders)
        return np.cumsum(hit[:-1]) > 0, items


NAMES = ("n_words", "n_hit", "items")


def _ddl(names: tuple[str, str, str]) -> str:
    return f"{names[0]} long, {names[1]} long, {names[2]} array<string>"


def _measure(texts: pa.RecordBatch, column: str, prints: Fingerprints) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    n = texts.num_rows
    n_words, n_hit, items = np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in range(n)]
    for first, end, data, offsets in text_slices(texts, column, _SLICE):
        words = split_words(data, offsets)
        hit, found = prints.look(words)
        n_words[first:end] = np.bincount(words.row, minlength=end - first)
        n_hit[first:end] = np.bincount(words.row[hit], minlength=end - first)
        for row, names in found.items():
            items[first + row] = sorted(names)
    return n_words, n_hit, items


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 6,
    broadcast_bytes: int = 32 << 20,
    keep: tuple[str, ...] = (),
    names: tuple[str, str, str] = NAMES,
) -> DataFrame:
    """``id``, the ``keep`` columns, and under ``names`` the numbers of words and of words hit,
    and the sorted item ids found in each text.

    The benchmark's windows are sent to all executors if they hold at most ``broadcast_bytes``
    in memory (``HELD_PER_BYTE`` bounds that by the size of the texts). A larger benchmark is
    joined by fingerprint instead.
    """
    if not 1 <= k <= window:
        raise ValueError("k must be from 1 to window")
    kept = list(dict.fromkeys((id_col, *keep)))
    if clash := set(kept) & set(names):
        raise ValueError(f"columns {sorted(clash)} are kept; give other names")
    columns = [F.col(f"`{c}`") for c in kept]
    source = text_col if text_col in kept else "__text"  # a text that is kept is sent once
    rows = docs.select(*columns, *([] if source in kept else [F.col(f"`{text_col}`").alias(source)]))
    items = pick(benchmark, item=item_col, words=item_text_col).where("words is not null and item is not null")
    items = items.select(F.col("item").cast("string").alias("item"), F.encode("words", "UTF-8").alias("words")).where(F.length("words") > 0)
    size = items.agg(F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("n")).first()["n"]
    if size * HELD_PER_BYTE > broadcast_bytes:
        return _by_join(docs.select(*columns, F.col(f"`{text_col}`").alias("__text")), items, kept, window, k, names)
    prints = docs.sparkSession.sparkContext.broadcast(
        Fingerprints(window, k).add([(r["item"], bytes(r["words"])) for r in items.collect()])
    )
    out = docs.select(*[F.col(f"`{c}`") for c in kept]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, found = _measure(batch, source, prints.value)
            arrays = [batch.column(c) for c in kept]
            arrays += [pa.array(n_words), pa.array(n_hit), pa.array(found, type=pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])

    return rows.mapInArrow(run, extended(out, _ddl(names)))


def _by_join(rows: DataFrame, items: DataFrame, kept: list[str], window: int, k: int, names: tuple[str, str, str]) -> DataFrame:
    """Fingerprints of both sides meet in a join; only texts that share one see its items."""

    def prints_of(key: str, text: str, wanted: list[int], screen: Broadcast | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(key)
                for first, end, data, offsets in text_slices(batch, text, _SLICE):
                    words = split_words(data, offsets)
                    for length in wanted:
                        marks = Fingerprints(window, k).fingerprint(words.code, length)
                        if not len(marks):
                            continue
                        row = words.row[: len(marks)]
                        inside = row == words.row[length - 1 :]
                        if key == "item":  # an item has windows of one length only
                            size = np.bincount(words.row, minlength=end - first)
                            inside &= np.minimum(size[row], window) == length
                        if screen is not None:  # nearly all marks that no item has end here
                            low = marks & U64((1 << SCREEN_BITS) - 1)
                            inside &= (screen.value[(low >> U64(6)).astype(np.int64)] >> (low & U64(63)) & U64(1)).astype(bool)
                        pairs = np.unique(np.stack([row[inside].astype(np.uint64), marks[inside]]), axis=1)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(first + pairs[0].astype(np.int64))), pa.array(np.full(pairs.shape[1], length, np.int32)), pa.array(pairs[1].view(np.int64))],
                            names=[key, "length", "mark"],
                        )

        return run

    tagged = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    items = cut(items)
    theirs = cut(items.mapInArrow(prints_of("item", "words", list(range(1, window + 1))), "item string, length int, mark long"))
    lengths = sorted(r["length"] for r in theirs.select("length").distinct().collect())  # ``window`` rows at most
    bits = theirs.select(F.col("mark").bitwiseAND(F.lit((1 << SCREEN_BITS) - 1)).alias("low"))
    words = bits.groupBy(F.shiftright("low", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 63 as int))")).alias("bits")).toArrow()
    screen = np.zeros(1 << SCREEN_BITS - 6, dtype=np.uint64)
    screen[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(screen)
    ours = tagged.select("__row", "__text").mapInArrow(prints_of("__row", "__text", lengths, shared), "__row long, length int, mark long")
    pairs = ours.join(theirs, ["length", "mark"]).select("__row", "item").distinct().join(items, "item")
    met = pairs.groupBy("__row").agg(F.collect_list(F.struct("item", "words")).alias("__met")).withColumnRenamed("__row", "__of")
    held = tagged.join(met, F.col("__row") == F.col("__of"), "left").drop("__row", "__of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, found = _measure(batch, "__text", Fingerprints(window, k))  # the words of all texts at once
            for i in np.flatnonzero(batch.column("__met").is_valid().to_numpy(zero_copy_only=False)).tolist():
                prints = Fingerprints(window, k).add([(m["item"], m["words"]) for m in batch.column("__met")[i].as_py()])
                _, hit, (found[i],) = _measure(batch.slice(i, 1), "__text", prints)
                n_hit[i] = hit[0]
            arrays = [*(batch.column(c) for c in kept), pa.array(n_words), pa.array(n_hit), pa.array(found, type=pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])

    return held.mapInArrow(run, extended(held.drop("__text", "__met").schema, _ddl(names)))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the registered query."""
    return found.select(
        F.col(f"`{id_col}`"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: DuckDB SQL for the registered query: every window of every text is compared.
ORACLE = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), sized AS (
    SELECT item_id, w, least(len(w), 10) AS n FROM item_words WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS span FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), doc_windows AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS span
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)
), hits AS (
    SELECT doc_id, n, i, item_id FROM doc_windows JOIN windows USING (n, span)
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
