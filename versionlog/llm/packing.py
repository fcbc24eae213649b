"""Packing of tokenized documents into sequences, planned by non-negative least squares.

A document's ids (and the id that ends it) are cut into pieces of ``window`` ids and a rest.
The histogram of piece lengths, which has ``window`` bins whatever the size of the corpus, is
all the plan needs: combinations of two or three lengths that fill a window exactly are
enumerated, non-negative least squares finds how often to repeat each so that their lengths
add up to the histogram, the counts are rounded down to what is there, and the residual
pieces are packed greedily, longest first.

Pieces get a global number in the order (length, id, start), so each planned place is a range
of numbers, and a piece finds its sequence and offset by a lookup in the plan. Sequences are
padded to ``window``. Null and empty texts have only the ending id. Very long texts are encoded
whole, part by part. Rows repeated in the input are packed as often, ties in the order of pieces
are broken by all their columns, and an empty table has no pieces. Other columns of the input
are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import cut, extended, pick
from versionlog.llm.sharding import number_rows

# Fixed value: the pattern by which byte-level BPE vocabularies of this kind split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1
    characters stand for themselves, and the other bytes, in order, are written from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """The vocabulary as ranks, with its control strings, if that gives the same ids: a byte-level
    BPE whose merges are in the order of their ids, and control strings matched as they stand."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    plain = plain and model["type"] == "BPE" and spec["normalizer"] is None
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    control = spec["added_tokens"]
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in control):
        return None
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(model["vocab"]) != 256 + len(merged):
        return None
    of = byte_of_char()
    return {bytes(of[c] for c in word): n for word, n in model["vocab"].items()}, {t["content"]: t["id"] for t in control}


@lru_cache(maxsize=2)
def encoder(path: str):
    """Two functions, from a text and from a single piece of a text to ids, for the .json file of a tokenizer.

    Ids are those of the ``tokenizers`` library, control strings included. A plain byte-level BPE
    is encoded from its ranks, which is several times faster; any other file by the library.
    """
    with open(path, encoding="utf-8") as f:
        found = _ranks(json.load(f))
    if found is not None:
        import tiktoken

        ranks, control = found
        known = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=control)
        every = set(control)
        return (lambda text: known.encode(text, allowed_special=every, disallowed_special=())), known._encode_single_piece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    return ids, ids


#: A text is encoded in parts of about so many characters, cut where a word begins after a
#: single space, which no merge crosses.
PART = 1 << 16
#: A run of white space this long is encoded by itself: matching it overflows the stack of the
#: pattern's engine. It is one piece but for its last character, if a text goes on after it.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART:
        cut = text.find(" ", at + PART)
        while cut != -1 and not (cut + 1 < len(text) and text[cut + 1].isalpha() and text[cut - 1].isalnum()):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(text: str, path: str) -> array:
    ids = array("I")
    run, run_piece = encoder(path)
    for part in _parts(text):
        at = 0
        for white in _WHITE.finditer(part):
            end = white.end() - (white.end() < len(part))
            ids.extend(run(part[at : white.start()]))
            ids.extend(run_piece(part[white.start() : end]))
            at = end
        ids.extend(run(part[at:]))
    return ids


def pieces(docs: DataFrame, *, id_col: str, text_col: str, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document's pieces."""
    rows = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, start, length, crc, total = [], array("q"), array("q"), array("q"), array("q")
            for i, text in enumerate(batch.column("text")):
                ids = encode(text.as_py() or "", tokenizer)
                ids.append(end_id)
                raw, n = memoryview(ids.tobytes()), len(ids)
                for s in range(0, n, window):
                    size = min(window, n - s)
                    where.append(i)
                    start.append(s)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + size)]))
                    total.append(n)
            ids_of = batch.column("id").take(pa.array(where, pa.int64()))
            arrays = [ids_of, *(pa.array(np.frombuffer(x, np.int64)) if len(x) else pa.array([], pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(run, extended(rows.select("id").schema, "start long, length long, ids_crc32 long, doc_tokens long"))


def combinations_of(hist: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """All pairs and triples of present lengths that fill the window, the best supplied first.

    There are about window**2 / 12 at most (87893 for 1024).
    """
    have = np.flatnonzero(hist)
    found: list[tuple[float, tuple[int, ...]]] = []
    for a in have:
        b = window - a
        if a <= b and hist[b]:
            found.append((min(hist[a], hist[b]), (int(a), int(b))))
    for i, a in enumerate(have):
        b = have[i:]
        c = window - a - b
        ok = (c >= b) & (c > 0)
        b, c = b[ok], c[ok]
        ok = hist[c] > 0
        b, c = b[ok], c[ok]
        for x, y in zip(b.tolist(), c.tolist(), strict=True):
            found.append((min(hist[a], hist[x], hist[y]) / 3, (int(a), x, y)))
    found.sort(key=lambda f: (-f[0], f[1]))
    return [p for _, p in found]


def least_squares(columns: list[Counter], target: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative x that brings the sum of x[j] * columns[j] near the target (coordinate descent)."""
    x = np.zeros(len(columns))
    rest = target.astype(float).tolist()
    flat = [(list(c.items()), sum(v * v for v in c.values())) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, (items, norm) in enumerate(flat):
            step = max(sum(v * rest[length] for length, v in items) / norm, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for length, v in items:
                    rest[length] -= step * v
        if moved < 0.25:
            break
    return x


@dataclass
class Plan:
    """Places in the order of piece numbers: from ``first`` on, sequence and offset."""

    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    repeated: list[tuple[tuple[int, ...], int]]

    def place(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.first, number, side="right") - 1
        return self.sequence[at] + number - self.first[at], self.offset[at]


def solve(hist: np.ndarray, window: int, sweeps: int = 60) -> Plan:
    """The plan for ``hist[length]`` pieces of each length from 1 to ``window``."""
    left = hist.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], times: int) -> None:
        need = Counter(pattern)
        times = min([times, *(int(left[n]) // k for n, k in need.items())])
        if times > 0:
            patterns.append((pattern, times))
            for n, k in need.items():
                left[n] -= k * times

    use((window,), int(left[window]))
    chosen = combinations_of(left, window)
    x = least_squares([Counter(p) for p in chosen], left, sweeps)
    for j in np.argsort(-x, kind="stable"):
        use(chosen[j], int(x[j] + 0.5))
    while left.any():  # residuals: the longest piece first, then the longest that still fits
        pattern, room, used = [], window, Counter()
        sizes = np.flatnonzero(left)[::-1].tolist()
        for n in sizes:
            fits = min(room // n, int(left[n]))
            if fits:
                pattern += [n] * fits
                used[n] = fits
                room -= n * fits
        use(tuple(pattern), min(int(left[n]) // k for n, k in used.items()))
    base = np.concatenate([[0], np.cumsum(hist)])[:-1]  # number of the first piece of each length
    first, sequence, offset, start = [], [], [], 0
    taken = np.zeros(len(hist), dtype=np.int64)
    for pattern, times in patterns:
        at = 0
        for n in pattern:
            first.append(base[n] + taken[n])
            sequence.append(start)
            offset.append(at)
            taken[n] += times
            at += n
        start += times
    order = np.argsort(np.array(first, dtype=np.int64), kind="stable")
    return Plan(*(np.array(v, dtype=np.int64)[order] for v in (first, sequence, offset)), start, patterns)


def pack(
    docs: DataFrame,
    *,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 1024,
    end_id: int = 0,
) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    # written once: finding the ranges would tokenize everything a second time
    held = cut(pieces(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, window=window, end_id=end_id))
    numbered, _ = number_rows(held, "length", "id", "start", "ids_crc32", "doc_tokens")
    hist = np.zeros(window + 1, dtype=np.int64)
    for r in numbered.groupBy("length").count().collect():  # ``window`` rows at most
        hist[r["length"]] = r["count"]
    plan = solve(hist, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column("row").to_numpy(zero_copy_only=False))
            kept = [n for n in batch.schema.names if n != "row"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = extended(numbered.drop("row").schema, "sequence_id long, offset long")
    return numbered.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


__all__ = ["encode", "pack", "pieces", "solve", "vocabulary"]
