import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from versionlog.llm import packing

JSON = packing.vocabulary("byte_bpe_50k.json")


def check(rows, texts, window, end_id=0):
    """Every id once, in order; sequences without gaps."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    tokenizer = Tokenizer.from_file(JSON)
    want = sorted((i, end_id, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id])) for i, t in texts)
    crcs = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    expected = sorted(
        (i, s, min(window, len(ids) - s), zlib.crc32(np.array(ids[s : s + window], "<u4").tobytes()), len(ids))
        for i, _, ids in want
        for s in range(0, len(ids), window)
    )
    assert crcs == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


def test_odd_rows_and_repeats(odd):
    from tests.llm.conftest import ODD

    rows = packing.pack(odd.where("doc_id is not null"), tokenizer=JSON, window=64).collect()
    check(rows, [x for x in ODD if x[0] is not None], 64)
    assert packing.pack(odd, tokenizer=JSON).where("doc_id is null").count() == 1


def test_documents_fill_their_sequences(docs):
    rows = packing.pack(docs, tokenizer=JSON).collect()
    n = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 1024)
    assert n <= 1.06 * sum(r.length for r in rows) / 1024 + 1


def test_empty_table(nothing):
    assert packing.pack(nothing, tokenizer=JSON).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=17, max_size=17))
def test_plan_places_each_piece_once(counts):
    hist = np.array(counts)
    hist[0] = 0
    plan = packing.solve(hist, 16)
    total = int(hist.sum())
    sequence, offset = plan.place(np.arange(total))
    length = np.repeat(np.arange(17), hist)
    filled = {}
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
        filled.setdefault(s, []).append((o, n))
    assert len(filled) == plan.sequences
    for pieces in filled.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 16


def test_least_squares_solves_an_exact_mixture():
    from collections import Counter

    hist = np.zeros(11)
    for pattern, times in (((4, 6), 30), ((2, 3, 5), 12)):
        for n in pattern:
            hist[n] += times
    x = packing.least_squares([Counter((4, 6)), Counter((2, 3, 5)), Counter((2, 2, 6))], hist, 200)
    assert x.round().tolist() == [30, 12, 0]


TEXTS = ["", "<|endoftext|> is text", "it's  two   spaces \n\n tabs\t\tend ", "x" * 3000, "naïve café 你好世界 🙂🙂", "a b " * 70_000, "1234 5678,90", " lead", "trail ", "a" + " " * 5000 + "b c", "x" + "\n" * 9000 + "\ty" + " " * 4096]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_library(text):
    assert packing.encode(text, JSON).tolist() == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


LIBRARY = Tokenizer.from_file(JSON)
PIECES = st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "<|", " ", "  ", "\n", "\t", "'s", "'LL", "don't", "12", "é", "🙂", "你好", "word", " Word", "\u00a0", "\u3000", "a\u0301", "_", "--", "\x00", "\u2028"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(PIECES, max_size=20).map("".join), st.text(max_size=60)))
def test_any_text_has_the_ids_of_the_library(text):
    assert packing.encode(text, JSON).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_control_strings_are_single_ids(spark):
    assert packing.encode("a<|endoftext|>b", JSON).tolist() == [64, 50256, 65]
    df = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, "<|endoftext|>" * 300)], "doc_id long, text string")
    check(packing.pack(df, tokenizer=JSON).collect(), [(r.doc_id, r.text) for r in df.collect()], 1024)


def test_other_vocabularies_are_read_by_the_library(tmp_path):
    import json

    spec = json.load(open(JSON, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    assert packing._ranks(spec) is None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    text = "some words <|endoftext|> and more"
    assert packing.encode(text, str(path)).tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def test_very_long_white_space():
    assert len(packing.encode(" " * 300_000 + "a", JSON)) > 1000


def test_all_combinations_are_planned():
    hist = np.zeros(1025, dtype=np.int64)
    hist[1:1024] = 30000
    window = 1024
    want = {(a, window - a) for a in range(1, window // 2 + 1)}
    want |= {(a, b, window - a - b) for a in range(1, window) for b in range(a, window) if window - a - b >= b}
    assert set(packing.combinations_of(hist, window)) == want
