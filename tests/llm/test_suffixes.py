import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from versionlog.llm import suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[a : a + length] for x in data for a in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x) + 1, bool)
        for a in range(len(x) - length + 1):
            if seen[x[a : a + length]] > 1:
                gone[a : a + length] = True
        gone = gone[: len(x)]
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        starts = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(x), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def run(df, **options):
    found = suffixes.digest(suffixes.remove_repeats(df, **options))
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())


def expected(rows, length=suffixes.LENGTH):
    return sorted((-1 if i is None else i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], length), strict=True))


def test_odd_rows(odd):
    from tests.llm.conftest import ODD

    assert run(odd) == expected(ODD)


def test_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == expected(rows)


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 200}, {"bucket_rows": 2}])
def test_random_pieces_with_small_buckets(spark, options):
    r = random.Random(7)
    pieces = ["".join(r.choice("ab cé") for _ in range(r.randrange(5, 60))) for _ in range(12)]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randrange(0, 9)))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df, length=20, q=8, **options) == expected(rows, 20)


def test_empty_table(nothing):
    assert run(nothing) == []


def test_long_texts_are_read_in_segments(monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 100)
    monkeypatch.setattr(suffixes, "MAX_RUN", 7)
    data = np.frombuffer(bytes(random.Random(1).choice(b"ab") for _ in range(950)), np.uint8)
    found = list(suffixes.runs(data, 40, 8))
    assert sum(n for *_, n, _ in found) == 950 - 40 + 1
    starts = [f for _, _, f, _, _ in found]
    assert starts == sorted(starts)


def test_identifiers_at_depth_name_equal_strings():
    data = np.frombuffer(b"abcabcabdabcabcabd" * 3, np.uint8)
    for length in (1, 5, 8, 13, 20):
        ids = suffixes.refine(data, length)
        names = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
        assert len(ids) == len(names)
        assert all((ids[i] == ids[j]) == (names[i] == names[j]) for i in range(len(names)) for j in range(i))


def test_settled_suffixes_leave_and_names_stay_apart():
    r = random.Random(5)
    for _ in range(60):
        pieces = [bytes(r.choice(b"abc") for _ in range(r.randrange(1, 40))) for _ in range(4)]
        data = np.frombuffer(b"".join(r.choice(pieces) for _ in range(r.randrange(1, 12))), np.uint8)
        for length in (3, 9, 24, 37):
            if len(data) < length:
                continue
            ids = suffixes.refine(data, length).tolist()
            names = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
            assert len(set(zip(ids, names, strict=True))) == len(set(ids)) == len(set(names))


def test_very_long_texts(spark):
    r = random.Random(9)
    shared = "".join(r.choice("abcdefgh ") for _ in range(1000))
    text = "".join(r.choice("abcdefgh ") for _ in range(2_000_000))
    rows = [(1, text[:700_000] + shared + text[700_000:]), (2, shared), (3, "ab" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"bucket_bytes": 1000}):
        got = {x[0]: x[1:4] for x in run(df, **options)}
        assert got == {1: (2_001_000, 1000, 1), 2: (1000, 1000, 1), 3: (600_000, 600_000, 1)}
