import zlib
from collections import Counter

import numpy as np
import pytest

from versionlog.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    image = sharding.permute(np.arange(n), n, seed=5)
    assert sorted(image.tolist()) == list(range(n))


def test_shuffles_and_depends_on_the_seed():
    a, b = (sharding.permute(np.arange(5000), 5000, seed) for seed in (1, 2))
    assert (a == b).mean() < 0.01 and (a == np.arange(5000)).mean() < 0.01
    assert abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.1


def check(df, shards, rows):
    got = sharding.digest(sharding.assign_shards(df, shards=shards)).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    return {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in got}


def test_documents_are_placed_alike_however_they_are_split(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = check(docs, 16, rows)
    assert first == check(docs.repartition(7), 16, rows)
    numbers = {i: n for n, i in enumerate(sorted(i for i, _ in rows))}
    for (i, _), place in first.items():  # computable from the row number alone
        shard, slot = sharding.place(np.array([numbers[i]]), len(rows), 16, 20240229)
        assert (shard[0], slot[0]) == place


def test_odd_rows_and_empty_table(odd, nothing):
    from tests.llm.conftest import ODD

    check(odd, 4, ODD)
    assert sharding.digest(sharding.assign_shards(nothing)).collect() == []
