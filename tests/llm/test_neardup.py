import random

import numpy as np
import pytest

from versionlog.llm import neardup, simhash
from versionlog.llm.components import components


def classes(rows, similarity=0.8, words=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if rows[i][1] == rows[j][1] or both >= similarity * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"edit{r.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("options", [{}, {"group_limit": 3}, {"list_limit": 8, "broadcast_rows": 0}, {"list_limit": 2}, {"list_limit": 16}])
def test_near_copies(spark, options):
    r = random.Random(11)
    rows = []
    for _ in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 300))]
        for _ in range(r.randrange(1, 9)):
            rows.append((len(rows), edited(r, words, r.choice([0, 0, 1, 1, 2, 30]))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.id: x.component_id for x in neardup.near_duplicates(df, **options).collect()}
    of = classes(rows)
    wrong = sum((of[i] == of[j]) != (got[i] == got[j]) for i in range(len(rows)) for j in range(i))
    assert wrong == 0
    kept = neardup.keep_one(df, **options).collect()
    assert sorted(x.doc_id for x in kept) == sorted({min(i for i, c in enumerate(of) if c == d) for d in of})


def test_odd_rows(odd, nothing):
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((x.doc_id is None, x.doc_id) for x in kept.collect())
    assert ids == [(False, 1), (False, 4), (False, 6), (False, 7), (False, 8), (True, None)]
    assert neardup.keep_one(nothing).collect() == []


def test_links_of_a_list_span_it():
    g = np.random.default_rng(5)
    base = g.integers(0, 1 << 62, dtype=np.uint64)
    flips = (np.uint64(1) << g.integers(0, 64, (40, 3)).astype(np.uint64))
    prints = base ^ np.bitwise_xor.reduce(flips, axis=1)
    pairs = simhash.spanning(prints, neardup.REACH, neardup.LEAST)
    assert len(pairs) < len(prints)
    seen, todo = {0}, [0]
    while todo:
        node = todo.pop()
        for a, b in pairs.tolist():
            for x, y in ((a, b), (b, a)):
                if x == node and y not in seen:
                    seen.add(y)
                    todo.append(y)
    assert len(seen) == len(prints)


def test_groups_are_verified_exactly():
    r = random.Random(8)
    base = [r.getrandbits(60) for _ in range(40)]
    sets = [np.unique(np.array([x if r.random() > e else r.getrandbits(60) for x in base[: r.randrange(1, 41)]], np.uint64)) for e in [0.0, 0.02, 0.1, 0.3] * 30]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if neardup.jaccard(sets[i], sets[j]) >= 0.8 - 1e-12:
                root[find(i)] = find(j)
    want = [find(i) for i in range(len(sets))]
    root = list(range(len(sets)))
    for a, b in neardup.verified(sets, 0.8):
        assert neardup.jaccard(sets[a], sets[b]) >= 0.8 - 1e-12
        root[find(a)] = find(b)
    have = [find(i) for i in range(len(sets))]
    assert all((want[i] == want[j]) == (have[i] == have[j]) for i in range(len(sets)) for j in range(i))


def test_large_groups_keep_all_links(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = [(i, edited(r, words[: r.choice([150, 200])], r.randrange(1, 7))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    of = classes(rows)
    for options in ({"group_limit": 100}, {"group_bytes": 1 << 17}):
        got = {x.id: x.component_id for x in neardup.near_duplicates(df, **options).collect()}
        assert len(set(got.values())) == len(set(of))
        assert len({(of[i], got[i]) for i in range(len(rows))}) == len(set(of))


def test_a_joined_group_is_not_dealt_in_pairs(spark):
    """Blocks of one label alone never meet; every other two sets of near sizes do."""
    rows = [(i, 0, 5 if i < 1000 else 6, 0, 80) for i in range(1200)]  # one label, two classes
    rows += [(2000 + i, 0, 5, 2000 + i, 80) for i in range(9)] + [(3000 + i, 1, 5, 3000, 80) for i in range(400)]
    sets = spark.createDataFrame(rows, "node long, root long, class long, label long, bytes long")
    placed, tasks = neardup.dealt(sets, 100, 1 << 20)
    block, pairs = {r.node: r.block for r in placed.collect()}, {(r.x, r.y) for r in tasks.collect()}
    assert len(block) == len(rows) and len(pairs) <= 1 + 1000 // 50 + 200 // 50
    for n, root, kind, label, _ in rows:
        for i in range(9):
            if root == 0 and label != 2000 + i:
                assert {(block[n], block[2000 + i]), (block[2000 + i], block[n])} & pairs


def test_long_lists_compare_all_pairs(spark):
    g = np.random.default_rng(9)
    prints = g.integers(0, 1 << 63, 150, dtype=np.uint64) >> np.uint64(24) << np.uint64(24) | np.uint64(0x123456)
    flips = np.uint64(sum(1 << (8 * i + 1) for i in range(3, 8)))  # partners share the three bytes of their list only
    both = np.concatenate([prints, prints ^ flips]).view(np.int64).tolist()
    nodes = spark.createDataFrame([(i, [x]) for i, x in enumerate(both)], "node long, prints array<long>")
    for options in ({}, {"broadcast_rows": 0}):
        found = {(r.a, r.b) for r in neardup.candidates(nodes, 20, **options).collect()}
        assert {(i, i + 150) for i in range(150)} <= found


def test_contracted_links_have_the_same_classes(spark):
    r = random.Random(2)
    pairs = sorted({tuple(sorted((r.randrange(300), r.randrange(300)))) for _ in range(260)} - {(i, i) for i in range(300)})
    df = spark.createDataFrame(pairs, "a long, b long")
    few = neardup.contracted(df)
    assert {x.node: x.root for x in components(few).collect()} == {x.node: x.root for x in components(df).collect()}
    hub = [(a, b) for b in range(50, 400) for a in range(0, 50, 7)]  # each member with all representatives
    assert neardup.contracted(spark.createDataFrame(hub, "a long, b long")).count() <= 350 + 8


@pytest.mark.parametrize("limit", [2048, 2, 8, 16])
def test_planted_near_copies_are_found(spark, limit):
    """Two texts each, of a similarity from 0.8 on, at any length of lists that are split."""
    r = random.Random(17)
    rows = []
    while len(rows) < 300:
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(80, 400))]
        pair = [" ".join(words), edited(r, words, r.randrange(1, 1 + len(words) // 30))]
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in pair)
        if len(a & b) >= 0.8 * len(a | b):
            rows += [(len(rows) + i, t) for i, t in enumerate(pair)]
    got = {x.id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), list_limit=limit).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, 300, 2)) >= 0.98 * 150
    assert len(set(got.values())) >= 150


def test_very_long_texts_and_clashing_names(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(10**6)}" for _ in range(400_000)]
    rows = [(1, " ".join(words), 5, "x"), (2, edited(r, words, 100), 6, "y"), (3, " ".join(words[:1000]), 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int, component_id string")
    assert [(x.doc_id, x.digest, x.component_id) for x in neardup.keep_one(df).orderBy("doc_id").collect()] == [(1, 5, "x"), (3, 7, "z")]
