import random

import numpy as np
import pytest
import xxhash

from versionlog.llm import simhash
from versionlog.llm.components import components


def slow_print(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_odd_rows(odd):
    from tests.llm.conftest import ODD

    got = simhash.digest(simhash.near_duplicates(odd)).collect()
    prints = [slow_print(t) for _, t in ODD]
    of = classes(prints)
    least = {c: min((i for (i, _), d in zip(ODD, of, strict=True) if d == c and i is not None), default=None) for c in of}
    want = sorted((i if i is not None else -1, f"{p:016x}", least[c]) for (i, _), p, c in zip(ODD, prints, of, strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got) == want


def test_documents(docs):
    rows = docs.select("doc_id", "text").collect()
    of = classes([slow_print(r.text) for r in rows])
    least = {}
    for r, c in zip(rows, of, strict=True):
        least[c] = min(r.doc_id, least.get(c, r.doc_id))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {r.doc_id: least[c] for r, c in zip(rows, of, strict=True)}


@pytest.mark.parametrize("limit", [2, 5, 2048])
def test_links_connect_what_is_within_reach(spark, limit):
    r = random.Random(limit)
    prints = set()
    for _ in range(12):  # clusters, and chains of small steps
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 14)):
            prints.add(x)
            for _ in range(r.randrange(0, 4)):
                x ^= 1 << r.randrange(64)
    prints = sorted(prints)
    signed = [(p - (p >> 63 << 64),) for p in prints]
    nodes = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in components(simhash.links(nodes, limit)).collect()}
    of = classes(prints)
    names = [roots.get(s[0], s[0]) for s in signed]
    assert all((of[i] == of[j]) == (names[i] == names[j]) for i in range(len(of)) for j in range(i))


def test_neighbour_lookup_equals_all_pairs():
    r = random.Random(3)
    base = r.getrandbits(64)
    prints = np.array(sorted({base ^ (r.getrandbits(24) & r.getrandbits(24)) for _ in range(7000)}), dtype=np.uint64)
    assert len(prints) > 5500

    def roots(links):
        root = {int(p): int(p) for p in prints}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in links.tolist():
            root[find(a)] = find(b)
        return len({find(int(p)) for p in prints})

    fast = roots(simhash.list_links(prints))
    pairs = [np.stack([prints[i + 1 :][m], np.full(m.sum(), prints[i])], axis=1) for i in range(len(prints)) if (m := np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3).any()]
    assert fast == roots(np.concatenate(pairs))


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table(nothing):
    assert simhash.digest(simhash.near_duplicates(nothing)).collect() == []


def test_very_long_texts(spark):
    text = " ".join(f"word{i % 1000}" for i in range(300_000))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "x" * 3_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.digest(simhash.near_duplicates(df)).collect()}
    assert got[1].fingerprint == f"{slow_print(text):016x}" and got[2].component_id == 1 and got[3].component_id == 3


def test_count_filter_and_bits_agree_with_plain_counts():
    g = np.random.default_rng(2)
    x = g.integers(0, 1 << 63, 3000, dtype=np.uint64)
    y = x ^ np.bitwise_or.reduce(np.uint64(1) << g.integers(0, 64, (3000, 4)).astype(np.uint64), axis=1)
    plain = [sum((a >> 8 * i & 255) == (b >> 8 * i & 255) for i in range(8)) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert simhash.shared_bytes(x ^ y).tolist() == plain
    want = [i for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)) if plain[i] >= 5 and (a ^ b).bit_count() <= 3]
    assert simhash._within(x, y, 3, 5).tolist() == want
