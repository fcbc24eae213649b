import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from versionlog.llm import quality


def slow_model(texts, order):
    """Interpolated modified Kneser-Ney, count by count."""
    counts = {order: Counter()}
    for t in texts:
        padded = b"\0" * (order - 1) + t
        for i in range(len(t)):
            counts[order][padded[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n = Counter(c.values())
        discounts[k] = (0.0, *quality.Discounts.of(n[1], n[2], n[3], n[4]).values)
    context = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            context[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        lower = p(g[1:])
        mine = context[k].get(g[:-1])
        if not mine:
            return lower
        n = counts[k].get(g, 0)
        spare = sum(discounts[k][min(m, 3)] for m in mine)
        return (n - discounts[k][min(n, 3)] + spare * lower) / sum(mine)

    return p


@pytest.mark.parametrize("order", [3, 5])
def test_costs_equal_the_slow_model(spark, docs, order, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.limit(40).collect()]
    trained, asked = rows[:25], [*rows[20:28], (900, "zz unseen \x01 Ω"), (901, ""), (902, None)]
    model = quality.fit(spark.createDataFrame(trained, "doc_id long, text string"), order=order)
    df = spark.createDataFrame([(*r, "en") for r in asked], "doc_id long, text string, lang string").coalesce(1)
    got = {r.id: (r.n_bytes, r.cost) for r in quality.score(df, model, shards=7).collect()}
    p = slow_model([t.encode() for _, t in trained], order)
    known = {}
    for i, t in asked:
        data = (t or "").encode()
        padded = b"\0" * (order - 1) + data
        cost = 0
        for j in range(len(data)):
            g = padded[j : j + order]
            if g not in known:
                known[g] = round(-math.log(p(g)) * quality.SCALE)
            cost += known[g]
        assert got[i][0] == len(data)
        assert abs(got[i][1] - cost) <= 1 + len(data) * 0.01, i
    for lanes in (1, 3):  # several blocks, with copies of each shard
        monkeypatch.setattr(quality, "BLOCK", 3000)
        again = {r.id: (r.n_bytes, r.cost) for r in quality.score(df, model, shards=5, lanes=lanes).collect()}
        assert again == got
    total = sum(p(rows[0][1].encode()[:order - 1] + bytes([b])) for b in range(256))
    assert total == pytest.approx(1)


def test_grams_in_pieces(monkeypatch):
    data = np.frombuffer(b"abcdefghij" * 5, np.uint8)
    offsets = np.array([0, 3, 3, 20, 41, 50])
    whole = quality.grams_of(data, offsets, 5)
    monkeypatch.setattr(quality, "BLOCK", 7)
    parts = list(quality._pieces(data, offsets, 5))
    assert np.array_equal(np.concatenate([g for _, g in parts]), whole)
    assert [a for a, _ in parts] == list(range(0, 50, 7))
    for found, want in zip(quality.counted(data, offsets, 5), np.unique(whole, return_counts=True), strict=True):
        assert np.array_equal(found, want)


def test_junk_is_rejected_and_clean_text_stays(spark):
    r = random.Random(2)
    words = ["the", "of", "reading", "water", "mountain", "story", "quiet", "little", "house", "river", "walked", "under"]
    clean = [(i, " ".join(r.choice(words) for _ in range(r.randrange(20, 80))), "en") for i in range(400)]
    junk = [(1000 + i, "".join(chr(r.randrange(33, 126)) for _ in range(300)), "en") for i in range(20)]
    odd = [(2000, None, "en"), (2001, "", None), (2002, "anything at all #@!", "xx"), (2003, "the", "en"), (None, "the river", "en")]
    df = spark.createDataFrame(clean + junk + odd + clean[:3], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 400, 2)] + [(1000, 0, 0), (None, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == df.count()
    assert {x.doc_id for x in got if x.rejected} == {1000 + i for i in range(20)}
    by = {x.doc_id: x for x in got}
    assert by[2000].perplexity is None and by[2002].threshold is None and by[2001].n_bytes == 0
    assert quality.classify(df.limit(0), labels).collect() == []
    assert not any(x.rejected for x in quality.classify(df, labels.limit(0)).collect())


def test_labels_sort_the_documents(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r.rejected for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    kept = [not got[i] for i, q in good.items() if q == 1]
    gone = [got[i] for i, q in good.items() if q == 0]
    assert sum(kept) >= 0.97 * len(kept) and sum(gone) >= 0.6 * len(gone)


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    import corpus_pipeline

    r = random.Random(2)
    words = ["the", "of", "reading", "water", "mountain", "story"]
    rows = [(i, " ".join(r.choice(words) for _ in range(60)), "en", "s", 0) for i in range(200)]
    junk = "".join(chr(r.randrange(33, 126)) for _ in range(len(rows[7][1])))
    rows.append((7, junk, "en", "s", 0))  # the same id and length as a clean one
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    judged = quality.classify(df, spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int"))
    assert [x.doc_id for x in judged.collect() if x.rejected] == [7]
    assert judged.where("doc_id = 7").count() == 2
    corpus_pipeline.table, kept = (lambda *_: spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")), corpus_pipeline.table
    try:
        out = [x.text for x in corpus_pipeline.keep_quality(spark, df, "").where("doc_id = 7").collect()]
    finally:
        corpus_pipeline.table = kept
    assert out == [rows[7][1]]
