"""Toxic words against a brute-force version."""

import random
import re

import pytest

from versionlog.llm import quality, toxic
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def bound(hits, others):
    n, zz = hits + others, 1.96**2
    p = hits / n
    return (p + zz / (2 * n) - 1.96 * (p * (1 - p) / n + zz / (4 * n * n)) ** 0.5) / (1 + zz / n)


def brute(rows, labels, share=0.9):
    bad = {i for i, x in labels if x == 1 and i is not None}
    good = {i for i, x in labels if x == 0 and i is not None} - bad
    owner, clean = {}, {}
    for i, text in rows:
        found = words(text)
        if i in bad:
            for pair in zip(["", *found], found):
                owner[pair] = min(i, owner.get(pair, i))
        if i in good:
            for w in set(found):
                clean[w] = clean.get(w, 0) + 1
    owners = {}
    for (_, w), i in owner.items():
        owners.setdefault(w, set()).add(i)
    return {w: (len(s), clean.get(w, 0)) for w, s in owners.items() if bound(len(s), clean.get(w, 0)) >= share}


@pytest.fixture(scope="module")
def made():
    r = random.Random(5)
    plain = [a + b + c for a in ("ta", "lo", "mi", "ñu", "ße", "ra") for b in ("re", "na", "sol", "dim", "ör", "pek") for c in ("", "lu", "va", "ki", "ëm", "to")]

    def text(extra=()):
        out = [r.choice(plain) for _ in range(60)]
        for w in extra:
            out.insert(r.randrange(len(out)), w)
        return " ".join(out).capitalize()

    rows = [(i, text()) for i in range(300)]
    rows += [(1000 + i, text(r.sample(["Slurp", "gnarf", "BLÖRK"], 2))) for i in range(150)]
    copied = text(["rarely", "rarely", "rarely"])
    rows += [(2000 + i, copied) for i in range(100)]  # copies of one toxic text: no evidence about its words
    rows += [(3000 + i, text(["seldom"])) for i in range(60)]  # in toxic and in clean texts
    rows += [(4000, text(["gnarf"])), (4001, "a Gnarf."), (4002, "gnarfing"), (None, "slurp"), (0, "x slurp"), (0, "x slurp")]
    labels = [(i, 0) for i in range(300)] + [(1000 + i, 1) for i in range(120)] + [(2000 + i, 1) for i in range(100)]
    labels += [(3000 + i, i % 2) for i in range(60)] + [(None, 1), (5, None), (1000, 0), (77777, 1)]
    return rows + [(9000 + k, t) for k, (_, t) in enumerate(ODD)], labels


@pytest.mark.parametrize("limit", [0, 32 << 20])
def test_against_brute_force(spark, made, limit):
    rows, labels = made
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    marks = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, toxic int, id int")
    got = toxic.lexicon(df, marks, broadcast_bytes=limit)
    want = brute(rows, labels)
    assert {r.word: (r.owners, r.clean) for r in got.collect()} == want
    assert {w for w in want if w.isascii()} <= {"slurp", "gnarf"} and "gnarf" in want and "rarely" not in want and "seldom" not in want
    held = toxic.holders(df, got, broadcast_bytes=limit)
    assert sorted(str(r.id) for r in held.collect()) == sorted({str((i, t)): str(i) for i, t in rows if set(words(t)) & set(want)}.values())


def test_column_of_the_classifier(spark, made):
    rows, labels = made
    df = spark.createDataFrame([(i, t, "xx") for i, t in rows], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int")
    got = quality.classify(df, marks).collect()
    told = set(brute(rows, labels))
    assert len(got) == len(rows)
    assert sorted(str(r.doc_id) for r in got if r.toxic) == sorted(str(i) for i, t in rows if told & set(words(t)))
    assert not any(r.toxic for r in got if r.doc_id is not None and 0 < r.doc_id < 300)
    few = spark.createDataFrame([(i, 1, x) for i, x in labels if i is not None and i < 1030], "doc_id long, quality int, toxic int")
    assert not any(r.toxic for r in quality.classify(df, few).collect())  # 30 toxic texts are too few


def test_empty_tables(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, toxic int")
    assert toxic.lexicon(nothing, labels).count() == 0
    assert toxic.lexicon(odd, labels.limit(0)).count() == 0
    assert toxic.holders(odd, toxic.lexicon(odd, labels)) is None
    told = spark.createDataFrame([("words",), ("aaa",)], "word string")
    assert [r.id for r in toxic.holders(odd, told).collect()] == [6] and toxic.holders(nothing, told).count() == 0


def test_very_long_texts(spark):
    rows = [(1, "one two three " * 400_000 + "told"), (2, "x" * 5_000_000), (3, "told" + " y" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.id for r in toxic.holders(df, spark.createDataFrame([("told",)], "word string")).collect()) == [1, 3]


def test_pipeline_drops_toxic_documents(spark, made, monkeypatch):
    import corpus_pipeline

    rows, labels = made
    df = spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: marks)
    out = {(r.doc_id, r.text) for r in corpus_pipeline.keep_quality(spark, df, "").collect()}
    judged = quality.classify(df, marks).where("not rejected and not toxic").select("doc_id").collect()
    told = set(brute(rows, labels))
    assert {i for i, _ in out} == {r.doc_id for r in judged} and not any(told & set(words(t)) for _, t in out)
    assert (4002, "gnarfing") in out
