import random

import duckdb
import pytest

import corpus_pipeline
from versionlog.llm import lines


def against_sql(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.sql(lines.ORACLE)
    got = lines.digest(lines.dedup_lines(df))
    assert sorted(got.columns) == sorted(found.columns)
    ours = sorted(tuple(r[c] for c in found.columns) for r in got.collect())
    assert ours == sorted(found.fetchall())


def test_documents(docs):
    against_sql(docs)


def test_repeated_chunks_of_lines(spark):
    block = "\n".join(f"line {i} of a block that several texts share" for i in range(12))
    rows = [(i, f"intro {i}\n{block}\noutro {i}") for i in range(8)] + [(90, block), (91, block), (92, ""), (93, None), (94, "\n\n\n\n"), (95, "\n\n\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    against_sql(df)
    out = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert out[0].text == rows[0][1]  # the first occurrence stays
    assert len(out[91].text) < 0.5 * len(block)  # single lines at its ends may stay
    assert out[93].text is None and out[92].text == ""
    assert len(out[5].text) < 0.5 * len(rows[5][1])
    assert lines.dedup_lines(df, broadcast_rows=0).orderBy("doc_id").collect() == lines.dedup_lines(df).orderBy("doc_id").collect()


def test_boundaries_resist_shifts(spark):
    block = [f"shared line {i}" for i in range(40)]
    rows = [(1, "\n".join(block)), (2, "\n".join(["one more line", *block]))]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 2").first()
    assert sum(r.n for r in out.removed) >= 20


def test_odd_rows_keep_their_columns(odd, nothing):
    out = lines.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "removed"]
    assert out.count() == odd.count()
    same = sorted(r.text for r in out.where("doc_id = 9").collect())
    assert len(set(same)) == 1  # rows equal in id and text are treated alike
    assert lines.dedup_lines(nothing).count() == 0


@pytest.mark.parametrize("every", [1, 2, 5])
def test_chunks_cover_all_lines(spark, every):
    text = "\n".join(str(i * i) for i in range(50))
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(lines.chunks(df["t"], every, 3).alias("c")).first().c
    assert [x for c in found for x in c.lines] == text.split("\n")
    assert [c["at"] for c in found] == [sum(len(d.lines) for d in found[:i]) for i in range(len(found))]


def test_native_plan(docs):
    plan = lines.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def without_repeated_runs(rows, length=2):
    """Lines covered by a run of ``length`` lines that occurred before."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        of = text.split("\n")
        gone = set()
        for at in range(len(of) - length + 1):
            run = tuple(of[at : at + length])
            if run in seen:
                gone.update(range(at, at + length))
            seen.add(run)
        out[i] = "\n".join(x for at, x in enumerate(of) if at not in gone)
    return out


def test_pipeline_removes_short_passages(spark):
    r = random.Random(4)
    passages = [[f"shared {p} {i}" for i in range(r.randrange(1, 5))] for p in range(30)]
    rows = [(i, "\n".join(x for _ in range(r.randrange(1, 6)) for x in [*r.choice(passages), f"own {i} {r.random()}"])) for i in range(60)]
    rows += [(70, "a\na\na\na"), (71, "a\nb\na\nb\na"), (72, ""), (73, "\n"), (74, "one line"), (75, "one line")]
    df = spark.createDataFrame([(*x, len(x[1])) for x in rows], "doc_id long, text string, n_chars long")
    want = without_repeated_runs(rows)
    got = corpus_pipeline.drop_repeated_lines(spark, df, "").collect()
    assert {x.doc_id: x.text for x in got} == want and len(got) == len(rows)
    assert all(x.n_chars == len(x.text) for x in got)
    few = {x.doc_id: x for x in lines.dedup_lines(df, windows=True, least_lines=3, broadcast_rows=0).collect()}
    assert {i: x.text for i, x in few.items()} == without_repeated_runs(rows, 3)


def test_windows_take_odd_rows(odd, nothing):
    out = lines.dedup_lines(odd, windows=True)
    assert out.count() == odd.count()
    assert out.where("doc_id = 1").first().text is None
    assert len({x.text for x in out.where("doc_id = 9").collect()}) == 1
    assert lines.dedup_lines(nothing, windows=True).count() == 0


def test_long_texts_take_linear_time(spark):
    import time

    n = 60_000
    block = "\n".join(f"line {i} of a long text" for i in range(n))
    df = spark.createDataFrame([(1, block), (2, block), (3, block + "\nand one more")], "doc_id long, text string")
    start = time.perf_counter()
    out = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert out[1] == block and len(out[2]) < 0.5 * len(block) and len(out[3]) < 0.5 * len(block)
    every = {r.doc_id: r.text for r in lines.dedup_lines(df, windows=True).collect()}
    assert every == {1: block, 2: "", 3: "and one more"}
    assert time.perf_counter() - start < 60


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a\nb", 5, "x"), (2, "a\nb", 6, "y")], "doc_id long, text string, n_lines int, removed string")
    with pytest.raises(ValueError):
        lines.dedup_lines(df)
    out = lines.dedup_lines(df, windows=True, details=("__n", "__gone")).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.removed, r["__n"], len(r["__gone"])) for r in out] == [("a\nb", 5, "x", 2, 0), ("", 6, "y", 2, 1)]
    assert lines.dedup_lines(df, details=None).columns == df.columns


def test_runs_are_merged(spark):
    df = spark.sql("select array(struct(0 as at, 2 as n), struct(1 as at, 2 as n), struct(5 as at, 2 as n), struct(7 as at, 2 as n)) as r")
    assert [tuple(x) for x in df.select(lines.merged("r").alias("m")).first().m] == [(0, 3), (5, 4)]
