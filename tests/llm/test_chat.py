import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from versionlog.llm import chat, registry

TEXT = st.text(st.sampled_from("<|>\\n\n imend_start ab|>é🙂"), max_size=30)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_round_trip(messages):
    given_ = [chat.Message("assistant" if len(r) % 2 else r, t) for r, t in messages]
    text, spans = chat.render(given_)
    assert chat.parse(text) == given_
    assert [chat.unescape(text[a:b]) for a, b in spans] == [m.text for m in given_ if m.role == "assistant"]
    assert text.count("<|im_start|>") == len(given_)


def test_fold():
    log = [
        ("message", "user", "hi", None),
        ("delta", "assistant", "he", None),
        ("delta", "assistant", "llo", None),
        ("edit", "user", "hi there", 0),
        ("regenerate", "", "", None),
        ("delta", "assistant", "good ", None),
        ("delta", "assistant", "day", None),
        ("edit", "user", "lost", 9),
        ("delta", "user", "bye", None),
    ]
    assert [(m.role, m.text) for m in chat.fold(log)] == [("user", "hi there"), ("assistant", "good day"), ("user", "bye")]
    assert chat.fold([]) == [] and chat.fold([("regenerate", "", "", None)]) == []
    with pytest.raises(ValueError):
        chat.fold([("other", "", "", None)])


def test_logs_with_events_of_all_kinds(spark):
    rows = [
        (1, 3, "delta", "assistant", "lo", None),
        (1, 2, "delta", "assistant", "hel", None),
        (1, 1, "message", "user", "hi", None),
        (1, 4, "edit", None, "hi!", 0),
        (2, 1, None, None, None, None),
        (None, 1, "message", "user", "x", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, kind string, role string, text string, target int").repartition(3)
    log = chat.events(df, kind_col="kind", target_col="target")
    got = {r.conv: chat.parse(r.formatted) for r in chat.format_chats(log).collect()}
    assert got == {1: [chat.Message("user", "hi!"), chat.Message("assistant", "hello")], 2: [chat.Message("", "")], None: [chat.Message("user", "x")]}


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    want = con.sql(registry.ORACLES["op9_chat"])
    got = registry.QUERIES["op9_chat"](spark, path)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_one_very_long_conversation_repeated_rows_and_empty_table(spark):
    rows = spark.range(30_000).selectExpr("7L as conv_id", "id % 15000 as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "'same' as text", "1 as conv")
    out = chat.digest(chat.format_chats(chat.events(rows))).collect()
    assert len(out) == 1 and out[0].n_turns == 30_000 and out[0].loss_chars == 4 * 15_000
    assert chat.digest(chat.format_chats(chat.events(rows.limit(0)))).collect() == []


def test_clashing_names_and_very_long_texts(spark):
    rows = [(1, 0, "user", "q", "x", 7), (1, 1, "assistant", "<|im_end|>" * 400_000, "y", 8), (None, 0, "user", None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, seq int")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(chat.events(df))).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 4_000_000 and got[None].n_turns == 1
