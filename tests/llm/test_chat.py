"""Chat formatting: folding of events, reversible rendering, digests."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from coweave.llm import chat, queries

EVENTS = "conv_id bigint, turn bigint, message bigint, seq bigint, kind string, text string, role string"
odd = st.text(alphabet=["\\", "#", "<", "/", "t", "u", "r", "n", ">", ":", " ", "\n", "é", "😀"], max_size=30)
pieces = st.lists(st.sampled_from(["\\", "###", "</turn>", "\n", "### user: ", "x", "#", ":"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(odd, pieces), st.one_of(odd, pieces)), max_size=5))
def test_rendering_is_reversible(turns):
    parts = [chat.render(r, t) for r, t in turns]
    text = "".join(p for p, _, _ in parts)
    back = list(chat.read_back(text))
    assert [(r, t) for r, t, _, _ in back] == turns
    assert [chat.unescape(text[a:b]) for _, _, a, b in back] == [t for _, t in turns]
    assert [chat.unescape(p[a:b]) for p, a, b in parts] == [t for _, t in turns]


def test_events_fold_into_final_messages(spark):
    rows = [(1, 0, 10, 0, "open", "user"), (1, 0, 10, 1, "delta", "hel"), (1, 0, 10, 2, "delta", "lo"),
            (1, 1, 11, 0, "open", "assistant"), (1, 1, 11, 1, "delta", "draft"), (1, 1, 11, 2, "regenerate", None),
            (1, 1, 11, 3, "delta", "fi"), (1, 1, 11, 4, "delta", "nal"), (1, 1, 11, 5, "edit", "edited"),
            (1, 1, 11, 6, "delta", "!"), (2, None, 12, 0, "delta", None), (None, 0, 13, 0, "open", "user"),
            (None, 0, 13, 1, "delta", "no id"), (1, 1, 14, 0, "open", "assistant"), (1, 1, 14, 1, "delta", "same turn")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], EVENTS).repartition(4)
    got = sorted(((r["conv_id"], r["turn"], r["message"], r["role"], r["text"]) for r in chat.reconstruct(df).collect()), key=str)
    assert got == sorted([(1, 0, 10, "user", "hello"), (1, 1, 11, "assistant", "edited!"), (2, None, 12, "", ""),
                          (None, 0, 13, "user", "no id"), (1, 1, 14, "assistant", "same turn")], key=str)


def test_digests_of_odd_rows(spark):
    rows = [(-7, 0, "user", queries.ODD_TEXT), (-7, 1, "assistant", queries.ODD_TEXT), (3, 1, "assistant", None),
            (3, 0, None, "x" * 200_000), (4, 0, "assistant", "a"), (4, 0, "assistant", "b"), (4, 0, "assistant", "b"),
            (None, None, "user", "")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows],
                               "conv_id bigint, turn bigint, role string, text string, seq int, segment string")
    segments = chat.format_messages(chat.reconstruct(queries.conversation_events(df)))
    got = {r["conv_id"]: r for r in chat.conversation_digests(segments).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    conv = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        conv.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(conv)
    for c, turns in conv.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
        assert got[c]["formatted_chars"] == sum(len(chat.render(r, t)[0]) for r, t in turns)


def test_empty_log(spark):
    empty = chat.reconstruct(spark.createDataFrame([], EVENTS))
    assert chat.conversation_digests(chat.format_messages(empty)).count() == 0


def test_ties_of_one_turn_equal_the_sql(spark, tmp_path):
    """Messages of one turn go by role and raw text, as in the registered SQL."""
    import duckdb
    texts = ["a", "a b", "a</turn>", "a\\", "a\\b", "a###", "a#", "ab", "", None, "###", "##", "\\###", "é", "a\n", "a:"]
    roles = ["user", "assistant", "us:er", "us\\er", None, "###"]
    rows = [(c, c % 2, r, t) for c in range(3) for r in roles for t in texts] + [(1, None, "user", "late"), (1, 1, "user", "a")] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    path = str(tmp_path)
    df.coalesce(1).write.mode("overwrite").parquet(path + "/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{path}/conversations.parquet/*.parquet')")
    # nulls first: the order that the job gives a missing turn
    want = con.sql(queries.SQL_OP4.replace("order by turn,", "order by turn nulls first,"))
    got = queries.op4_chat_formatting(spark, path)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
