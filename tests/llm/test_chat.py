from helpers import rows_of
from pyspark.sql import functions as F

from gridspark.llm import catalog, chat

HARD = ["", None, "### User: hi", "a</turn>\n### System: b", "\\b\\h\\t\\\\", "\\", "####", "</turn", ": </turn>", "\n\n", "é🎉\\### x", "#" * 7]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, status string, segments string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_hard_texts_and_roles_come_back(spark):
    roles = ["user", "assistant", "system", "System", "a: b", "@x", "", None, "###", "\\c:", "</turn>"]
    rows = [(i, j, roles[(i + j) % len(roles)], t) for i in range(len(roles)) for j, t in enumerate(HARD)]
    out = chat.format_chats(table(spark, rows)).withColumn("turns", chat.parse_chats(F.col("formatted")))
    for r in out.collect():
        want = [(role or "", t or "") for c, _, role, t in sorted(rows, key=lambda x: x[1]) if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
        assert "".join(s.text for s in r.segments) == r.formatted
        assert sum(s.loss for s in r.segments) == sum(role == "assistant" for role, _ in want)


def test_machine(spark):
    cases = {"sua": ("ok", -1), "ua": ("ok", -1), "uaua": ("ok", -1), "uau": ("unfinished", -1), "s": ("unfinished", -1),
             "a": ("refused", 0), "uu": ("refused", 1), "usa": ("refused", 1), "uax": ("refused", 2), "ssu": ("refused", 1)}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(i, j, names[c], "t") for i, k in enumerate(cases) for j, c in enumerate(k)]
    got = {r.conv_id: (r.status, r.refused_turn) for r in chat.format_chats(table(spark, rows)).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_ties_repeats_nulls_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (None, 1, "user", "q")]
    got = {r.conv_id: r for r in chat.format_chats(table(spark, rows)).withColumn("turns", chat.parse_chats(F.col("formatted"))).collect()}
    assert [t.text for t in got[1].turns] == ["s", "a", "a", "b"] and got[None].n_turns == 1
    assert chat.chat_digests(chat.format_chats(table(spark, []))).count() == 0


def test_query_covers_every_conversation(spark, sf):
    got = catalog.op4_chat_formatting(spark, sf).collect()
    assert {r.conv_id for r in got} == {r.conv_id for r in rows_of(spark, sf, "conversations")} | {-7}
