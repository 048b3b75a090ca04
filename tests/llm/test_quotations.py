"""Quotation linking on small conversations and against a loop."""

from __future__ import annotations

import __spark_entry__ as entry_points
from ordina.llm import quotations as q

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, branch string, hash int"


def linked(spark, rows):
    return q.link(spark.createDataFrame([(*r, "b", 3) for r in rows], SCHEMA)).collect()


def test_parse():
    own, quotes, said, deepest = q.parse("Bob wrote:\n> first line here\n>> an older line\n> second line here\n\nMy own answer.")
    assert own == "My own answer." and deepest == 2
    assert len(quotes) == 3 and {level for level, _, _ in quotes} == {1, 2}
    assert len(said) == 1 and q.parse(None) == (None, [], [], 0) and q.parse("")[0] == ""


def test_replies(spark):
    rows = [
        (1, 0, "user", "What is the capital of France?\nAnd its largest river, please?"),
        (1, 1, "assistant", "> What is the capital of France?\nThe capital of France is Paris."),
        (1, 2, "user", "On Monday Ann wrote:\n> and its LARGEST river,  please?\nI still want to know that one."),
        (1, 3, "assistant", ">> What is the capital of France?\n> The capital of France is Paris.\nIt has been so for long."),
        (1, 4, "user", "> Something that nobody has ever said here\nThank you both so very much for that."),
        (1, 5, "user", "> Thank you both so very much for that.\n> It has been so for long.\nYou are welcome."),
        (2, 0, "user", "> The capital of France is Paris.\nNot in this conversation."),
        (2, 3, "user", "After a gap in the turns."),
        (3, 7, "user", None),
        (3, 8, "user", ""),
    ]
    got = {(r.conv_id, r.turn): r for r in linked(spark, rows)}
    parents = {k: r.parent_turn for k, r in got.items()}
    assert parents == {
        (1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 3, (1, 5): 4, (2, 0): None, (2, 3): None, (3, 7): None, (3, 8): 7,
    }
    assert [got[1, t].branch for t in range(6)] == [0, 0, 2, 0, 0, 0]
    assert [got[1, t].depth for t in range(6)] == [0, 1, 0, 2, 3, 4]
    assert got[1, 2].text == "I still want to know that one." and got[1, 3].quote_depth == 2
    assert not any(">" in (r.text or "") for r in got.values())
    assert got[3, 7].text is None and got[3, 8].text == ""


def test_edge_rows(spark):
    rows = [(None, 1, "u", "a"), (1, None, "u", "b"), (1, 0, None, "same words said twice"), (1, 0, None, "same words said twice"), (1, 1, "u", "> same words said twice\nyes")]
    got = linked(spark, rows)
    assert len(got) == 5
    assert [r.parent_turn for r in got if r.turn == 1 and r.conv_id == 1] == [0]
    assert all(r.depth == 0 for r in got if r.conv_id is None or r.turn is None)
    assert q.link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation(spark):
    """Branches by doubling against a walk; every third message quotes an early one."""
    rows = []
    for t in range(300):
        quote = f"> this is what message number {t // 2} says\n" if t % 3 == 2 else ""
        rows.append((1, t, "u", quote + f"this is what message number {t} says"))
    rows.append((2, 0, "u", "long " * 200_000))
    got = {r.turn: r for r in linked(spark, rows) if r.conv_id == 1}
    parent = {t: (t // 2 if t % 3 == 2 else t - 1) for t in range(1, 300)}
    first, branch, depth = {}, {0: 0}, {0: 0}
    for t in range(1, 300):
        goes_on = first.setdefault(parent[t], t) == t
        branch[t], depth[t] = (branch[parent[t]], depth[parent[t]] + 1) if goes_on else (t, 0)
    assert {t: r.parent_turn for t, r in got.items() if t} == parent
    assert {t: (r.branch, r.depth) for t, r in got.items()} == {t: (branch[t], depth[t]) for t in range(300)}


def test_given_conversations(spark):
    rows = entry_points.queries()["op10_quotations"](spark, SF_DIR).collect()
    texts = sorted((r.conv_id, r.turn, r.text) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect())
    assert sorted((r.conv_id, r.turn, q.parse(r.text)[0]) for r in rows) == sorted((c, t, q.parse(x)[0]) for c, t, x in texts)
    assert all(r.branch == 0 and r.depth == r.turn for r in rows if r.quote_depth == 0)
