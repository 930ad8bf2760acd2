import pytest

from sessionlake.llm import chat_format


def chats(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string, position int")
    return {
        r.conv_id: (r.n_turns, r.copies, r.chat) for r in chat_format.format_chats(turns.repartition(3)).collect()
    }


def rows(id, *turns):
    return [(id, i, "user" if i % 2 == 0 else "assistant", t, "mine", 1) for i, t in enumerate(turns)]


def rendered(*turns):
    return "".join(
        f"<|im_start|>{'user' if i % 2 == 0 else 'assistant'}\n{t}<|im_end|>\n" for i, t in enumerate(turns)
    )


@pytest.mark.parametrize("stretch", [1, 2, 1000])
def test_snapshots_collapse(spark, monkeypatch, stretch):
    monkeypatch.setattr(chat_format, "STRETCH", stretch)
    got = chats(
        spark,
        rows(1, "a")
        + rows(2, "a", "b")
        + rows(3, "a", "b", "c", "d", "e")
        + rows(4, "a", "b", "x")
        + rows(5, "b")
        + rows(7, "a", "b", "x")
        + rows(6, "ab"),
    )
    assert got == {
        3: (5, 1, rendered("a", "b", "c", "d", "e")),
        4: (3, 2, rendered("a", "b", "x")),
        5: (1, 1, rendered("b")),
        6: (1, 1, rendered("ab")),
    }


def test_odd_rows(spark):
    base = (None, 1)
    got = chats(
        spark,
        [
            (1, 0, "user", None, *base),
            (1, 0, "user", None, *base),
            (2, None, None, "first", *base),
            (2, 5, "b", "x", *base),
            (2, 5, "a", "y", *base),
            (None, 0, "user", "of nobody", *base),
            (3, 0, "", "first", *base),
            (4, 0, "user", "w " * 50_000, *base),
        ],
    )
    assert got[1] == (1, 1, "<|im_start|>user\n<|im_end|>\n")
    assert got[2][2] == "<|im_start|>\nfirst<|im_end|>\n<|im_start|>a\ny<|im_end|>\n<|im_start|>b\nx<|im_end|>\n"
    assert got[None][0] == 1
    assert got[3] == (1, 1, "<|im_start|>\nfirst<|im_end|>\n")
    assert len(got[4][2]) > 100_000


def test_empty_table(spark):
    assert chats(spark, []) == {}
