import pytest

from meshframe.llm import chat

TURNS = "array<struct<role:string,text:string>>"


def test_names_with_dots_and_other_case(spark):
    one, two = [("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no")]
    df = spark.createDataFrame([(1, "d", "old", one, two, "s", "c")], f"pair_id int, `a.b` string, Prompt string, chosen {TURNS}, rejected {TURNS}, shared string, `x``y` string")
    got = chat.preference_pairs(df)
    assert got.columns == ["pair_id", "a.b", "shared", "x`y", "prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans"]
    row = got.select("prompt", "`a.b`", "shared", "`x``y`").first()
    assert tuple(row) == ("<|user|>\nhi<|end|>\n", "d", "s", "c") and chat.preference_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 17, 3000])
def test_spans_of_many_turns(spark, n):
    turns = [(("assistant", "user", None)[i % 3], "é" * (i % 7) or None) for i in range(n)]
    rejected = [("system", "x"), *turns]
    row = chat.preference_pairs(spark.createDataFrame([(turns, rejected)], f"chosen {TURNS}, rejected {TURNS}")).first()
    for text, spans, own in ((row["chosen"], row["chosen_spans"], turns), (row["rejected"], row["rejected_spans"], rejected)):
        assert [text[s["start"] : s["stop"]] for s in spans] == [(t or "") + chat.END for r, t in own if r == "assistant"]
