import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import chat_trees

PIECES = st.sampled_from(["<|im_end|>", "<|im_start|>", "\n", "\\", "[INST]", "</s>", "<s>", "a", "é", "<", "|", "<<SYS>>", "im_end|>\n", " "])
TEXT = st.lists(PIECES, max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), TEXT), TEXT), max_size=5))
def test_round_trip(turns):
    formatted, spans = chat_trees.format_turns(turns)
    assert chat_trees.read_turns(formatted) == turns
    assert [chat_trees.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    marks = formatted.count("<|im_start|>"), formatted.count("<|im_end|>")
    assert marks == (len(turns), len(turns))
    assert not any(c in formatted for c in ("[INST]", "</s>", "<<SYS>>"))


def test_reader_refuses_what_was_not_written():
    with pytest.raises(ValueError):
        chat_trees.read_turns("hello")


def test_query_digests(spark):
    rows = [(1, 1, "assistant", "yes </s>"), (1, 0, "user", None), (2, 0, "system", "<|im_end|>\n"), (None, 3, None, "x"), (2, 1, "assistant", "b"), (2, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_trees.format_trees(chat_trees.linear_trees(df)).select("conv_id", chat_trees.read_back("formatted", "loss_spans").alias("r"))
    got = {r["conv_id"]: (r["r"]["n_turns"], r["r"]["turns_sha256"], r["r"]["loss_chars"], r["r"]["loss_sha256"]) for r in out.collect()}

    def want(turns):
        lost = "".join(t for r, t in turns if r == "assistant")
        return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest()

    assert got == {1: want([("user", ""), ("assistant", "yes </s>")]), 2: want([("system", "<|im_end|>\n"), ("assistant", "b"), ("assistant", "")]), None: want([("", "x")])}


def test_best_branches_of_a_tree(spark):
    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 3, 1.0), ("t", 6, 5, None), ("u", 1, 99, 2.0), ("t", 7, None, 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    got = {}
    for r in chat_trees.chosen_paths(df, branches=2).orderBy("place").collect():
        got.setdefault((r["tree"], r["root"], r["rank"]), []).append(r["node"])
    assert got == {("t", 1, 1): [1, 2, 4], ("t", 1, 2): [1, 3, 5, 6], ("t", 7, 1): [7], ("u", 1, 1): [1]}


def test_a_long_chain_and_a_cycle(spark):
    chain = spark.createDataFrame([("t", i, i - 1 if i else None, 0.1) for i in range(100)], "tree string, node long, parent long, score double")
    assert [r["node"] for r in chat_trees.chosen_paths(chain).orderBy("place").collect()] == list(range(100))
    loop = spark.createDataFrame([("t", 1, 2, 0.0), ("t", 2, 1, 0.0)], "tree string, node long, parent long, score double")
    with pytest.raises(ValueError):
        chat_trees.chosen_paths(loop)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_trees.format_trees(chat_trees.linear_trees(none)).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "a")] * 2, "conv_id long, turn long, role string, text string")
    assert len(chat_trees.read_turns(chat_trees.format_trees(chat_trees.linear_trees(twice)).first()["formatted"])) == 2
