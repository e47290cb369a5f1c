"""Chat formatting: best branches of reply trees, one training text each.

Messages form trees through parent ids.  Self-joins with doubled steps give
every message its root, depth and the summed score of its path, in as many
rounds as the depth has binary digits; the same step tables then list the
messages of each chosen root-to-leaf path.  Leaves of a root are ranked by
path score (ties: by leaf id) and the best ``branches`` become conversations.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings
inside roles and texts are broken by a backslash after their first
character; backslashes are doubled and a role's line breaks are escaped, so
reading back gives the same turns.  Loss spans are the code point ranges of
assistant texts.

Edge cases: null texts and roles count as empty; a null conversation id is a
conversation of its own; a message whose parent is absent is a root; repeated
rows are turns of their own (ties in turn order go by role and text); an
empty table gives no conversation.  Messages in a parent cycle have no root
and belong to no path; they raise an error rather than vanish.  Extra columns
are not carried over.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import LONG, STRING, cut_lineage, record

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of public chat templates; texts may hold them only escaped.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
CONTROL = re.compile("(?=(?:" + "|".join(map(re.escape, CONTROLS)) + "))(.)")
ROLE = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*+)\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and its loss spans."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}\n".replace("\n", "\\\n", role.count("\n")), escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The inverse of ``format_turns``; fails on a text that it didn't write."""
    turns, at = [], 0
    while at < len(formatted):
        head = ROLE.match(formatted, at)
        stop = formatted.find(END + "\n", head.end()) if head else -1
        if stop < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(head[1]), unescape(formatted[head.end() : stop])))
        at = stop + len(END) + 1
    return turns


@F.pandas_udf(record(formatted=STRING, loss_spans=T.ArrayType(record(start=LONG, stop=LONG))))
def written(turns: pd.Series) -> pd.DataFrame:
    out = [format_turns([(t["role"], t["text"]) for t in row]) for row in turns]
    return pd.DataFrame({"formatted": [x[0] for x in out], "loss_spans": [[{"start": a, "stop": b} for a, b in x[1]] for x in out]})


@F.pandas_udf(record(n_turns=LONG, turns_sha256=STRING, loss_chars=LONG, loss_sha256=STRING, formatted_chars=LONG))
def read_back(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Digests of what a reader finds in the stored text and mask."""
    rows = []
    for text, marks in zip(formatted, spans, strict=True):
        turns = read_turns(text)
        lost = "".join(unescape(text[s["start"] : s["stop"]]) for s in marks)
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


# --- paths --------------------------------------------------------------------


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, node, place) of the best ``branches`` root-to-leaf paths of each root.

    ``nodes`` has tree, node, parent (null at roots) and score; (tree, node) is
    unique and not null.
    """
    nodes = cut_lineage(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    inner = nodes.select("tree", F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("has_parent"))
    # up: the message `hops` replies above, and the score summed over those hops
    up = nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("has_parent"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("hops"), "score")
    rows, limit = cut_lineage(up), nodes.count()
    done, climbing = rows.where("up IS NULL"), rows.where("up IS NOT NULL")
    steps = []
    while not climbing.isEmpty():  # only messages that haven't reached their root go on
        if 2 ** len(steps) > limit:
            raise ValueError("the parents of some messages form a cycle")
        steps.append(climbing.select("tree", "node", "up"))
        above = climbing.unionByName(done).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("score").alias("score2"))
        higher = climbing.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("score") + F.col("score2")).alias("score"))
        higher = cut_lineage(higher)
        done, climbing = done.unionByName(higher.where("up IS NULL")), higher.where("up IS NOT NULL")
    ends = done.select("tree", "node", F.col("hops").alias("length"), F.col("score").alias("path_score"))
    leaves = ends.join(inner, ["tree", "node"], "left_anti")
    members = leaves.select("tree", F.col("node").alias("leaf"), "node", "length", "path_score", F.col("length").alias("place"))
    for k in reversed(range(len(steps))):  # every height is one sum of powers of two
        hop = members.join(steps[k], ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), "length", "path_score", (F.col("place") - 2**k).alias("place"))
        members = cut_lineage(members.unionByName(hop))  # else every step doubles the plan
    roots = members.where("place = 1").select("tree", "leaf", F.col("node").alias("root"), "path_score")
    order = F.row_number().over(W.partitionBy("tree", "root").orderBy(F.desc("path_score"), "leaf"))
    best = roots.withColumn("rank", order).where(F.col("rank") <= branches).select("tree", "leaf", "root", "rank")
    return members.join(best, ["tree", "leaf"]).select("tree", "root", "rank", "leaf", "node", "place")


def linear_trees(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of flat conversations as trees: every turn answers the one before it."""
    by_turn = W.partitionBy(conv_id).orderBy(F.col(turn).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(by_turn).cast("long")
    out = rows.select(F.col(conv_id).alias("conv_id"), node.alias("node"), "role", "text")
    return out.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def tree_key(conv_id: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("i"), conv_id.cast("string")), F.lit("none"))


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, root, rank, formatted, loss_spans), one row per chosen path.

    ``messages`` has conv_id, node, parent, score, role and text.
    """
    keyed = cut_lineage(messages.select(tree_key(F.col("conv_id")).alias("tree"), "conv_id", "node", "parent", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    paths = chosen_paths(keyed, branches)
    turns = paths.join(keyed.select("tree", "conv_id", "node", "role", "text"), ["tree", "node"])
    grouped = turns.groupBy("tree", "conv_id", "root", "rank").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    out = grouped.select("conv_id", "root", "rank", written("turns").alias("w"))
    return out.select("conv_id", "root", "rank", "w.formatted", "w.loss_spans")
