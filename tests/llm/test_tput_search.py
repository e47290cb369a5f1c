"""Ranked search against a plain loop over all documents and items."""

import math
import random
import re
from collections import Counter

import pytest

from quarryline.llm import tput_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, words = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 75 + (25 * sum(c.values()) * n) // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((score, doc))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(scored[:k])]
    return sorted(map(str, out))


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÜBER", "naïve", "x1"]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 80)))) for i in range(300)]
    docs += [(1000 + i, "w50 w51 w52, W53!w54") for i in range(40)]  # a group of copies, all of one score
    docs += [docs[7]] * 3 + [(None, "w1 w2 w3"), (None, None), (500, ""), (501, "?! .."), (502, "w9 " * 40_000), (503, "Café bar x\u0000y")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(12)] + [(3, "w50 w51"), (None, "w2 w2 w2 w40"), (50, None), (51, "unknown"), (52, "CAFÉ café bar y"), (53, "w50 w51 w52 w53 w54")]
    return docs, items


@pytest.mark.parametrize(("k", "block", "pairs"), [(20, 200_000, 1_000_000), (3, 40, 50), (1, 60, 7)])
def test_all_items_against_a_plain_loop(spark, monkeypatch, k, block, pairs):
    docs, items = corpus()
    monkeypatch.setattr(tput_search, "PAIRS", pairs)
    d = spark.createDataFrame([(*r, "extra", 1) for r in docs], "doc_id long, text string, score string, `row` int").repartition(5)
    q = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, `rank` int")
    got = [tuple(r) for r in tput_search.search(d, q, k, block).collect()]
    assert sorted(map(str, got)) == plain(docs, items, k)


def test_no_documents_or_items(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert tput_search.search(d, q).collect() == []
    assert tput_search.search(q.toDF("doc_id", "text"), d.toDF("item_id", "text")).collect() == []
    assert tput_search.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), q).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_most_lists_are_cut_before_they_are_summed():
    """Bounds drop what can't be among the best: of rising impacts only the upper ones of one list are read."""
    lists = tput_search.Lists([(0, 0, 1), (0, 1, 2)], {0: 100, 1: 10}, {0: 120})
    assert lists.least.tolist() == [60, 30] and lists.unread.tolist() == [59, 20] and lists.all_unread.tolist() == [79]
