import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, share=1.5, most=2, weights=(3.0, 1.0, 2.0)):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        goal = {s: most * sizes[s] if s in full else rest * w[s] / sum(w[f] for f in free) for s in names}
        over = {s for s in free if goal[s] >= most * sizes[s]}
        if not over:
            return goal
        full |= over


def rows(seed=1, n=300):
    rng = random.Random(seed)
    sources = ["hot"] * 6 + ["b", "c", "é", "tiny", None]
    made = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 50, 400])) or None, rng.choice(sources)) for i in range(n)]
    return made + [(5, "same text twice", "b"), (5, "same text twice", "b"), (None, "no id", None), (900, "", "empty")]


@pytest.fixture(scope="module")
def mixed(spark):
    made = rows()
    df = spark.createDataFrame([(*r, 0) for r in made], "doc_id long, text string, source string, taken int")
    return made, mixing.mix(df).collect(), mixing.mix(df).collect()


def test_sizes_targets_and_takings(mixed):
    made, got, _ = mixed
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, _ in made)
    sizes = {}
    for _, t, s in made:
        sizes[s] = sizes.get(s, 0) + size(t)
    goal = water(sizes)
    for s, n in sizes.items():
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {n} and own[0]["target"] == pytest.approx(goal[s])
        assert abs(sum(r["taken"] for r in own) - goal[s]) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_reruns_agree(mixed):
    _, a, b = mixed
    key = lambda r: str(tuple(r))
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_splits_keep_exact_quotas():
    quota = np.array([1000, 3, 0, 57])
    leaves = list(mixing.split(quota, 0, 37, 1, 5))
    assert [a for a, _, _ in sorted(leaves, key=lambda x: x[0])] == list(range(37))
    assert (sum(q for _, _, q in leaves) == quota).all() and all((q >= 0).all() for _, _, q in leaves)
    total = sorted(int(q.sum()) for _, _, q in leaves)
    assert total[-1] - total[0] <= 6


def test_blocks_are_owned_once(spark):
    goals = spark.createDataFrame([(1, 10_000), (2, 0), (3, 777)], "source_rank int, goal long")
    table = mixing.block_table(goals, block_words=100, shard_blocks=8).collect()
    assert len(table) == len({(r["source_rank"], r["block"]) for r in table}) == 100 + 8
    assert {r["block"] for r in table if r["source_rank"] == 3} == set(range(8))


def test_the_mix_itself(spark):
    made = rows(7, 80)
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    out, plan = mixing.mixed_documents(df), mixing.mix(df).collect()
    assert out.columns == df.columns
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    want = {}
    for r in plan:
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
    assert got == {s: n for s, n in want.items() if n}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]
