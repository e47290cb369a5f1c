"""Scores against a plain model of dictionaries; the model sums to one and is better on texts that it didn't learn from."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarryline.llm import ngram_automaton

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END = object()


def words(text):
    return [*WORD.findall((text or "").encode().lower()), END]


class Plain:
    def __init__(self, texts, order, prior):
        self.order, self.prior = order, prior
        self.counts = Counter(tuple(t[i : i + n]) for t in map(words, texts) for n in range(1, order + 1) for i in range(len(t) - n + 1))
        self.all = sum(c for g, c in self.counts.items() if len(g) == 1)
        self.known = sum(len(g) == 1 for g in self.counts)

    def base(self, w):
        return (self.counts[w,] + 1) / (self.all + self.known + 1)

    def share(self, history, w):
        if not history:
            return self.base(w)
        return (self.counts[(*history, w)] + self.prior * self.share(history[1:], w)) / (self.counts[history] + self.prior)

    def score(self, text):
        t = words(text)
        return sum(math.log10(self.share(tuple(t[max(0, i - self.order + 1) : i]), w)) for i, w in enumerate(t))


def texts():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "ÉTÉ", "İ", "w1 w2"]
    out = [" ".join(rng.choices(vocabulary, [1 / (1 + i) for i in range(len(vocabulary))], k=rng.randrange(1, 60))) for _ in range(120)]
    return [*out, None, "", " \n\t", "W1 w2\x0bw3\x0cw4", "x" * 200_000, "unseen words only", out[0], out[0]] + ["w0 w1 w2 w3 w4 w5"] * 40


@pytest.mark.parametrize(("order", "slice_tokens", "part_tokens"), [(1, 1 << 19, 1 << 20), (2, 300, 100), (3, 50, 400), (2, 1, 1 << 20)])
def test_scores_against_dictionaries(spark, monkeypatch, order, slice_tokens, part_tokens):
    monkeypatch.setattr(ngram_automaton, "PART_TOKENS", part_tokens)
    rows = [(i if i != 11 else None, t, None if i == 5 else i % 3 != 1, "own") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean, `slice` string").repartition(3)
    got = ngram_automaton.score(df, F.col("learn"), ["doc_id", "slice"], order=order, prior=7.0, slice_tokens=slice_tokens).collect()
    model = Plain([t for _, t, learn, _ in rows if learn], order, 7.0)
    found = {r["own"]["doc_id"]: r for r in got}
    assert len(got) == len(rows) == len(found) and all(r["own"]["slice"] == "own" and r["train_tokens"] == model.all for r in got)
    for i, t, _, _ in rows:
        s, w = found[i]["scores"], words(t)
        assert (s["n_tokens"], s["n_known"]) == (len(w), sum(model.counts[x,] > 0 for x in w))
        assert s["base_score"] == pytest.approx(sum(math.log10(model.base(x)) for x in w), rel=1e-12)
        assert s["score"] == pytest.approx(model.score(t), rel=1e-9)
        if order == 1:
            assert s["score"] == pytest.approx(s["base_score"], rel=1e-12)


def test_a_state_is_a_distribution():
    """What leaves a state, by arcs or by failure, adds up to one."""
    model = Plain(texts(), 3, 5.0)
    every = [g[0] for g in model.counts if len(g) == 1]
    for history in [(), (b"w0",), (b"w0", b"w1"), (b"w3", b"w0"), (b"never", b"w1")]:
        unseen = 1 - sum(model.share((), w) for w in every)  # one unknown word's share, scaled like all lower ones
        scale = math.prod(5.0 / (model.counts[history[i:]] + 5.0) for i in range(len(history)))
        assert sum(model.share(history, w) for w in every) + scale * unseen == pytest.approx(1)


def test_nothing_learned_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(ngram_automaton.score(df, F.lit(False), ["doc_id"]).collect())
    assert [(r["own"]["doc_id"], *r["scores"], r["train_tokens"]) for r in got] == [(1, 3, 0, 0.0, 0.0, 0), (2, 1, 0, 0.0, 0.0, 0)]
    assert ngram_automaton.score(df.limit(0), F.lit(True), ["doc_id"]).collect() == []


def test_better_than_single_tokens_on_unseen_texts(spark):
    rng = random.Random(2)
    follow = {w: rng.choices([f"v{i}" for i in range(50)], k=3) for w in [f"v{i}" for i in range(50)]}

    def chain():
        out = [rng.choice(list(follow))]
        while len(out) < 60:
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    df = spark.createDataFrame([(i, chain()) for i in range(200)], "doc_id long, text string")
    got = ngram_automaton.score(df, F.col("doc_id") % 7 != 2, ["doc_id"], prior=20.0).where("own.doc_id % 7 = 2").agg(F.sum("scores.score"), F.sum("scores.base_score")).first()
    assert got[0] > 0.75 * got[1]
