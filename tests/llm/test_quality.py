import math
import random
import re
from collections import Counter

import pytest

from quarryline.llm import quality_bayes, quality_llr
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            inside.update(range(i, i + 5))
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), copies, len(inside), n < 10 or 100 * len(inside) > 20 * n


def texts():
    rng = random.Random(2)
    vocabulary = ["lorem", "ipsum", "dolor", "été", "#1", "a|b", "<x>", "sit", "amet", "𝒳"]
    made = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(60)]
    made += ["\n".join(rng.choices(["one line", "two line", "", "  ", "three\x0bfour"], k=12)) for _ in range(10)]
    made += ["a b c d e " * 5, "w " * 4, " ".join(map(str, range(500))) + " 0 1 2 3 4", "x" * 5000, None, "", " \t\n", "\x1fa\u00a0b\u2003c"]
    return made


def test_rules_against_brute_force(spark):
    rows = [(i, t, 5) for i, t in enumerate(texts())]
    judged = quality_llr.judge(spark.createDataFrame(rows, "doc_id long, text string, n_words int"), [0.0] * 16)
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in judged.collect()}
    assert got == {i: base(t) for i, t, _ in rows}
    assert all(r["kept"] == (not r["base_failed"]) for r in judged.collect())


def test_a_filter_on_the_verdict_plans_and_runs(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    kept = quality_llr.judge(spark.createDataFrame(rows, "doc_id long, text string"), [0.0] * 16).where("kept").select("doc_id")
    assert sorted(r[0] for r in kept.collect()) == [i for i, t in rows if not base(t)[5]]


def test_ratios_are_those_of_smoothed_multinomials(spark):
    docs = spark.createDataFrame([(1, "good text good"), (2, "bad noise noise"), (3, None), (None, "good")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (9, 1), (None, 1)], "doc_id long, quality int")
    got = quality_llr.log_ratios(docs, labels, buckets=64)
    grams = lambda t: docs.sparkSession.createDataFrame([(t,)], "t string").select(quality_llr.buckets_of(quality_llr.words_of(F.col("t")), 64)).first()[0]
    raw, good = Counter(), Counter()
    for t in ("good text good", "bad noise noise", "good"):
        raw.update(grams(t))
    good.update(grams("good text good"))
    want = [math.log((good[b] + 1) / (sum(good.values()) + 64)) - math.log((raw[b] + 1) / (sum(raw.values()) + 64)) for b in range(64)]
    assert got == pytest.approx(want)
    assert quality_llr.log_ratios(docs, labels.limit(0), buckets=8) == [0.0] * 8


def test_native_plan(spark):
    plan = quality_llr.judge(spark.createDataFrame([(1, "a")], "doc_id long, text string"), [0.0] * 8)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def site_rows():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = " ".join(rng.choices(["the", "river", "runs", "over", "stones", "and", "mills"], k=40)) if good else " ".join(rng.choices(["BUY", "NOW", "$$$", "###", "|", "win!!!"], k=40))
        rows.append((i, text, f"s{i % 5}" if i % 11 else None, "en" if i % 3 else None))
        if i % 2:
            labels.append((i, int(good)))
    return rows, labels


TRUE_WORDS = ("the", "river", "runs", "over", "stones", "and", "mills")


def test_classifier_separates_and_counts_every_document(spark):
    rows, labels = site_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    evidence = quality_bayes.learn(docs, marks, "text", "doc_id")
    sites = quality_bayes.fit_sites(quality_bayes.read(docs, evidence, "text", F.col("source"), F.col("lang")))
    assert sites.paths.agg(F.sum("path_n")).first()[0] == len(rows)
    scored = classified(docs.withColumn("kept", F.lit("old")), marks).collect()
    assert len(scored) == len(rows)
    truth = {i: t.startswith(TRUE_WORDS) for i, t, _, _ in rows}
    assert sum(r["kept"] == truth[r["doc_id"]] for r in scored) >= 0.97 * len(rows)
    unseen = [r for r in scored if r["doc_id"] % 2 == 0]  # without labels
    assert sum(r["kept"] == truth[r["doc_id"]] for r in unseen) >= 0.97 * len(unseen)


def classified(docs, marks, **more):
    return quality_bayes.classify(docs, marks, "text", "doc_id", F.col("source"), F.col("lang"), **more)


def test_words_alone_are_evidence():
    """Texts of the same surface, of which one kind uses other words."""
    counts = {"good": quality_bayes.grams("the quiet river"), "bad": quality_bayes.grams("the cheap offer")}
    ratios = quality_bayes.np.zeros(quality_bayes.BUCKETS)
    ratios[counts["good"]] += 1
    ratios[counts["bad"]] -= 1
    assert quality_bayes.features("quiet river", ratios)[-1] > 0 > quality_bayes.features("cheap offer", ratios)[-1]
    assert len(quality_bayes.grams("one")) == 1 and len(quality_bayes.grams("")) == 0 and len(quality_bayes.grams("A b a B")) == 4


def test_ratios_by_plain_counts(spark):
    rows = [(1, True, "a b c"), (2, True, "a b"), (3, False, "x y"), (4, False, None), (5, False, "x a")]
    got = quality_bayes.gram_ratios(spark.createDataFrame(rows, "doc_id long, good boolean, text string").repartition(3))
    good, bad = Counter(), Counter()
    for _, is_good, t in rows:
        (good if is_good else bad).update(quality_bayes.grams(t or "").tolist())
    want = [math.log((good[b] + 1) / 4) - math.log((bad[b] + 1) / 5) for b in range(quality_bayes.BUCKETS)]
    assert got.tolist() == pytest.approx(want)


def test_two_runs_agree_in_every_bit(spark):
    rows, labels = site_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    runs = [sorted(map(tuple, classified(docs.repartition(n), marks.repartition(n), keep=["doc_id"]).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_posteriors_shrink_to_their_parents(spark):
    docs = spark.createDataFrame([(1, "calm words here", "big", "a"), (2, None, "big", "b"), (3, "", None, None), (3, "", None, None)], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_bayes.learn(docs, none, "text", "doc_id").weights == quality_bayes.DEFAULT_WEIGHTS
    out = classified(docs, none).collect()
    assert len(out) == 4 and not any(r["kept"] for r in out if not (r["text"] or "").strip())
    for r in out:  # with its own vote taken out, a lone document's site says what the site above says
        if r["source"] is None or r["lang"] == "b":
            assert 0 < r["path_posterior"] < 1
    assert classified(docs.limit(0), none).count() == 0


def test_a_sparse_site_says_less_than_a_large_one(spark):
    """Of two sites without a good document the large one moves its posterior further from the prior."""
    rng = random.Random(9)
    loud = lambda: " ".join(rng.choices(["BUY", "NOW", "$$$", "###", "|", "win!!!"], k=40))
    calm = lambda: " ".join(rng.choices(TRUE_WORDS, k=40))
    rows = [(i, calm(), f"s{i % 7}", "en") for i in range(200)] + [(1000 + i, loud(), "large", "en") for i in range(60)] + [(2000 + i, loud(), "small", "en") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in rows[::2]], "doc_id long, quality int")
    out = {r["doc_id"]: r["path_posterior"] for r in classified(docs, marks).collect()}
    assert out[1000] < out[2000] < out[0]
