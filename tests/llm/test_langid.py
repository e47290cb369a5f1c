import random

import numpy as np
from pyspark.sql import functions as F

from quarryline.llm import langid_hd

ALPHABETS = {"aa": "aeiou lmn", "bb": "xyzqw krt", "cc": "абвгд еж"}


def text(rng, lang, n=200):
    return "".join(rng.choices(ALPHABETS[lang], k=n))


def rows():
    rng = random.Random(8)
    return [(i, text(rng, lang), lang) for i, lang in enumerate(["aa", "aa", "bb", "cc", "bb", "cc", "aa"] * 20)]


def test_held_out_accuracy_and_edges(spark):
    made = rows()
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", None), (1003, "É", None), (1004, "аб" * 50_000, None)]
    docs = spark.createDataFrame(made + odd, "doc_id long, text string, lang string")
    train = F.col("doc_id") % 3 != 1
    prototypes = langid_hd.learn(docs, "text", "lang", "doc_id", train)
    assert sorted(r["lang"] for r in prototypes.collect()) == ["aa", "bb", "cc"]
    got = {r["doc_id"]: (r["language"]["lang"], r["language"]["score"]) for r in langid_hd.predict(docs.select("doc_id", "text"), prototypes).collect()}
    assert all(got[i][0] == lang for i, _, lang in made)
    assert got[1000] == got[1001] == got[1002] == ("und", 0.0)
    assert got[1004][0] == "cc" and all(0 <= s <= 1 for _, s in got.values())
    want = by_loop(made + odd, lambda i: i % 3 != 1)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-5 for i in want)


def by_loop(rows, trained):
    """Prototypes and predictions by plain loops over all rows."""
    enc, sums, out = langid_hd.Encoder(), {}, {}
    for i, t, lang in rows:
        if trained(i) and lang is not None and enc.bundle(t) is not None:
            sums[lang] = sums.get(lang, 0) + np.rint(enc.bundle(t).astype(float) * langid_hd.UNITS)
    for i, t, _ in rows:
        vector, best = enc.bundle(t), ("und", 0.0)
        if vector is not None:
            cosines = {k: round(float((v / np.linalg.norm(v)).astype(np.float32) @ vector), 6) for k, v in sorted(sums.items())}
            lang = max(cosines, key=cosines.get)
            best = (lang, min(1.0, max(0.0, cosines[lang])))
        out[i] = best
    return out


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    prototypes = langid_hd.learn(docs, "text", "lang", "doc_id", F.lit(True))
    assert prototypes.count() == 0 and langid_hd.predict(docs, prototypes).first()["language"]["lang"] == "und"
    assert langid_hd.predict(docs.limit(0), prototypes).count() == 0


def test_more_languages_than_are_held_at_once(spark):
    """12,000 short prototypes in blocks give what one block gives; equal ones go to the first name."""
    rng, enc = np.random.default_rng(3), langid_hd.Encoder(16)
    vectors = rng.integers(-50, 50, (12_000, 16))
    texts = ["hello there", "once upon", "abc", None]
    vectors[11_000] = langid_hd.in_units(enc.bundle(texts[0]))
    vectors[11_999] = vectors[7] = langid_hd.in_units(enc.bundle(texts[1]))
    prototypes = spark.createDataFrame([(f"l{i:05d}", v.tolist()) for i, v in enumerate(vectors)], "lang string, vector array<long>")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    read = lambda df: {r["doc_id"]: tuple(r["language"]) for r in df.collect()}
    got = read(langid_hd.predict(docs, prototypes, dimensions=16, most_bytes=8 * 16 * 5000))
    assert got == read(langid_hd.predict(docs, prototypes, dimensions=16))
    assert got[0] == ("l11000", 1.0) and got[1] == ("l00007", 1.0) and got[3] == ("und", 0.0)


def test_a_bundle_is_the_sum_of_bound_letters():
    enc = langid_hd.Encoder(64, 3, 1)
    vector = enc.bundle("Ab, a")
    codes = [32, 97, 98, 32, 97, 32]
    letters = {c: np.random.default_rng([1, c]).integers(0, 2, 64, np.int8) * 2 - 1 for c in codes}
    total = sum(letters[a] * np.roll(letters[b], 1) * np.roll(letters[c], 2) for a, b, c in zip(codes, codes[1:], codes[2:])).astype(float)
    assert np.allclose(vector, total / np.linalg.norm(total), atol=1e-6)
