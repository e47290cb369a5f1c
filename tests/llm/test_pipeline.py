"""Every stage of the pipeline on its own input, against brute force."""

import importlib
import math
import random
import zlib
from collections import Counter
from importlib.util import find_spec

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryline.llm import quality_bayes, quality_llr
from tests.llm.test_mixing import WORD, water
from tests.llm.test_quality import base
from tests.llm.test_shingles import kept_ids

pytestmark = pytest.mark.skipif(find_spec("corpus_pipeline") is None, reason="no pipeline")


def documents():
    rng = random.Random(12)
    calm = ["the", "river", "runs", "over", "stones", "and", "mills", "stand", "beside", "it", "for", "years", "été", "house"]
    loud = ["BUY", "NOW", "$$$", "###", "|", "win!!!", "%%%"]
    rows = []
    for i in range(160):
        words = rng.choices(loud, k=60) if i % 9 == 4 else rng.choices(calm, k=rng.randrange(5, 400))
        rows.append((i, " ".join(words), ["en", "fr", None][i % 3], f"src{i % 4}" if i % 7 else None, 0))
    rows += [(200 + i, rows[i][1], "en", "copies", 0) for i in range(12)]
    rows += [(300, None, "en", "src0", 0), (301, "", "en", "src1", 0), (302, "one", None, None, 0)]
    labels = [(i, int(i % 9 != 4), 0) for i in range(0, 160, 2)]
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows, labels = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    module = importlib.import_module("corpus_pipeline")
    docs, out = spark.read.parquet(str(folder / "documents.parquet")), []
    for name, stage in module.STAGES:
        made, _ = module.stored(stage(spark, docs, str(folder)))
        out.append((name, docs, made))
        docs = made
    return out, labels


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_columns_stay(stages):
    out, _ = stages
    assert [name for name, _, _ in out] == ["quality classifier", "quality rules", "near-dedup", "mixing", "packing"]
    assert all(after.columns == before.columns for _, before, after in out[:-1])


def test_classifier_against_its_formula(stages):
    (_, before, after), labels = stages[0][0], stages[1]
    marks = before.sparkSession.createDataFrame(labels, "doc_id long, quality int, toxic int")
    evidence = quality_bayes.learn(before, marks, "text", "doc_id")
    sites = quality_bayes.fit_sites(quality_bayes.read(before, evidence, "text", F.col("source"), F.col("lang")))
    rows = before.collect()
    odds = {r["doc_id"]: float(np.dot(evidence.weights, quality_bayes.features(r["text"] or "", evidence.ratios)) + evidence.intercept) for r in rows}
    p = {i: round(1e6 / (1 + math.exp(-x))) / 1e6 for i, x in odds.items()}
    good, n, path_good, path_n = Counter(), Counter(), Counter(), Counter()
    for r in rows:
        good[r["source"]] += p[r["doc_id"]]
        n[r["source"]] += 1
        path_good[r["source"], r["lang"]] += p[r["doc_id"]]
        path_n[r["source"], r["lang"]] += 1
    prior = (sum(good.values()) + 1) / (len(rows) + 2)
    assert prior == pytest.approx(sites.prior)
    logit = lambda x: math.log(x / (1 - x))
    bounded = lambda x: min(1 - 1e-6, max(1e-6, x))
    kept = []
    for r in rows:
        i, host, path = r["doc_id"], r["source"], (r["source"], r["lang"])
        above = bounded((sites.host_strength * prior + good[host] - p[i]) / (sites.host_strength + n[host] - 1))
        site = bounded((sites.path_strength * above + path_good[path] - p[i]) / (sites.path_strength + path_n[path] - 1))
        if (r["text"] or "").strip() and 1 / (1 + math.exp(-(odds[i] - evidence.base + logit(site)))) >= quality_bayes.THRESHOLD:
            kept.append(i)
    assert ids(after) == sorted(kept)
    assert 100 <= len(kept) < len(rows)


def test_rules_against_counts(stages):
    (_, before, after), labels = stages[0][1], stages[1]
    spark = before.sparkSession
    rows = before.collect()
    grams = {r["doc_id"]: r["g"] for r in before.select("doc_id", quality_llr.buckets_of(quality_llr.words_of(F.col("text"))).alias("g")).collect()}
    trusted = {i for i, q, _ in labels if q}
    raw, good = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        good.update(g if i in trusted else [])
    size, n_raw, n_good = quality_llr.BUCKETS, sum(raw.values()), sum(good.values())
    ratio = lambda b: math.log((good[b] + 1) / (n_good + size)) - math.log((raw[b] + 1) / (n_raw + size))
    score = {i: sum(map(ratio, g)) / len(g) if g else 0.0 for i, g in grams.items()}
    want = sorted(r["doc_id"] for r in rows if not base(r["text"])[5] and score[r["doc_id"]] >= quality_llr.THRESHOLD)
    assert ids(after) == want and spark is not None


def test_one_of_each_group_stays(stages):
    _, before, after = stages[0][2]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    assert ids(after) == kept_ids(rows)


def test_mix_comes_to_its_targets(stages):
    _, before, after = stages[0][3]
    size, taken = Counter(), Counter()
    for r in before.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in after.collect():
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
    goal = water(dict(size))
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in after.collect())
    assert max(Counter(ids(after)).values()) <= 2


def test_packing_holds_every_token(stages):
    _, before, after = stages[0][4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], zlib.crc32(np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in before.collect())
    pieces = after.toPandas()
    assert pieces.groupby(["task", "row"])["length"].sum().sum() == pieces.drop_duplicates(["task", "row"])["doc_tokens"].sum()
    assert sorted(pieces.drop_duplicates(["task", "row"])["doc_id"]) == [i for i, _ in want]
    whole = pieces[pieces["length"] == pieces["doc_tokens"]]
    assert set(zip(whole["doc_id"], whole["ids_crc32"])) <= set(want)
    used = pieces.groupby("sequence_id")["length"].sum()
    assert used.max() <= 1024 and (pieces["offset"] + pieces["length"]).max() <= 1024
