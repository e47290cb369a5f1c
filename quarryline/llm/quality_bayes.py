"""Quality classifier: document evidence under hierarchical site priors.

Three levels are combined.  The evidence of a document is the log-odds of a
logistic model over surface features of the whole text and the mean
log-likelihood ratio of its hashed words and word pairs.  Every host has a
Beta-Binomial posterior of its share of good documents, shrunk toward the
global share; every path of a host has one shrunk toward its host.  The
strength of either shrinkage is estimated from the spread between groups
(method of moments), so sparse sites fall back to their parents.  A
document's score is its own log-likelihood ratio plus the log-odds of its
path's posterior, from which its own contribution has been taken out.

The evidence is learned from at most ``fit_rows`` labelled documents, those
of the least hashed ids: one half of them counts n-grams, the other half,
whose texts the counts haven't seen, fits the logistic model.  Site posteriors
count every document of the corpus.  Texts are read once: their evidence is
settled with the columns to be returned, and sites and verdicts come from that
table.  Votes are summed as whole millionths, so reruns agree in every bit.

Edge cases: a null or wordless text has no evidence of quality and is
rejected; null hosts and paths are groups of their own; without labels of
both kinds the fixed prior model is used; labels for absent documents are
ignored, and of several labels of one id the lowest counts, of several texts
the one of least hash.  A score at the threshold is kept.  Every input row
gives one output row, an empty table none, and texts are read whole, whatever
their length.  Columns named like outputs are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import DOUBLE, attach, column, cut_lineage, unpacked

#: At most this many labelled documents teach the evidence.
FIT_ROWS = 20_000
#: A document is kept if the probability that it is good is at least this.
THRESHOLD = 0.5
#: Hash buckets of words and word pairs.
BUCKETS = 1 << 15
#: Parts of a vote.
UNITS = 1_000_000
OUTPUTS = ["doc_llr", "host_posterior", "path_posterior", "quality_score", "kept"]

FEATURES = ("upper_share", "symbol_share", "pipe_share", "bang_share", "repeat_share", "pair_repeat_share", "longest_run_share", "digit_share", "mean_word", "log_words", "mark_word_share", "gram_ratio")
#: Texts that are Python strings at once; the rest of a batch stays in Arrow's buffers.
SLICE = 256


def surface(text: str) -> tuple[float, ...]:
    """Surface features of the whole text, each in linear time."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return (0.0,) * (len(FEATURES) - 1)
    count = text.encode().count
    upper = sum(map(str.isupper, words))
    symbols = sum(count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<", b">"))
    marked = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:!?|")
    same = [a == b for a, b in zip(words, words[1:], strict=False)]
    pairs = set(zip(words, words[1:], strict=False))
    return (
        upper / n, min(1.0, symbols / chars * 5), count(b"|") / n, count(b"!") / n, sum(same) / n, 1 - (len(pairs) + 1) / n if n > 1 else 0.0,
        1 - len(set(words)) / n, sum(map(count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / chars, min(20.0, chars / n) / 10, min(9.0, np.log1p(n)) / 9, marked / n,
    )


def grams(text: str) -> np.ndarray:
    """Distinct buckets of the lower-cased words and of pairs of neighbours."""
    words = text.lower().encode().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(20)
    return np.unique(np.concatenate((h, pairs)) % np.uint64(BUCKETS)).astype(np.int64)


def features(text: str, ratios: np.ndarray) -> tuple[float, ...]:
    found = grams(text)
    return (*surface(text), float(ratios[found].mean()) if len(found) else 0.0)


def in_slices(texts: pa.Array) -> Iterator[str]:
    for a in range(0, len(texts), SLICE):
        yield from (t or "" for t in texts.slice(a, SLICE).to_pylist())


# --- evidence -------------------------------------------------------------------


@dataclass
class Evidence:
    weights: list[float]
    intercept: float
    #: Log-odds of the labelled share, taken out of the classifier so that sites supply the prior.
    base: float
    #: Log-likelihood ratio of every bucket.
    ratios: np.ndarray


#: Used without labels: shouting, symbols and repetition count against a text.
DEFAULT_WEIGHTS = [-8.0, -8.0, -8.0, -8.0, -8.0, -4.0, 0.0, -4.0, 0.0, 0.0, -8.0, 0.0]
DEFAULT_INTERCEPT = 4.0


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton steps for ridge logistic regression on features of one spread; the last weight is the intercept, which isn't penalised."""
    spread = np.where((sd := x.std(axis=0)) > 1e-9, sd, 1.0)
    x = np.column_stack([x / spread, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / np.append(spread, 1.0)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, good, bad): the number of texts with each bucket."""
    counts = np.zeros((2, BUCKETS + 1), np.int64)  # the last place counts the texts
    for rows in batches:
        for good, text in zip(rows.column("good").to_pylist(), in_slices(rows.column("text")), strict=True):
            counts[0 if good else 1, np.append(grams(text), BUCKETS)] += 1
    met = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[0, met]), pa.array(counts[1, met])], ["bucket", "good", "bad"])


def gram_ratios(labelled: DataFrame) -> np.ndarray:
    """log p(bucket | good) - log p(bucket | bad), with one text of either kind added; zeros if a kind is missing."""
    counts = labelled.select("good", "text").mapInArrow(count_grams, "bucket long, good long, bad long")
    counts = counts.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas()  # at most BUCKETS + 1 rows
    good, bad = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    good[counts["bucket"]], bad[counts["bucket"]] = counts["good"], counts["bad"]
    if not good[-1] or not bad[-1]:
        return np.zeros(BUCKETS)
    return (np.log((good + 1) / (good[-1] + 2)) - np.log((bad + 1) / (bad[-1] + 2)))[:-1]


def learn(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, fit_rows: int = FIT_ROWS) -> Evidence:
    """The evidence that labelled documents of ``docs`` teach."""
    known = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    by_hash = F.xxhash64(F.lit(11), "doc_id")
    sampled = known.orderBy(by_hash, "doc_id").limit(fit_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sampled), "doc_id")
    rows = rows.groupBy("doc_id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = cut_lineage(rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(2))))
    ratios = gram_ratios(rows.where("fold = 0"))

    @F.arrow_udf(T.ArrayType(DOUBLE))
    def vector(texts: pa.Array) -> pa.Array:
        return pa.array([features(t, ratios) for t in in_slices(texts)], pa.list_(pa.float64()))

    seen = rows.where("fold = 1").select("doc_id", "good", vector("text").alias("x")).toPandas().sort_values("doc_id")
    y = seen["good"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Evidence(DEFAULT_WEIGHTS, DEFAULT_INTERCEPT, 0.0, np.zeros(BUCKETS))
    *weights, intercept = fit_logistic(np.stack(seen["x"].to_list()), y).tolist()
    return Evidence(weights, intercept, float(np.log(y.mean() / (1 - y.mean()))), ratios)


def log_odds(evidence: Evidence, text: Column) -> Column:
    """The logistic model's log-odds of a text."""
    weights, intercept, ratios = np.array(evidence.weights), evidence.intercept, evidence.ratios

    @F.arrow_udf(DOUBLE)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([float(np.dot(weights, features(t, ratios)) + intercept) for t in in_slices(texts)], pa.float64())

    return run(text)


# --- sites ----------------------------------------------------------------------


@dataclass
class Sites:
    prior: float
    host_strength: float
    path_strength: float
    #: (host, path, path_good, path_n, host_good, host_n), one row per path; good in UNITS.
    paths: DataFrame


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def strength(groups: DataFrame, good: Column, n: str, parent: Column) -> float:
    """Pseudo-counts of the parent that explain the spread of shares between groups (method of moments).

    For a Beta prior of strength k, E[(good - n p)^2] = p (1 - p) n (k + n) / (k + 1).
    """
    p = F.greatest(F.least(parent, F.lit(0.999)), F.lit(0.001))
    v = p * (1 - p)
    seen = groups.where(F.col(n) > 1).agg(F.sum(F.pow(good - F.col(n) * p, 2)).alias("s"), F.sum(v * F.col(n)).alias("a"), F.sum(v * F.col(n) * F.col(n)).alias("b")).first()
    if not seen["a"]:
        return 10.0
    # s (k + 1) = a k + b, solved for k; little spread means strong shrinkage
    spare = seen["s"] - seen["a"]
    found = min(1e4, max(1.0, (seen["b"] - seen["s"]) / spare)) if spare > 0 else 1e4
    return float(f"{found:.6g}")  # the sums' last digits depend on the order of their terms


def fit_sites(seen: DataFrame) -> Sites:
    """Posteriors of all hosts and paths from (host, path, vote)."""
    paths = cut_lineage(seen.groupBy("host", "path").agg(F.sum("vote").alias("path_good"), F.count("*").alias("path_n")))
    hosts = paths.groupBy("host").agg(F.sum("path_good").alias("host_good"), F.sum("path_n").alias("host_n"))
    whole = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    prior = float((whole["good"] / UNITS + 1) / (whole["n"] + 2)) if whole["n"] else 0.5
    host_strength = strength(hosts, F.col("host_good") / UNITS, "host_n", F.lit(prior))
    paths = cut_lineage(attach(paths, hosts, ["host"]))
    host_share = (F.lit(host_strength * prior) + F.col("host_good") / UNITS) / (F.lit(host_strength) + F.col("host_n"))
    return Sites(prior, host_strength, strength(paths, F.col("path_good") / UNITS, "path_n", host_share), paths)


# --- verdicts ---------------------------------------------------------------------


def read(docs: DataFrame, evidence: Evidence, text: str, host: Column, path: Column, keep: list[str] | None = None) -> DataFrame:
    """(row, host, path, odds, vote, has_word), settled; ``row`` holds the columns to be returned."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in OUTPUTS]
    has_word = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(F.struct(*(column(c).alias(c) for c in kept)).alias("row"), host.alias("host"), path.alias("path"), has_word.alias("has_word"), log_odds(evidence, F.col(text)).alias("odds"))
    return cut_lineage(rows.withColumn("vote", F.round(sigmoid(F.col("odds")) * UNITS).cast("long")))


def judge(seen: DataFrame, evidence: Evidence, sites: Sites, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``seen`` with doc_llr, host_posterior, path_posterior, quality_score and kept."""
    bounded = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-6)), F.lit(1e-6))
    logit = lambda c: F.log(c) - F.log1p(-c)
    # Without its own vote: a document must not be its own site's evidence.
    share = lambda k, parent, good, n: (F.lit(k) * parent + (F.col(good) - F.col("vote")) / UNITS) / (F.lit(k) + F.col(n) - 1)
    rows = attach(seen, sites.paths, ["host", "path"])
    rows = rows.withColumn("host_posterior", bounded(share(sites.host_strength, F.lit(sites.prior), "host_good", "host_n")))
    rows = rows.withColumn("path_posterior", bounded(share(sites.path_strength, F.col("host_posterior"), "path_good", "path_n")))
    rows = rows.withColumn("doc_llr", F.col("odds") - F.lit(evidence.base))
    rows = rows.withColumn("quality_score", sigmoid(F.col("doc_llr") + logit(F.col("path_posterior"))))
    return rows.select(*unpacked(rows, "row", seen.schema["row"].dataType.names), *OUTPUTS[:-1], (F.col("has_word") & (F.col("quality_score") >= threshold)).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, host: Column, path: Column, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with the verdict of evidence and sites.

    What is kept is settled with the evidence, so leave texts out where they aren't wanted.
    """
    evidence = learn(docs, labels, text, doc_id)
    seen = read(docs, evidence, text, host, path, keep)
    return judge(seen, evidence, fit_sites(seen))
