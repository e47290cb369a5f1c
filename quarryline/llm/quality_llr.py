"""Quality rules and a hashed n-gram likelihood ratio, in built-in functions only.

The rules count what the whole text holds: words, symbols, lines that repeat
an earlier one, and words inside word windows that occur more than once.  The
likelihood ratio compares two multinomials over hashed word n-grams: one
counted on trusted documents, one on the raw corpus, both with add-one
smoothing.  A document's score is the sum of its n-grams' log ratios divided
by their number, and the same threshold holds for every document.

The raw counts cover all documents.  The trusted counts come from at most
``trusted_rows`` documents labelled good, so their ids can be broadcast.

Edge cases: a null or empty text has no words and fails the rules; a text
with no n-gram scores 0; without trusted documents all log ratios are 0.
Each row gives one row, repeated rows and ids included; an empty table gives
none.  Texts are read whole, whatever their length.  A ratio at the threshold
is kept.  Columns named like outputs are replaced, all others stay.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import GAP, WORD, row_of, unpacked

BUCKETS = 4096
TRUSTED_ROWS = 20_000
#: Log ratio per n-gram below which a document is rejected.
THRESHOLD = -0.35
WINDOW = 5
MIN_WORDS = 10
#: Percent of the words that may lie in repeated windows.
MOST_REPEATED = 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def window_hashes(words: Column, n: int) -> Column:
    """Hashes of the n-word windows, by their first word; empty if there are fewer words."""
    starts = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, n))))
    return F.slice(starts, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A filter on a result is pushed below the columns that it was built from,
    which would copy every one of them into its users, and those again; bound to
    a lambda's variable, a value stays one.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    same = lambda s, x, k: (F.get(s, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]))
    again = lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: same(s, x, k)), lambda x: x["i"]))
    new_words = lambda a: F.transform(a, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(a, k + 1) - i, F.lit(WINDOW))))
    counted = lambda s: let(again(s), lambda a: F.aggregate(new_words(a), F.lit(0), lambda acc, x: acc + x))
    # Most texts repeat no window and need no sorting.
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeats, let(F.array_sort(placed), counted)).otherwise(0).cast("long")


def rule_values(text: Column, words: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; ``words`` is bound."""
    whole = F.coalesce(text, F.lit(""))
    n_words = F.size(words).cast("long")
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))

    def values(repeated: Column) -> Column:
        return F.struct(
            n_words.alias("n_words"),
            F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            ((n_words < MIN_WORDS) | (100 * repeated > MOST_REPEATED * n_words)).alias("base_failed"),
        )

    return let(let(window_hashes(words, WINDOW), repeated_words), values)


def buckets_of(words: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of every word and of every pair of neighbouring words."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(F.lit(1), w), F.lit(buckets)).cast("int"))
    pairs = F.transform(words, lambda w, i: F.pmod(F.xxhash64(F.lit(2), w, F.get(words, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(single, F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def log_ratios(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> list[float]:
    """log p_trusted - log p_raw of every bucket, in one pass over the corpus."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q > 0")
    trusted = good.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(trusted_rows).select(F.col("doc_id").alias("trusted"))
    read = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    marked = read.join(F.broadcast(trusted), F.col("id") == F.col("trusted"), "left").withColumn("words", words_of(F.col("text")))
    grams = marked.select(F.col("trusted").isNotNull().alias("good"), F.explode(buckets_of(F.col("words"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("good")).collect()  # at most `buckets` rows
    raw, trusted_n = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["bucket"]], trusted_n[r["bucket"]] = r["raw"], r["good"]
    total_raw, total_good = sum(raw), sum(trusted_n)
    if not total_good:
        return [0.0] * buckets
    return [math.log((g + 1) / (total_good + buckets)) - math.log((n + 1) / (total_raw + buckets)) for g, n in zip(trusted_n, raw, strict=True)]


def judge(docs: DataFrame, ratios: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the rule columns, llr and kept."""
    outputs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")

    def mean_ratio(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
        return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0)

    def verdict(rules: Column, llr: Column) -> Column:
        values = [rules[c].alias(c) for c in outputs[:6]]
        return F.struct(*values, llr.alias("llr"), (~rules["base_failed"] & (llr >= threshold)).alias("kept"))

    def judged(words: Column) -> Column:
        llr = let(buckets_of(words, len(ratios)), mean_ratio)
        return let(rule_values(F.col(text), words), lambda rules: let(llr, lambda value: verdict(rules, value)))

    return docs.select(row_of(docs, outputs).alias("row"), let(words_of(F.col(text)), judged).alias("verdict")).select(*unpacked(docs, "row", [c for c in docs.columns if c not in outputs]), "verdict.*")
