"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A
letter n-gram binds its letters by elementwise product, each letter's vector
being rotated by its place; a text bundles (adds) its n-grams.  A language's
prototype is the sum of its training texts' unit vectors, and a text gets the
language whose prototype has the largest cosine with it.

Texts are lower-cased; everything that isn't a letter counts as one gap
between words, which has a vector of its own.  Training takes about
``per_language`` texts of each language, chosen by a hash of their id.

Edge cases: a null text, or one without letters, is ``und`` with score 0;
ties go to the language that sorts first; with nothing to learn from, every
text is ``und``.  Each row gives one row, repeated rows included, and an empty
table none.  Texts are read whole, whatever their length.  Null ids are never
trained on.  Any number of languages is learned and compared.  A column named
language is replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import DOUBLE, STRING, attach, cut_lineage, hash_share, record, row_of

DIMENSIONS = 1024
N = 3
SEED = 97
#: Training texts of each language, about; a bound on what is fitted, not on what is judged.
PER_LANGUAGE = 3000
#: Rows of n-gram vectors that a worker keeps (each of DIMENSIONS bytes).
KEPT_NGRAMS = 40_000
#: Bytes of prototypes that the driver and every task hold at once.
BLOCK_BYTES = 64 << 20
#: Sums by language that a training task holds.
HELD_SUMS = 2000
#: Parts of a unit vector's component, so that sums don't depend on their order.
UNITS = 1 << 30
GAP = 32
UNKNOWN = "und"


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Lower-case code point of every letter, GAP for all else; no letters lie beyond plane 3."""
    table = np.full(0x110000, GAP, np.int64)
    for code in range(0x40000):
        c = chr(code)
        if c.isalpha():
            table[code] = ord(c.lower()[0])
    return table


class Encoder:
    """Bundles of texts; keeps the vectors of n-grams that it has met."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = N, seed: int = SEED):
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return self.letters[code]

    def bound(self, key: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for place in range(self.n):
            out *= np.roll(self.letter((key >> 18 * place) & 0x3FFFF), place)
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of the n-grams, one row each."""
        at = [self.rows.get(k, -1) for k in keys.tolist()]
        fresh = [i for i, r in enumerate(at) if r < 0]
        extra = []
        for i in fresh:
            key, vector = int(keys[i]), self.bound(int(keys[i]))
            if len(self.rows) < KEPT_NGRAMS:
                at[i] = self.rows[key] = len(self.rows)
                if at[i] == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                self.vectors[at[i]] = vector
            else:
                extra.append((i, vector))
        out = self.vectors[at]
        for i, vector in extra:
            out[i] = vector
        return out

    def ngrams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct n-grams and their counts; None without letters."""
        codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.concatenate(([GAP], codes, [GAP]))
        codes = codes[np.concatenate(([True], (codes[1:] != GAP) | (codes[:-1] != GAP)))]
        if len(codes) < 3:
            return None
        size = len(codes) - self.n + 1
        keys = sum(codes[p : p + size] << 18 * p for p in range(self.n))
        return np.unique(keys, return_counts=True)

    def bundle(self, text: str | None) -> np.ndarray | None:
        found = self.ngrams(text) if text else None
        if found is None:
            return None
        keys, counts = found
        out = np.zeros(self.dimensions, np.float32)
        for a in range(0, len(keys), 8192):  # bounds the memory of texts with very many n-grams
            out += counts[a : a + 8192].astype(np.float32) @ self.lookup(keys[a : a + 8192]).astype(np.float32)
        norm = float(np.linalg.norm(out))
        return out / norm if norm else None


@lru_cache(1)
def encoder(dimensions: int = DIMENSIONS) -> Encoder:
    return Encoder(dimensions)


def in_units(vector: np.ndarray) -> np.ndarray:
    return np.rint(vector.astype(np.float64) * UNITS).astype(np.int64)


def summed(dimensions: int) -> Callable:
    """(lang, place, v): sums of unit vectors by language; a task holds about HELD_SUMS of them at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def parts() -> Iterator[pd.DataFrame]:
            for lang, vector in sums.items():
                yield pd.DataFrame({"lang": lang, "place": np.arange(len(vector)), "v": vector})
            sums.clear()

        for rows in batches:
            for text, lang in zip(rows["text"], rows["lang"], strict=True):
                vector = encoder(dimensions).bundle(text)
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + in_units(vector)
                if len(sums) > HELD_SUMS:
                    yield from parts()
        yield from parts()

    return run


def learn(docs: DataFrame, text: str, lang: str, doc_id: str, train: Column, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> DataFrame:
    """(lang, vector): the sum of the training texts' unit vectors of each language, in whole UNITS."""
    rows = docs.where(train & F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    shared = attach(rows, cut_lineage(counts), ["lang"])
    sampled = shared.where(hash_share(["id"], 5, F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")))).select("text", "lang")
    sums = sampled.mapInPandas(summed(dimensions), "lang string, place int, v long").groupBy("lang", "place").agg(F.sum("v").alias("v"))
    vectors = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("parts"))  # one entry for each dimension
    return cut_lineage(vectors.select("lang", F.col("parts.v").alias("vector")))


def blocks_of(prototypes: DataFrame, dimensions: int, most_bytes: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Names and unit prototypes in the order of the languages, in blocks of at most so many bytes of vectors."""
    size = max(1, most_bytes // (8 * dimensions))
    last = None
    while True:
        rest = prototypes if last is None else prototypes.where(F.col("lang") > last)
        rows = rest.orderBy("lang").limit(size).toPandas()
        if not len(rows):
            return
        vectors = np.stack(rows["vector"].to_list()).astype(np.float64)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        yield rows["lang"].to_list(), (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)
        last = rows["lang"].iloc[-1]
        if len(rows) < size:
            return


JUDGED = record(lang=STRING, score=DOUBLE)


def judge(names: list[str], matrix: np.ndarray) -> Callable[[Column], Column]:
    dimensions = matrix.shape[1]

    @F.pandas_udf(JUDGED)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            vector = encoder(dimensions).bundle(t)
            if vector is None or not names:
                out.append((UNKNOWN, 0.0))
                continue
            cosines = matrix @ vector
            best = int(np.argmax(cosines))
            out.append((names[best], float(min(1.0, max(0.0, round(float(cosines[best]), 6))))))
        return pd.DataFrame(out, columns=["lang", "score"])

    return run


def predict(docs: DataFrame, prototypes: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``language`` of lang and score, by the text alone.

    Prototypes beyond ``most_bytes`` are compared block by block, the best so
    far being settled between blocks; a later language must be better by the
    rounded score, so blocks don't change a prediction.
    """
    rows = docs.select(row_of(docs, ["language"]).alias("row"), F.col(text).alias("text"))
    language = None
    for names, matrix in blocks_of(prototypes, dimensions, most_bytes):
        if language is not None:
            rows = cut_lineage(rows.select("row", "text", language.alias("best")))
        found = judge(names, matrix)(F.col("text"))
        language = found if "best" not in rows.columns else F.when(found["score"] > F.col("best.score"), found).otherwise(F.col("best"))
    if language is None:
        language = judge([], np.zeros((0, dimensions), np.float32))(F.col("text"))
    return rows.select("row", language.alias("language")).select("row.*", "language")
