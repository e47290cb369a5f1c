"""Dense vectors as arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this length sums are unrolled, so that whole-stage code generation compiles them.
UNROLLED = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _sum(term, a: Column, b: Column, size: int | None) -> Column:
    if size and size <= UNROLLED:
        total = term(F.get(a, F.lit(0)), F.get(b, F.lit(0)))
        for i in range(1, size):
            total = total + term(F.get(a, F.lit(i)), F.get(b, F.lit(i)))
        return total
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column, size: int | None = None) -> Column:
    """Summed from left to right; ``size`` is the common length where it is known."""
    return _sum(lambda x, y: x * y, a, b, size)


def norm(a: Column) -> Column:
    """Folded: once per row, and unrolled it would fill the method that a search's dot product needs."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column, size: int | None = None) -> Column:
    """0 for vectors of unequal length, null or zero vectors."""
    same = (F.size(a) == F.size(b)) & (norm_a > 0) & (norm_b > 0)
    return F.coalesce(F.when(same, dot(a, b, size) / (norm_a * norm_b)), F.lit(0.0))


def euclidean_similarity(a: Column, b: Column, size: int | None = None) -> Column:
    """1 / (1 + distance)."""
    far = F.sqrt(_sum(lambda x, y: (x - y) * (x - y), a, b, size))
    return F.coalesce(F.when(F.size(a) == F.size(b), 1 / (1 + far)), F.lit(0.0))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def hash_embedding(text: Column, dimension: int, normalize: bool = True) -> Column:
    """A deterministic stand-in for an embedding model.

    Big-endian 32-bit words of SHA-256 over ``counter:text``, spread over
    [-1, 1), of length 1 if ``normalize``.
    """
    seed = F.when(F.coalesce(text, F.lit("")) == "", F.lit("\u0000")).otherwise(text)
    values = []
    for counter in range(-(-dimension // 8)):
        digest = F.sha2(F.concat(F.lit(f"{counter}:"), seed).cast("binary"), 256)
        values += [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") / F.lit(4294967296.0) * 2.0 - 1.0 for i in range(8)]
    vector = F.array(*values[:dimension])
    if not normalize:
        return vector
    scaled = lambda v, length: F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)
    return let(vector, lambda v: let(norm(v), lambda length: scaled(v, length)))


def vector_errors(vector: Column, dimension: int) -> Column:
    """Names of what is wrong with an embedding, empty if nothing."""

    def errors(v: Column) -> Column:
        bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        found = F.array(
            F.when(F.size(v) != dimension, "wrong_dimension"),
            F.when(bad, "non_finite_value"),
            F.when(F.forall(v, lambda x: x == 0.0), "zero_vector"),
        )
        return F.when(v.isNull() | (F.size(v) == 0), F.array(F.lit("empty_vector"))).otherwise(F.array_compact(found))

    return let(doubles(vector), errors)
