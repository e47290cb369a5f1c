"""Strings and tokens.

Java's ``\\s``, ``\\w``, ``\\d`` and ``\\b`` are ASCII by default; patterns that
must see Unicode text begin with ``(?U)``.  Lengths count code points.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def words(text: Column) -> Column:
    """Runs of characters that aren't white space; empty for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def is_blank(text: Column) -> Column:
    """True for null, empty and white texts."""
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def cut(text: Column, chars: int) -> Column:
    """The text, or its first ``chars`` code points without white space at their end."""
    short = F.regexp_replace(F.substring(text, 1, chars), r"(?U)\s+$", "")
    return F.when(F.length(text) <= chars, text).otherwise(short)


def char_tokens(text: Column, chars_per_token: int = 4) -> Column:
    """Token estimate of a text: a quarter of its length, 1 at least, 0 if empty."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / chars_per_token))).cast("int")


def reading_seconds(tokens: Column, per_minute: int = 200) -> Column:
    return F.bround(tokens / F.lit(float(per_minute)) * 60.0, 2)


def contains_any(text: Column, parts: tuple[str, ...] | list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def array_contains_any(items: Column, wanted: tuple[str, ...] | list[str]) -> Column:
    return F.arrays_overlap(items, F.array(*map(F.lit, wanted)))


def distinct_terms(text: Column, pattern: str, stop_words: tuple[str, ...]) -> Column:
    """Lower-cased matches of ``pattern`` over one character, without stop words, in order of first sight."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    kept = F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*stop_words))
    return F.array_distinct(kept)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def first_of(cases: list[tuple[Column, str]], default: str | None) -> Column:
    """The label of the first condition that holds."""
    out = None
    for condition, label in cases:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def _unicode_form(form: str):
    @F.pandas_udf(T.StringType())
    def normalized(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return normalized


_NFC, _NFKC = _unicode_form("NFC"), _unicode_form("NFKC")


def _composed(text: Column, udf) -> Column:
    """Only texts beyond ASCII travel to Python; normal forms leave the others as they are."""
    odd = text.rlike(r"[^\x00-\x7F]")
    return F.when(odd, udf(F.when(odd, text))).otherwise(text)


def nfc(text: Column) -> Column:
    return _composed(text, _NFC)


def nfkc(text: Column) -> Column:
    return _composed(text, _NFKC)


def normalize_text(text: Column, unicode_form: bool = True, collapse_blank_lines: bool = True) -> Column:
    """Line ends as ``\\n``, no control characters but tab and line feed, no white space at line ends,
    one blank line at most in a row, one line feed at the end; empty texts stay empty."""
    out = nfc(text) if unicode_form else text
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\p{C}&&[^\n\t]]", "")
    out = F.regexp_replace(out, r"(?U)[^\S\n]+(?=\n|\z)", "")
    if collapse_blank_lines:
        out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"\A\n+|\n+\z", "")
    return F.when(out == "", "").otherwise(F.concat(out, F.lit("\n")))
