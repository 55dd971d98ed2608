"""Similarities of two texts or two sets. Built-in expressions, but for Jaro-Winkler and the common
subsequence, which Spark lacks: one Arrow function computes all three that a pair needs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmark.functions.text import char_ngrams


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of two arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that lies in the other; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    return jaccard(char_ngrams(a, n), char_ngrams(b, n))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; equal texts 1, also if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def sorted_words(a: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(a, " "), lambda w: w != "")), " ")


def token_sort_similarity(a: Column, b: Column) -> Column:
    return edit_similarity(sorted_words(a), sorted_words(b))


def length_ratio(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(F.least(F.length(a), F.length(b)) / longer)


# -- texts, one pair at a time --------------------------------------------------------------------


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one big integer per row."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & places.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    return 2.0 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


def jaro(a: str, b: str) -> float:
    """Equal texts 1 (also if both are empty); 0 if one is empty or nothing matches."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = bytearray(len(b))
    left = []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), i + reach + 1)
        while j >= 0 and used[j]:
            j = b.find(c, j + 1, i + reach + 1)
        if j >= 0:
            used[j] = 1
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3.0


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1) -> float:
    """Jaro, raised by a common beginning of up to four characters where it is 0.7 or more."""
    base = jaro(a, b)
    if base < 0.7 or base == 1.0:
        return base
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return base + prefix * prefix_weight * (1.0 - base)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def lcs_ratio_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.LongType())
def common_subsequence_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


_TEXTS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("name_jw", "addr_jw", "name_lcs")])


@F.pandas_udf(_TEXTS)
def pair_texts(n1: pd.Series, n2: pd.Series, a1: pd.Series, a2: pd.Series) -> pd.DataFrame:
    """The three similarities of a pair that no built-in has, in one crossing to Python."""
    rows = [
        (jaro_winkler(p, q), jaro_winkler(r, s) if r and s else 0.0, lcs_ratio(p, q))
        for p, q, r, s in zip(n1, n2, a1, a2, strict=True)
    ]
    return pd.DataFrame(rows, columns=["name_jw", "addr_jw", "name_lcs"])
