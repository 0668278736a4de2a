"""String and vector similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if a == b:
        return len(a)
    seen: dict[str, int] = {}
    for i, c in enumerate(a):
        seen[c] = seen.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = seen.get(c)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 2 * _common(a, b) / n if n else 1.0


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 LCS / (len a + len b); 1 for two empty strings, null for a null."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def name_scores(a: Column, b: Column) -> tuple[Column, Column]:
    """(ratio, ratio of the token-sorted strings)."""
    return ratio(a, b), ratio(token_sorted(a), token_sorted(b))


def string_similarity(a: Column, b: Column) -> Column:
    """The greater of both ratios, four digits, half to even."""
    r, t = name_scores(a, b)
    return F.bround(F.greatest(r, t), 4)


def _letters(x: str) -> tuple[int, int]:
    bits, seen = 0, {}
    for c in x:
        seen[c] = k = seen.get(c, 0) + 1
        bits ^= 1 << (ord(c) * 31 + k * 53) % 128
    return tuple(int.from_bytes((bits >> s & (1 << 64) - 1).to_bytes(8), signed=True) for s in (0, 64))


@F.pandas_udf(T.StructType().add("lo", "long").add("hi", "long"))
def letters(x: pd.Series) -> pd.DataFrame:
    """128 bits of a string: each letter, by which of its occurrences it is, turns one bit over."""
    return pd.DataFrame([_letters(v) for v in x], columns=["lo", "hi"], dtype="int64")


def upper_bound(len_a: Column, len_b: Column, letters_a: Column, letters_b: Column) -> Column:
    """What a ratio, of the strings or of the token-sorted ones, can reach at most.

    From the lengths, and from the letters: one that only one side has can't be common, and turns one bit over at most.
    """
    apart = sum((F.bit_count(letters_a[x].bitwiseXOR(letters_b[x])) for x in ("lo", "hi")), F.lit(0))
    n = len_a + len_b
    return F.least(2 * F.least(len_a, len_b), n - apart) / n


def dot(a, b) -> Column:
    """Sum of products, in doubles; null if a side is null."""
    p = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(p, F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine of two vectors; null for null and zero vectors."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
