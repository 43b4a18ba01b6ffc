"""Indel similarity: 100 * 2 * LCS / (len a + len b), 0 where either string is empty or null. Letters count as they are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; a's positions are the bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & places.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    return 200.0 * lcs(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def ratio_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_native(a: Column, b: Column) -> Column:
    """The same by array functions, row by row of the usual table; for short strings."""
    left, right = F.split(F.coalesce(a, F.lit("")), ""), F.split(F.coalesce(b, F.lit("")), "")
    zero = F.transform(F.sequence(F.lit(0), F.length(F.coalesce(b, F.lit("")))), lambda _: F.lit(0))

    def row(old: Column, x: Column) -> Column:
        step = lambda new, j: F.concat(new, F.array(F.when(x == right[j], old[j] + 1).otherwise(F.greatest(old[j + 1], F.element_at(new, -1)))))
        return F.aggregate(F.sequence(F.lit(0), F.length(b) - 1), F.array(F.lit(0)), step)

    common = F.element_at(F.aggregate(left, zero, row), -1)
    short = (F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0)
    return F.when(short, F.lit(0.0)).otherwise(200.0 * common / (F.length(a) + F.length(b)))


def may_reach(a: Column, b: Column, cutoff: float) -> Column:
    """Whether lengths alone allow the cutoff."""
    return 200.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)) >= cutoff


def cut(score: Column, cutoff: float) -> Column:
    return F.when(score >= cutoff, score).otherwise(F.lit(0.0))
