"""Tests on numbers."""

from __future__ import annotations

from math import comb

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact sign test, ties left out."""
    n, k = wins + losses, min(wins, losses)
    return min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def sign_tests(wins: Column, losses: Column) -> Column:
    """The same for columns: binomial coefficients are whole numbers of any size, so it runs over Arrow batches."""

    @F.pandas_udf("double")
    def test(w: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([sign_test(int(a), int(b)) for a, b in zip(w, n)], dtype=float)

    return test(wins, losses)
