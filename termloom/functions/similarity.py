"""String distances from their published definitions, as Arrow functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def damerau_levenshtein(a: str, b: str) -> int:
    """Edits (insertion, deletion, substitution, transposition of neighbours that may be edited between) from a to b,
    by the algorithm of Lowrance and Wagner (1975)."""
    n, m = len(a), len(b)
    far = n + m
    d = {(-1, -1): far}
    for i in range(n + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(m + 1):
        d[-1, j], d[0, j] = far, j
    seen: dict[str, int] = {}
    for i in range(1, n + 1):
        match = 0
        for j in range(1, m + 1):
            k, q = seen.get(b[j - 1], 0), match
            same = a[i - 1] == b[j - 1]
            if same:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, q - 1] + (i - k - 1) + 1 + (j - q - 1))
        seen[a[i - 1]] = i
    return d[n, m]


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Winkler's (1990) similarity; the sums are made in one fixed order, as ties are told by equal doubles."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(mine, (c for j, c in enumerate(b) if used[j]), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


def distances(token: Column, form: Column) -> Column:
    """struct<dist:int,sim:double> of each pair."""

    def over(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(damerau_levenshtein(x, y), jaro_winkler(x, y)) for x, y in zip(a, b, strict=True)], columns=["dist", "sim"])

    return F.pandas_udf(over, "dist int, sim double")(token, form)
