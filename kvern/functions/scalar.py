"""Plain Python scalars and their Arrow UDFs, for SQL users and for folds that run in Python anyway."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvern.functions.numbers import FIRST_WEIGHTS, HITS, MISREAD, ORG_WEIGHTS, READ, SECOND_WEIGHTS

_FOLD = str.maketrans(MISREAD, READ)


def _check(digits: str, weights) -> int:
    return -sum(w * int(c) for w, c in zip(weights, digits)) % 11


def valid_mod11(s: str | None) -> bool:
    return bool(s and re.fullmatch("[0-9]{11}", s)) and _check(s, FIRST_WEIGHTS) == int(s[9]) and _check(s, SECOND_WEIGHTS) == int(s[10])


def valid_orgnr(s: str | None) -> bool:
    return bool(s and re.fullmatch("[0-9]{9}", s)) and _check(s, ORG_WEIGHTS) == int(s[8])


def identity_form(s: str) -> bool:
    day, month = int(s[:2]), int(s[2:4])
    return (1 <= day <= 31 or 41 <= day <= 71) and 1 <= month <= 12


#: Eleven digits that follow each other with at most two separators between neighbours, wherever they begin.
_WINDOW = re.compile(r"(?=([0-9](?:[ .,_-]{0,2}[0-9]){10}))")


def find_numbers(text: str | None, mod11: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, digits) of the numbers of a string, from left to right without overlap, at most three places with separators."""
    hits = []
    for m in _WINDOW.finditer((text or "").translate(_FOLD)):
        said = m[1]
        digits = re.sub("[^0-9]", "", said)
        if (not hits or m.start() >= hits[-1][1]) and len(re.findall("[^0-9]+", said)) <= 3 and identity_form(digits) and (valid_mod11(digits) or not mod11):
            hits.append((m.start(), m.start() + len(said), digits))
    return hits


def poisson_upper(k: int, level: float = 0.95) -> float:
    """The mean at which k or fewer events have a chance of 1 - level, by bisection."""

    def below(mean: float) -> float:
        term = total = math.exp(-mean)
        for i in range(1, k + 1):
            term *= mean / i
            total += term
        return total

    low, high = 0.0, k + 10.0 * math.sqrt(k + 1) + 10
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) > 1 - level else (low, mid)
    return high


@F.pandas_udf(T.BooleanType())
def valid_mod11_udf(s: pd.Series) -> pd.Series:
    return s.map(valid_mod11)


@F.pandas_udf(T.BooleanType())
def valid_orgnr_udf(s: pd.Series) -> pd.Series:
    return s.map(valid_orgnr)


@F.pandas_udf(HITS)
def find_numbers_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"start": a, "end": b, "digits": d} for a, b, d in find_numbers(x)])


@F.pandas_udf(T.DoubleType())
def poisson_upper_udf(k: pd.Series) -> pd.Series:
    return k.map(lambda x: None if pd.isna(x) else poisson_upper(int(x)))
