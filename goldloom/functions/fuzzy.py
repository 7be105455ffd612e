"""Scores of 0 to 100 for inexact search: shares of characters that two texts have in common in the same order.

The base is 1 - (characters to delete and insert) / (characters of both); it rests on the longest common subsequence, which is
counted with one bit per character of the shorter text. Both functions are Arrow UDFs: Spark has no such distance.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _places(a: str) -> dict[str, int]:
    """For each character the bits of its places."""
    out: dict[str, int] = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def _common(places: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of b and a text of n characters."""
    full = (1 << n) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return n - row.bit_count()


def share(a: str, b: str) -> float:
    """Share of both texts' characters that is common; 100 for two empty texts."""
    whole = len(a) + len(b)
    return 100.0 if not whole else 200.0 * _common(_places(a), len(a), b) / whole


def token_set_score(a: str, b: str) -> float:
    """Best share among the words that both have, and these with the other words of either; 0 without words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (only_x and only_y):
        return 100.0
    joined = [" ".join(filter(None, (both, s))) for s in (only_x, only_y)]
    # The words in common stand first in both texts, so what differs lies behind them.
    differing = len(only_x) + len(only_y) - 2 * _common(_places(only_x), len(only_x), only_y)
    best = 100.0 * (1 - differing / (len(joined[0]) + len(joined[1])))
    if both:
        best = max(best, *(100.0 * (1 - (len(j) - len(both)) / (len(j) + len(both))) for j in joined))
    return best


def partial_score(a: str, b: str) -> float:
    """Best share of the shorter text and any part of the longer one that is as long, or shorter at either end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    best = _best_part(a, b)
    return max(best, _best_part(b, a)) if len(a) == len(b) else best


def _best_part(a: str, b: str) -> float:
    n, places, best = len(a), _places(a), 0.0
    known = set(a)
    for end in range(1, len(b) + n):
        start, stop = max(0, end - n), min(end, len(b))
        # A part that ends in a foreign character, or begins with one past the start, is no better than one without it.
        if stop < len(b) and b[stop - 1] not in known or start and b[start] not in known and stop == len(b):
            continue
        part = b[start:stop]
        best = max(best, 200.0 * _common(places, n, part) / (n + len(part)))
        if best == 100.0:
            break
    return best


@F.pandas_udf(DoubleType())
def _token_set(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([token_set_score(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def _partial(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([partial_score(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def token_set(a: Column, b: Column) -> Column:
    return _token_set(a, b)


def partial(a: Column, b: Column) -> Column:
    return _partial(a, b)
