"""Exact quantiles of a whole column, without bringing its values to one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many values a quantile is one aggregate; beyond, ranges of values are counted first.
SMALL = 1_000_000
RANGES = 200


def order_statistics(rows: DataFrame, column: str, places: list[int], small: int = SMALL) -> list[float]:
    """The values at places (from 0) among the sorted values of a column, NULL left out.

    Ranges between approximate quantiles are counted, and only the range that a place
    falls into is looked at again, until it is small or holds one value.
    """
    out = []
    for place in places:
        part, rank = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x")), place
        while True:
            n, low, high = part.agg(F.count("x"), F.min("x"), F.max("x")).first()
            if low == high:
                out.append(low)
                break
            if n <= small:
                out.append(part.agg(F.get(F.sort_array(F.collect_list("x")), F.lit(rank))).first()[0])
                break
            edges = sorted(set(part.agg(F.percentile_approx("x", [k / RANGES for k in range(1, RANGES)])).first()[0]) | {high})
            at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("x")))  # range k: above edge k - 1, up to edge k
            counts = {r["k"]: r["n"] for r in part.groupBy(at.alias("k")).agg(F.count("*").alias("n")).collect()}  # RANGES rows at most
            k = 0
            while rank >= counts.get(k, 0):
                rank -= counts.get(k, 0)
                k += 1
            inside = F.col("x") <= edges[k]
            if k:
                inside &= F.col("x") > edges[k - 1]
            smaller = part.where(inside)
            if counts[k] == n:  # the approximation does not split it: halve the range of values
                middle = (low + high) / 2
                below = part.where(F.col("x") <= middle).count()
                smaller, rank = (part.where(F.col("x") <= middle), rank) if rank < below else (part.where(F.col("x") > middle), rank - below)
            part = smaller
    return out


def quantiles(rows: DataFrame, column: str, shares: list[float], small: int = SMALL) -> list[float | None]:
    """Quantiles of a column, linear between values; None of an empty one. Only counts and results reach the driver."""
    n = rows.where(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    if n <= small:
        return list(rows.agg(F.percentile(F.col(column).cast("double"), F.array(*[F.lit(float(s)) for s in shares]))).first()[0])
    at = [s * (n - 1) for s in shares]
    places = sorted({math.floor(a) for a in at} | {math.ceil(a) for a in at})
    value = dict(zip(places, order_statistics(rows, column, places, small), strict=True))
    return [value[math.floor(a)] + (a - math.floor(a)) * (value[math.ceil(a)] - value[math.floor(a)]) for a in at]
