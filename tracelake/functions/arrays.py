"""Column functions on arrays: statistics of windows, ragged bucketing, maps and reductions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def array_sum(a) -> Column:
    return F.aggregate(_present(a), F.lit(0.0), lambda s, x: s + x)


def _present(a) -> Column:
    return F.filter(_col(a), lambda x: x.isNotNull())


def array_mean(a) -> Column:
    """Mean of the values that are there; NULL for none."""
    return F.try_divide(array_sum(a), F.size(_present(a)))


def array_std(a) -> Column:
    """Population standard deviation of the values that are there; NULL for none."""
    return F.transform(F.array(array_mean(a)), lambda m: F.sqrt(F.try_divide(F.aggregate(_present(a), F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.size(_present(a)))))[0]


def peak_to_trough(window) -> Column:
    return F.array_max(_col(window)) - F.array_min(_col(window))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b, floor: float = 1e-10) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def template_magnitude(template, window) -> Column:
    """Projection of a window on the template at unit length; a template of length zero is left as it is."""
    size = norm(template)
    return dot(template, window) / F.when(size == 0, F.lit(1.0)).otherwise(size)


def onset_offset(values, n: int) -> tuple[Column, Column]:
    """Mean of the last n values less that of the first n, and the difference over their pooled deviation.

    A pooled deviation of 0 gives 0 for no difference, else an infinity of its sign.
    """
    first, last = F.slice(_col(values), 1, n), F.slice(_col(values), -n, n)
    diff = array_mean(last) - array_mean(first)
    pooled = F.sqrt((F.pow(array_std(first), 2) + F.pow(array_std(last), 2)) / 2)
    infinite = F.lit(float("inf"))
    d_prime = F.when(pooled > 0, F.try_divide(diff, pooled)).when(diff == 0, F.lit(0.0)).when(diff > 0, infinite).when(diff < 0, -infinite)
    return diff, d_prime


def digitize(x, edges, right: bool = False) -> Column:
    """How many edges lie below x (right: at x or below)."""
    return F.size(F.filter(_col(edges), lambda e: (e <= _col(x)) if right else (e < _col(x))))


def boundsorted_counts(values, edges) -> Column:
    """Numbers of sorted values in [edge i, edge i + 1); values beyond the last edge are not counted."""
    below = lambda e: F.size(F.filter(_col(values), lambda v: v < e))
    return F.transform(F.sequence(F.lit(0), F.size(_col(edges)) - 2), lambda k: below(F.get(_col(edges), k + 1)) - below(F.get(_col(edges), k)))


def bounds(values, edges) -> tuple[Column, Column]:
    """Left and right index of each bin in sorted values."""
    below = lambda e: F.size(F.filter(_col(values), lambda v: v < e))
    left = F.transform(F.slice(_col(edges), 1, F.size(_col(edges)) - 1), below)
    right = F.transform(F.slice(_col(edges), 2, F.size(_col(edges)) - 1), below)
    return left, right


def demean(values) -> Column:
    return F.transform(F.array(array_mean(values)), lambda m: F.transform(_col(values), lambda x: x - m))[0]


def nan_concat(packed, gap: int = 5) -> Column:
    """Arrays of an array end to end, with gap NULLs between them."""
    parts = F.transform(_col(packed), lambda a, k: F.when(k == 0, a).otherwise(F.concat(F.array_repeat(F.lit(None).cast("double"), gap), a)))
    return F.flatten(parts)


def double_exponential(t, a: float, b: float, c: float, d: float, e: float) -> Column:
    """a exp(b t) + c exp(d t) + e with a and c held at 0 or more, b and d at 0 or less."""
    term = lambda x, y: F.lit(float(max(x, 0))) * F.exp(_col(t) * F.lit(float(min(y, 0))))
    return term(a, b) + term(c, d) + F.lit(float(e))


def resample(values, n: int) -> Column:
    """n values on an even grid from the first to the last sample, linear between samples; NULL of an empty array."""
    a = _col(values)
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * (F.size(a) - 1) / F.lit(float(max(n - 1, 1))))

    def between(x):
        low = F.floor(x).cast("int")
        left = F.get(a, low)
        return left + (x - low) * (F.coalesce(F.get(a, low + 1), left) - left)

    return F.when(F.size(a) > 0, F.transform(at, between))


def bucket_bounds(values, most: int) -> Column:
    """Counts of sorted values in the default bins 0, 1, ..., most + 1."""
    return boundsorted_counts(values, F.transform(F.sequence(F.lit(0), F.lit(most + 1)), lambda k: k.cast("double")))


def digitize_list(values, edges, right: bool = False) -> Column:
    """digitize of each value of an array."""
    return F.transform(_col(values), lambda x: digitize(x, edges, right))


def apply_lists(kernel: Callable[[np.ndarray], np.ndarray], returns: str = "array<double>") -> Callable[[Column], Column]:
    """A function on array columns from one on NumPy arrays: of the same length back, an empty one as it is, NULL for NULL. Arrow batches."""

    @F.pandas_udf(returns)
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kernel(np.asarray(x)).tolist() if len(x) else [] for x in column])

    return lambda c: run(_col(c))


def reduce_lists(kernel: Callable[[np.ndarray], float], returns: str = "double") -> Callable[[Column], Column]:
    """A function on array columns from a reducer of NumPy arrays; NULL of an empty array or of NULL. Arrow batches."""

    @F.pandas_udf(returns)
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or not len(x) else kernel(np.asarray(x)) for x in column], dtype=object)

    return lambda c: run(_col(c))
