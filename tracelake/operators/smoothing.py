"""Savitzky-Golay smoothing as window functions over blocks of frames.

The least-squares polynomial over a window is known from the sums of x, k x, k² x ... over it, k being the
distance from its centre. Those sums are one window of (roi, block), so no Python runs and a
trace with most rows is many tasks. Distances are taken from the middle of the block, so sums stay small. The ends of a
trace follow the polynomials of its first and last window, which stand in the blocks there as well.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames of a block; longer where the window is long.
SPAN = 1024


def with_halo(traces: DataFrame, halo: int, block: int) -> DataFrame:
    """traces with block and own: samples of a block, and with own false up to halo more on either side."""
    frame = F.col("frame")
    ids = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.floor((frame - halo) / block)), F.floor((frame + halo) / block))
    return traces.withColumn("block", F.explode(ids)).withColumn("own", F.floor(frame / block) == F.col("block"))


def block_of(window: int, block: int = SPAN) -> int:
    return max(block, 4 * window)


def _product(*factors: str) -> str:
    return " * ".join(f for f in factors if f) or "1D"


def _power(x: str, n: int) -> str:
    return " * ".join([x] * n)


def with_smooth(blocks: DataFrame, window: int, order: int, block: int, column: str = "value") -> DataFrame:
    """Blocks with a halo of window samples at least, with ``smooth``: of column, right at the own samples.

    NULL where the window holds a missing or NULL sample, and all along a trace shorter than the window.
    """
    if window % 2 == 0 or order >= window:
        raise ValueError("the window must be odd and exceed the order")
    half, powers = window // 2, range(order + 1)
    design = np.vander(np.arange(window) - half, order + 1, increasing=True).astype(float)
    inverse = np.linalg.inv(design.T @ design)
    part = "PARTITION BY roi_id, block"
    near = f"OVER ({part} ORDER BY frame RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    # Sums about the block's middle, then about the sample itself, then the polynomial's coefficients.
    about = [f"sum({_product('_x', _power('_at', j))}) {near} AS _m{j}" for j in powers]
    own = [" + ".join(_product(f"{math.comb(j, i) * (-1) ** (j - i)}D", f"_m{i}", _power("_at", j - i)) for i in range(j + 1)) for j in powers]
    read = [" + ".join(f"{float(inverse[i, j])!r}D * ({own[j]})" for j in powers) for i in powers]
    kept = [c for c in blocks.columns if not c.startswith("_")]
    placed = blocks.selectExpr(*kept, f"cast({column} AS double) AS _x", f"cast(frame - block * {block} - {block // 2} AS double) AS _at")
    summed = placed.selectExpr(*kept, "_at", f"count(_x) {near} AS _n", *about, f"max(frame) OVER ({part}) AS _last")
    fitted = summed.selectExpr(*kept, "_last", f"CASE WHEN _n = {window} THEN array({', '.join(read)}) END AS _own")
    ends = [f"max(CASE WHEN frame = {place} THEN _own END) OVER ({part}) AS {name}" for name, place in (("_first", half), ("_end", f"_last - {half}"))]
    along = lambda name, e: " + ".join(_product(f"{name}[{j}]", _power(e, j)) for j in powers)
    found = f"CASE WHEN frame < {half} THEN {along('_first', f'(frame - {half})')} WHEN frame > _last - {half} THEN {along('_end', f'(frame - _last + {half})')} ELSE _own[0] END AS smooth"
    return fitted.selectExpr(*kept, "_last", "_own", *ends).selectExpr(*kept, found)


def savgol(traces: DataFrame, window: int, order: int = 2, column: str = "value", block: int = SPAN) -> DataFrame:
    """traces (roi_id, frame, column and others) with ``smooth``."""
    size = block_of(window, block)
    return with_smooth(with_halo(traces, window, size), window, order, size, column).where("own").drop("own", "block")
