"""Filters over image tables, line by line: (row, col, value) or pixel codes (row, col, v).

A line of an image is as long as the camera's picture, however long the video, so each
is one small group; long kernels cost no more rows than short ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import dsp
from tracelake.operators.blocks import column_of, grouped, samples

#: Ways to go on beyond an edge: a constant, the edge value, mirrored with or without the edge value twice, around.
MODES = ("constant", "nearest", "reflect", "mirror", "wrap")


def odd_kernel(kernel) -> np.ndarray:
    k = np.asarray(kernel, float)
    if any(n % 2 == 0 for n in k.shape):
        raise ValueError("a kernel has an odd number of weights")
    return k


def convolve_lines(image: DataFrame, kernel: list[float], along: str, size: int, mode: str = "constant", constant: float = 0.0) -> DataFrame:
    """image convolved along its rows' or columns' direction (along is row or col); size is the image's extent that way.

    Pixels that are not in the table count as the constant and get no row.
    """
    weights = odd_kernel(kernel)
    column = "v" if "v" in image.columns else "value"
    line = "col" if along == "row" else "row"
    ordered = image.select(line, along, column).repartition(line).sortWithinPartitions(line, along)
    schema = ordered.schema

    def run(batches):
        for _, group in grouped(batches, 1):
            at = group[along].to_numpy()
            own = samples(group[column])
            flat = own.reshape(len(own), -1)
            whole = np.full((size, flat.shape[1]), constant)
            whole[at] = flat
            out = dsp.convolve_lines(whole, weights, mode, constant)[at]
            yield pa.RecordBatch.from_arrays([group[line].combine_chunks(), group[along].combine_chunks(), column_of(out.reshape(own.shape))], [line, along, column])

    return ordered.mapInArrow(run, schema).select("row", "col", column)


def convolve_separable(image: DataFrame, kernels: tuple[list[float], list[float]], height: int, width: int, mode: str = "constant", constant: float = 0.0) -> DataFrame:
    """image convolved by one kernel down its rows' numbers, then by one along its columns' numbers."""
    down = convolve_lines(image, kernels[0], "row", height, mode, constant)
    return convolve_lines(down, kernels[1], "col", width, mode, constant)


def gaussian_image(image: DataFrame, sigma: float, height: int, width: int) -> DataFrame:
    """image smoothed by a Gaussian of 4 deviations to either side, mirrored at its edges."""
    kernel = dsp.gaussian_kernel(sigma).tolist()
    return convolve_separable(image, (kernel, kernel), height, width, "reflect")


def folded(index: Column, size: int, mode: str) -> Column:
    """A row or column number brought inside 0..size - 1 by a mode; the constant leaves it outside."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if mode == "nearest":
        return F.greatest(F.lit(0), F.least(index, F.lit(size - 1)))
    if mode == "wrap":
        return F.pmod(index, F.lit(size))
    if mode == "reflect":
        place = F.pmod(index, F.lit(2 * size))
        return F.least(place, F.lit(2 * size - 1) - place)
    if mode == "mirror":
        place = F.pmod(index, F.lit(max(2 * size - 2, 1)))
        return F.least(place, F.lit(2 * size - 2) - place)
    return index


def convolve_image(v: DataFrame, kernel: list[list[float]], height: int, width: int, rank: int, mode: str = "constant", constant: float = 0.0, fill: bool = False) -> DataFrame:
    """Pixel codes convolved by a small kernel of odd size: each pixel gathers its neighbours. Pixels that are not there count as the constant.

    They get no row, unless fill is set: then those of the image that a pixel of the table reaches get one too.
    """
    weights = odd_kernel(kernel)
    hr, hc = weights.shape[0] // 2, weights.shape[1] // 2
    taps = F.array(*[F.struct(F.lit(r - hr).alias("r"), F.lit(c - hc).alias("c"), F.lit(float(w)).alias("w")) for r, line in enumerate(weights) for c, w in enumerate(line) if w])
    places = v.select("row", "col")
    if fill:
        reached = places.select("row", "col", F.explode(taps).alias("t")).select((F.col("row") + F.col("t.r")).alias("row"), (F.col("col") + F.col("t.c")).alias("col"))
        places = places.union(reached.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))).distinct()
    wanted = places.select("row", "col", F.explode(taps).alias("t")).select("row", "col", "t.w", folded(F.col("row") - F.col("t.r"), height, mode).alias("r"), folded(F.col("col") - F.col("t.c"), width, mode).alias("c"))
    other = v.select(F.col("row").alias("r"), F.col("col").alias("c"), "v")
    found = wanted.join(other, ["r", "c"], "left")
    sums = F.array(*[F.sum(F.col("w") * F.coalesce(F.get("v", F.lit(k)), F.lit(float(constant)))) for k in range(rank)])
    return found.groupBy("row", "col").agg(sums.alias("v"))
