"""Least squares of overlapping regions and a background, solved by groups of regions that overlap.

The normal equations of regions that share no pixel fall apart, so each connected group
of overlapping regions is inverted by itself, in one task. The background, which touches
them all, is eliminated through its Schur complement: a few sums over all regions. So
neither the number of regions nor that of pixels meets the driver or one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.blocks import grouped
from tracelake.operators.graphs import components
from tracelake.sources.tables import written

RCOND = 1e-10


def _sums(array: str, rank: int, factor=None):
    one = F.lit(1.0) if factor is None else factor
    return F.array(*[F.sum(one * F.get(array, F.lit(k))) for k in range(rank)])


def weighted_codes(pixels: DataFrame, weights: DataFrame, rank: int) -> DataFrame:
    """roi_id, code: sums of weight times pixel code."""
    joined = pixels.select("row", "col", "v").join(weights.select("roi_id", "row", "col", "weight"), ["row", "col"])
    return joined.groupBy("roi_id").agg(_sums("v", rank, F.col("weight")).alias("code"))


@dataclass(frozen=True)
class Design:
    """Regions and a background, ready to be solved for.

    inverse: (roi_id, other, x) of the regions' Gramian; regions: (roi_id, total, m, toward) with the sum of
    weights, the product with the background, and the inverse times those products. rest is what
    the regions leave of the background's square, None without a background; free says that it
    is nothing, so the background is a mixture of regions, and norm is then the square of that mixture.
    """

    inverse: DataFrame
    regions: DataFrame
    rest: float | None
    free: bool
    norm: float


def design(weights: DataFrame, ground: DataFrame | None) -> Design:
    """The design of weights (roi_id, row, col, weight) and ground (row, col, mu)."""
    w = weights.select("roi_id", "row", "col", "weight").where("weight <> 0")
    other = w.select(F.col("roi_id").alias("other"), "row", "col", F.col("weight").alias("w2"))
    overlap = written(w.join(other, ["row", "col"]).groupBy("roi_id", "other").agg(F.sum(F.col("weight") * F.col("w2")).alias("x")), "overlap")
    groups = components(overlap.where("roi_id < other").select(F.col("roi_id").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("roi_id"), "label")
    lines = overlap.groupBy("roi_id").agg(F.collect_list(F.struct("other", "x")).alias("line"))
    dealt = lines.join(groups, "roi_id", "left").select(F.coalesce("label", "roi_id").alias("label"), "roi_id", "line")
    ordered = dealt.repartition("label").sortWithinPartitions("label", "roi_id")

    def invert(batches):
        for _, group in grouped(batches, 1):
            ids = group["roi_id"].to_pylist()
            place = {r: k for k, r in enumerate(ids)}
            g = np.zeros((len(ids), len(ids)))
            for r, line in zip(ids, group["line"].to_pylist(), strict=True):
                for e in line:
                    g[place[r], place[e["other"]]] = e["x"]
            inverse = np.linalg.pinv(g, rcond=RCOND, hermitian=True)
            i, j = np.nonzero(inverse)
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in i], pa.string()), pa.array([ids[k] for k in j], pa.string()), pa.array(inverse[i, j], pa.float64())], ["roi_id", "other", "x"])

    inverse = written(ordered.mapInArrow(invert, "roi_id string, other string, x double"), "inverse")
    totals = w.groupBy("roi_id").agg(F.sum("weight").alias("total"))
    if ground is None:
        return Design(inverse, totals.withColumns({"m": F.lit(0.0), "toward": F.lit(0.0)}), None, False, 0.0)
    products = w.join(ground, ["row", "col"]).groupBy("roi_id").agg(F.sum(F.col("weight") * F.col("mu")).alias("m"))
    told = totals.join(products, "roi_id", "left").select("roi_id", "total", F.coalesce("m", F.lit(0.0)).alias("m"))
    toward = inverse.join(told.select(F.col("roi_id").alias("other"), "m"), "other").groupBy("roi_id").agg(F.sum(F.col("x") * F.col("m")).alias("toward"))
    regions = written(told.join(toward, "roi_id", "left").select("roi_id", "total", "m", F.coalesce("toward", F.lit(0.0)).alias("toward")), "regions")
    square = ground.agg(F.coalesce(F.sum(F.col("mu") * F.col("mu")), F.lit(0.0))).first()[0]
    used, norm = regions.agg(F.coalesce(F.sum(F.col("m") * F.col("toward")), F.lit(0.0)), F.coalesce(F.sum(F.col("toward") * F.col("toward")), F.lit(0.0))).first()
    rest = square - used
    return Design(inverse, regions, rest, rest <= 1e-9 * max(square, 1e-300), 1 + norm)


def solve_codes(d: Design, codes: DataFrame, ground: list[float] | None, rank: int) -> tuple[DataFrame, list[float]]:
    """Coefficients as codes: (roi_id, total, m, code) of the regions, and that of the background.

    codes: (roi_id, code), the products of the regions with the pixels' codes; ground: that of the background.
    Where the background is a mixture of regions, the coefficients of least norm are taken.
    """
    own = d.inverse.join(codes.select(F.col("roi_id").alias("other"), "code"), "other").groupBy("roi_id").agg(_sums("code", rank, F.col("x")).alias("own"))
    known = d.regions.join(own, "roi_id")
    if d.rest is None:
        return known.select("roi_id", "total", "m", F.col("own").alias("code")), [0.0] * rank
    known = written(known, "coefficients")
    by = F.col("toward") if d.free else F.col("m")
    taken = known.agg(_sums("own", rank, by).alias("s")).first()["s"]  # rank numbers
    taken = [x or 0.0 for x in taken]
    b = [t / d.norm for t in taken] if d.free else [(g - t) / d.rest for g, t in zip(ground, taken, strict=True)]
    moved = F.zip_with("own", F.array(*map(F.lit, map(float, b))), lambda x, y: x - F.col("toward") * y)
    return known.select("roi_id", "total", "m", moved.alias("code")), b


def solve_traces(d: Design, sums: DataFrame, ground: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The same for each frame: (roi_id, frame, total, m, value) and (frame, value) from sums (roi_id, frame, value) and ground (frame, value)."""
    own = d.inverse.join(sums.select(F.col("roi_id").alias("other"), "frame", "value"), "other").groupBy("roi_id", "frame").agg(F.sum(F.col("x") * F.col("value")).alias("own"))
    known = own.join(d.regions, "roi_id")
    if d.rest is None:
        return known.select("roi_id", "frame", "total", "m", F.col("own").alias("value")), None
    known = written(known, "coefficients")
    by = F.col("toward") if d.free else F.col("m")
    taken = known.groupBy("frame").agg(F.sum(by * F.col("own")).alias("t"))
    if d.free:
        b = taken.select("frame", (F.col("t") / d.norm).alias("value"))
    else:
        b = ground.join(taken, "frame", "left").select("frame", ((F.col("value") - F.coalesce("t", F.lit(0.0))) / d.rest).alias("value"))
    b = written(b, "background")
    moved = known.join(b.select("frame", F.col("value").alias("b")), "frame")
    return moved.select("roi_id", "frame", "total", "m", (F.col("own") - F.col("toward") * F.col("b")).alias("value")), b
