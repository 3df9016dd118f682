"""Traces of regions from a video: one entry for low-rank video and for frames.

Low-rank video is never reconstructed: regions, rings and backgrounds become codes, and
only these meet the codes of the frames. From frames there are two passes: the mean image and the rings
first, then the sums of the regions by frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import arrays as A
from tracelake.operators import regions as R
from tracelake.operators import spikes as E
from tracelake.operators import statistics as S
from tracelake.operators import video as V
from tracelake.operators.least_squares import design, solve_codes, solve_traces, weighted_codes
from tracelake.sources.tables import written


@dataclass(frozen=True)
class LowRank:
    """A video as codes: u (frame, u) with the singular values in it, v (row, col, v), and their rank."""

    u: DataFrame
    v: DataFrame
    rank: int

    @staticmethod
    def of(u: DataFrame, s: list[float], v: DataFrame) -> LowRank:
        """From orthonormal frames and pixels and their singular values."""
        scaled = F.zip_with("u", F.array(*map(F.lit, map(float, s))), lambda x, y: x * y)
        return LowRank(u.select("frame", scaled.alias("u")), v.select("row", "col", "v"), len(s))


def check(neuropil: tuple[int, int], smooth: int, exclusion: float) -> None:
    if len(neuropil) != 2 or neuropil[1] < neuropil[0]:
        raise ValueError("the ring is (inner, outer), outer not below inner")
    if smooth < 0 or (smooth and smooth % 2 == 0):
        raise ValueError("the smoothing window is 0 or odd")
    if not 0 < exclusion <= 1:
        raise ValueError("the exclusion share lies above 0, up to 1")


def neuropil(video: LowRank | DataFrame, weights: DataFrame, height: int, width: int, ring: tuple[int, int], smooth: int = 0, exclusion: float = 0.4) -> DataFrame:
    """roi_id, frame, value: mean of the ring around each region, smoothed if asked for; 0 for a region without a ring."""
    own = weights.where("weight > 0").select("roi_id", "row", "col")
    around = R.uniform_weights(R.annuli(own, *ring, height, width, exclusion))
    if isinstance(video, LowRank):
        found, frames = V.extract_from_codes(video.u, video.v, around, video.rank), video.u.select("frame")
    else:
        found, frames = V.extract_traces(video, around), video.select("frame").distinct()
    found = written(found, "neuropil")
    bare = own.select("roi_id").distinct().join(found.select("roi_id").distinct(), "roi_id", "left_anti")
    found = found.unionByName(bare.join(frames, how="cross").select("roi_id", "frame", F.lit(0.0).alias("value")))
    return E.savgol(found, smooth) if smooth else found


def _ground(video: LowRank | DataFrame, active: DataFrame) -> DataFrame:
    """row, col, mu: the mean image of the active pixels over its maximum."""
    if isinstance(video, LowRank):
        image = V.mean_image(video.u, video.v.join(active, ["row", "col"], "left_semi"), video.rank)
    else:
        image = video.join(V.beside(active), ["row", "col"], "left_semi").groupBy("row", "col").agg(F.avg("value").alias("value"))
    image = written(image, "mean")
    top = image.agg(F.max("value")).first()[0] or 1.0
    return image.select("row", "col", (F.col("value") / top).alias("mu"))


def extract_traces(
    video: LowRank | DataFrame,
    weights: DataFrame,
    height: int,
    width: int,
    ring: tuple[int, int] = (-1, -1),
    *,
    ols: bool = True,
    weighted: bool = True,
    compute_mean: bool = True,
    keep_mean: bool = True,
    remove_neuropil: bool = True,
    normalize: bool = False,
    smooth: int = 0,
    exclusion: float = 0.4,
) -> tuple[DataFrame, DataFrame | None]:
    """(roi_id, frame, value) of each region, and of the rings around them (None where ring has a negative inner radius).

    video is LowRank or frames (frame, row, col, value). ols separates overlapping regions, beside the mean
    image where compute_mean says so; else weighted sums are taken. A coefficient counts times the sum of its
    weights, with the background under the region where keep_mean says so. weighted=False gives all pixels of
    a region the same weight, 1 over their number. The rings are subtracted unless remove_neuropil is False. normalize gives
    the change against the median over all frames, in percent.
    """
    check(ring, smooth, exclusion)
    w = weights.where("weight <> 0")
    if not weighted:
        w = R.uniform_weights(w.where("weight > 0").select("roi_id", "row", "col"))
    active = weights.groupBy("row", "col").agg(F.sum("weight").alias("s")).where("s > 0").select("row", "col")
    w = written(w.join(active, ["row", "col"], "left_semi"), "weights")
    rings = neuropil(video, weights, height, width, ring, smooth, exclusion) if ring[0] >= 0 else None
    low = isinstance(video, LowRank)
    if not ols:
        found = V.extract_from_codes(video.u, video.v, w, video.rank) if low else V.extract_traces(video, w)
    else:
        ground = _ground(video, active) if compute_mean else None
        d = design(w, ground)
        if low:
            back = None
            if ground is not None:
                one = ground.select(F.lit("").alias("roi_id"), "row", "col", F.col("mu").alias("weight"))
                back = weighted_codes(video.v, one, video.rank).first()
                back = list(back["code"]) if back else [0.0] * video.rank
            solved, b = solve_codes(d, weighted_codes(video.v, w, video.rank), back, video.rank)
            under = F.col("m") if keep_mean and ground is not None else F.lit(0.0)
            code = F.zip_with("code", F.array(*map(F.lit, map(float, b))), lambda x, y: x * F.col("total") + under * y)
            found = solved.select("roi_id", code.alias("code")).join(video.u, how="cross").select("roi_id", "frame", A.dot("u", "code").alias("value"))
        else:
            kinds = w.select("roi_id", "row", "col", "weight", F.lit(False).alias("ground"))
            if ground is not None:
                kinds = kinds.union(ground.select(F.lit(None), "row", "col", "mu", F.lit(True)))
            found = written(video.join(V.beside(kinds), ["row", "col"]).groupBy("ground", "roi_id", "frame").agg(F.sum(F.col("weight") * F.col("value")).alias("value")), "sums")
            sums = found.where("NOT ground").drop("ground")
            back = found.where("ground").select("frame", "value") if ground is not None else None
            solved, b = solve_traces(d, sums, back)
            value = F.col("value") * F.col("total")
            if keep_mean and b is not None:
                solved = solved.join(b.select("frame", F.col("value").alias("b")), "frame")
                value = value + F.col("m") * F.col("b")
            found = solved.select("roi_id", "frame", value.alias("value"))
    if rings is not None and remove_neuropil:
        other = rings.select("roi_id", "frame", F.col("value").alias("n"))
        found = found.join(other, ["roi_id", "frame"], "left").select("roi_id", "frame", (F.col("value") - F.coalesce("n", F.lit(0.0))).alias("value"))
    return S.dff_median(found) if normalize else found, rings


def pair_traces(video: LowRank | DataFrame, groups: dict[str, DataFrame], height: int, width: int, **options) -> DataFrame:
    """kind, roi_id, frame, value of several collections of regions, by plain means less their rings unless options say otherwise."""
    options = {"ring": (15, 30), "ols": False, "weighted": False} | options
    out = None
    for kind, weights in groups.items():
        found = extract_traces(video, weights, height, width, **options)[0].select(F.lit(kind).alias("kind"), "roi_id", "frame", "value")
        out = found if out is None else out.unionByName(found)
    return out
