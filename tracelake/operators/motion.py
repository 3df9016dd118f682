"""Motion correction of low-rank video, in code space.

Frames are never reconstructed. Shifts come from cross-correlating component images
with a reference, once per component; a frame's correlation image is then a sum of
these with its code. What is as large as one picture of the camera, or as large as
rank pictures, is handled in blocks of image rows of bounded size; what grows with the
video stays in tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import arrays as A
from tracelake.functions import dsp
from tracelake.operators import video as V
from tracelake.operators.blocks import grouped
from tracelake.operators.extract import LowRank
from tracelake.sources.tables import written

#: Numbers of component images that are sent to the tasks at once.
MOST = 16_000_000


def component_images(v: DataFrame, height: int, width: int, ready=lambda image: image) -> DataFrame:
    """k, image (row by row): what a function makes of each component's picture, one task each."""
    long = v.select("row", "col", F.posexplode("v").alias("k", "x")).select("k", "row", "col", "x")
    ordered = long.repartition("k").sortWithinPartitions("k", "row", "col")

    def run(batches):
        for (k,), group in grouped(batches, 1):
            image = np.zeros((height, width))
            image[group["row"].to_numpy(), group["col"].to_numpy()] = group["x"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([ready(image).ravel()], pa.list_(pa.float64()))], ["k", "image"])

    return ordered.mapInArrow(run, "k int, image array<double>")


def weighted_image(images: DataFrame, weights: list[float], height: int, width: int) -> np.ndarray:
    """The picture that is the sum of component images times weights: one picture reaches the driver."""
    w = F.array(*map(F.lit, map(float, weights)))
    cells = images.select(F.posexplode("image").alias("p", "x"), F.get(w, F.col("k")).alias("w")).groupBy("p").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    out = np.zeros(height * width)
    for p, x in cells.collect():
        out[p] = x
    return out.reshape(height, width)


def estimate_shifts(u: DataFrame, images: DataFrame, reference: np.ndarray, max_shift: int | None, most: int = MOST) -> DataFrame:
    """frame, dy, dx: where the correlation of each frame with the reference is greatest in absolute value, the first place of several.

    images are the components' pictures made ready for alignment, reference a picture made ready alike.
    Shifts longer than max_shift are 0.
    """
    height, width = reference.shape
    spectrum = np.conj(np.fft.fft2(reference))

    def correlate(batches):
        for batch in batches:
            rows = []
            for image in batch.column(1).to_pylist():
                cross = np.fft.ifft2(np.fft.fft2(np.array(image).reshape(height, width)) * spectrum).real
                rows.append(np.fft.fftshift(cross).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["k", "cross"])

    cross = written(images.mapInArrow(correlate, "k int, cross array<double>"), "cross")
    rank = cross.count()
    rows = max(1, most // max(rank * width, 1))
    best = None
    for low in range(0, height, rows):
        part = cross.select("k", F.slice("cross", low * width + 1, min(rows, height - low) * width).alias("c")).orderBy("k").collect()  # most numbers
        basis = u.sparkSession.sparkContext.broadcast(np.array([r["c"] for r in part], float))

        def peak(batches, basis=basis, low=low):
            for batch in batches:
                codes = np.array(batch.column(1).to_pylist(), float)
                places, heights = [], []
                for k in range(0, len(codes), 64):
                    found = np.abs(codes[k : k + 64] @ basis.value)
                    at = found.argmax(axis=1)
                    places.extend((at + low * width).tolist())
                    heights.extend(found[np.arange(len(at)), at].tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heights, pa.float64()), pa.array(places, pa.int64())], ["frame", "height", "place"])

        found = u.select(F.col("frame").cast("bigint").alias("frame"), "u").mapInArrow(peak, "frame bigint, height double, place bigint")
        best = found if best is None else best.union(found)
    top = best.groupBy("frame").agg(F.max(F.struct("height", (-F.col("place")).alias("no"))).alias("t")).select("frame", (-F.col("t.no")).alias("p"))
    dy, dx = F.expr(f"cast(p div {width} - {height // 2} AS int)"), F.expr(f"cast(p % {width} - {width // 2} AS int)")
    near = F.lit(True) if max_shift is None else F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") <= max_shift * max_shift
    return top.select("frame", dy.alias("dy"), dx.alias("dx")).select("frame", F.when(near, F.col("dy")).otherwise(0).alias("dy"), F.when(near, F.col("dx")).otherwise(0).alias("dx"))


def shifted_mean(video: LowRank, shifts: DataFrame, height: int, width: int) -> DataFrame:
    """row, col, value: the mean picture with each frame's shift taken back. Frames are summed by shift before they meet pixels."""
    codes = video.u.join(shifts, "frame").groupBy("dy", "dx").agg(V._sum_of("u", video.rank).alias("code"), F.count("*").alias("n"))
    told = written(codes, "codes")
    n = told.agg(F.sum("n")).first()[0] or 1
    moved = told.join(video.v, how="cross").select(
        F.pmod(F.col("row") - F.col("dy"), F.lit(height)).alias("row"), F.pmod(F.col("col") - F.col("dx"), F.lit(width)).alias("col"), (A.dot("code", "v") / n).alias("x")
    )
    return moved.groupBy("row", "col").agg(F.sum("x").alias("value"))


def rolled(v: DataFrame, dy: int, dx: int, height: int, width: int) -> DataFrame:
    """v with every component's picture moved down and to the right, around the edges."""
    return v.select(F.pmod(F.col("row") + dy, F.lit(height)).cast("int").alias("row"), F.pmod(F.col("col") + dx, F.lit(width)).cast("int").alias("col"), "v")


def expand(video: LowRank, shifts: DataFrame, axis: str, height: int, width: int, max_rank: int | None = None) -> LowRank:
    """The video with each frame moved by its shift (frame, d) along rows or cols: one copy of the components for each shift, made orthogonal again.

    Components whose singular value vanishes go, and all beyond max_rank.
    """
    different = sorted(r[0] for r in shifts.select("d").distinct().collect())  # at most twice the largest shift
    if different in ([], [0]):
        return video
    places = F.array(*map(F.lit, different))
    none = F.array_repeat(F.lit(0.0), video.rank)
    u = video.u.join(shifts, "frame").select("frame", F.flatten(F.transform(places, lambda s: F.when(s == F.col("d"), F.col("u")).otherwise(none))).alias("u"))
    copies = None
    for k, s in enumerate(different):
        one = rolled(video.v, s if axis == "row" else 0, s if axis == "col" else 0, height, width).withColumn("no", F.lit(k))
        copies = one if copies is None else copies.union(one)
    v = copies.groupBy("row", "col").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "v"))), lambda x: x["v"])).alias("v"))
    rank = video.rank * len(different)
    left, sigma, right = V.orthogonal(written(u, "u"), [1.0] * rank, written(v, "v"))
    kept = sum(x > sigma[0] * 1e-7 for x in sigma)
    kept = max(1, min(kept, max_rank or kept))
    scaled = F.zip_with(F.slice("u", 1, kept), F.array(*map(F.lit, sigma[:kept])), lambda x, y: x * y)
    return LowRank(written(left.select("frame", scaled.alias("u")), "u"), written(right.select("row", "col", F.slice("v", 1, kept).alias("v")), "v"), kept)


def apply_shifts(video: LowRank, shifts: DataFrame, height: int, width: int, max_rank: int | None = None) -> LowRank:
    """The video with each frame moved by (dy, dx) around the edges, first sideways, then down."""
    sideways = expand(video, shifts.select("frame", F.col("dx").alias("d")), "col", height, width, max_rank)
    return expand(sideways, shifts.select("frame", F.col("dy").alias("d")), "row", height, width, max_rank)


def truncated(video: LowRank, rank: int | None) -> LowRank:
    """The video with its first components, rank at most."""
    if rank is None or rank >= video.rank:
        return video
    return LowRank(video.u.select("frame", F.slice("u", 1, rank).alias("u")), video.v.select("row", "col", F.slice("v", 1, rank).alias("v")), rank)


def find_shifts(video: LowRank, height: int, width: int, max_shift: int | None = None, passes: int = 2, *, mask: DataFrame | None = None, hpf: float = 10.0, sharp: float = 1.0, amount: float = 100.0) -> DataFrame:
    """frame, dy, dx against the mean picture, of the corrected video from the second pass on.

    For alignment pictures are high-passed (less their Gaussian of hpf pixels) and sharpened; pixels
    of mask (row, col) are filled from around it first.
    """
    hidden = np.zeros((height, width), bool)
    if mask is not None:
        for r, c in mask.select("row", "col").distinct().collect():  # one picture at most
            hidden[r, c] = True
    ready = lambda image: dsp.sharpened(dsp.filled(image, hidden), hpf, sharp, amount)
    images = written(component_images(video.v, height, width, ready), "images")
    mean = video.u.agg(V._mean_of("u", video.rank).alias("m")).first()["m"]  # rank numbers
    reference = weighted_image(images, list(mean), height, width)
    shifts = written(estimate_shifts(video.u, images, reference, max_shift), "shifts")
    for _ in range(passes - 1):
        picture = np.zeros((height, width))
        for r, c, x in shifted_mean(video, shifts, height, width).collect():  # one picture
            picture[r, c] = x
        shifts = written(estimate_shifts(video.u, images, ready(picture), max_shift), "shifts")
    return shifts


def motion_correct(video: LowRank, height: int, width: int, max_shift: int | None = None, passes: int = 2, *, max_rank: int | None = None, **options) -> tuple[LowRank, DataFrame]:
    """The corrected video and the shifts (frame, dy, dx) that were taken back; options as for find_shifts. max_rank cuts components off before and after."""
    video = truncated(video, max_rank)
    shifts = find_shifts(video, height, width, max_shift, passes, **options)
    back = shifts.select("frame", (-F.col("dy")).alias("dy"), (-F.col("dx")).alias("dx"))
    return apply_shifts(video, back, height, width, max_rank), shifts


def artifact_regions(pixels: DataFrame) -> DataFrame:
    """roi_id = artifact, row, col: the filled convex hulls of all regions of three pixels or more, as one region."""
    ordered = pixels.select("roi_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct().repartition("roi_id").sortWithinPartitions("roi_id", "row", "col")

    def run(batches):
        for _, group in grouped(batches, 1):
            points = np.stack([group["row"].to_numpy(), group["col"].to_numpy()], axis=1)
            filled = dsp.hull_pixels(points) if len(points) >= 3 else points[:0]
            yield pa.RecordBatch.from_arrays([pa.array(filled[:, 0], pa.int32()), pa.array(filled[:, 1], pa.int32())], ["row", "col"])

    return ordered.mapInArrow(run, "row int, col int").distinct().select(F.lit("artifact").alias("roi_id"), "row", "col")
