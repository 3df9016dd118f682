"""Traces from low-rank video: least squares with background, neuropil rings, low-pass normalisation, phase windows, motion."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import arrays as A
from tracelake.functions import dsp
from tracelake.operators import event_joins as J
from tracelake.operators import masks, selection
from tracelake.operators import regions as R
from tracelake.operators import signals as G
from tracelake.operators import spectra as S
from tracelake.operators import spikes as E
from tracelake.operators import video as V
from tracelake.operators.blocks import blockwise
from tracelake.operators.least_squares import design, solve_codes, weighted_codes
from tracelake.operators.quantiles import quantiles
from tracelake.sources.tables import pack, written


def ols_traces(u: DataFrame, pixels: DataFrame, weights: DataFrame, rank: int) -> DataFrame:
    """roi_id, frame, value: least-squares coefficients of overlapping regions beside a constant background, over all pixels."""
    ground = pixels.select("row", "col", F.lit(1.0).alias("mu"))
    whole = list(pixels.agg(V._sum_of("v", rank).alias("s")).first()["s"])  # rank numbers
    solved, _ = solve_codes(design(weights, ground), weighted_codes(pixels, weights, rank), whole, rank)
    return solved.select("roi_id", "code").join(u, how="cross").select("roi_id", "frame", A.dot("u", "code").alias("value"))


def neuropil_traces(u: DataFrame, pixels: DataFrame, regions: DataFrame, inner: int, outer: int, height: int, width: int, rank: int) -> DataFrame:
    """roi_id, frame, value: the mean trace of the ring around each region; a region without a ring has no rows."""
    ring = R.annuli(regions, inner, outer, height, width, threshold=2.0)
    return V.extract_from_codes(u, pixels, R.uniform_weights(ring), rank)


def subtract_neuropil(traces: DataFrame, neuropil: DataFrame, share: float = 1.0) -> DataFrame:
    other = neuropil.select("roi_id", "frame", F.col("value").alias("_n"))
    return traces.join(other, ["roi_id", "frame"], "left").select("roi_id", "frame", (F.col("value") - share * F.coalesce("_n", F.lit(0.0))).alias("value"))


def lowpass_codes(u: DataFrame, window: int, order: int) -> DataFrame:
    """u smoothed in time, component by component, with the end values repeated; by blocks of frames, so length is no matter."""
    if window % 2 == 0 or order >= window:
        raise ValueError("the window must be odd and exceed the order")
    named = u.select(F.lit("u").alias("roi_id"), "frame", "u")
    return blockwise(named, lambda x, first, last: dsp.savgol_block(x, window, order, "nearest", first, last), window, "u", ("u",), block=1024).drop("roi_id")


def subtractive_lowpass(u: DataFrame, window: int, order: int) -> DataFrame:
    """u less its smooth part: what is slow goes from every pixel."""
    if window % 2 == 0 or order >= window:
        raise ValueError("the window must be odd and exceed the order")
    named = u.select(F.lit("u").alias("roi_id"), "frame", "u")
    return blockwise(named, lambda x, first, last: x - dsp.savgol_block(x, window, order, "nearest", first, last), window, "u", ("u",), block=1024).drop("roi_id")


def divisive_lowpass(u: DataFrame, v: DataFrame, window: int, order: int, rank: int, least: float = 1e-8) -> DataFrame:
    """u over the slow part of the mean pixel, which is held off zero by least."""
    mean = np.array(v.agg(V._mean_of("v", rank).alias("m")).first()["m"], float)  # rank numbers

    def kernel(x, first, last):
        base = dsp.savgol_block(x, window, order, "nearest", first, last) @ mean
        held = np.where(np.abs(base) >= least, base, np.where(base < 0, -least, least))
        return x / held[:, None]

    if window % 2 == 0 or order >= window:
        raise ValueError("the window must be odd and exceed the order")
    named = u.select(F.lit("u").alias("roi_id"), "frame", "u")
    return blockwise(named, kernel, window, "u", ("u",), block=1024).drop("roi_id")


def phase_windows(traces: DataFrame, fs: float, low: float, high: float, target: float, most: int, half: int) -> DataFrame:
    """roi_id, event_idx, frame, offset, value: windows of each trace around rises of its band's phase through target."""
    n = traces.groupBy("roi_id").agg((F.max("frame") + 1).alias("n"))
    picked = E.thin_events(E.crossings(G.phase(traces, fs, low, high), target), n, half, most)
    events = picked.select("roi_id", (F.row_number().over(Window.partitionBy("roi_id").orderBy("frame")) - 1).alias("event_idx"), "frame")
    return J.event_windows(traces, events, half, half)


def phase_means(windows: DataFrame) -> DataFrame:
    """roi_id, offset, mean, std of windows less their own mean."""
    own = windows.groupBy("roi_id", "event_idx").agg(F.avg("value").alias("_m"))
    less = windows.join(own, ["roi_id", "event_idx"]).withColumn("value", F.col("value") - F.col("_m"))
    return less.groupBy("roi_id", "offset").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def phase_bins(phases: DataFrame, bins: int) -> DataFrame:
    """phases with bin: equal counts by quantile edges, an edge belonging to the bin above it."""
    edges = quantiles(phases, "value", [k / bins for k in range(1, bins)])
    if edges[:1] == [None]:
        return phases.withColumn("bin", F.lit(None).cast("int"))
    return phases.withColumn("bin", A.digitize("value", F.array(*map(F.lit, edges)), right=True))


def project(rows: DataFrame, column: str, basis: np.ndarray) -> DataFrame:
    """rows with an array column multiplied by a basis."""
    return V._times(rows, column, basis)


def robust_coherence(traces: DataFrame, fs: float, size: int, overlap: int, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """Pairwise coherence of traces with a little seeded noise, so that silence coheres with nothing."""
    return S.pairwise_coherence(S.with_noise(traces, noise, seed), fs, size, overlap)


def keyframes(phases: DataFrame, u: DataFrame, bins: int, rank: int) -> DataFrame:
    """bin, code: mean code of the frames whose phase (frame, value) falls in each of bins quantile bins; reconstruct() makes images of it."""
    return phase_bins(phases, bins).join(u, "frame").groupBy("bin").agg(V._mean_of("u", rank).alias("code"))


def event_codes(u: DataFrame, events: DataFrame, n_pre: int, n_post: int) -> DataFrame:
    """roi_id, event_idx, offset, u: the codes of the frames around each event; frames beyond the video have NULL."""
    spine = events.select("roi_id", "event_idx", "frame", F.explode(F.sequence(F.lit(-n_pre), F.lit(n_post))).alias("offset"))
    right = u.select(F.col("frame").alias("_f"), "u")
    return spine.join(right, spine["frame"] + spine["offset"] == right["_f"], "left").select("roi_id", "event_idx", "offset", "u")


def normalized_peaks(traces: DataFrame, half: int, spread_window: int, height: float, distance: int, prominence: float, reach: int) -> DataFrame:
    """roi_id, frame, height of peaks of the median high-pass, sign turned, over the rolling deviation of its positive samples."""
    flat = E.rolling_median_highpass(traces, half)
    turned = E.positive_spread(flat.withColumn("value", -F.col("value")), spread_window)
    ready = turned.select("roi_id", "frame", F.coalesce(F.try_divide("value", "spread"), F.lit(0.0)).alias("value"))
    return G.detect_peaks(pack(ready), height, distance, prominence, reach)


@dataclass(frozen=True)
class Survey:
    """What spatial_survey finds: regions (roi_id, row, col), events, and traces by stage (roi_id, frame, value)."""

    regions: DataFrame
    events: DataFrame
    raw: DataFrame
    highpass: DataFrame
    baseline: DataFrame
    standard: DataFrame
    despiked: DataFrame | None


def spatial_survey(
    u: DataFrame,
    pixels: DataFrame,
    height: int,
    width: int,
    rank: int,
    *,
    grid: int = 8,
    percentile: float = 90.0,
    closing: int = 5,
    least: int = 50,
    dff_mode: str = "savgol_add",
    dff_window: int = 201,
    spike_window: int | None = 75,
    sd_threshold: float = 4.0,
    despike_window: int | None = 3,
    despike_smooth: int = 51,
) -> Survey:
    """Traces and events of a grid of regions over the brightest pixels of the mean image; lengths are in frames.

    Pixels at or above the percentile are closed by a square and cut into grid x grid cells; cells
    with fewer than ``least`` pixels go. Traces are plain means, changed by dff_mode, over their own
    deviation; events are taken out by despike_impute unless despike_window is None.
    """
    image = V.mean_image(u, pixels, rank)
    bright = masks.closed_square(selection.top_share(image, percentile), closing, height, width)
    tall, wide = height // grid, width // grid
    inside = bright.where((F.col("row") < tall * grid) & (F.col("col") < wide * grid))
    place = F.format_string("r=%d c=%d", F.floor(F.col("row") / tall) + 1, F.floor(F.col("col") / wide) + 1)
    named = inside.select(place.alias("roi_id"), "row", "col")
    regions = written(named.join(named.groupBy("roi_id").agg(F.count("*").alias("n")).where(F.col("n") >= least), "roi_id", "left_semi"), "regions")
    raw = written(V.extract_from_codes(u, pixels, R.uniform_weights(regions), rank), "raw")
    changed = written(G.filter_dff(raw, dff_mode, dff_window), "changed")
    flat, base = (changed.select("roi_id", "frame", F.col(c).alias("value")) for c in ("dff", "baseline"))
    deviation = flat.groupBy("roi_id").agg(F.stddev_pop("value").alias("sd"))
    standard = written(flat.join(deviation, "roi_id").select("roi_id", "frame", F.try_divide("value", "sd").alias("value")), "standard")
    events = written(E.detect_spikes(standard, sd_threshold, spike_window), "events")
    despiked = None if despike_window is None else E.despike_impute(standard, events, despike_window, despike_smooth)
    return Survey(regions, events, raw, flat, base, standard, despiked)


def double_filtered(traces: DataFrame, window: int) -> DataFrame:
    """roi_id, frame, low, value: value less half the difference of two smooths, a moving mean and a line in each window."""

    def kernel(x, first, last):
        low = (dsp.savgol_block(x, window, 0, "interp", first, last) - dsp.savgol_block(x, window, 1, "interp", first, last)) / 2
        return low, x - low

    return blockwise(traces, kernel, window, results=("low", "value"))


def peaks_of_deviation(traces: DataFrame, window: int, method: str, height: float, distance: int | None = None, reach: int | None = None) -> DataFrame:
    """roi_id, frame, height of peaks, 2 at least above their bases, of the high-pass less its mean, sign turned, over the deviation of its positive samples.

    method median takes a running median off (0 within half a window of the ends), double_filt what double_filtered does.
    """
    if method == "median":
        flat = E.rolling_median_highpass(traces, window // 2)
    elif method == "double_filt":
        flat = double_filtered(traces, E.odd(window)).select("roi_id", "frame", "value")
    else:
        raise ValueError(f"no such method: {method}")
    own = flat.groupBy("roi_id").agg(F.avg("value").alias("m"), F.stddev_pop(F.when(F.col("value") > 0, F.col("value"))).alias("sd"))
    ready = flat.join(own, "roi_id").select("roi_id", "frame", F.coalesce(F.try_divide(F.col("m") - F.col("value"), "sd"), F.lit(0.0)).alias("value"))
    return G.detect_peaks(pack(ready), height, distance, 2.0, reach)
