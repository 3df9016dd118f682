"""Detection, grouping and removal of events.

Windows of a fixed number of samples run on blocks of frames with a halo, so a roi
that holds a third of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import dsp
from tracelake.operators import smoothing
from tracelake.operators.blocks import blockwise
from tracelake.operators.event_joins import event_windows
from tracelake.operators.smoothing import SPAN, block_of, with_halo, with_smooth


def _order():
    return Window.partitionBy("roi_id").orderBy("frame")


def odd(n: int) -> int:
    """n, or the next number where n is even."""
    return n + (n % 2 == 0)


def savgol(traces: DataFrame, window: int, order: int = 2, mode: str = "interp", column: str = "value") -> DataFrame:
    """roi_id, frame, value: Savitzky-Golay smoothing, by blocks. A trace shorter than the window has NULL in mode interp."""
    if window % 2 == 0 or order >= window:
        raise ValueError("the window must be odd and exceed the order")
    if mode == "interp" and order <= 3:
        return smoothing.savgol(traces.select("roi_id", "frame", F.col(column).alias("value")), window, order).select("roi_id", "frame", F.col("smooth").alias("value"))
    return blockwise(traces, lambda x, first, last: dsp.savgol_block(x, window, order, mode, first, last), window, column)


def rolling_median_highpass(traces: DataFrame, half: int) -> DataFrame:
    """Values less the median of the centred window; 0 within half frames of either end."""
    return blockwise(traces, lambda x, first, last: dsp.median_highpass_block(x, half), half)


def rolling_median(traces: DataFrame, half: int) -> DataFrame:
    """The median of the centred window, with zeros beyond either end."""
    return blockwise(traces, lambda x, first, last: dsp.medfilt_block(x, half), half)


def rolling_windows(traces: DataFrame, length: int, hop: int = 1, pad: bool = False) -> DataFrame:
    """roi_id, frame (centre), window: centred windows of odd length inside the trace, every hop frames from the first.

    With pad every frame has a row, whose window is NULL where none is centred.
    """
    if length <= 0:
        raise ValueError("a window needs a frame")
    half = odd(length) // 2
    at = _order().rowsBetween(-half, half)
    found = traces.select("roi_id", "frame", F.collect_list(F.struct("value")).over(at).alias("w"))
    whole = (F.size("w") == 2 * half + 1) & ((F.col("frame") - half) % hop == 0)
    window = F.transform("w", lambda x: x["value"])
    if pad:
        return found.select("roi_id", "frame", F.when(whole, window).alias("window"))
    return found.where(whole).select("roi_id", "frame", window.alias("window"))


def rolling_windows_ms(traces: DataFrame, window_ms: float, fs: float, hop_ms: float | None = None, pad: bool = False) -> DataFrame:
    """rolling_windows with lengths in milliseconds, rounded; without hop_ms windows are a window apart."""
    return rolling_windows(traces, round(window_ms * fs / 1000), max(1, round((window_ms if hop_ms is None else hop_ms) * fs / 1000)), pad)


def moving_average(traces: DataFrame, half: int) -> DataFrame:
    """traces with baseline: the mean of the centred window, as much of it as there is."""
    return traces.withColumn("baseline", F.avg("value").over(_order().rowsBetween(-half, half)))


def detect_spikes(traces: DataFrame, sd_threshold: float, window: int | None = None, positive: bool = False, block: int = SPAN) -> DataFrame:
    """roi_id, event_idx, frame, amplitude, sbr: one event per run of samples beyond the threshold, at its first extreme.

    window (made odd) gives a Savitzky-Golay baseline of order 2 to take off first; a trace that is
    shorter has no events. Noise is the population deviation of the samples of the other
    sign, of all where there is none. Amplitude is the extreme against that of up to three samples
    before it (0 at frame 0); sbr is amplitude over noise, or amplitude where noise is 0.

    Samples are dealt once, into blocks of frames with a halo, for the baseline, the noise and the runs
    alike. Runs are joined over the borders of blocks, so only runs, not samples, meet by roi.
    """
    size = odd(window) if window else 3
    block = block_of(size, block)
    turned = traces.select("roi_id", "frame", (F.lit(1.0 if positive else -1.0) * F.col("value")).alias("raw"))
    at = Window.partitionBy("roi_id", "block").orderBy("frame")
    dealt = with_halo(turned, size, block).withColumn("before", F.min("raw").over(at.rangeBetween(-3, -1)))
    flat = with_smooth(dealt, size, 2, block, "raw").withColumn("v", F.col("raw") - F.col("smooth")) if window else dealt.withColumn("v", F.col("raw"))
    rows = flat.where("own").select("roi_id", "block", "frame", "raw", "before", "v")
    noise = rows.groupBy("roi_id").agg(F.expr("coalesce(stddev_pop(CASE WHEN v < 0 THEN v END), stddev_pop(v)) AS noise"))
    above = f"coalesce(v > {float(sd_threshold)!r}D * noise, false) AS above"
    marked = rows.join(noise, "roi_id").selectExpr("*", above)
    over = "OVER (PARTITION BY roi_id, block ORDER BY frame)"
    began = marked.selectExpr("*", f"CASE WHEN above AND NOT coalesce(lag(above) {over}, false) THEN 1 ELSE 0 END AS began")
    islands = began.selectExpr("*", f"sum(began) {over} AS island").where("above")
    # The greatest sample, the first of several: its frame, value, what stands before it, and the noise.
    best = "max(struct(v, -frame AS no, frame, raw, before, noise)) AS best"
    runs = islands.groupBy("roi_id", "block", "island").agg(F.expr("min(frame) AS first"), F.expr("max(frame) AS last"), F.expr(best))
    by_roi = "OVER (PARTITION BY roi_id ORDER BY first)"
    apart = runs.selectExpr("roi_id", "first", "best", f"CASE WHEN first = lag(last) {by_roi} + 1 THEN 0 ELSE 1 END AS apart")
    peaks = apart.selectExpr("roi_id", "best", f"sum(apart) {by_roi} AS run").groupBy("roi_id", "run").agg(F.expr("max(best) AS p"))
    found = peaks.selectExpr("roi_id", "p.frame AS frame", "coalesce(p.raw - p.before, 0D) AS amplitude", "p.noise AS noise")
    number = "cast(row_number() OVER (PARTITION BY roi_id ORDER BY frame) - 1 AS bigint) AS event_idx"
    return found.selectExpr("roi_id", number, "frame", "amplitude", "CASE WHEN noise > 0 THEN try_divide(amplitude, noise) ELSE amplitude END AS sbr")


def group_bursts(events: DataFrame, interval: int, rois: DataFrame | None = None) -> DataFrame:
    """roi_id, burst, frames: events split where the gap exceeds interval. A roi of rois without events has one empty burst."""
    gap = F.col("frame") - F.lag("frame").over(_order())
    numbered = events.withColumn("_new", F.when(gap > interval, 1).otherwise(0)).withColumn("burst", F.sum("_new").over(_order()))
    found = numbered.groupBy("roi_id", "burst").agg(F.array_sort(F.collect_list("frame")).alias("frames"))
    if rois is None:
        return found
    none = rois.select("roi_id").distinct().join(events.select("roi_id").distinct(), "roi_id", "left_anti")
    return found.unionByName(none.select("roi_id", F.lit(0).cast("bigint").alias("burst"), F.array().cast("array<bigint>").alias("frames")))


def despike(traces: DataFrame, events: DataFrame, n_pre: int, n_post: int) -> DataFrame:
    """traces less, at each event, the mean waveform of its roi; overlapping waveforms add up."""
    windows = event_windows(traces, events, n_pre, n_post)
    wave = windows.groupBy("roi_id", "offset").agg(F.avg("value").alias("w"))
    put = windows.join(wave, ["roi_id", "offset"]).select("roi_id", (F.col("frame") + F.col("offset")).alias("frame"), "w").groupBy("roi_id", "frame").agg(F.sum("w").alias("w"))
    return traces.join(put, ["roi_id", "frame"], "left").select("roi_id", "frame", (F.col("value") - F.coalesce("w", F.lit(0.0))).alias("value"))


def near_events(traces: DataFrame, events: DataFrame, half: int) -> DataFrame:
    """roi_id, frame of samples within half frames of an event or of either end of the trace."""
    around = events.select("roi_id", F.explode(F.sequence(F.col("frame") - half, F.col("frame") + half)).alias("frame"))
    ends = traces.groupBy("roi_id").agg(F.max("frame").alias("last"))
    edges = traces.join(ends, "roi_id").where((F.col("frame") < half) | (F.col("frame") > F.col("last") - half)).select("roi_id", "frame")
    return around.union(edges).distinct()


def despike_impute(traces: DataFrame, events: DataFrame, window: int, savgol_window: int) -> DataFrame:
    """traces with the samples of near_events, half of the (odd) window wide, taken from a second-order Savitzky-Golay smooth."""
    mask = near_events(traces, events, odd(window) // 2).withColumn("near", F.lit(True))
    both = smoothing.savgol(traces.select("roi_id", "frame", "value"), odd(savgol_window))
    return both.join(mask, ["roi_id", "frame"], "left").select("roi_id", "frame", F.when(F.col("near"), F.col("smooth")).otherwise(F.col("value")).alias("value"))


def crossings(phases: DataFrame, target: float) -> DataFrame:
    """roi_id, frame where value rises through target."""
    before = F.lag("value").over(_order())
    return phases.withColumn("_b", before).where((F.col("_b") < target) & (F.col("value") > target)).select("roi_id", "frame")


def thin_events(frames: DataFrame, n_frames: DataFrame, margin: int, most: int) -> DataFrame:
    """Up to most events per roi, evenly strided, at least margin frames from either end."""
    inner = frames.join(n_frames, "roi_id").where((F.col("frame") >= margin) & (F.col("frame") < F.col("n") - margin)).drop("n")
    own = Window.partitionBy("roi_id")
    k = F.row_number().over(own.orderBy("frame")) - 1
    stride = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(own) / most))
    picked = inner.withColumn("_k", k).withColumn("_s", stride).where(F.col("_k") % F.col("_s") == 0)
    return picked.where(F.col("_k") / F.col("_s") < most).select("roi_id", "frame")


def positive_spread(traces: DataFrame, window: int) -> DataFrame:
    """traces with spread: sample deviation of the positive values in a centred window.

    It takes min(window / 2, 40) of them; gaps are interpolated between their neighbours, and
    before the first one filled with it.
    """
    half = window // 2
    at = _order().rowsBetween(-half, half)
    positive = F.when(F.col("value") > 0, F.col("value"))
    raw = traces.withColumn("_r", F.when(F.count(positive).over(at) >= min(window // 2, 40), F.stddev_samp(positive).over(at)))
    past, future = _order().rowsBetween(Window.unboundedPreceding, 0), _order().rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("_r").isNotNull(), F.struct("frame", F.col("_r").alias("v")))
    ends = raw.withColumn("_a", F.last(known, True).over(past)).withColumn("_b", F.first(known, True).over(future))
    share = F.try_divide(F.col("frame") - F.col("_a.frame"), F.col("_b.frame") - F.col("_a.frame"))
    between = F.col("_a.v") + F.coalesce(share, F.lit(0.0)) * (F.col("_b.v") - F.col("_a.v"))
    return ends.withColumn("spread", F.coalesce(between, "_a.v", "_b.v")).drop("_r", "_a", "_b")


def cross_correlate(x: DataFrame, y: DataFrame, max_lag: int) -> DataFrame:
    """roi_id, lag, r for short lags: mean of x(t + lag) y(t) of demeaned traces; lag > 0 means that y leads."""

    def less_mean(t, name):
        mean = F.avg("value").over(Window.partitionBy("roi_id"))
        return t.select("roi_id", "frame", (F.col("value") - mean).alias(name), F.count(F.lit(1)).over(Window.partitionBy("roi_id")).alias(f"{name}_n"))

    a, b = less_mean(x, "x"), less_mean(y, "y").drop("y_n")
    moved = b.select("roi_id", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"), "frame", "y").withColumn("frame", F.col("frame") + F.col("lag"))
    return a.join(moved, ["roi_id", "frame"]).groupBy("roi_id", "lag").agg((F.sum(F.col("x") * F.col("y")) / F.max("x_n")).alias("r"))
