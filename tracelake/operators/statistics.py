"""Aggregations over events and traces: templates, magnitudes, labels, bins, trends, normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import arrays as A
from tracelake.operators.event_joins import count_neighbors, event_windows, nearest_event


def per_event(windows: DataFrame) -> DataFrame:
    """roi_id, event_idx, frame, window: the rows of event_windows as one array per event."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "value")))
    return windows.groupBy("roi_id", "event_idx", "frame").agg(F.transform(ordered, lambda x: x["value"]).alias("window"))


def event_template(traces: DataFrame, events: DataFrame, n_pre: int, n_post: int) -> DataFrame:
    """roi_id, offset, mean, std (population), sem, n over the events of a roi; missing samples are skipped."""
    std = F.stddev_pop("value")
    return event_windows(traces, events, n_pre, n_post).groupBy("roi_id", "offset").agg(
        F.avg("value").alias("mean"), std.alias("std"), F.try_divide(std, F.sqrt(F.count("value"))).alias("sem"), F.count("value").alias("n")
    )


def peak_to_trough(traces: DataFrame, events: DataFrame, n_pre: int, n_post: int) -> DataFrame:
    """roi_id, event_idx, frame, ptt: range of the samples around each event, from a partial aggregate."""
    return event_windows(traces, events, n_pre, n_post).groupBy("roi_id", "event_idx", "frame").agg((F.max("value") - F.min("value")).alias("ptt"))


def template_magnitudes(traces: DataFrame, events: DataFrame, n_pre: int, n_post: int) -> DataFrame:
    """roi_id, event_idx, frame, magnitude: each window on its roi's mean window at unit length."""
    windows = event_windows(traces, events, n_pre, n_post)
    template = windows.groupBy("roi_id", "offset").agg(F.avg("value").alias("t"))
    size = template.groupBy("roi_id").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("size"))
    product = windows.join(template, ["roi_id", "offset"]).groupBy("roi_id", "event_idx", "frame").agg(F.sum(F.col("t") * F.col("value")).alias("p"))
    return product.join(size, "roi_id").select("roi_id", "event_idx", "frame", (F.col("p") / F.when(F.col("size") == 0, 1.0).otherwise(F.col("size"))).alias("magnitude"))


def onset_offset(traces: DataFrame, events: DataFrame, n_pre: int, n_post: int, n: int) -> DataFrame:
    """roi_id, event_idx, frame, diff, d_prime of each window, by its first and last n samples."""
    if n > n_pre + n_post + 1:
        raise ValueError("n exceeds the window")
    diff, d_prime = A.onset_offset("window", n)
    return per_event(event_windows(traces, events, n_pre, n_post)).select("roi_id", "event_idx", "frame", diff.alias("diff"), d_prime.alias("d_prime"))


def classify_events(traces: DataFrame, events: DataFrame, n_near: int, n_mean: int, inverted: bool = False) -> DataFrame:
    """events with n_neighbors, mean_diff and label: BS where others are within n_near frames, else SS-ADP or SS-noADP by the sign of mean_diff.

    mean_diff is the mean of the last n_mean samples of the window of n_near frames to either side of an
    event, less that of its first n_mean; samples outside of the trace are left out. Both are added up from the event
    outwards, so that the sign of a difference near 0 does not depend on the order in which rows come. A rise is an ADP;
    inverted takes a fall for one, as fits indicators that go down.
    """
    if n_mean > 2 * n_near + 1:
        raise ValueError("n_mean exceeds the window")
    near = count_neighbors(events, n_near)
    before, after = F.reverse(F.slice("window", 1, n_mean)), F.slice("window", -n_mean, n_mean)
    change = A.array_mean(after) - A.array_mean(before)
    means = per_event(event_windows(traces, events, n_near, n_near)).select("roi_id", "event_idx", change.alias("mean_diff"))
    rise = F.col("mean_diff") < 0 if inverted else F.col("mean_diff") > 0
    label = F.when(F.col("n_neighbors") > 0, "BS").when(rise, "SS-ADP").otherwise("SS-noADP")
    return near.join(means, ["roi_id", "event_idx"], "left").select("roi_id", "event_idx", "frame", "n_neighbors", "mean_diff", label.alias("label"))


def label_proportions(labelled: DataFrame, labels: list[str]) -> DataFrame:
    """roi_id and, per label, its count n_<label> and share p_<label> (0 where a roi has none of them)."""
    counts = [F.sum(F.when(F.col("label") == x, 1).otherwise(0)).alias(f"n_{x}") for x in labels]
    found = labelled.groupBy("roi_id").agg(*counts)
    total = sum((F.col(f"n_{x}") for x in labels), F.lit(0))
    return found.select("roi_id", *[f"n_{x}" for x in labels], *[F.coalesce(F.try_divide(F.col(f"n_{x}"), total), F.lit(0.0)).alias(f"p_{x}") for x in labels])


def grouped_type_stats(traces: DataFrame, labelled: DataFrame, events: DataFrame, n_band: int, n_pre: int, n_post: int, mode: str = "pool", groups: DataFrame | None = None, reference: str | None = None) -> DataFrame:
    """label, (group,) offset, mean, std, n: windows of the event nearest to each labelled event of a reference.

    labelled has (roi_id, event_idx, frame, label). Without groups every roi is its own reference. With groups
    (roi_id, group) the labelled events of the roi ``reference`` are matched to the events of every member. Mode pool
    takes all windows alike; mode mean first averages the windows with the same ordinal among the matched events
    over the members of a group, then those means.
    """
    if mode not in ("pool", "mean"):
        raise ValueError(f"no such mode: {mode}")
    keys = ["label", "offset"] if groups is None else ["label", "group", "offset"]
    asked = labelled.select("roi_id", "event_idx", "frame", "label")
    if groups is not None:
        told = asked.where(F.col("roi_id") == reference).drop("roi_id")
        asked = groups.select("roi_id").distinct().join(told, how="cross").select("roi_id", "event_idx", "frame", "label")
    matched = nearest_event(asked.select("roi_id", "event_idx", "frame"), events, n_band, n_band).where("nearest IS NOT NULL")
    named = matched.join(asked.select("roi_id", "event_idx", "label"), ["roi_id", "event_idx"])
    ordinal = F.row_number().over(Window.partitionBy("roi_id", "label").orderBy("event_idx"))
    tagged = named.withColumn("no", ordinal).select("roi_id", F.struct("event_idx", "label", "no").alias("event_idx"), F.col("nearest").alias("frame"))
    windows = event_windows(traces, tagged, n_pre, n_post).select("roi_id", "event_idx.label", "event_idx.no", "offset", "value")
    if groups is not None:
        windows = windows.join(groups, "roi_id")
    if mode == "mean":
        windows = windows.groupBy(*keys, "no").agg(F.avg("value").alias("value"))
    return windows.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def rolling_background(traces: DataFrame, half: int) -> DataFrame:
    """traces with background: twice the population deviation of the positive samples in a centred window; NULL near the ends."""
    at = Window.partitionBy("roi_id").orderBy("frame")
    whole = F.count(F.lit(1)).over(at.rowsBetween(-half, half)) == 2 * half + 1
    spread = F.stddev_pop(F.when(F.col("value") > 0, F.col("value"))).over(at.rowsBetween(-half, half))
    return traces.withColumn("background", F.when(whole, 2 * spread))


def spike_metrics(traces: DataFrame, events: DataFrame, fs: float, half: int, n_post: int) -> DataFrame:
    """roi_id, event_idx, frame, spike_time_s, raw_dff, peak_to_trough_dff, background, sbr of each event."""
    ptt = peak_to_trough(traces, events, 0, n_post)
    at = rolling_background(traces, half).select("roi_id", "frame", "value", "background")
    return ptt.join(at, ["roi_id", "frame"], "left").select(
        "roi_id", "event_idx", "frame", (F.col("frame") / fs).alias("spike_time_s"), F.col("value").alias("raw_dff"), F.col("ptt").alias("peak_to_trough_dff"), "background", F.try_divide("ptt", "background").alias("sbr")
    )


def binned_stats(raw: DataFrame, dff: DataFrame, metrics: DataFrame, fs: float, bin_s: float) -> DataFrame:
    """roi_id, bin_time_s, mean_F, spike_rate, mean_sbr, mean_dff, background_noise per bin.

    Only events with an SBR count; the last bin may be short, and its rate is over its own frames.
    """
    width = round(bin_s * fs)
    own = lambda: F.expr(f"frame div {width}")
    means = raw.groupBy("roi_id", own().alias("bin")).agg(F.avg("value").alias("mean_F"), F.count(F.lit(1)).alias("frames"))
    other = dff.groupBy("roi_id", own().alias("bin")).agg(F.avg("value").alias("mean_dff"))
    spikes = metrics.groupBy("roi_id", own().alias("bin")).agg(F.count("sbr").alias("n"), F.avg("sbr").alias("mean_sbr"), F.avg("background").alias("background_noise"))
    return (
        means.join(other, ["roi_id", "bin"])
        .join(spikes, ["roi_id", "bin"], "left")
        .select("roi_id", (F.col("bin") * width / fs).alias("bin_time_s"), "mean_F", (F.coalesce("n", F.lit(0)) / F.col("frames") * fs).alias("spike_rate"), "mean_sbr", "mean_dff", "background_noise")
    )


def trend_fits(binned: DataFrame, metrics: list[str], log: bool = False) -> DataFrame:
    """roi_id, metric and the line through each metric over bin_time_s.

    Plain: change_per_min, intercept, r2. log: pct_per_min, initial, r2, NULL where a value is not positive. Under two points: NULL.
    """
    long = binned.unpivot(["roi_id", "bin_time_s"], metrics, "metric", "y").where("y IS NOT NULL")
    y = F.when(F.col("y") > 0, F.ln("y")) if log else F.col("y")
    fit = long.groupBy("roi_id", "metric").agg(
        F.regr_slope(y, "bin_time_s").alias("slope"), F.regr_intercept(y, "bin_time_s").alias("at0"), F.regr_r2(y, "bin_time_s").alias("r2"), F.count("y").alias("n"), F.min("y").alias("least")
    )
    sound = (F.col("n") >= 2) & ((F.col("least") > 0) if log else F.lit(True))
    first, second = ((F.exp("slope") - 1) * 6000, F.exp("at0")) if log else (F.col("slope") * 60, F.col("at0"))
    names = ("pct_per_min", "initial") if log else ("change_per_min", "intercept")
    return fit.select("roi_id", "metric", F.when(sound, first).alias(names[0]), F.when(sound, second).alias(names[1]), F.when(sound, F.col("r2")).alias("r2"))


def _per_roi(traces: DataFrame) -> DataFrame:
    """traces with _mean and _sd of each roi: partial sums joined back, so no task sees a whole trace."""
    own = traces.groupBy(F.col("roi_id").alias("_roi")).agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    return traces.join(own, F.col("roi_id") == F.col("_roi"))


def zscore(traces: DataFrame) -> DataFrame:
    """Per roi, values less their mean over their population deviation; a deviation of 0 counts as 1."""
    found = (F.col("value") - F.col("_mean")) / F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    return _per_roi(traces).withColumn("value", found).select(*traces.columns)


def dff_median(traces: DataFrame) -> DataFrame:
    """Per roi, the change against the median in percent; a median of 0 counts as 1."""
    middle = F.percentile("value", F.lit(0.5)).over(Window.partitionBy("roi_id"))
    return traces.withColumn("value", 100 * (F.col("value") - middle) / F.when(middle == 0, 1.0).otherwise(middle))


def clip_center(traces: DataFrame, deviations: float = 10.0) -> DataFrame:
    """Per roi, values held at mean + deviations, then less their median."""
    top = F.col("_mean") + deviations * F.col("_sd")
    held = _per_roi(traces).withColumn("value", F.least(F.col("value"), top)).select(*traces.columns)
    return held.withColumn("value", F.col("value") - F.percentile("value", F.lit(0.5)).over(Window.partitionBy("roi_id")))


def rank_average(rows: DataFrame, by: str = "value", group: str | None = None, ranges: int = 200) -> DataFrame:
    """rows with rank: 1 for the least, ties sharing their mean rank.

    Ranks come from counts per distinct value, so equal values are one row. Without a group the
    values are cut into ranges by approximate quantiles: running sums stay within a range, and the
    totals of the ranges before it, a few numbers, are added.
    """
    keys = [group] if group else []
    counts = rows.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_n"))
    if group:
        upto = F.sum("_n").over(Window.partitionBy(group).orderBy(by))
    else:
        edges = rows.agg(F.percentile_approx(by, [k / ranges for k in range(1, ranges)])).first()[0] or []
        counts = counts.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>"), lambda e: e <= F.col(by))))
        totals = counts.groupBy("_range").agg(F.sum("_n").alias("_t"))
        before = totals.select("_range", (F.sum("_t").over(Window.orderBy("_range")) - F.col("_t")).alias("_before"))  # ranges rows at most
        counts = counts.join(F.broadcast(before), "_range")
        upto = F.sum("_n").over(Window.partitionBy("_range").orderBy(by)) + F.col("_before")
    ranks = counts.select(*keys, by, (upto - (F.col("_n") - 1) / 2).alias("rank"))
    return rows.join(ranks, [*keys, by])


def regress_background(rows: DataFrame, intercept: bool = True) -> DataFrame:
    """roi_id, frame, value: what is left of value after a line through background, per roi; without intercept a multiple of it."""
    if intercept:
        fit = rows.groupBy("roi_id").agg(F.regr_slope("value", "background").alias("a"), F.regr_intercept("value", "background").alias("b"))
    else:
        fit = rows.groupBy("roi_id").agg(F.try_divide(F.sum(F.col("value") * F.col("background")), F.sum(F.col("background") * F.col("background"))).alias("a"), F.lit(0.0).alias("b"))
    return rows.join(fit, "roi_id").select("roi_id", "frame", (F.col("value") - F.col("a") * F.col("background") - F.col("b")).alias("value"))


def update_session(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """existing without the sessions of new, and new. Nothing in new leaves existing as it is."""
    if existing is None:
        return new
    return existing.join(new.select("session").distinct(), "session", "left_anti").unionByName(new)


def concatenate(parts: list[DataFrame]) -> DataFrame:
    """The rois of all parts; a ValueError where their sampling rates differ."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    rates = [r[0] for r in out.select("fs").distinct().limit(2).collect()]
    if len(rates) > 1:
        raise ValueError("sampling rates differ")
    return out


def quantile_spread(traces: DataFrame) -> DataFrame:
    """frame, mean and the 0, 25, 75 and 100 % quantiles across rois."""
    q = F.percentile("value", F.array(*map(F.lit, (0.0, 0.25, 0.75, 1.0))))
    return traces.groupBy("frame").agg(F.avg("value").alias("mean"), q.alias("q")).select("frame", "mean", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("q0", "q25", "q75", "q100"))])


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, n over equal bins from the least to the greatest value, the last one closed."""
    ends = rows.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    placed = rows.crossJoin(ends).select(F.least(F.floor((F.col(column) - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)) * bins), F.lit(bins - 1)).alias("bin"))
    return placed.groupBy(F.coalesce("bin", F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def segment_traces(trace: DataFrame, start: int, length: int, fs: float) -> DataFrame:
    """id, frame (in the segment), value: equal segments from start; a short last one is dropped."""
    numbered = trace.where(F.col("frame") >= start).withColumn("k", F.expr(f"(frame - {start}) div {length}"))
    whole = numbered.groupBy("roi_id", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == length).drop("n")
    begin = (start + F.col("k") * length) / fs
    return numbered.join(whole, ["roi_id", "k"]).select("roi_id", F.format_string("%.2f-%.2fs", begin, begin + length / fs).alias("id"), (F.col("frame") - start - F.col("k") * length).alias("frame"), "value")


def segment_events(events: DataFrame, start: int, length: int, n_segments: int | None = None) -> DataFrame:
    """roi_id, segment, frame (in the segment) of the events that fall in one; without n_segments, segments go on to the last event, so none after start is lost."""
    k = F.expr(f"(frame - {start}) div {length}")
    inside = F.col("frame") >= start
    if n_segments is not None:
        inside &= F.col("frame") < start + length * n_segments
    return events.where(inside).select("roi_id", k.alias("segment"), (F.col("frame") - start - k * length).alias("frame"))


def event_magnitudes(traces: DataFrame, events: DataFrame, n_pre: int, n_post: int, magnitude: Callable[[Column], Column]) -> DataFrame:
    """roi_id, event_idx, frame, magnitude: what a function of the column ``window`` (an array) makes of the samples around each event."""
    return per_event(event_windows(traces, events, n_pre, n_post)).select("roi_id", "event_idx", "frame", magnitude(F.col("window")).alias("magnitude"))
