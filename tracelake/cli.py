"""Command line over Parquet tables: python -m tracelake.cli COMMAND INPUT... OUTPUT."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracelake.operators import extraction as X
from tracelake.operators import guided
from tracelake.operators import motion as M
from tracelake.operators import signals as G
from tracelake.operators import spikes as E
from tracelake.operators import statistics as S
from tracelake.operators import video as V
from tracelake.operators.extract import LowRank, extract_traces
from tracelake.operators.sketches import randomized_svd
from tracelake.sources import files


def parse_slice(text: str) -> tuple[int | None, int | None, int]:
    """start:stop:step, or one number for a slice of one."""
    parts = [int(x) if x.strip() else None for x in text.split(":")]
    if len(parts) == 1:
        return parts[0], parts[0] + 1 if parts[0] != -1 else None, 1
    start, stop, step = [*parts, None, None][:3]
    if step is not None and step < 1:
        raise ValueError("a step is 1 or more")
    return start, stop, step or 1


def video(spark, path: str) -> LowRank:
    """A low-rank video as convert writes it: u holds the singular values."""
    u = spark.read.parquet(f"{path}/u")
    return LowRank(u, files.read_codes(spark, f"{path}/v"), len(u.first()["u"]))


def save_video(spark, u, s: list[float], v, path: str) -> None:
    """u with the singular values in it, s, and v, a table each."""
    LowRank.of(u, s, v).u.write.parquet(f"{path}/u")
    spark.createDataFrame([(s,)], "s array<double>").write.parquet(f"{path}/s")
    files.save_codes(v.select("row", "col", "v"), f"{path}/v")


def convert(spark, a):
    if files.is_low_rank(spark, a.input):
        low = video(spark, a.input)
        files.save_video(V.frames_of(low.u, low.v), a.output, a.batch)
        return
    spark.dataSource.register(files.RawFrames)
    raw = spark.read.format("rawframes").options(path=a.input, width=a.width, height=a.height, offset=a.offset, gap=a.gap, dtype=a.dtype).load()
    files.save_video(raw.select("frame", "pixels"), a.output, a.batch)


def svd(spark, a):
    frames = spark.read.parquet(a.input).select("frame", "pixels")
    work = f"{a.output}/passes"
    if not a.restart and files.stored(spark, f"{work}/settings") is not None:
        raise ValueError(f"{work} holds a conversion under way; --restart goes on with it")
    u, s, right = randomized_svd(frames, a.width * a.height, a.rank, a.seed, passes=a.passes, path=work, each=a.each or None, block=a.batch)
    place = [F.expr(f"cast(pixel div {a.width} AS int)").alias("row"), F.expr(f"cast(pixel % {a.width} AS int)").alias("col")]
    save_video(spark, u, s, right.select(*place, "v"), a.output)


def svd_guided(spark, a):
    frames = spark.read.parquet(a.input).select("frame", F.posexplode("pixels").alias("p", "value"))
    long = frames.selectExpr("frame", f"cast(p div {a.width} AS int) AS row", f"cast(p % {a.width} AS int) AS col", "cast(value AS double) AS value")
    numbers = lambda text: tuple(int(x) for x in text.split(","))
    found = guided.guided_svd(long, spark.read.parquet(a.rois), sizes=numbers(a.sizes), hops=numbers(a.hops), windows=numbers(a.windows), clusters=a.clusters, rank=a.rank or None)
    save_video(spark, *found, a.output)


def info(spark, a):
    for name in "usv" if files.is_low_rank(spark, a.input) else ("",):
        table = spark.read.parquet(f"{a.input}/{name}")
        print(name or "frames", table.count())
        table.printSchema()


def cut(spark, a):
    if not files.is_low_rank(spark, a.input):
        V.slice_frames(spark.read.parquet(a.input), *parse_slice(a.temporal)).write.parquet(a.output)
        return
    low, (start, stop, step) = video(spark, a.input), parse_slice(a.component)
    rows, cols = ([parse_slice(x) for x in a.spatial.split(",")] + [(None, None, 1)])[:2]
    ahead = lambda x: (x[0] or 0, x[1]) if (x[0] or 0) >= 0 and (x[1] or 0) > 0 else None  # noqa: E731  what prunes folders
    pixels = files.read_codes(spark, f"{a.input}/v", ahead(rows), ahead(cols), (0, stop) if (stop or 0) > 0 and (start or 0) >= 0 else None)
    V.slice_components(V.slice_frames(low.u, *parse_slice(a.temporal)), "u", start, stop, step).write.parquet(f"{a.output}/u")
    V.slice_components(spark.read.parquet(f"{a.input}/s"), "s", start, stop, step).write.parquet(f"{a.output}/s")
    files.save_codes(V.slice_components(V.slice_pixels(pixels, rows, cols), "v", start, stop, step), f"{a.output}/v")


def changed(spark, a, u):
    """The video of a.input with other codes of frames."""
    u.write.parquet(f"{a.output}/u")
    spark.read.parquet(f"{a.input}/s").write.parquet(f"{a.output}/s")
    files.save_codes(files.read_codes(spark, f"{a.input}/v"), f"{a.output}/v")


def video_sub(spark, a):
    changed(spark, a, X.subtractive_lowpass(video(spark, a.input).u, a.window, a.order))


def video_dff(spark, a):
    low = video(spark, a.input)
    changed(spark, a, X.divisive_lowpass(low.u, low.v, a.window, a.order, low.rank))


def motion(spark, a):
    mask = spark.read.parquet(a.mask) if a.mask else None
    fixed, shifts = M.motion_correct(video(spark, a.input), a.height, a.width, a.max_shift, a.passes, mask=mask, hpf=a.hpf, max_rank=a.rank or None)
    left, sigma, right = V.orthogonal(fixed.u, [1.0] * fixed.rank, fixed.v)
    save_video(spark, left, sigma, right, a.output)
    shifts.selectExpr("frame", "dy AS est_row_shift", "dx AS est_col_shift").write.option("header", True).csv(f"{a.output}/shifts")


def extract(spark, a):
    weights = spark.read.parquet(a.rois)
    if "weight" not in weights.columns:
        weights = weights.withColumn("weight", F.lit(1.0))
    if files.is_low_rank(spark, a.input):
        source = video(spark, a.input)
    else:
        pixels = spark.read.parquet(a.input).select("frame", F.posexplode("pixels").alias("p", "value"))
        source = pixels.selectExpr("frame", f"cast(p div {a.width} AS int) AS row", f"cast(p % {a.width} AS int) AS col", "cast(value AS double) AS value")
    found, rings = extract_traces(source, weights, a.height, a.width, (a.inner, a.outer), ols=a.ols, weighted=not a.uniform, remove_neuropil=not a.keep_neuropil, normalize=a.normalize, smooth=a.smooth)
    found.write.parquet(a.output)
    if rings is not None and a.neuropil:
        rings.write.parquet(a.neuropil)


def survey(spark, a):
    low = video(spark, a.input)
    if a.fs or a.hpf_ms or a.spike_hpf_ms:
        # Lengths in time, at the rate of the session file beside the video or of --fs.
        fs = files.session_rate(spark, a.input, a.fs or 500.0)
        a.dff_window = E.odd(round(a.hpf_ms * fs / 1000)) if a.hpf_ms else a.dff_window
        a.spike_window = E.odd(round(a.spike_hpf_ms * fs / 1000)) if a.spike_hpf_ms else a.spike_window
    found = X.spatial_survey(
        low.u, low.v, a.height, a.width, low.rank, grid=a.grid, percentile=a.percentile, closing=a.closing, least=a.least, dff_window=a.dff_window, spike_window=a.spike_window, sd_threshold=a.threshold, despike_window=a.despike_window, despike_smooth=a.despike_smooth
    )
    for name in ("regions", "events", "raw", "highpass", "baseline", "standard", "despiked"):
        getattr(found, name).write.parquet(f"{a.output}/{name}")


def trace_dff(spark, a):
    G.filter_dff(spark.read.parquet(a.input), a.mode, a.window).write.parquet(a.output)


def detect(spark, a):
    E.detect_spikes(spark.read.parquet(a.input), a.threshold, a.window or None, a.positive).write.parquet(a.output)


def report(spark, a):
    traces, events = spark.read.parquet(a.input), spark.read.parquet(a.events)
    metrics = S.spike_metrics(traces, events, a.fs, a.half, max(1, round(a.fs / 100)))
    S.binned_stats(traces, traces, metrics, a.fs, a.bin).write.parquet(a.output)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tracelake")
    commands = out.add_subparsers(dest="command", required=True)

    def add(name, run, *options, extra=()):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("input")
        for x in extra:
            p.add_argument(x)
        if run is not info:
            p.add_argument("output")
        for flag, default in options:
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, type=type(default), default=default)

    size = (("--width", 588), ("--height", 624))
    add("h5-convert", convert, *size, ("--offset", 0), ("--gap", 1728), ("--dtype", "uint8"), ("--batch", 1000))
    add("convert", svd, *size, ("--rank", 50), ("--seed", 0), ("--passes", 2), ("--batch", 1000), ("--each", 0), ("--restart", False))
    bands = (("--sizes", "21,11,5"), ("--hops", "10,5,2"), ("--windows", "5000,1000,200"))
    add("convert-guided", svd_guided, *size, *bands, ("--clusters", 10), ("--rank", 0), extra=("rois",))
    add("svd-info", info)
    add("slice", cut, ("--temporal", ":"), ("--spatial", ":"), ("--component", ":"))
    add("video-sub-dff", video_sub, ("--window", 301), ("--order", 2))
    add("video-dff", video_dff, ("--window", 301), ("--order", 2))
    add("motion-correct", motion, *size, ("--max-shift", 10), ("--passes", 2), ("--mask", ""), ("--hpf", 10.0), ("--rank", 0))
    ring = (("--inner", -1), ("--outer", -1), ("--smooth", 0), ("--neuropil", ""))
    add("extract-traces", extract, *size, *ring, ("--ols", False), ("--uniform", False), ("--keep-neuropil", False), ("--normalize", False), extra=("rois",))
    lengths = (("--dff-window", 201), ("--spike-window", 75), ("--despike-window", 3), ("--despike-smooth", 51))
    add("spatial-survey", survey, *size, ("--grid", 8), ("--percentile", 90.0), ("--closing", 5), ("--least", 50), ("--threshold", 4.0), *lengths, ("--fs", 0.0), ("--hpf-ms", 0.0), ("--spike-hpf-ms", 0.0))
    add("trace-dff", trace_dff, ("--mode", "savgol_mult"), ("--window", 301))
    add("detect-spikes", detect, ("--threshold", 3.0), ("--window", 0), ("--positive", False))
    add("qc-report", report, ("--fs", 500.0), ("--half", 250), ("--bin", 10.0), extra=("events",))
    return out


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName("tracelake").getOrCreate(), a)


if __name__ == "__main__":
    main()
