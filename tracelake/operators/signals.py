"""Signal operators on packed traces: one Arrow batch holds many traces, and a kernel runs on each.

Peaks, exponential fits and lags need a whole trace. Filters with feedback (operators.recursive), phases
(operators.fourier), spectra (operators.spectra) and what needs only a neighbourhood of each sample (operators.spikes,
operators.smoothing) run on blocks of time. Pairs of traces meet in
blocks of traces: a task holds two blocks, and no pair becomes a row before it is reduced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import dsp
from tracelake.operators import fourier, recursive
from tracelake.operators.blocks import blockwise, grouped
from tracelake.sources.tables import pack

PAIR_BLOCK = 64


def map_traces(packed: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """roi_id, values: kernel applied to the values of every roi."""

    def run(batches):
        for batch in batches:
            out = [kernel(np.array(x, float)).tolist() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["roi_id", "values"])

    return packed.select("roi_id", "values").mapInArrow(run, "roi_id string, values array<double>")


def map_together(packed: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """roi_id, values: kernel applied to the rows of a matrix, one for each trace; the traces of a batch that are of one length share a call."""

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            out: list[list[float]] = [[] for _ in rows]
            lengths = np.array([len(x) for x in rows])
            for n in np.unique(lengths[lengths > 0]):
                same = np.flatnonzero(lengths == n)
                for k, line in zip(same, kernel(np.array([rows[j] for j in same], float)), strict=True):
                    out[k] = line.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["roi_id", "values"])

    return packed.select("roi_id", "values").mapInArrow(run, "roi_id string, values array<double>")


def _table(packed: DataFrame, kernel, fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """Rows that kernel yields for the array, the last column, of every row."""

    def run(batches):
        for batch in batches:
            rows = []
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                rows.extend((*row[:-1], *x) for x in kernel(np.array(row[-1], float)))
            parts = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(list(p), t) for p, (_, t) in zip(parts, fields, strict=True)], [n for n, _ in fields])

    return packed.mapInArrow(run, ddl)


def filter_dff(traces: DataFrame, mode: str, window: int = 301, order: int = 2) -> DataFrame:
    """roi_id, frame, dff, baseline of traces (roi_id, frame, value), by mode.

    savgol_add and savgol_mult take a Savitzky-Golay baseline, med_add a running median (of an odd window,
    zeros beyond the ends): local, so they run on blocks. 2exp and 2exp_add fit two exponentials to medians of
    windows of each whole trace. _add gives differences, the others ratios. Where a trace is shorter
    than the window, or a baseline is 0, the result is NULL.
    """
    if mode in ("savgol_add", "savgol_mult"):
        if window % 2 == 0 or order >= window:
            raise ValueError("the window must be odd and exceed the order")

        def kernel(x, first, last):
            base = dsp.savgol_block(x, window, order, "interp", first, last)
            return dsp.change(x, base, mode == "savgol_add"), base

        return blockwise(traces, kernel, window, results=("dff", "baseline"))
    if mode == "med_add":
        half = window // 2

        def median(x, first, last):
            base = dsp.medfilt_block(x, half)
            return x - base, base

        return blockwise(traces, median, half, results=("dff", "baseline"))
    if mode not in ("2exp", "2exp_add"):
        raise ValueError(f"no such mode: {mode}")

    def fitted(x):
        dff, base = dsp.detrend(x, window, mode == "2exp_add")
        return [(k, *(None if math.isnan(v) else float(v) for v in pair)) for k, pair in enumerate(zip(dff, base, strict=True))]

    fields = [("roi_id", pa.string()), ("frame", pa.int64()), ("dff", pa.float64()), ("baseline", pa.float64())]
    return _table(pack(traces), fitted, fields, "roi_id string, frame bigint, dff double, baseline double")


def exponential_fits(traces: DataFrame, window: int = 301) -> DataFrame:
    """roi_id, fit (a, b, c, d, e) of mode 2exp; NULL for a constant trace or one shorter than the window."""

    def kernel(x):
        return [(list(found) if (found := dsp.fit_exponentials(x, window)) else None,)] if len(x) else [(None,)]

    return _table(pack(traces), kernel, [("roi_id", pa.string()), ("fit", pa.list_(pa.float64()))], "roi_id string, fit array<double>")


def pairwise(packed: DataFrame, ready: Callable[[np.ndarray], object], kernel: Callable[[object, object], list[tuple]], fields: list[tuple[str, pa.DataType]], ddl: str, unique: bool = False, block: int = PAIR_BLOCK) -> DataFrame:
    """x, y and what kernel gives for every pair of rois with x <= y, once; unique leaves out a roi with itself.

    Rois are dealt into blocks of about ``block`` by hash, and each pair of blocks is one group: traces are
    sent once to each block, made ready once in a group, and their pairs never stand in a table.
    """
    n = max(1, -(-packed.count() // block))
    parts = F.pmod(F.xxhash64("roi_id"), F.lit(n)).cast("int")
    dealt = packed.select("roi_id", "values", parts.alias("part")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    ordered = dealt.select(F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "roi_id", "values").repartition("i", "j").sortWithinPartitions("i", "j", "part", "roi_id")
    names = ["x", "y", *[f for f, _ in fields]]
    kinds = [pa.string(), pa.string(), *[t for _, t in fields]]

    def run(batches):
        for (i, j), group in grouped(batches, 2):
            held = [(roi, part, ready(np.array(v, float))) for roi, part, v in zip(*(group[c].to_pylist() for c in ("roi_id", "part", "values")), strict=True)]
            for a, (roi, part, own) in enumerate(held):
                rows = []
                for other, its, value in held[a:]:
                    if (i == j or part != its) and not (unique and roi == other):
                        (x, p), (y, q) = sorted([(roi, own), (other, value)], key=lambda e: e[0])
                        rows.extend((x, y, *found) for found in kernel(p, q))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return ordered.mapInArrow(run, f"x string, y string, {ddl}")


def pairwise_cross_correlation(packed: DataFrame, max_lag: int, normalize: bool = True, unique: bool = False) -> DataFrame:
    """x, y, lag, r of all pairs (x <= y), over the frames both have."""

    def kernel(a, b):
        n = min(len(a), len(b))
        if not n:
            return []
        lags, r = dsp.cross_correlation(a[:n], b[:n], max_lag, normalize)
        return list(zip(lags.tolist(), r.tolist(), strict=True))

    return pairwise(packed, lambda x: x, kernel, [("lag", pa.int64()), ("r", pa.float64())], "lag bigint, r double", unique)


def phase(traces: DataFrame, fs: float, low: float, high: float) -> DataFrame:
    """roi_id, frame, value: the phase of the analytic signal of a band of traces (roi_id, frame, value)."""
    return fourier.phase(recursive.bandpass(traces, fs, low, high))


def detect_peaks(packed: DataFrame, height: float, distance: int, prominence: float, reach: int) -> DataFrame:
    """roi_id, frame, height of peaks."""

    def kernel(x):
        return [(int(p), float(x[p])) for p in dsp.find_peaks(x, height, distance, prominence, reach)]

    fields = [("roi_id", pa.string()), ("frame", pa.int64()), ("height", pa.float64())]
    return _table(packed.select("roi_id", "values"), kernel, fields, "roi_id string, frame bigint, height double")


def less_running_mean(traces: DataFrame, size: int) -> DataFrame:
    """traces less the mean of size samples around each, the ends mirrored; by blocks. An even size reaches one sample further back."""

    def kernel(x, first, last):
        before, after = size // 2, size - 1 - size // 2
        padded = np.concatenate([x[:before][::-1] if first else np.repeat(x[:1], before), x, x[::-1][:after] if last else np.repeat(x[-1:], after)])
        while len(padded) < len(x) + size - 1:  # a trace shorter than the window
            padded = np.pad(x, (before, after), mode="symmetric")
        total = np.concatenate([[0.0], np.cumsum(padded)])
        return x - (total[size:] - total[:-size])[: len(x)] / size

    return blockwise(traces, kernel, size)


def smooth_pictures(frames: DataFrame, sigma: float, height: int, width: int) -> DataFrame:
    """frames (frame, row, col, value) with each picture smoothed by a Gaussian, mirrored at its edges; a picture is one group."""
    ordered = frames.select("frame", "row", "col", "value").repartition("frame").sortWithinPartitions("frame")

    def run(batches):
        for (frame,), group in grouped(batches, 1):
            picture = np.zeros((height, width))
            r, c = group["row"].to_numpy(), group["col"].to_numpy()
            picture[r, c] = group["value"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([frame] * len(r), pa.int64()), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(dsp.gaussian(picture, sigma)[r, c], pa.float64())], ["frame", "row", "col", "value"])

    return ordered.mapInArrow(run, "frame bigint, row int, col int, value double")
