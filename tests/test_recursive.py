"""Filters with feedback over blocks against the kernel over whole traces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import dsp
from tracelake.operators import recursive as R
from tracelake.operators import smoothing
from tracelake.operators import spikes as E


def walks(seed, lengths):
    r = np.random.default_rng(seed)
    return {f"r{k}": 50 + np.cumsum(r.normal(size=n)) + 3 * np.sin(np.arange(n) / 7) for k, n in enumerate(lengths)}


def rows(spark, traces):
    return spark.createDataFrame([(roi, k, float(v)) for roi, x in traces.items() for k, v in enumerate(x)], "roi_id string, frame bigint, value double").repartition(5, F.rand(1))


def held(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.roi_id, {})[r.frame] = r.value
    return {roi: np.array([own[k] for k in range(len(own))], float) for roi, own in out.items()}


@pytest.mark.parametrize("specs", [["<0.5"], [">2"], ["0.8-1.5"], ["<0.2", ">3", "1-1.2"]])
def test_filters_equal_the_whole_trace(spark, specs):
    # One trace has most rows and is many blocks; others end right before, at and behind the border of a block, or are a few samples.
    traces = walks(1, [2000, 150, 100, 99, 101, 102, 127, 1, 2, 12, 40])
    got = held(R.frequency_filter(rows(spark, traces), 10.0, specs, block=50))
    assert set(got) == set(traces)
    for roi, x in traces.items():
        want = dsp.frequency_filter(x, 10.0, specs)
        assert len(got[roi]) == len(x)
        assert np.abs(got[roi] - want).max() < 1e-9 * max(1, np.abs(x).max()), roi


@pytest.mark.parametrize("block", [64, 333, 8192])
def test_bandpass_does_not_depend_on_blocks(spark, block):
    traces = walks(2, [3000, 700])
    got = held(R.bandpass(rows(spark, traces), 100.0, 2.0, 9.0, block=block))
    for roi, x in traces.items():
        assert np.abs(got[roi] - dsp.bandpass(x, 100.0, 2.0, 9.0)).max() < 1e-9


def test_large_trace_is_many_tasks(spark):
    traces = walks(3, [4000])
    packed = R.pack_blocks(rows(spark, traces), R.Cascade(dsp.butterworth(4, 0.1, "high")), 100)
    assert packed.count() == 40
    assert packed.select(F.max(F.size("samples"))).first()[0] <= 100 + 3 * 9


def test_missing_values_and_frames(spark):
    traces = rows(spark, walks(4, [500, 300]))
    filtered = R.frequency_filter(traces.withColumn("value", F.when((F.col("roi_id") != "r0") | (F.col("frame") != 250), F.col("value"))), 10.0, ["<0.5"], block=100)
    assert {(r.roi_id, r.n) for r in filtered.groupBy("roi_id").agg(F.count("value").alias("n")).collect()} == {("r0", 0), ("r1", 300)}
    with pytest.raises(Exception, match="missing or repeated"):
        R.frequency_filter(traces.where("frame <> 130"), 10.0, ["<0.5"], block=100).collect()
    assert R.frequency_filter(traces.limit(0), 10.0, ["<0.5"]).count() == 0


def test_cascade_equals_its_sections():
    r = np.random.default_rng(5)
    sections = dsp.butterworth(4, (0.05, 0.2), "band")
    x, cascade = r.normal(size=(3, 333)), R.Cascade(sections)
    y, state = cascade(x, np.zeros((3, 2 * len(sections))))
    want = x
    for s in sections:
        want = dsp._section(want, s, np.zeros((2, 3)))
    assert np.abs(y - want).max() < 1e-11
    halves = cascade(x[:, :100], np.zeros((3, 2 * len(sections))))
    again, last = cascade(x[:, 100:], halves[1])
    assert np.abs(np.concatenate([halves[0], again], axis=1) - y).max() < 1e-11
    assert np.abs(last - state).max() < 1e-11


def test_missing_frames_are_missing_samples(spark):
    # k squared without frames 10 and 11: a window that reaches them has no smooth, all others are exact.
    left = spark.createDataFrame([("a", k, float(k * k)) for k in range(40) if k not in (10, 11)], "roi_id string, frame bigint, value double")
    for order, mode in ((2, "interp"), (2, "nearest"), (4, "interp")):
        got = {r.frame: r.value for r in E.savgol(left, 5, order, mode).collect()}
        assert set(got) == set(range(40)) - {10, 11}
        for k in range(2, 38):
            if k not in (10, 11):
                assert (got[k] is None) if 8 <= k <= 13 else got[k] == pytest.approx(k * k), (order, mode, k)
    with pytest.raises(Exception, match="there twice"):
        E.savgol(left.union(left.where("frame = 7")), 5, 2, "nearest").collect()


@pytest.mark.parametrize(("window", "order"), [(5, 2), (9, 3), (21, 1), (7, 0)])
def test_smoothing_in_windows_equals_the_kernel(spark, window, order):
    traces = walks(6, [300, window, window - 1, window + 1, 64, 65, 1])
    got = {(r.roi_id, r.frame): r.smooth for r in smoothing.savgol(rows(spark, traces), window, order, block=32).collect()}
    assert len(got) == sum(map(len, traces.values()))
    for roi, x in traces.items():
        own = np.array([got[roi, k] for k in range(len(x))], float)
        if len(x) < window:
            assert np.isnan(own).all()
        else:
            assert np.allclose(own, dsp.savgol(x, window, order), atol=1e-8)
