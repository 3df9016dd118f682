"""Small worked examples with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import arrays as A
from tracelake.functions import dsp
from tracelake.operators import event_joins as J
from tracelake.operators import regions as R
from tracelake.operators import spikes as E
from tracelake.operators import statistics as S
from tracelake.operators.blocks import blockwise
from tracelake.operators.quantiles import quantiles


def lit(values):
    return F.array(*[F.lit(v) for v in values])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def events(spark, lists):
    return spark.createDataFrame([(str(r), k, f) for r, fs in enumerate(lists) for k, f in enumerate(fs)], "roi_id string, event_idx bigint, frame bigint")


def traces(spark, lists):
    return spark.createDataFrame([(str(r), k, float(v)) for r, vs in enumerate(lists) for k, v in enumerate(vs)], "roi_id string, frame bigint, value double")


@pytest.mark.parametrize(
    ("values", "bins", "left", "right", "counts"),
    [
        ([0, 0, 1, 2, 4], range(6), [0, 2, 3, 4, 4], [2, 3, 4, 4, 5], [2, 1, 1, 0, 1]),
        ([2, 3, 3], range(6), [0, 0, 0, 1, 3], [0, 0, 1, 3, 3], [0, 0, 1, 2, 0]),
        ([1, 1, 1], range(4), [0, 0, 3], [0, 3, 3], [0, 3, 0]),
        ([5, 6, 7], range(6), [0, 0, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]),
    ],
)
def test_boundsorted(spark, values, bins, left, right, counts):
    v, e = lit(values), lit(bins)
    assert one(spark, A.boundsorted_counts(v, e)) == counts
    low, high = A.bounds(v, e)
    assert one(spark, low) == left
    assert one(spark, high) == right


def test_digitize(spark):
    edges = lit(range(5))
    assert [one(spark, A.digitize(F.lit(x), edges)) for x in range(5)] == [0, 1, 2, 3, 4]
    assert [one(spark, A.digitize(F.lit(x), edges, right=True)) for x in range(5)] == [1, 2, 3, 4, 5]
    assert [one(spark, A.digitize(F.lit(x), edges, right=True)) for x in (-1, 0, 5)] == [0, 1, 5]
    uneven = lit([0.0, 1.0, 3.0, 4.0])
    assert [one(spark, A.digitize(F.lit(x), uneven)) for x in (0.5, 1.5, 2.5, 3.5)] == [1, 2, 2, 3]


def test_demean(spark):
    assert one(spark, A.demean(lit([1.0, 2.0, 3.0]))) == [-1, 0, 1]
    assert one(spark, A.demean(lit([4.0, 5.0]))) == [-0.5, 0.5]
    assert one(spark, A.demean(F.array().cast("array<double>"))) == []


def test_neighbor_events(spark):
    def found(a, b, **k):
        return [r.neighbors for r in J.neighbor_events(events(spark, a), events(spark, b), 2, 2, **k).orderBy("roi_id", "event_idx").collect()]

    assert found([[10, 20, 30], [100]], [[9, 11, 25], [200]]) == [[9, 11], [], [], []]
    assert found([[10]], [[8, 9, 11, 12]], max_n=2) == [[9, 11]]
    assert found([[10]], [[8, 9, 11, 12]], max_n=10) == [[8, 9, 11, 12]]
    assert found([[10]], [[8, 9, 11, 12]], max_n=1) == [[9]]


def test_nearest_event(spark):
    got = J.nearest_event(events(spark, [[10, 20, 30]]), events(spark, [[11, 25]]), 2, 2).orderBy("event_idx").collect()
    assert [r.nearest for r in got] == [11, None, None]


def test_windows_beyond_the_trace_are_null(spark):
    got = J.event_windows(traces(spark, [[0, 1, 2]]), events(spark, [[0, 2]]), 1, 1).orderBy("event_idx", "offset").collect()
    assert [r.value for r in got] == [None, 0, 1, 1, 2, None]


@pytest.mark.parametrize(("values", "n", "diff", "d"), [(range(6), 2, 4, 8), ([1, 1, 1, 1], 2, 0, 0), ([1, 1, 2, 2], 2, 1, math.inf), ([2, 2, 1, 1], 2, -1, -math.inf)])
def test_onset_offset(spark, values, n, diff, d):
    a, b = A.onset_offset(lit(map(float, values)), n)
    assert one(spark, a) == diff
    assert one(spark, b) == pytest.approx(d)


def test_template(spark):
    got = S.event_template(traces(spark, [range(5)]), events(spark, [[1, 3]]), 1, 1).orderBy("offset").collect()
    assert [r["mean"] for r in got] == [1, 2, 3]


def test_magnitude(spark):
    t = lit([1.0, 0.0, -1.0])
    assert one(spark, A.template_magnitude(t, t)) == pytest.approx(math.sqrt(2))
    assert one(spark, A.template_magnitude(t, lit([0.0, 0.0, 0.0]))) == 0


def test_peak_to_trough(spark):
    assert S.peak_to_trough(traces(spark, [range(5)]), events(spark, [[1]]), 1, 1).first()["ptt"] == 2


def test_classify(spark):
    close = S.classify_events(traces(spark, [range(20)]), events(spark, [[8, 10]]), 3, 2)
    assert {(r.label, r.n_neighbors) for r in close.collect()} == {("BS", 1)}
    step = traces(spark, [[0] * 10 + [1] * 10])
    assert S.classify_events(step, events(spark, [[10]]), 3, 2).first()["label"] == "SS-ADP"
    assert S.classify_events(step, events(spark, [[10]]), 3, 2, inverted=True).first()["label"] == "SS-noADP"


def test_classify_takes_the_ends_of_the_window(spark):
    # Around the event the trace falls, between the ends of the window it rises.
    trace = [0, 0, 9, 9, 9, 5, 1, 1, 1, 4, 4]
    got = S.classify_events(traces(spark, [trace]), events(spark, [[5]]), 5, 2).first()
    assert (got.mean_diff, got.label) == (4, "SS-ADP")
    assert S.classify_events(traces(spark, [trace]), events(spark, [[5]]), 2, 2).first()["label"] == "SS-noADP"
    with pytest.raises(ValueError):
        S.classify_events(traces(spark, [trace]), events(spark, [[5]]), 1, 4)


def spikes_by_hand(x, threshold, window, positive):
    x = np.asarray(x, float) * (1 if positive else -1)
    v = x - dsp.savgol(x, window, 2) if window else x
    below = v[v < 0]
    noise = below.std() if len(below) else v.std()
    out, k = [], 0
    while k < len(v):
        end = k
        while end < len(v) and v[end] > threshold * noise:
            end += 1
        if end > k:
            at = k + int(v[k:end].argmax())
            amplitude = x[at] - x[max(0, at - 3) : at].min() if at else 0.0
            out.append((at, amplitude, amplitude / noise if noise > 0 else amplitude))
        k = max(end, k + 1)
    return out


@pytest.mark.parametrize("positive", [True, False])
@pytest.mark.parametrize(("window", "block"), [(None, 8192), (None, 7), (9, 8192), (9, 5)])
def test_detect_spikes_by_hand(spark, positive, window, block):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2, 90)).cumsum(axis=1) / 3
    x[:, [0, 1, 40, 41, 42, 89]] += 4 if positive else -4
    got = E.detect_spikes(traces(spark, x), 1.0, window, positive, block).orderBy("roi_id", "frame").collect()
    want = [(str(r), k, *s) for r in range(2) for k, s in enumerate(spikes_by_hand(x[r], 1.0, window, positive))]
    assert [(r.roi_id, r.event_idx, r.frame) for r in got] == [w[:3] for w in want]
    assert np.allclose([(r.amplitude, r.sbr) for r in got], [w[3:] for w in want])


def test_blocks_equal_whole_traces(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2, 70))
    long = traces(spark, x)
    kernel = lambda v, first, last: dsp.savgol_block(v, 11, 2, "interp", first, last)
    for block in (12, 20, 70, 1000):
        got = blockwise(long, kernel, 11, block=block).orderBy("roi_id", "frame").collect()
        assert np.allclose([r.value for r in got], np.concatenate([dsp.savgol(r, 11, 2) for r in x]))
    assert all(r.value is None for r in E.savgol(traces(spark, [[1, 2, 3]]), 5).collect())


def test_despike_impute(spark):
    x = np.random.default_rng(10).standard_normal(40)
    got = [r.value for r in E.despike_impute(traces(spark, [x]), events(spark, [[12]]), 4, 7).orderBy("frame").collect()]
    near = [k < 2 or k > 37 or abs(k - 12) <= 2 for k in range(40)]
    assert np.allclose(got, np.where(near, dsp.savgol(x, 7, 2), x))


def test_exact_quantiles_without_one_task(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.standard_normal(3000), np.full(900, 0.25), [1e9, -1e9]])
    rows = spark.createDataFrame([(float(v),) for v in x], "value double").repartition(4)
    shares = [0, 0.001, 0.25, 0.5, 0.77, 0.999, 1]
    for small in (50, 10**6):
        assert np.allclose(quantiles(rows, "value", shares, small), np.quantile(x, shares), rtol=1e-12)
    assert quantiles(rows.limit(0), "value", [0.5]) == [None]


def test_hierarchy(spark):
    ids = spark.createDataFrame([(i,) for i in ("1", "1.b2", "1.b2.3", "1.b1", "1.x.y", "7.2")], "id string")
    assert {r.id: r.root for r in R.roots(ids).collect()} == {"1": "1", "1.b2": "1", "1.b2.3": "1", "1.b1": "1", "1.x.y": "1.x.y", "7.2": "7.2"}
    assert {r.id: r.children for r in R.children(ids).collect()} == {"1": ["1.b1", "1.b2"], "1.b2": ["1.b2.3"], "1.b2.3": [], "1.b1": [], "1.x.y": [], "7.2": []}
    below = [r.id for r in R.subtrees(ids).where("root = '1'").orderBy("place").collect()]
    assert below == ["1", "1.b1", "1.b2", "1.b2.3"]
    order = spark.createDataFrame([("1", 1), ("7.2", 0), ("1.b2", 0), ("1.b1", 1), ("1.b2.3", 0), ("1.x.y", 2)], "id string, ord int")
    known = [r.id for r in R.topological(ids, order).collect() if r.id != "1.x.y"]
    assert known.index("1.b2") < known.index("1.b2.3") < known.index("1.b1")


def test_list_hooks(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 6.0],), ([],), (None,)], "a array<double>")
    got = rows.select(A.reduce_lists(lambda x: float(np.median(x)))("a").alias("m"), A.apply_lists(lambda x: x - x.mean())("a").alias("d"), A.resample("a", 5).alias("r")).collect()
    assert [r.m for r in got] == [2.0, None, None]
    assert [r.d for r in got] == [[-2.0, -1.0, 3.0], [], None]
    assert got[0].r == [1.0, 1.5, 2.0, 4.0, 6.0]
    assert one(spark, A.digitize_list(lit([0.5, 1.0, 2.5]), lit([1.0, 2.0]))) == [0, 0, 2]
    assert one(spark, A.bucket_bounds(lit([0.0, 0.0, 2.0]), 3)) == [2, 0, 1, 0]
    assert one(spark, A.double_exponential(F.lit(2.0), 3, -0.5, -1, 4, 1)) == pytest.approx(3 * math.exp(-1) + 1)


def test_hopping_counts(spark):
    rois = spark.createDataFrame([("0",)], "roi_id string")
    got = J.hopping_counts(events(spark, [[15]]), rois, 10, 20, 31).orderBy("anchor").collect()
    assert [r.n for r in got] == [0, 1, 1, 0]
    two = spark.createDataFrame([("0",), ("1",)], "roi_id string")
    got = J.hopping_counts(events(spark, [[], [10]]), two, 10, 10, 31).where("roi_id = '0'").collect()
    assert [r.n for r in got] == [0, 0, 0, 0]


def test_cross_correlation_lag(spark):
    x = [math.sin(k * k * 0.1) for k in range(60)]
    y = x[-3:] + x[:-3]
    got = E.cross_correlate(traces(spark, [x]), traces(spark, [y]), 5).orderBy(F.desc("r")).first()
    assert got.lag == -3
    flat = E.cross_correlate(traces(spark, [[1] * 30]), traces(spark, [[1] * 30]), 3)
    assert all(r.r == 0 for r in flat.collect())


def test_bursts(spark):
    rois = spark.createDataFrame([("0",), ("1",)], "roi_id string")
    got = E.group_bursts(events(spark, [[1, 3, 10, 12]]), 4, rois).orderBy("roi_id", "burst").collect()
    assert [r.frames for r in got] == [[1, 3], [10, 12], []]


def test_boundary_edges(spark):
    px = spark.createDataFrame([("a", 0, 0), ("b", 0, 0), ("b", 0, 1), ("c", 0, 0), ("c", 0, 1), ("c", 1, 0), ("c", 1, 1)], "roi_id string, row int, col int")
    assert {r.roi_id: r["count"] for r in R.boundary_edges(px).groupBy("roi_id").count().collect()} == {"a": 4, "b": 6, "c": 8}


def test_annulus_of_a_pixel(spark):
    px = spark.createDataFrame([("a", 5, 5)], "roi_id string, row int, col int")
    ring = {(r.row, r.col) for r in R.annuli(px, 1, 2, 10, 10).collect()}
    assert ring == {(5 + r, 5 + c) for r in range(-2, 3) for c in range(-2, 3) if abs(r) + abs(c) == 2}
    assert R.annuli(px, -1, 2, 10, 10).count() == 0


def test_ids(spark):
    ids = spark.createDataFrame([("1",), ("1.b2",), ("1.b2.3",), ("7.2",), ("s1",)], "id string")
    tree = {r.id: (r.depth, r.parent) for r in R.id_columns(ids).collect()}
    assert tree == {"1": (1, None), "1.b2": (2, "1"), "1.b2.3": (3, "1.b2"), "7.2": (2, None), "s1": (1, None)}
    kinds = {r.id: (r.kind, r.short) for r in R.process_ids(ids).collect()}
    assert kinds["1.b2"] == ("branch", "1.b2")
    assert kinds["s1"][0] == "soma"
    colors = {r.id: r.color for r in R.color_cycle(ids, 5).collect()}
    assert colors["1"] != colors["1.b2"] != colors["1.b2.3"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "parent string, child string")
    assert {(r.root, r.node, r.depth) for r in R.recursive_closure(spark, edges).collect()} == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}


def test_linear_index(spark):
    got = R.from_linear_index(spark.createDataFrame([(1,), (4,), (11,)], "idx int"), 10).select("row", "col", R.linear_index(F.col("row"), F.col("col"), 10).alias("i")).collect()
    assert [tuple(r) for r in got] == [(0, 0, 1), (3, 0, 4), (0, 1, 11)]


def test_update_session(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "session string, x int")
    new = spark.createDataFrame([("b", 3)], "session string, x int")
    assert {tuple(r) for r in S.update_session(old, new).collect()} == {("a", 1), ("b", 3)}
    assert S.update_session(None, new).count() == 1
    assert S.update_session(old, new.limit(0)).count() == 2


def test_concatenate(spark):
    a = spark.createDataFrame([("a", 10.0)], "roi_id string, fs double")
    assert S.concatenate([a, a]).count() == 2
    with pytest.raises(ValueError):
        S.concatenate([a, a.withColumn("fs", F.lit(5.0))])


def test_rank_average(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "value double")
    assert sorted(r["rank"] for r in S.rank_average(rows).collect()) == [1, 2.5, 2.5, 4]


def test_match_labels(spark):
    roots = spark.createDataFrame([("1", "0")], "roi_id string, root string")
    own = events(spark, [[], [10, 50]])
    labels = spark.createDataFrame([("0", 11, 0, "SS"), ("0", 11, 1, "BS")], "roi_id string, frame bigint, event_idx bigint, label string")
    got = J.match_labels(own, roots, labels, 3, 3).collect()
    assert [(r.frame, r.root_frame, r.label) for r in got] == [(10, 11, "SS")]


def test_positive_spread_and_thinning(spark):
    got = E.positive_spread(traces(spark, [[1, -1, 2, -2, 3, -3, 4, -4, 5]]), 4).orderBy("frame").collect()
    assert all(r.spread is not None and r.spread > 0 for r in got)
    frames = spark.createDataFrame([("0", k) for k in range(0, 100, 5)], "roi_id string, frame bigint")
    n = spark.createDataFrame([("0", 100)], "roi_id string, n bigint")
    kept = [r.frame for r in E.thin_events(frames, n, 10, 4).orderBy("frame").collect()]
    assert len(kept) == 4
    assert min(kept) >= 10
