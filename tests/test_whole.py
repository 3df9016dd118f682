"""Queries over tables beyond what the fixed sizes, prefixes and id filters of their first versions kept, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect
from tracelake.operators import event_joins as J
from tracelake.operators import references as RS
from tracelake.plans import registry
from tracelake.sources import tables as T

WIDTH, RANK = 25, 64


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """A folder whose image has 28 rows, the last one not full; labels of 12 regions."""
    path = str(tmp_path_factory.mktemp("tall"))
    rng = np.random.default_rng(3)
    codes = rng.standard_normal((27 * WIDTH + 9, RANK))
    rows = [(k, c.tolist(), int(label)) for k, (c, label) in enumerate(zip(codes, rng.integers(0, 12, len(codes)), strict=True))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def pixels(tall, spark):
    """(row, col) -> (code, roi_id)."""
    return {(r.vec_id // WIDTH, r.vec_id % WIDTH): (np.array(r.embedding), str(r.label)) for r in spark.read.parquet(f"{tall}/embeddings.parquet").collect()}


def _ball(at, steps):
    return {(at[0] + r, at[1] + c) for r in range(-steps, steps + 1) for c in range(-steps, steps + 1) if abs(r) + abs(c) <= steps}


def _rings(pixels, inner, outer):
    """roi_id -> pixels of the image between the two dilations."""
    own = {}
    for at, (_, roi) in pixels.items():
        own.setdefault(roi, set()).add(at)
    height = max(r for r, _ in pixels) + 1
    grown = lambda s, n: {q for p in s for q in _ball(p, n) if 0 <= q[0] < height and 0 <= q[1] < WIDTH}
    return {roi: grown(s, outer) - grown(s, inner) for roi, s in own.items()}


def _opened(mask, height):
    kept = {p for p in mask if _ball(p, 1) <= mask}
    return {q for p in kept for q in _ball(p, 1) if 0 <= q[0] < height and 0 <= q[1] < WIDTH}


def test_local_correlation_has_all_rows(spark, tall, pixels):
    got = {(r.row, r.col): r.r for r in registry.QUERIES["local_correlation"](spark, tall).collect()}
    height = max(r for r, _ in pixels) + 1
    unit = {at: v / np.linalg.norm(v) for at, (v, _) in pixels.items()}
    assert set(got) == set(unit)
    for (r, c), v in unit.items():
        around = [(min(max(r + a, 0), height - 1), min(max(c + b, 0), WIDTH - 1)) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
        assert got[r, c] == pytest.approx(np.mean([v @ unit[q] for q in around if q in unit]), abs=2e-5)


def test_annulus_pixels_have_all_rows(spark, tall, pixels):
    got = {(r.roi_id, r.row, r.col) for r in registry.QUERIES["annulus_pixels"](spark, tall).collect()}
    assert got == {(roi, *p) for roi, ring in _rings(pixels, 1, 3).items() for p in ring}


def test_masks_have_all_rows(spark, tall, pixels):
    height = max(r for r, _ in pixels) + 1
    got = {(r.row, r.col) for r in registry.QUERIES["opened_mask"](spark, tall).collect()}
    want = _opened({at for at, (v, _) in pixels.items() if v[0] >= 0}, height)
    assert got == want and max(r for r, _ in want) >= 20
    got = {(r.row, r.col) for r in registry.QUERIES["dark_mask"](spark, tall).collect()}
    cut, top = np.quantile([v[0] for v, _ in pixels.values()], 0.9), np.quantile([v[1] for v, _ in pixels.values()], 0.98)
    near = {q for at, (v, _) in pixels.items() if v[1] >= top for q in _ball(at, 1)}
    want = _opened({at for at, (v, _) in pixels.items() if v[0] <= cut} - near, height)
    assert got == want and max(r for r, _ in want) >= 20


@pytest.fixture(scope="module")
def uneven(spark, tmp_path_factory):
    """A folder of events where one user has 260 rows and others few."""
    path = str(tmp_path_factory.mktemp("uneven"))
    rng = np.random.default_rng(4)
    users = [u for u, n in ((0, 260), (1, 83), (2, 20), (3, 4), (7, 40), (25, 66)) for _ in range(n)]
    kinds = ["error", "purchase", "view"]
    rows = [(k, u, k, kinds[rng.integers(0, 3)] if u != 3 else "view", round(float(rng.uniform(0, 100)), 2)) for k, u in enumerate(rng.permutation(users).tolist())]
    made = spark.createDataFrame(rows, "event_id bigint, user_id bigint, s bigint, event_type string, value double")
    made.select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), "event_type", "value").write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture(scope="module")
def lists(spark, uneven):
    """roi_id -> its values, and roi_id -> frames of its error events, in time order."""
    values, errors = {}, {}
    for r in spark.read.parquet(f"{uneven}/events.parquet").orderBy("ts").collect():
        own = values.setdefault(str(r.user_id), [])
        if r.event_type == "error":
            errors.setdefault(str(r.user_id), []).append(len(own))
        own.append(r.value)
    return values, errors


def test_segment_events_of_all_segments(spark, uneven, lists):
    _, errors = lists
    got = sorted(map(tuple, registry.QUERIES["segment_events"](spark, uneven).select("roi_id", "segment", "frame").collect()))
    want = sorted((roi, (f - 5) // 15, (f - 5) % 15) for roi, at in errors.items() for f in at if f >= 5)
    assert got == want and any(s >= 4 for _, s, _ in want)


def test_events_to_trace_covers_the_last_frame(spark, uneven, lists):
    values, errors = lists
    got = {(r.roi_id, r.anchor): r.n for r in registry.QUERIES["events_to_trace"](spark, uneven).collect()}
    ends = {roi: max(200, len(x) - 1 + 10) for roi, x in values.items()}
    assert got == {(roi, a): sum(abs(f - a) <= 8 for f in errors.get(roi, [])) for roi, end in ends.items() for a in range(0, end, 10)}
    assert ("0", 260) in got


@pytest.mark.parametrize("span", [4096, 16])
def test_cross_event_means_of_all_traces(spark, uneven, lists, span, monkeypatch):
    from tracelake.operators import event_joins as J

    means = J.cross_means
    monkeypatch.setattr(J, "cross_means", lambda *a: means(*a, block=2, span=span))
    values, errors = lists
    got = {(r.trace_roi, r.roi_id, r.offset): r["mean"] for r in registry.QUERIES["cross_event_means"](spark, uneven).collect()}
    assert set(got) == {(t, e, o) for t in values for e in errors for o in (-1, 0, 1)}
    for (t, e, o), mean in got.items():
        seen = [values[t][f + o] for f in errors[e] if 0 <= f + o < len(values[t])]
        assert mean == (pytest.approx(np.mean(seen), abs=2e-5) if seen else None)


def test_crop_bounds_of_all_regions(spark, tall, pixels):
    got = {r.roi_id: (r.row0, r.row1, r.col0, r.col1) for r in registry.QUERIES["crop_bounds"](spark, tall).collect()}
    height = max(r for r, _ in pixels) + 1
    want = {}
    for roi in {roi for _, roi in pixels.values()}:
        rows, cols = zip(*[at for at, (_, x) in pixels.items() if x == roi], strict=True)
        want[roi] = (max(min(rows) - 2, 0), min(max(rows) + 3, height), max(min(cols) - 2, 0), min(max(cols) + 3, WIDTH))
    assert got == want


def test_traces_of_all_regions(spark, tall, pixels):
    video = np.array([v for _, (v, _) in sorted(pixels.items())])
    labels = np.array([roi for _, (_, roi) in sorted(pixels.items())])
    ids = sorted(set(labels))
    # Every pixel is in a region, so regions and background are dependent: the least-norm solution is asked for.
    design = np.array([*[(labels == roi).astype(float) for roi in ids], np.ones(len(labels))]).T
    want = np.linalg.pinv(design) @ (video @ video.T)
    got = {(r.roi_id, r.frame): r.value for r in registry.QUERIES["ols_traces"](spark, tall).collect()}
    assert set(got) == {(roi, f) for roi in ids for f in range(len(video))}
    assert np.allclose([[got[roi, f] for f in range(len(video))] for roi in ids], want[:-1], atol=2e-4)
    rings = {roi: ring for roi, ring in _rings(pixels, 1, 3 - 1).items() if any(p in pixels for p in ring)}
    got = {(r.roi_id, r.frame): r.value for r in registry.QUERIES["neuropil_traces"](spark, tall).collect()}
    assert set(got) == {(roi, f) for roi in rings for f in range(len(video))} and len(rings) > 3
    for roi, ring in rings.items():
        # Places of the image's last row that have no pixel count as 0, as in extract_from_codes.
        code = sum(pixels[p][0] for p in ring if p in pixels) / len(ring)
        assert np.allclose([got[roi, f] for f in range(len(video))], video @ code, atol=2e-5)


def test_against_reference_has_all_traces(spark, uneven, lists):
    values, errors = lists
    at = lambda roi, f: values[roi][f] if f < len(values[roi]) else None
    rows = J.beside_reference(T.traces(spark, uneven), registry._errors(spark, uneven), 0, 1, "0")
    got = {(r.roi_id, r.event_idx, r.offset, r.trace_roi): (r.value, r.reference) for r in rows.collect()}
    assert got == {(e, k, o, t): (at(t, f + o), at("0", f + o)) for e, frames in errors.items() for k, f in enumerate(frames) for o in (0, 1) for t in values}
    stats = {(r.trace_roi, r.roi_id, r.offset): r for r in RS.reference_stats(T.traces(spark, uneven), registry._errors(spark, uneven), 0, 1, "0", block=3, span=7).collect()}
    assert set(stats) == {(t, e, o) for t in values for e in errors if errors[e] for o in (0, 1)}
    for (t, e, o), r in stats.items():
        both = np.array([(at(t, f + o), at("0", f + o)) for f in errors[e] if at(t, f + o) is not None and at("0", f + o) is not None], float).reshape(-1, 2)
        assert r.n == len(both)
        if r.n:
            assert np.allclose([r.mean, r.std, r.ref_mean, r.ref_std], [*both.mean(axis=0)[:1], *both.std(axis=0)[:1], *both.mean(axis=0)[1:], *both.std(axis=0)[1:]], atol=1e-5)
            assert np.isclose(r.cov, np.cov(both.T, bias=True)[0, 1], atol=1e-6)
        else:
            assert (r.mean, r.std, r.cov) == (None, None, None)


def test_against_reference_has_each_event(spark, uneven, lists):
    values, errors = lists
    at = lambda roi, f: values[roi][f] if f < len(values[roi]) else None
    got = registry.QUERIES["against_reference"](spark, uneven).collect()
    want = {(e, k, o, t): (at(t, f + o), at("0", f + o)) for e, frames in errors.items() for k, f in enumerate(frames) for o in (0, 1) for t in values}
    assert len(got) == len(want) and {(r.roi_id, r.event_idx, r.offset, r.trace_roi): (r.value, r.reference) for r in got} == want


def test_sql_of_against_reference_has_each_event():
    con = connect("/root/testdata/sf0.001")
    rows = con.execute(f"SELECT count(*), count(DISTINCT (roi_id, event_idx)), count(DISTINCT trace_roi) FROM ({registry.ORACLES['against_reference']})").fetchone()
    errors, users = con.execute("SELECT count(*) FILTER (event_type = 'error'), count(DISTINCT user_id) FROM events").fetchone()
    assert rows == (errors * 2 * users, errors, users)


@pytest.mark.parametrize("sizes, broadcast", [((2, 3, 50), True), ((1, 1, 7), False), ((), True)])
def test_beside_reference_in_blocks(spark, uneven, sizes, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(J, "MOST_BROADCAST", 0)
    traces, errors = T.traces(spark, uneven), registry._errors(spark, uneven)
    odd = errors.union(spark.createDataFrame([(None, 0, 2), ("none such", 0, 3), ("0", 1000, 5), ("0", 1001, 5)], errors.schema)).union(errors.where("roi_id = '1'").withColumn("event_idx", F.col("event_idx") + 500))
    short = traces.where("NOT (roi_id = '0' AND frame = 5)").union(spark.createDataFrame([(None, 4, 1.5)], traces.schema))
    want = J.against_reference(J.cross_windows(short, odd, 2, 1), "0").select("roi_id", "event_idx", "offset", "trace_roi", "value", "reference")
    got = J.beside_reference(short, odd, 2, 1, "0", *sizes)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert J.beside_reference(short, odd, 2, 1, "no such trace", *sizes).count() == 0
    assert J.beside_reference(short, odd.limit(0), 2, 1, "0", *sizes).count() == 0


def _grown(seeds, codes, threshold):
    """Breadth-first growth; seeds: roi_id -> pixels, codes: pixel -> code."""
    out = set()
    for roi, own in seeds.items():
        mean = np.mean([codes[p] for p in own], axis=0)
        fits = {p for p, v in codes.items() if v @ mean >= threshold * np.linalg.norm(v) * np.linalg.norm(mean)}
        region, edge = set(own), set(own)
        while edge:
            edge = {q for p in edge for q in _ball(p, 1) if q in fits} - region
            region |= edge
        out |= {(roi, *p) for p in region}
    return out


def test_grow_until_it_stalls(spark):
    from tracelake.operators import masks as M

    snake = {(0, c) for c in range(9)} | {(1, 8), (2, 8)} | {(3, c) for c in range(9)}
    codes = {(r, c): np.array([1.0, 0.1] if (r, c) in snake else [0.0, 1.0]) for r in range(4) for c in range(9)}
    px = spark.createDataFrame([(r, c, v.tolist()) for (r, c), v in codes.items()], "row int, col int, v array<double>")
    seeds = spark.createDataFrame([("a", 0, 0), ("b", 3, 4)], "roi_id string, row int, col int")
    got = sorted(map(tuple, M.grow(seeds, px, 0.5, 2).select("roi_id", "row", "col").collect()))
    assert got == sorted((roi, *p) for roi in "ab" for p in snake)


def test_grown_regions_of_the_table(spark, tall, pixels):
    seeds = {}
    for at, (_, roi) in pixels.items():
        seeds.setdefault(roi, set()).add(at)
    got = [(r.roi_id, r.row, r.col) for r in registry.QUERIES["grown_regions"](spark, tall).collect()]
    assert len(got) == len(set(got)) and set(got) == _grown(seeds, {at: v for at, (v, _) in pixels.items()}, 0.05)


@pytest.mark.parametrize("span", [4096, 16])
def test_sums_of_blocks_are_not_shuffled(spark, uneven, span):
    """Means over events in small blocks, in one span and in many; the sums of one span are the result as they leave their task."""
    traces, events = T.traces(spark, uneven), T.events(spark, uneven, "error")
    found = J.cross_means(traces, events, 1, 2, block=2, span=span)
    plain = J.cross_windows(traces, events, 1, 2).groupBy("trace_roi", "roi_id", "offset").agg(F.avg("value").alias("mean"))
    rows = lambda df: sorted((r.trace_roi, r.roi_id, r.offset, None if r.mean is None else round(r.mean, 9)) for r in df.collect())
    assert rows(found) == rows(plain)
    if span == 4096:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("MapInArrow")]
    wanted, same = RS.reference_stats(traces, events, 0, 1, "0"), RS.reference_stats(traces, events, 0, 1, "0", block=2, span=span)
    told = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else -1 if x is None else x for x in r) for r in df.collect())
    assert told(wanted) == told(same)
