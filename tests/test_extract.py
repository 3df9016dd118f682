"""Extraction, motion, guided bases and survey masks against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import dsp
from tracelake.operators import extraction as X
from tracelake.operators import guided as Z
from tracelake.operators import masks as M
from tracelake.operators import motion as MC
from tracelake.operators import signals as G
from tracelake.operators import video as V
from tracelake.operators.extract import LowRank, extract_traces

rng = np.random.default_rng(12)
HEIGHT, WIDTH, FRAMES, RANK = 6, 7, 40, 3
U, P = rng.standard_normal((FRAMES, RANK)) + [4, 0, 0], rng.standard_normal((HEIGHT * WIDTH, RANK)) + [2, 0, 0]
MOVIE = U @ P.T
WEIGHTS = {"a": {(1, 1): 1.0, (1, 2): 0.5, (2, 1): 2.0}, "b": {(1, 2): 1.0, (1, 3): 1.0}, "c": {(4, 5): 0.7, (4, 6): 0.2, (5, 5): 1.0}}


@pytest.fixture(scope="module")
def video(spark):
    u = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(U)], "frame bigint, u array<double>")
    v = spark.createDataFrame([(k // WIDTH, k % WIDTH, x.tolist()) for k, x in enumerate(P)], "row int, col int, v array<double>")
    return LowRank(u, v, RANK)


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame([(i, r, c, w) for i, cells in WEIGHTS.items() for (r, c), w in cells.items()], "roi_id string, row int, col int, weight double")


def rings(inner, outer, share):
    ball = lambda cells, n: {(r, c) for r in range(HEIGHT) for c in range(WIDTH) if any(abs(r - a) + abs(c - b) <= n for a, b in cells)}
    taken = {p for cells in WEIGHTS.values() for p in cells}
    out = {}
    for i, cells in WEIGHTS.items():
        ring = ball(cells, outer) - ball(cells, inner)
        free = ring - taken
        out[i] = free if ring and len(free) / len(ring) >= share else ring
    return out


def plain(ring=(-1, -1), ols=True, weighted=True, compute_mean=True, keep_mean=True, remove=True, normalize=False, smooth=0, share=0.4):
    w = np.zeros((HEIGHT * WIDTH, len(WEIGHTS)))
    for k, cells in enumerate(WEIGHTS.values()):
        for (r, c), x in cells.items():
            w[r * WIDTH + c, k] = x if weighted else 1 / len(cells)
    active = w.sum(axis=1) > 0
    y = MOVIE[:, active].T
    if ols:
        design = w[active]
        if compute_mean:
            mean = y.mean(axis=1)
            mu = mean / mean.max()
            design = np.hstack([design, mu[:, None]])
        c = np.linalg.pinv(design) @ y
        found = c[: w.shape[1]] * w[active].sum(axis=0)[:, None]
        if compute_mean and keep_mean:
            found += (mu @ w[active])[:, None] * c[-1:]
    else:
        found = w[active].T @ y
    around = None
    if ring[0] >= 0:
        cells = rings(*ring, share)
        around = np.stack([MOVIE[:, [r * WIDTH + c for r, c in cells[i]]].mean(axis=1) if cells[i] else np.zeros(FRAMES) for i in WEIGHTS])
        if smooth:
            around = np.stack([dsp.savgol(x, smooth, 2) for x in around])
        if remove:
            found = found - around
    if normalize:
        base = np.median(found, axis=1, keepdims=True)
        found = 100 * (found - base) / base
    return found, around


def matrix(df):
    rows = df.orderBy("roi_id", "frame").collect()
    return np.array([r.value for r in rows]).reshape(-1, FRAMES)


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"compute_mean": False},
        {"keep_mean": False},
        {"ols": False},
        {"ols": False, "weighted": False, "ring": (0, 2), "smooth": 5},
        {"weighted": False, "ring": (1, 3), "normalize": True},
        {"ring": (1, 2), "remove": False},
    ],
)
@pytest.mark.parametrize("low", [True, False])
def test_extract_traces(spark, video, weights, options, low):
    if not low and len(options) == 1 and "ols" not in options:
        pytest.skip("the paths are alike")
    want, around = plain(**options)
    options = dict(options)
    if "remove" in options:
        options["remove_neuropil"] = options.pop("remove")
    source = video if low else V.reconstruct(video.u, video.v)
    found, rings_found = extract_traces(source, weights, HEIGHT, WIDTH, options.pop("ring", (-1, -1)), **options)
    assert np.allclose(matrix(found), want, atol=1e-6)
    assert (rings_found is None) == (around is None)
    if around is not None:
        assert np.allclose(matrix(rings_found), around)


def test_extract_refuses_bad_options(video, weights):
    for ring, more in (((3, 2), {}), ((1, 2), {"smooth": 4}), ((1, 2), {"exclusion": 0.0})):
        with pytest.raises(ValueError):
            extract_traces(video, weights, HEIGHT, WIDTH, ring, **more)


def test_motion(spark):
    base = rng.standard_normal((12, 10))
    base = dsp.gaussian(base, 1.0) * 5
    shifts = [(0, 0), (1, 0), (0, -2), (2, 1), (0, 0), (-1, 2), (0, 0), (1, 1), (0, 0), (0, 0)]
    movie = np.stack([np.roll(base, s, (0, 1)) * (1 + 0.02 * k) for k, s in enumerate(shifts)]).reshape(10, -1)
    left, sigma, right = np.linalg.svd(movie, full_matrices=False)
    rank = int((sigma > 1e-9).sum())
    u = spark.createDataFrame([(k, (x * sigma)[:rank].tolist()) for k, x in enumerate(left)], "frame bigint, u array<double>")
    v = spark.createDataFrame([(k // 10, k % 10, x[:rank].tolist()) for k, x in enumerate(right.T)], "row int, col int, v array<double>")
    found = MC.find_shifts(LowRank(u, v, rank), 12, 10, 4, hpf=3.0)
    got = [(r.dy, r.dx) for r in found.orderBy("frame").collect()]
    off = np.array(got) - shifts
    assert (off == off[0]).all()  # up to one shift that all frames share
    tiles = MC.estimate_shifts(u, MC.component_images(v, 12, 10, lambda x: dsp.sharpened(x, 3.0, 1.0, 100.0)), dsp.sharpened(base, 3.0, 1.0, 100.0), 4, most=40)
    assert [(r.dy, r.dx) for r in tiles.orderBy("frame").collect()] == shifts
    none = MC.estimate_shifts(u, MC.component_images(v, 12, 10), base, 0)
    assert {(r.dy, r.dx) for r in none.collect()} == {(0, 0)}
    back = spark.createDataFrame([(k, -a, -b) for k, (a, b) in enumerate(shifts)], "frame bigint, dy int, dx int")
    fixed = MC.apply_shifts(LowRank(u, v, rank), back, 12, 10)
    rows = V.reconstruct(fixed.u, fixed.v).orderBy("frame", "row", "col").collect()
    still = np.array([r.value for r in rows]).reshape(10, 12, 10)
    assert np.allclose(still, [base * (1 + 0.02 * k) for k in range(10)], atol=1e-6)
    assert fixed.rank < 4
    mean = {(r.row, r.col): r.value for r in MC.shifted_mean(LowRank(u, v, rank), back.selectExpr("frame", "-dy AS dy", "-dx AS dx"), 12, 10).collect()}
    assert np.allclose([[mean[r, c] for c in range(10)] for r in range(12)], base * 1.09)


def test_artifact_hulls(spark):
    px = spark.createDataFrame([("a", 0, 0), ("a", 0, 3), ("a", 3, 0), ("b", 9, 9), ("b", 9, 8)], "roi_id string, row int, col int")
    got = {(r.row, r.col) for r in MC.artifact_regions(px).collect()}
    assert got == {(r, c) for r in range(4) for c in range(4) if r + c <= 3}


def test_guided_svd(spark):
    t = np.arange(120)
    cells = {(r, c): (np.sin(t / 9) if c < 4 else np.cos(t / 4)) * (1 + 0.1 * r) + 2 for r in range(5) for c in range(8)}
    frames = spark.createDataFrame([(int(k), r, c, float(x[k])) for (r, c), x in cells.items() for k in t], "frame bigint, row int, col int, value double")
    feet = spark.createDataFrame([("a" if c < 4 else "b", r, c) for r, c in cells], "roi_id string, row int, col int")
    mixed = {}
    for r in Z.mixtures(feet, (3,), (2,)).collect():
        mixed.setdefault((r.roi_id, r.mix), set()).add((r.row, r.col))
    assert mixed["a", "0-0-0"] == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert mixed["a", "0-2-2"] == {(r, c) for r in (1, 2, 3) for c in (1, 2, 3)}
    assert {m for i, m in mixed if i == "b"} == {f"0-{r}-{c}" for r in (0, 2, 4) for c in (4, 6)}
    u, s, v = Z.guided_svd(frames, feet, sizes=(3,), hops=(2,), windows=(40, 10), clusters=2, rank=8, least=3)
    got = np.array([r.u for r in u.orderBy("frame").collect()])
    assert np.allclose(got.T @ got, np.eye(got.shape[1]), atol=1e-6)
    right = {(r.row, r.col): r.v for r in v.collect()}
    movie = np.array([cells[p] for p in sorted(cells)]).T
    made = (got * s) @ np.array([right[p] for p in sorted(cells)]).T
    assert np.linalg.norm(made - movie) < 0.02 * np.linalg.norm(movie)


def test_guided_svd_of_codes(spark):
    """The basis of a low-rank video is that of its pictures."""
    r = np.random.default_rng(8)
    u, v = r.standard_normal((150, 4)).cumsum(axis=0), r.standard_normal((40, 4))
    video = LowRank(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(u)], "frame bigint, u array<double>"), spark.createDataFrame([(k // 8, k % 8, x.tolist()) for k, x in enumerate(v)], "row int, col int, v array<double>"), 4)
    feet = spark.createDataFrame([("a" if k % 8 < 4 else "b", k // 8, k % 8) for k in range(40)], "roi_id string, row int, col int")
    options = {"sizes": (3,), "hops": (2,), "windows": (40, 10), "clusters": 2, "rank": 8, "least": 3}
    low, whole = Z.guided_svd(video, feet, **options), Z.guided_svd(V.reconstruct(video.u, video.v), feet, **options)
    assert np.allclose(low[1][:4], whole[1][:4]) and np.allclose(low[1][4:], 0, atol=1e-4)
    made = [np.array([x.u for x in q.orderBy("frame").collect()]) * s @ np.array([x.v for x in p.orderBy("row", "col").collect()]).T for q, s, p in (low, whole)]
    assert np.allclose(*made, atol=1e-6)


def test_array_svd(spark):
    movie = rng.standard_normal((60, 5, 6)).cumsum(axis=0)
    frames = spark.createDataFrame([(k, r, c, float(movie[k, r, c])) for k in range(60) for r in range(5) for c in range(6)], "frame bigint, row int, col int, value double")
    u, v = Z.array_svd(frames, 4, 20, 0.8)
    flat = movie.reshape(60, 30)
    padded = np.pad(flat, ((10, 9), (0, 0)), mode="symmetric")
    high = flat - np.stack([padded[k : k + 20].mean(axis=0) for k in range(60)])
    smooth = np.stack([dsp.gaussian(x.reshape(5, 6), 0.8).ravel() for x in high])
    ready = smooth / smooth.std(axis=0)
    left = np.linalg.svd(ready, full_matrices=False)[0][:, :4]
    got = np.array([r.u for r in u.orderBy("frame").collect()])
    assert np.allclose(np.abs(left.T @ got), np.eye(4), atol=0.35)  # sketched, so the last directions mix a little
    made = np.array([r.v for r in v.orderBy("row", "col").collect()])
    assert np.allclose(made, ready.T @ got, atol=1e-6)


def test_dark_halos(spark):
    image = rng.random((30, 30))
    region = {(14, 14), (14, 15), (15, 14)}
    table = spark.createDataFrame([(r, c, float(image[r, c])) for r in range(30) for c in range(30)], "row int, col int, value double")
    px = spark.createDataFrame([("a", r, c) for r, c in region], "roi_id string, row int, col int")
    halo, mask = M.dark_halos(table, px, 30, 30, share=0.5, local_share=0.7, sigma=3.0, keep_off=2, radius=8, least=1)
    near = lambda n: {(r, c) for r in range(30) for c in range(30) if any(abs(r - a) + abs(c - b) <= n for a, b in region)}
    rank = image.ravel().argsort().argsort().reshape(30, 30) + 1.0
    local = rank - dsp.gaussian(rank, 3.0)
    dark = (image < np.quantile(image, 0.5)) | (local < np.quantile(local, 0.7))
    want = {(r, c) for r in range(30) for c in range(30) if dark[r, c]} - near(2)
    assert {(r.row, r.col) for r in mask.collect()} == want
    own = want & near(8)
    around = lambda p: {(p[0] + a, p[1] + b) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))}
    kept = {p for p in own if around(p) <= own}
    opened = {q for p in kept for q in around(p) if 0 <= q[0] < 30 and 0 <= q[1] < 30}
    assert {(r.row, r.col) for r in halo.collect()} == opened


def test_closing_by_a_square(spark):
    cells = {(r, c) for r in range(2, 9) for c in range(2, 9)} - {(5, 5), (4, 6)}
    px = spark.createDataFrame(sorted(cells), "row int, col int")
    assert {(r.row, r.col) for r in M.closed_square(px, 3, 12, 12).collect()} == cells | {(5, 5), (4, 6)}


@pytest.mark.parametrize("method", ["median", "double_filt"])
def test_peaks_of_deviation(spark, method):
    x = rng.standard_normal(200)
    x[[50, 120]] -= 12
    long = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "roi_id string, frame bigint, value double")
    got = X.peaks_of_deviation(long, 21, method, 6.0)
    if method == "median":
        flat = dsp.median_highpass_block(x, 10)
    else:
        flat = x - (dsp.savgol(x, 21, 0) - dsp.savgol(x, 21, 1)) / 2
    deviation = -(flat - flat.mean()) / flat[flat > 0].std()
    assert [r.frame for r in got.orderBy("frame").collect()] == dsp.find_peaks(deviation, 6.0, None, 2.0).tolist() == [50, 120]


def test_pairs_meet_once(spark):
    x = {f"r{k:02d}": rng.standard_normal(64 + k).tolist() for k in range(9)}
    packed = spark.createDataFrame(list(x.items()), "roi_id string, values array<double>")
    fields, ddl = [("n", G.pa.int64())], "n bigint"
    for unique in (False, True):
        got = sorted((r.x, r.y, r.n) for r in G.pairwise(packed, len, lambda a, b: [(a + b,)], fields, ddl, unique, block=2).collect())
        assert got == [(a, b, len(x[a]) + len(x[b])) for a in x for b in x if a < b or (a == b and not unique)]


def test_running_means(spark):
    x = rng.standard_normal(50)
    long = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "roi_id string, frame bigint, value double")
    for size in (6, 7, 80):
        padded = np.pad(x, (size // 2, size - 1 - size // 2), mode="symmetric")
        want = x - [padded[k : k + size].mean() for k in range(50)]
        assert np.allclose([r.value for r in G.less_running_mean(long, size).orderBy("frame").collect()], want)


def test_overlapping_groups_are_solved_apart(spark, video, weights):
    from tracelake.operators import least_squares as LS

    ground = video.v.select("row", "col", F.lit(1.0).alias("mu"))
    d = LS.design(weights, ground)
    pairs = {(r.roi_id, r.other) for r in d.inverse.collect()}
    assert pairs == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")}
