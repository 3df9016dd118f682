import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake import cli
from tracelake.functions import dsp
from tracelake.operators import display as D
from tracelake.operators import extraction as X
from tracelake.operators import masks as M
from tracelake.operators import selection as L
from tracelake.operators import video as V
from tracelake.sources import synthetic, tables

rng = np.random.default_rng(5)


def grid(spark, values):
    return spark.createDataFrame([(r, c, float(x)) for r, line in enumerate(values) for c, x in enumerate(line)], "row int, col int, value double")


def pixels(spark, cells):
    return spark.createDataFrame(sorted(cells), "row int, col int")


def cells(df):
    return {(r.row, r.col) for r in df.collect()}


def test_morphology(spark):
    square = {(r, c) for r in range(2, 7) for c in range(2, 7)}
    px = pixels(spark, square | {(0, 9)})
    inner = {(r, c) for r in range(3, 6) for c in range(3, 6)}
    assert cells(M.erode(px)) == inner
    assert cells(M.opened(px, 10, 10)) == inner | {(r, c) for r in range(3, 6) for c in (2, 6)} | {(r, c) for c in range(3, 6) for r in (2, 6)}
    assert square <= cells(M.closed(px, 10, 10))


def test_resolve_ids(spark):
    rois = spark.createDataFrame([("1.b2", 0, "x"), ("x", 1, "y")], "roi_id string, roi_ord int, id_short string")
    assert [r.roi_id for r in L.resolve_ids(rois, ["x", "y", "1.b2"]).collect()] == ["x", "x", "1.b2"]
    with pytest.raises(ValueError):
        L.resolve_ids(rois, ["z"])
    with pytest.raises(Exception, match="length"):
        packed = spark.createDataFrame([("a", [1, 2])], "roi_id string, frames array<bigint>")
        L.select_events_by_mask(packed, spark.createDataFrame([("a", [True])], "roi_id string, mask array<boolean>")).collect()


def test_ordered_union(spark):
    make = lambda ids: spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "roi_id string, ord int")
    got = L.ordered_union([make("cab"), make("adb")]).orderBy("ord").collect()
    assert [r.roi_id for r in got] == list("cabd")


def test_ols_separates_overlaps(spark):
    weights = {"a": rng.random((4, 5)), "b": rng.random((4, 5))}
    times = rng.standard_normal((3, 30))
    movie = sum(np.multiply.outer(t, w) for t, w in zip(times, (weights["a"], weights["b"], np.ones((4, 5))), strict=True))
    left, s, right = np.linalg.svd(movie.reshape(30, 20), full_matrices=False)
    u = spark.createDataFrame([(k, (left[k, :3] * s[:3]).tolist()) for k in range(30)], "frame bigint, u array<double>")
    v = spark.createDataFrame([(p // 5, p % 5, right[:3, p].tolist()) for p in range(20)], "row int, col int, v array<double>")
    w = spark.createDataFrame([(i, r, c, float(m[r, c])) for i, m in weights.items() for r in range(4) for c in range(5)], "roi_id string, row int, col int, weight double")
    got = X.ols_traces(u, v, w, 3).orderBy("roi_id", "frame").collect()
    assert np.allclose([r.value for r in got], times[:2].ravel())


def test_lowpass(spark):
    flat = spark.createDataFrame([(k, [2.0, -1.0]) for k in range(40)], "frame bigint, u array<double>")
    v = spark.createDataFrame([(0, 0, [1.0, 0.5])], "row int, col int, v array<double>")
    assert np.allclose([r.u for r in X.subtractive_lowpass(flat, 11, 2).collect()], 0)
    assert np.allclose([r.value for r in V.reconstruct(X.divisive_lowpass(flat, v, 11, 2, 2), v).collect()], 1)


def test_robust_coherence(spark):
    rows = [("a", k, 0.0) for k in range(200)] + [("b", k, float(v)) for k, v in enumerate(rng.standard_normal(200))]
    long = spark.createDataFrame(rows, "roi_id string, frame bigint, value double")
    got = {(r.x, r.y): r.m for r in X.robust_coherence(long, 10.0, 32, 16).groupBy("x", "y").agg(F.avg("coherence").alias("m")).collect()}
    assert got["a", "a"] == pytest.approx(1)
    assert got["a", "b"] < 0.5


def test_display(spark):
    image = grid(spark, [[0, 1], [2, 4]])
    assert [r.shade for r in D.color_scale(image).orderBy("row", "col").collect()] == [0, 0.25, 0.5, 1]
    assert {r.shade for r in D.color_scale(grid(spark, [[3, 3]])).collect()} == {0.5}
    assert D.bar_size(48) == 10
    frames = image.withColumn("frame", F.lit(0))
    assert cells(D.stacked(frames, frames, 2, 2, 1, vertical=True)) == {(r, c) for r in range(4) for c in range(2)}
    assert max(r.value for r in D.reconstruct_scaled(frames).collect()) == 1


def test_synthetic_is_seeded(spark):
    a = synthetic.generate_traces(spark, 3, 50).orderBy("roi_id").collect()
    assert a == synthetic.generate_traces(spark, 3, 50).orderBy("roi_id").collect()
    assert min(min(r["values"]) for r in a) > 0
    assert len(synthetic.generate_footprints(spark, 2, 6, 7).first()["values"]) == 42
    assert synthetic.sample_fluorescence(synthetic.generate_traces(spark, 1, 50)).first()["values"][5] % 1 == 0


@pytest.mark.parametrize(("text", "want"), [("2:9:3", (2, 9, 3)), (":", (None, None, 1)), ("5", (5, 6, 1)), ("-1", (-1, None, 1)), ("-4:", (-4, None, 1))])
def test_parse_slice(text, want):
    assert cli.parse_slice(text) == want


def test_cli(spark, tmp_path, monkeypatch):
    x = np.zeros((1, 120))
    x[0, [20, 60]] = 9
    traces = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x[0] + rng.random(120) * 0.1 - 0.05)], "roi_id string, frame bigint, value double")
    traces.write.parquet(str(tmp_path / "t"))
    cli.main(["detect-spikes", str(tmp_path / "t"), str(tmp_path / "e"), "--positive", "--threshold", "20"])
    assert sorted(r.frame for r in spark.read.parquet(str(tmp_path / "e")).collect()) == [20, 60]
    cli.main(["qc-report", str(tmp_path / "t"), str(tmp_path / "e"), str(tmp_path / "q"), "--fs", "100", "--half", "10", "--bin", "0.5"])
    assert spark.read.parquet(str(tmp_path / "q")).count() == 3
    cli.main(["trace-dff", str(tmp_path / "t"), str(tmp_path / "d"), "--window", "31"])
    assert spark.read.parquet(str(tmp_path / "d")).count() == 120
    cli.main(["slice", str(tmp_path / "t"), str(tmp_path / "cut"), "--temporal", "2:8:2"])
    assert sorted(r.frame for r in spark.read.parquet(str(tmp_path / "cut")).collect()) == [2, 4, 6]


def test_cli_on_a_video(spark, tmp_path):
    """Commands on a converted video against the pixels it came from."""
    at = lambda name: str(tmp_path / name)
    times = rng.standard_normal((60, 2)) + [8, 3]
    movie = times @ (rng.random((2, 12)) + 1)
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(movie)], "frame bigint, pixels array<double>").write.parquet(at("f"))
    size = ["--width", "4", "--height", "3"]
    cli.main(["convert", at("f"), at("svd"), *size, "--rank", "3"])
    read = lambda name: spark.read.parquet(at(name))
    assert {n: read(f"svd/{n}").count() for n in "usv"} == {"u": 60, "s": 1, "v": 12}
    rois = [("a", 0, 0), ("a", 0, 1), ("b", 2, 3)]
    spark.createDataFrame([(*r, 1.0) for r in rois], "roi_id string, row int, col int, weight double").write.parquet(at("rois"))
    cli.main(["extract-traces", at("svd"), at("rois"), at("x"), *size, "--uniform"])
    got = {(r.roi_id, r.frame): r.value for r in read("x").collect()}
    assert np.allclose([got["a", k] for k in range(60)], movie[:, :2].mean(axis=1))
    assert np.allclose([got["b", k] for k in range(60)], movie[:, 11])
    cli.main(["extract-traces", at("f"), at("rois"), at("y"), *size, "--uniform"])
    assert all(r.value == pytest.approx(got[r.roi_id, r.frame]) for r in read("y").collect())
    cli.main(["video-dff", at("svd"), at("dff"), "--window", "11"])
    slow = dsp.savgol(movie.mean(axis=1), 11, 2, "nearest")
    made = {(r.frame, r.row, r.col): r.value for r in V.reconstruct(read("dff/u"), read("dff/v")).collect()}
    assert np.allclose([made[k, 1, 2] for k in range(60)], movie[:, 6] / slow)
    cli.main(["video-sub-dff", at("svd"), at("sub"), "--window", "11"])
    made = {(r.frame, r.row, r.col): r.value for r in V.reconstruct(read("sub/u"), read("sub/v")).collect()}
    assert np.allclose([made[k, 1, 2] for k in range(60)], movie[:, 6] - dsp.savgol(movie[:, 6], 11, 2, "nearest"))
    cli.main(["slice", at("svd"), at("part"), "--temporal", "10:20", "--spatial", "1:,:2", "--component", ":2"])
    made = {(r.frame, r.row, r.col): r.value for r in V.reconstruct(read("part/u"), read("part/v")).collect()}
    assert set(made) == {(k, r, c) for k in range(10, 20) for r in range(2) for c in range(2)}
    assert made[12, 0, 1] == pytest.approx(movie[12, 5])
    cli.main(["h5-convert", at("svd"), at("frames"), "--batch", "25"])
    assert np.allclose([r.pixels for r in read("frames").orderBy("frame").collect()], movie)
    cli.main(["spatial-survey", at("svd"), at("survey"), *size, "--grid", "1", "--percentile", "10", "--closing", "1", "--least", "1", "--dff-window", "11", "--spike-window", "11", "--threshold", "2"])
    region = {(r.row, r.col) for r in read("survey/regions").collect()}
    own = movie[:, [r * 4 + c for r, c in region]].mean(axis=1)
    assert np.allclose([r.value for r in read("survey/raw").orderBy("frame").collect()], own)
    flat = own - dsp.savgol(own, 11, 2)
    assert np.allclose([r.value for r in read("survey/standard").orderBy("frame").collect()], flat / flat.std())
    cli.main(["svd-info", at("svd")])


def test_pack_round_trip(spark):
    long = spark.createDataFrame([("a", k, float(k)) for k in range(5)], "roi_id string, frame bigint, value double")
    assert sorted(map(tuple, tables.unpack(tables.pack(long)).collect())) == sorted(map(tuple, long.collect()))
