"""Streamed extraction and streamed event windows against their batch forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import event_joins as J
from tracelake.operators.extract import extract_traces
from tracelake.streaming import extraction as X

HEIGHT, WIDTH, FRAMES = 8, 9, 12
SCHEMA = "frame bigint, row int, col int, value double"


@pytest.fixture(scope="module")
def video():
    r = np.random.default_rng(1)
    rows = [(f, i, j, float(20 + 5 * r.random() + f * (i + j) / 9)) for f in range(FRAMES) for i in range(HEIGHT) for j in range(WIDTH)]
    shapes = {"a": [(2, 2), (2, 3), (3, 2)], "b": [(2, 3), (3, 3), (3, 4)], "c": [(6, 7)]}
    return rows, [(roi, i, j, 0.5 + 0.1 * k) for roi, own in shapes.items() for k, (i, j) in enumerate(own)]


def stream(spark, rows, path, parts, schema=SCHEMA):
    """A stream of a file for each part, one at a time."""
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(f"{path}/{k:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def run(writer):
    q = writer.start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def values(df):
    return {(r.roi_id, r.frame): r.value for r in df.collect()}


@pytest.mark.parametrize(("options", "seed"), [({}, 1), ({"ols": False, "weighted": False}, 2), ({"compute_mean": False, "smooth": 5}, 3)])
def test_streamed_extraction_equals_batch(spark, tmp_path, video, options, seed):
    rows, shapes = video
    weights = spark.createDataFrame(shapes, "roi_id string, row int, col int, weight double")
    want, _ = extract_traces(spark.createDataFrame(rows, SCHEMA), weights, HEIGHT, WIDTH, (1, 2), **options)
    s = X.StreamedExtraction(spark, str(tmp_path / "s"), weights, HEIGHT, WIDTH, (1, 2), **options)
    r = np.random.default_rng(seed)
    (tmp_path / "none").mkdir()
    nothing = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "none"))
    with pytest.raises(RuntimeError, match="not finished"):
        s.extract(nothing, str(tmp_path / "c0"))
    with pytest.raises(RuntimeError, match="no frames"):
        s.finish()
    cut = np.array_split(r.permutation(len(rows)), 3)  # within frames, in any order
    run(s.precompute(stream(spark, rows, tmp_path / "p", cut), str(tmp_path / "c1")))
    s.finish()
    with pytest.raises(RuntimeError, match="over"):
        s.precompute(nothing, str(tmp_path / "c2"))
    again = X.StreamedExtraction(spark, str(tmp_path / "s"), weights, HEIGHT, WIDTH, (1, 2), **options)  # another process
    with pytest.raises(RuntimeError, match="second phase"):
        again.traces()
    run(again.extract(stream(spark, rows, tmp_path / "e", np.array_split(r.permutation(len(rows)), 2)), str(tmp_path / "c3")))
    got, expected = values(again.traces()), values(want)
    assert set(got) == set(expected)
    assert max(abs(got[k] - expected[k]) for k in expected) < 1e-6


def test_rings_are_zero_past_the_first_phase(spark, tmp_path, video):
    rows, shapes = video
    weights = spark.createDataFrame(shapes, "roi_id string, row int, col int, weight double")
    some = [r for r in rows if r[0] < 5]
    s = X.StreamedExtraction(spark, str(tmp_path / "s"), weights, HEIGHT, WIDTH, (1, 2), ols=False)
    run(s.precompute(stream(spark, some, tmp_path / "p", [range(len(some))]), str(tmp_path / "c1")))
    s.finish()
    run(s.extract(stream(spark, rows, tmp_path / "e", [range(len(rows))]), str(tmp_path / "c2")))
    less, plain = (values(extract_traces(spark.createDataFrame(rows, SCHEMA), weights, HEIGHT, WIDTH, (1, 2), ols=False, remove_neuropil=x)[0]) for x in (True, False))
    got = values(s.traces())
    assert max(abs(got[k] - (less if k[1] < 5 else plain)[k]) for k in got) < 1e-9
    assert len(got) == 3 * FRAMES


def test_frames_that_come_twice(spark, tmp_path, video):
    rows, shapes = video
    weights = spark.createDataFrame(shapes, "roi_id string, row int, col int, weight double")
    s = X.StreamedExtraction(spark, str(tmp_path / "s"), weights, HEIGHT, WIDTH)
    run(s.precompute(stream(spark, rows, tmp_path / "p", [range(len(rows)), range(20)]), str(tmp_path / "c1")))
    with pytest.raises(RuntimeError, match="twice"):
        s.finish()


def test_streamed_windows_equal_batch(spark, tmp_path):
    r = np.random.default_rng(7)
    samples = [(roi, k, float(v)) for roi, n in (("a", 60), ("b", 35)) for k, v in enumerate(r.normal(size=n)) if (roi, k) != ("a", 30)]
    events = [("a", 0, 1), ("a", 1, 29), ("a", 2, 59), ("b", 0, 34), ("b", 1, 10), ("c", 0, 5)]
    names = ("roi_id string, frame bigint, value double", "roi_id string, event_idx bigint, frame bigint")
    want = J.event_windows(spark.createDataFrame(samples, names[0]), spark.createDataFrame(events, names[1]), 2, 3)
    expected = sorted((x.roi_id, x.event_idx, x.frame, x.offset, x.value is not None, x.value or 0) for x in want.collect())
    for k in range(2):  # two orders of arrival, each within the watermark
        order, asked = r.permutation(len(samples)), r.permutation(len(events))
        # Rows of a roi that no one asks for drive time on, so that what waits is given out.
        told = stream(spark, [*samples, ("end", 1000, 0.0), ("end", 2000, 0.0)], tmp_path / f"t{k}", [*np.array_split(order, 3), [len(samples)], [len(samples) + 1]], names[0])
        near = stream(spark, [*events, ("end", 0, 1000), ("end", 1, 2000)], tmp_path / f"n{k}", [*np.array_split(asked, 3), [len(events)], [len(events) + 1]], names[1])
        found = X.event_windows(told, near, 2, 3, 10.0, "20 seconds")
        run(found.writeStream.format("parquet").option("path", str(tmp_path / f"o{k}")).option("checkpointLocation", str(tmp_path / f"c{k}")).outputMode("append"))
        got = spark.read.parquet(str(tmp_path / f"o{k}")).where("roi_id <> 'end'")
        assert sorted((x.roi_id, x.event_idx, x.frame, x.offset, x.value is not None, x.value or 0) for x in got.collect()) == expected


def test_late_rows_are_left_out(spark, tmp_path):
    names = ("roi_id string, frame bigint, value double", "roi_id string, event_idx bigint, frame bigint")
    samples = [("a", 5, 1.0), ("a", 500, 2.0), ("a", 1000, 0.0), ("a", 6, 9.0), ("a", 2000, 0.0), ("a", 3000, 0.0)]
    events = [("a", 0, 5), ("a", 1, 500), ("a", 2, 1000), ("a", 3, 7), ("a", 4, 2000), ("a", 5, 3000)]
    told, near = (stream(spark, rows, tmp_path / name, [[k] for k in range(6)], schema) for rows, name, schema in ((samples, "t", names[0]), (events, "n", names[1])))
    found = X.event_windows(told, near, 0, 1, 10.0, "10 seconds")
    run(found.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append"))
    got = {(x.event_idx, x.offset): x.value for x in spark.read.parquet(str(tmp_path / "o")).where(F.col("frame") < 2000).collect()}
    assert got == {(0, 0): 1.0, (0, 1): None, (1, 0): 2.0, (1, 1): None, (2, 0): 0.0, (2, 1): None}
