"""Randomized decompositions by one pass, two, or tiles; stopped and taken up again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake import cli
from tracelake.operators import sketches as K
from tracelake.sources import files

WIDTH = 90


def matrix(n, seed=1, decay=0.35):
    r = np.random.default_rng(seed)
    u, v = np.linalg.qr(r.normal(size=(n, 30)))[0], np.linalg.qr(r.normal(size=(WIDTH, 30)))[0]
    return (u * (100 * decay ** np.arange(30))) @ v.T


def frames(spark, m, first=0):
    return spark.createDataFrame([(first + k, x.tolist()) for k, x in enumerate(m)], "frame bigint, pixels array<double>").repartition(6)


def held(found):
    u, s, v = found
    u = np.array([r.u for r in u.orderBy("frame").collect()])
    v = np.array([r.v for r in v.orderBy("pixel").collect()])
    return u, np.array(s), v


def error(m, found):
    u, s, v = held(found)
    return np.linalg.norm(m - (u * s) @ v.T)


def test_one_and_two_passes(spark):
    m = matrix(120)
    exact = np.linalg.svd(m, compute_uv=False)
    best = np.sqrt((exact[6:] ** 2).sum())
    two = K.randomized_svd(frames(spark, m), WIDTH, 6, columns=25)
    one = K.randomized_svd(frames(spark, m), WIDTH, 6, columns=25, passes=1)
    assert np.allclose(two[1], exact[:6], rtol=1e-4)
    # The stated error of the single pass: its core is a least-squares solution, so values are off by a few of the first left out.
    assert np.abs(np.array(one[1]) - exact[:6]).max() < 3 * exact[6]
    assert error(m, two) < 1.05 * best
    assert error(m, one) < 5 * best
    for found in (one, two):
        u, _, v = held(found)
        assert np.allclose(u.T @ u, np.eye(6), atol=1e-8)
        assert np.allclose(v.T @ v, np.eye(6), atol=1e-8)


def test_single_pass_reads_frames_once(spark, tmp_path):
    looked = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            looked.add(batch.num_rows)
            yield batch

    m = matrix(100)
    frames(spark, m).write.parquet(str(tmp_path / "f"))
    watched = spark.read.parquet(str(tmp_path / "f")).select("frame", "pixels").mapInArrow(count, "frame bigint, pixels array<double>")
    plain = spark.read.parquet(str(tmp_path / "f"))
    sketch = K.Sketch(spark, str(tmp_path / "p"), WIDTH, 5, columns=40)
    sketch._round("both", watched, [0], sketch._first_kernel(True))
    assert looked.value == 100
    sketch.single_pass()
    assert looked.value == 100
    assert sketch._missing("both", plain) == []


def test_tiles_equal_frames(spark, tmp_path):
    m = matrix(150)
    sketch = K.Sketch(spark, str(tmp_path / "p"), WIDTH, 6, columns=32, block=40)
    sketch.first_pass(frames(spark, m))
    tiles = [(a, k, m[k, a : a + 30].tolist()) for a in range(0, WIDTH, 30) for k in range(150)]
    inner = sketch.inner_pass(spark.createDataFrame(tiles, "start bigint, frame bigint, pixels array<double>").repartition(5))
    whole = sketch.second_pass(frames(spark, m))
    assert np.allclose(inner[1], whole[1])
    a, b = held(inner), held(whole)
    assert np.allclose((a[0] * a[1]) @ a[2].T, (b[0] * b[1]) @ b[2].T, atol=1e-8)


class Stopped(Exception):
    pass


@pytest.mark.parametrize("passes", [1, 2])
def test_stopped_and_taken_up_again(spark, tmp_path, monkeypatch, passes):
    m = matrix(100, 2)
    rows = frames(spark, m).persist()
    whole = K.randomized_svd(rows, WIDTH, 5, columns=40, passes=passes, block=10)
    done, plain = [], K.Sketch._round

    def stops(self, name, own, blocks, kernel):
        if len(done) == 3 or (passes == 2 and len(done) == 7):
            done.append(None)
            raise Stopped
        plain(self, name, own, blocks, kernel)
        done.append((name, tuple(blocks)))

    monkeypatch.setattr(K.Sketch, "_round", stops)
    again = None
    for _ in range(3):
        try:
            again = K.randomized_svd(rows, WIDTH, 5, columns=40, passes=passes, path=str(tmp_path / "p"), each=2, block=10)
            break
        except Stopped:
            continue
    assert np.allclose(again[1], whole[1])
    worked = [d for d in done if d]
    names = ["both"] if passes == 1 else ["first", "second"]
    for name in names:  # each block once, though it was stopped
        assert sorted(b for own, blocks in worked if own == name for b in blocks) == list(range(10))
        ledger = K.Sketch(spark, str(tmp_path / "p"), WIDTH, 5, columns=40, block=10).ledger(name)
        assert ledger.count() == ledger.select("block").distinct().count() == 10
    assert len(worked) == 5 * len(names)


def test_half_written_rounds_are_not_read(spark, tmp_path):
    m, path = matrix(60, 3), str(tmp_path / "p")
    sketch = K.Sketch(spark, path, WIDTH, 4, columns=40, block=20)
    sketch.receive(frames(spark, m[20:40], 20))
    # A round that was written but never committed.
    spark.createDataFrame([("row", 0, 1, None, [9.0] * 12)], K.MADE).write.partitionBy("kind").parquet(f"{path}/first/round=lost")
    sketch.first_pass(frames(spark, m))
    assert sketch._made("first", "row").count() == 60
    assert np.allclose(sketch.second_pass(frames(spark, m))[1], K.randomized_svd(frames(spark, m), WIDTH, 4, columns=40)[1])


def test_overlaps_and_changes_are_errors(spark, tmp_path):
    m, path = matrix(40, 4), str(tmp_path / "p")
    sketch = K.Sketch(spark, path, WIDTH, 4, block=10)
    sketch.receive(frames(spark, m[:20]))
    with pytest.raises(ValueError, match="block 1 has been received before"):
        sketch.receive(frames(spark, m[10:30], 10))
    with pytest.raises(ValueError, match="other frames"):
        sketch.first_pass(frames(spark, m[:15]))
    with pytest.raises(ValueError, match="missing or repeated in block 3"):
        sketch.first_pass(frames(spark, m).where("frame <> 35"))
    sketch.verify("first", frames(spark, m))
    with pytest.raises(ValueError, match="other content"):
        sketch.verify("first", frames(spark, m + 1))
    with pytest.raises(ValueError, match="other settings"):
        K.Sketch(spark, path, WIDTH, 5, block=10)
    with pytest.raises(ValueError, match="no frames"):
        K.Sketch(spark, str(tmp_path / "q"), WIDTH, 4).second_pass(frames(spark, m).limit(0))


def test_convert_restarts(spark, tmp_path, monkeypatch):
    m = matrix(40, 5)
    at = lambda name: str(tmp_path / name)
    frames(spark, m).write.parquet(at("f"))
    call = ["convert", at("f"), at("svd"), "--width", "10", "--height", "9", "--rank", "4", "--batch", "10", "--each", "1"]
    plain, rounds = K.Sketch._round, []

    def stops(self, *a):
        rounds.append(a[2])
        if len(rounds) == 3:
            raise Stopped
        plain(self, *a)

    monkeypatch.setattr(K.Sketch, "_round", stops)
    with pytest.raises(Stopped):
        cli.main(call)
    with pytest.raises(ValueError, match="--restart"):
        cli.main(call)
    cli.main([*call, "--restart"])
    assert len(rounds) == 9  # 4 blocks twice, one of them begun twice
    low = cli.video(spark, at("svd"))
    u = np.array([r.u for r in low.u.orderBy("frame").collect()])
    v = np.array([r.v for r in low.v.orderBy("row", "col").collect()])
    assert np.abs(u @ v.T - m).max() < 3


def test_codes_by_tiles_are_pruned(spark, tmp_path):
    r = np.random.default_rng(6)
    codes = {(i, j): r.normal(size=40).tolist() for i in range(20) for j in range(30)}
    files.save_codes(spark.createDataFrame([(*k, v) for k, v in codes.items()], "row int, col int, v array<double>"), str(tmp_path / "v"), tile=8, chunk=16)
    part = files.read_codes(spark, str(tmp_path / "v"), rows=(3, 8), cols=(8, 17), components=(2, 30), tile=8, chunk=16)
    assert {(x.row, x.col): x.v for x in part.collect()} == {(i, j): v[2:30] for (i, j), v in codes.items() if 3 <= i < 8 and 8 <= j < 17}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    read = spark.read.parquet(str(tmp_path / "v")).where("row >= 3 AND row < 8 AND col >= 8 AND col < 17 AND tile_row = 0 AND tile_col BETWEEN 1 AND 2 AND chunk <= 1")
    assert read.select(F.input_file_name()).distinct().count() == 4  # of 3 x 4 x 3 folders
    assert {(x.row, x.col): x.v for x in files.read_codes(spark, str(tmp_path / "v")).collect()} == codes


def test_raw_ranges_read_their_frames_only(spark, tmp_path):
    pictures = np.arange(3 * 50 * 6, dtype=np.uint8).reshape(3, 50, 6)
    for k in range(3):
        (tmp_path / f"a_{k}.raw").write_bytes(pictures[k].tobytes())
    options = {"path": str(tmp_path), "width": 3, "height": 2, "batch": 10}

    def read(*filters):
        reader = files.PrunedRawReader(dict(options))
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [(p.first + p.start, p.first + p.stop) for p in reader.partitions()]

    at = ("frame",)
    assert len(read()) == 15
    assert read(files.GreaterThanOrEqual(at, 47), files.LessThan(at, 72)) == [(47, 50), (50, 60), (60, 70), (70, 72)]
    assert read(files.EqualTo(at, 101)) == [(101, 102)]
    assert read(files.In(at, (12, 3))) == [(3, 10), (10, 13)]
    assert read(files.GreaterThan(at, 148)) == [(149, 150)]
    assert read(files.LessThanOrEqual(at, -1)) == []
    spark.dataSource.register(files.RawFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = spark.read.format("rawframes").options(**{k: str(v) for k, v in options.items()}, pushdown="true").load().where("frame >= 47 AND frame < 52")
        assert found.rdd.getNumPartitions() == 2
        assert {r.frame: list(r.pixels) for r in found.collect()} == {k: pictures[k // 50, k % 50].tolist() for k in range(47, 52)}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    some = spark.read.format("rawframes").options(**{k: str(v) for k, v in options.items()}, start="95", stop="105").load()
    assert sorted(r.frame for r in some.collect()) == list(range(95, 105))
