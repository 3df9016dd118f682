import numpy as np
import pytest

from tracelake.sources import files
from tracelake.streaming import incremental


def test_raw_frames(spark, tmp_path):
    frames = np.arange(5 * 6, dtype=np.uint8).reshape(5, 2, 3)
    for name, part in (("a_2.raw", frames[3:]), ("a_1.raw", frames[:3])):
        (tmp_path / name).write_bytes(b"HEAD" + b"".join(f.tobytes() + b"GG" for f in part))
    spark.dataSource.register(files.RawFrames)
    got = spark.read.format("rawframes").options(path=str(tmp_path), width=3, height=2, offset=4, gap=2, batch=2).load().orderBy("frame").collect()
    assert [r.frame for r in got] == list(range(5))
    assert [r.pixels for r in got] == frames.reshape(5, -1).tolist()


def test_video_blocks_and_events(spark, tmp_path):
    frames = spark.range(30).selectExpr("id AS frame", "array(id) AS pixels")
    files.save_video(frames, str(tmp_path / "v"), 10)
    got = files.read_frames(spark, str(tmp_path / "v"), 8, 12, 10)
    assert sorted(r.frame for r in got.collect()) == [8, 9, 10, 11]
    assert "PartitionFilters: [isnotnull(block" in got._jdf.queryExecution().toString()
    events = spark.createDataFrame([("a", 0, 0), ("a", 1, 9)], "roi_id string, event_idx bigint, frame bigint")
    files.save_events(events, str(tmp_path / "e"))
    assert sorted(r.frame for r in spark.read.parquet(str(tmp_path / "e")).collect()) == [1, 10]
    assert sorted(r.frame for r in files.read_events(spark, str(tmp_path / "e")).collect()) == [0, 9]


def test_session(tmp_path):
    p = tmp_path / "s.toml"
    p.write_text('name = "x"\nfs = 10.0\nvideo = "v"\noutput = "o"\n')
    assert files.load_session(str(p)).fs == 10.0
    p.write_text('name = "x"\n')
    with pytest.raises(ValueError):
        files.load_session(str(p))


def test_import_file_and_region(spark, tmp_path):
    frames = np.arange(4 * 6, dtype="<u2").reshape(4, 2, 3)
    head = np.zeros(40, "<u2")
    head[[29, 30, 32, 33]] = [9, 19, 29, 39]
    (tmp_path / "a_1.raw").write_bytes(head.tobytes() + b"".join(f.tobytes() + b"GG" for f in frames))
    (tmp_path / "import_it.txt").write_text("- Image Type: '16-bit Unsigned'\n- Width: 3\n- Height: 2\n- Offset to first image: 80\n- Gap between images: 2\n")
    spark.dataSource.register(files.RawFrames)
    got = spark.read.format("rawframes").options(path=str(tmp_path), max_frames=3).load().orderBy("frame").collect()
    assert [r.pixels for r in got] == frames[:3].reshape(3, -1).tolist()
    assert files.camera_region(str(tmp_path / "a_1.raw")) == [10, 20, 30, 40]
    reader = files.RawReader({"path": str(tmp_path / "a_1.raw"), "width": 3, "height": 2, "offset": 85, "gap": 2, "dtype": "uint16"})
    with pytest.warns(UserWarning, match="pictures"):
        assert reader.count(str(tmp_path / "a_1.raw")) == 3


def test_regions_in_files(spark, tmp_path):
    px = spark.createDataFrame([("a", 0, 1, 2, 0.5), ("a", 1, 3, 4, 0.5), ("b", 0, 5, 6, 1.0)], "roi_id string, ord int, row int, col int, weight double")
    files.save_npz_regions(px, str(tmp_path / "r.npz"))
    assert sorted(map(tuple, files.read_npz_regions(spark, str(tmp_path / "r.npz")).collect())) == sorted(map(tuple, px.collect()))
    held = np.empty(1, object)
    held[0] = [1]
    np.savez(tmp_path / "code.npz", ids=held, offsets=np.array([0]), rows=held, cols=held, weights=held)
    with pytest.raises(ValueError):
        files.read_npz_regions(spark, str(tmp_path / "code.npz"))
    files.save_regions(px, str(tmp_path / "p"))
    assert files.read_regions(spark, str(tmp_path / "p")).count() == 3
    spark.createDataFrame([("a", 11), ("a", 4)], "roi_id string, pixel_idx int").write.parquet(str(tmp_path / "i"))
    assert sorted((r.row, r.col) for r in files.read_regions(spark, str(tmp_path / "i"), 10).collect()) == [(0, 1), (3, 0)]


def _run(spark, tmp_path, make):
    rows = spark.createDataFrame([("a", f"2024-01-01 00:00:{s:02d}", float(s)) for s in (1, 2, 9, 11, 30)] + [("a", "2024-01-01 01:00:00", 0.0)], "roi_id string, ts string, value double").selectExpr("roi_id", "cast(ts AS timestamp) ts", "value")
    src = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    name = f"t{abs(hash(str(tmp_path))) % 10**8}"
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_tumbling(spark, tmp_path):
    got = _run(spark, tmp_path, lambda s: incremental.tumbling_stats(s, "10 seconds", "0 seconds"))
    assert sorted(r.n for r in got) == [1, 1, 3]


def test_hopping(spark, tmp_path):
    got = _run(spark, tmp_path, lambda s: incremental.hopping_stats(s, "20 seconds", "10 seconds", "0 seconds"))
    assert sum(r.n for r in got) == 10


def test_sessions(spark, tmp_path):
    got = _run(spark, tmp_path, lambda s: incremental.session_bursts(s, "5 seconds", "0 seconds"))
    assert sorted(r.n for r in got) == [1, 2, 2]


def test_blocks_are_written_once(spark, tmp_path):
    frames = spark.range(20).selectExpr("id AS frame", "id * 2 AS value")
    frames.write.parquet(str(tmp_path / "in"))
    for k in range(2):  # the second run replays all
        stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
        q = incremental.write_blocks(stream, str(tmp_path / "out"), str(tmp_path / f"cp{k}"), 10).start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_changed_frames_are_an_error(spark, tmp_path):
    frames = spark.range(20).selectExpr("id AS frame", "id * 2 AS value")
    frames.write.parquet(str(tmp_path / "in"))
    frames.where("frame = 7").selectExpr("frame", "value + 1 AS value").write.parquet(str(tmp_path / "other"))
    for k, name in enumerate(("in", "other")):
        q = incremental.write_blocks(spark.readStream.schema(frames.schema).parquet(str(tmp_path / name)), str(tmp_path / "out"), str(tmp_path / f"cp{k}"), 10).start()
        if k:
            with pytest.raises(Exception, match="other content"):
                q.processAllAvailable()
        else:
            q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_twin_frames_in_one_batch(spark, tmp_path):
    schema = "frame bigint, value bigint"
    spark.createDataFrame([(1, 5), (1, 5), (2, 6), (12, 7)], schema).repartition(3).write.parquet(str(tmp_path / "twins"))
    spark.createDataFrame([(3, 5), (4, 6), (4, 7)], schema).repartition(3).write.parquet(str(tmp_path / "bad"))
    for k, name in enumerate(("twins", "bad")):
        q = incremental.write_blocks(spark.readStream.schema(schema).parquet(str(tmp_path / name)), str(tmp_path / "out"), str(tmp_path / f"cp{k}"), 10).start()
        if k:
            with pytest.raises(Exception, match="frame 4 came twice with other content"):
                q.processAllAvailable()
        else:
            q.processAllAvailable()
        q.stop()
    assert sorted((r.frame, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 5), (2, 6), (12, 7)]
