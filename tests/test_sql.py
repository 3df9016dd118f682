"""Queries against their SQL on small tables that the generated ones have no case of."""

import random

import pytest

from tests.compare import assert_same, connect
from tracelake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    """A folder with all tables, from which a test takes some away."""
    import os

    for name in os.listdir(SF):
        (tmp_path / name).symlink_to(f"{SF}/{name}")
    return tmp_path


def put(spark, folder, name, rows, schema):
    (folder / f"{name}.parquet").unlink()
    spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(folder / f"{name}.parquet")


def compare(spark, folder, *names):
    con = connect(folder)
    for name in names:
        assert_same(registry.QUERIES[name](spark, str(folder)), con, registry.ORACLES[name])


def test_convolution_reaches_pixels_beside_the_table(spark, folder):
    draw = random.Random(5)
    rows = [(k, [draw.gauss(0, 1) for _ in range(64)], k % 3) for k in (*range(60), 77, 93)]  # rows 2 and 3 are not full
    put(spark, folder, "embeddings", rows, "vec_id bigint, embedding array<float>, label int")
    compare(spark, folder, "spatial_convolution")


@pytest.fixture(params=[1, 7])
def ties(request, spark, folder):
    """Events whose means before and after are often equal up to the order of addition, in few or many files."""
    draw = random.Random(11)
    rows = []
    for user in range(400):
        for k, kind in enumerate(["view", "view", "view", "purchase", "error", "purchase", "view", "view", "view"]):
            rows.append((9 * user + k, k, user, kind, draw.choice([0.1, 0.2, 0.3, 0.7])))
    put(spark, folder, "events", rows, "event_id bigint, s bigint, user_id bigint, event_type string, value double")
    (folder / "events.parquet").rename(folder / "plain.parquet")
    made = spark.read.parquet(str(folder / "plain.parquet")).selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type", "value")
    made.coalesce(1).toPandas().to_parquet(folder / "events.parquet", coerce_timestamps="us", index=False)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield folder
    spark.conf.set("spark.sql.shuffle.partitions", held)


@pytest.mark.parametrize("name", ["classify_events", "label_proportions", "match_labels", "grouped_type_stats"])
def test_labels_of_equal_means(spark, ties, name):
    compare(spark, ties, name)
