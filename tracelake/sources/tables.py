"""The driver's tables as traces, events, pixel codes and region ids.

Long form: traces are (roi_id, frame, value), events (roi_id, event_idx, frame).
Packed form: (roi_id, values) and (roi_id, frames). Missing values are NULL in both.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver. Python workers are told where this package lies, as they may start anywhere."""
    told = spark.sparkContext.environment
    if ROOT not in told.get("PYTHONPATH", "").split(":"):
        told["PYTHONPATH"] = ":".join(filter(None, (ROOT, told.get("PYTHONPATH"))))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one named in spark.checkpoint.dir.

    Only a session whose executors are threads of this process (a local master, as in
    tests) may do without: a temporary folder takes its place. Elsewhere it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, read many times.

    Lineage ends here, so a lost executor costs a reread and no recomputation.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def framed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi_id, frame, value, event_type: each user's rows in time order, numbered from 0."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select(F.col("user_id").cast("string").alias("roi_id"), (F.row_number().over(order) - 1).cast("bigint").alias("frame"), nan_to_null("value").alias("value"), "event_type")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framed_events(spark, sf_dir).select("roi_id", "frame", "value")


def events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The frames of one event type, numbered per roi."""
    found = framed_events(spark, sf_dir).where(F.col("event_type") == kind)
    return number_events(found.select("roi_id", "frame"))


def number_events(frames: DataFrame) -> DataFrame:
    order = Window.partitionBy("roi_id").orderBy("frame")
    return frames.select("roi_id", (F.row_number().over(order) - 1).cast("bigint").alias("event_idx"), "frame")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi_id, frame, value, background: long two-channel traces, one per supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return rows.select(
        F.col("l_suppkey").cast("string").alias("roi_id"), (F.row_number().over(order) - 1).cast("bigint").alias("frame"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("background")
    )


def pixel_codes(spark: SparkSession, sf_dir: str, width: int = 25) -> DataFrame:
    """row, col, v (code of the pixel), roi_id: embeddings laid out on an image."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr(f"cast(vec_id div {width} AS int)").alias("row"), F.expr(f"cast(vec_id % {width} AS int)").alias("col"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("roi_id")
    )


def region_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id: dotted paths of regions, nations and suppliers."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    paths = r.join(n, r["r_regionkey"] == n["n_regionkey"]).select(F.concat_ws(".", F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("n"), "n_nationkey")).alias("nation"), "n_nationkey")
    supplied = s.join(paths, s["s_nationkey"] == paths["n_nationkey"]).select(F.concat_ws(".", "nation", F.concat(F.lit("s"), "s_suppkey")).alias("id"))
    return r.select(F.concat(F.lit("r"), "r_regionkey").alias("id")).union(paths.select("nation")).union(supplied)


def nan_to_null(column: str):
    return F.when(~F.isnan(column), F.col(column))


def pack(long: DataFrame) -> DataFrame:
    """roi_id and values in frame order; a missing frame leaves no gap."""
    return long.groupBy("roi_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda x: x["value"]).alias("values"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("roi_id", F.posexplode("values").alias("frame", "value")).select("roi_id", F.col("frame").cast("bigint").alias("frame"), "value")
