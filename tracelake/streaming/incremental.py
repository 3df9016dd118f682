"""Structured Streaming forms of the bounded operators: bins, sessions, and an idempotent block table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_stats(stream: DataFrame, width: str, late: str) -> DataFrame:
    """roi_id, bin_start, mean, n per window of event time ts; rows later than late are left out."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("roi_id", F.window("ts", width).alias("w"))
        .agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
        .select("roi_id", F.col("w.start").alias("bin_start"), "mean", "n")
    )


def hopping_stats(stream: DataFrame, width: str, hop: str, late: str) -> DataFrame:
    """roi_id, bin_start, mean, n per overlapping window."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("roi_id", F.window("ts", width, hop).alias("w"))
        .agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
        .select("roi_id", F.col("w.start").alias("bin_start"), "mean", "n")
    )


def session_bursts(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """roi_id, start, n: bursts of events no more than gap apart."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("roi_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"))
        .select("roi_id", "start", "n")
    )


def write_blocks(stream: DataFrame, path: str, checkpoint: str, block: int):
    """A query that stores frames by block; a frame that came before is not written again, so a replay changes nothing.

    Only the stored blocks that a batch touches are read. A frame that comes again with other content, in
    the same batch or a later one, is an error; one that comes again as it was is stored once.
    """

    def put(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        rest = sorted(c for c in batch.columns if c != "frame")
        content = F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")
        came = batch.withColumn("block", F.expr(f"frame div {block}")).persist()
        try:
            twice = came.groupBy("frame").agg(F.min(content).alias("a"), F.max(content).alias("b")).where("a <> b").select("frame").limit(1).collect()
            if twice:
                raise ValueError(f"frame {twice[0][0]} came twice with other content")
            touched = [r[0] for r in came.select("block").distinct().collect()]  # blocks of one batch
            try:
                stored = spark.read.parquet(path).where(F.col("block").isin(touched))
                seen = stored.select("block", "frame", content.alias("_stored"))
            except AnalysisException as e:  # nothing is stored yet
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                seen = None
            fresh = came
            if seen is not None:
                other = came.join(seen, ["block", "frame"]).where(content != F.col("_stored")).select("frame").limit(1).collect()
                if other:
                    raise ValueError(f"frame {other[0][0]} came again with other content")
                fresh = came.join(seen, ["block", "frame"], "left_anti")
            fresh.dropDuplicates(["frame"]).write.mode("append").partitionBy("block").parquet(path)
        finally:
            came.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
