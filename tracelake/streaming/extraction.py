"""Traces of regions from a stream of frames, in two phases, and windows around events from two streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import regions as R
from tracelake.operators import spikes as E
from tracelake.operators import video as V
from tracelake.operators.extract import check
from tracelake.operators.least_squares import Design, design, solve_traces
from tracelake.sources.tables import written


class StreamedExtraction:
    """extract_traces for frames (frame, row, col, value) that arrive in batches, cut anywhere, even within a frame.

    First phase: sums of the pixels and of the rings, a folder for each batch. ``finish`` makes the mean image, the
    rings and the design of least squares from them. Second phase: coefficients are linear in the pixels, so those of
    the parts of a frame add up; ``traces`` adds them and takes the rings off, which count as 0 beyond the frames of the first phase.
    Folders are named by batch and overwritten, so a replayed batch changes nothing. A phase that is
    skipped, or begun when it is over, is an error, as are frames that came twice in the first phase. What was done is
    told by tables in ``path``, so another process can go on.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        weights: DataFrame,
        height: int,
        width: int,
        ring: tuple[int, int] = (-1, -1),
        *,
        ols: bool = True,
        weighted: bool = True,
        compute_mean: bool = True,
        keep_mean: bool = True,
        remove_neuropil: bool = True,
        smooth: int = 0,
        exclusion: float = 0.4,
    ):
        check(ring, smooth, exclusion)
        self.spark, self.path, self.ols, self.compute_mean, self.keep_mean, self.smooth = spark, path.rstrip("/"), ols, compute_mean, keep_mean, smooth
        self.remove_neuropil = remove_neuropil and ring[0] >= 0
        w = weights.where("weight <> 0")
        if not weighted:
            w = R.uniform_weights(w.where("weight > 0").select("roi_id", "row", "col"))
        self.active = written(weights.groupBy("row", "col").agg(F.sum("weight").alias("s")).where("s > 0").select("row", "col"), "active")
        self.weights = written(w.join(self.active, ["row", "col"], "left_semi"), "weights")
        own = weights.where("weight > 0").select("roi_id", "row", "col")
        self.around = written(R.annuli(own, *ring, height, width, exclusion).select("roi_id", "row", "col"), "rings") if ring[0] >= 0 else None
        self.design: Design | None = None

    def _stored(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def precompute(self, stream: DataFrame, checkpoint: str):
        """A query of the first phase, to be started."""
        if self._stored("mean") is not None:
            raise RuntimeError("the first phase is over")

        def put(batch: DataFrame, number: int) -> None:
            if self._stored("mean") is not None:
                raise RuntimeError("the first phase is over")
            sums = batch.groupBy("row", "col").agg(F.sum("value").alias("x"), F.count("*").alias("n"))
            sums.write.mode("overwrite").parquet(f"{self.path}/sums/batch={number}")
            if self.around is not None:
                rings = batch.join(self.around, ["row", "col"]).groupBy("roi_id", "frame").agg(F.sum("value").alias("x"), F.count("*").alias("n"))
                rings.write.mode("overwrite").parquet(f"{self.path}/rings/batch={number}")
            batch.select("frame").distinct().write.mode("overwrite").parquet(f"{self.path}/frames/batch={number}")

        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)

    def finish(self) -> None:
        """Ends the first phase."""
        sums, frames = self._stored("sums"), self._stored("frames")
        if sums is None:
            raise RuntimeError("no frames came in the first phase")
        if self._stored("mean") is None:
            n = frames.select("frame").distinct().count()
            image = sums.groupBy("row", "col").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
            if image.where(F.col("n") > n).limit(1).count():
                raise RuntimeError("frames came twice in the first phase")
            image.select("row", "col", (F.col("x") / F.col("n")).alias("value")).write.mode("overwrite").parquet(f"{self.path}/mean")

    def _design(self) -> Design | None:
        image = self._stored("mean")
        if image is None:
            raise RuntimeError("the first phase is not finished")
        if self.ols and self.design is None:
            ground = None
            if self.compute_mean:
                own = image.join(self.active, ["row", "col"], "left_semi")
                top = own.agg(F.max("value")).first()[0] or 1.0
                ground = written(own.select("row", "col", (F.col("value") / top).alias("mu")), "ground")
            self.ground, self.design = ground, design(self.weights, ground)
        return self.design

    def rings(self) -> DataFrame | None:
        """roi_id, frame, value: means of the rings of the first phase, smoothed if asked for."""
        if self.around is None:
            return None
        found = self._stored("rings").groupBy("roi_id", "frame").agg((F.sum("x") / F.sum("n")).alias("value"))
        bare = self.weights.select("roi_id").distinct().join(self.around.select("roi_id").distinct(), "roi_id", "left_anti")
        whole = found.unionByName(bare.join(self._stored("frames").select("frame").distinct(), how="cross").select("roi_id", "frame", F.lit(0.0).alias("value")))
        return E.savgol(whole, self.smooth) if self.smooth else whole

    def extract(self, stream: DataFrame, checkpoint: str):
        """A query of the second phase, to be started."""
        self._design()

        def put(batch: DataFrame, number: int) -> None:
            held = written(batch.select("frame", "row", "col", "value"), "batch")
            # Every region has a row for every frame of the batch, of whose pixels it may have none here.
            spine = held.select("frame").distinct().join(self.weights.select("roi_id").distinct(), how="cross")
            part = V.extract_traces(held, self.weights).withColumnRenamed("value", "own")
            sums = written(spine.join(part, ["roi_id", "frame"], "left").select("roi_id", "frame", F.coalesce("own", F.lit(0.0)).alias("value")), "sums")
            found = sums
            if self.ols:
                back = None
                if self.ground is not None:
                    back = held.join(self.ground, ["row", "col"], "left").groupBy("frame").agg(F.coalesce(F.sum(F.col("mu") * F.col("value")), F.lit(0.0)).alias("value"))
                solved, b = solve_traces(self.design, sums, back)
                value = F.col("value") * F.col("total")
                if self.keep_mean and b is not None:
                    solved = solved.join(b.select("frame", F.col("value").alias("b")), "frame")
                    value = value + F.col("m") * F.col("b")
                found = solved.select("roi_id", "frame", value.alias("value"))
            found.write.mode("overwrite").parquet(f"{self.path}/traces/batch={number}")

        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)

    def traces(self) -> DataFrame:
        """roi_id, frame, value of what the second phase has had so far."""
        found = self._stored("traces")
        if found is None:
            raise RuntimeError("no frames came in the second phase")
        whole = found.groupBy("roi_id", "frame").agg(F.sum("value").alias("value"))
        if not self.remove_neuropil:
            return whole
        other = self.rings().select("roi_id", "frame", F.col("value").alias("ring"))
        return whole.join(other, ["roi_id", "frame"], "left").select("roi_id", "frame", (F.col("value") - F.coalesce("ring", F.lit(0.0))).alias("value"))


def event_windows(samples: DataFrame, events: DataFrame, n_pre: int, n_post: int, fs: float, late: str) -> DataFrame:
    """roi_id, event_idx, frame, offset, value from a stream of samples (roi_id, frame, value) and one of events (roi_id, event_idx, frame).

    Event time is the frame at fs samples a second. Either stream may run ahead of the other by ``late``; a row is
    held until both have gone on by that much, so state follows the delay and not the streams. Rows that are
    later than that are left out: a late sample gives NULL, a late event no window. An offset that no sample comes for gives NULL
    when time has gone past it.
    """
    # A watermark begins at time 0, so the earliest offset of frame 0 has to come after it.
    clock = lambda frame: F.timestamp_micros(F.round((frame + n_pre + 1) * (1_000_000 / fs)).cast("bigint"))
    near = events.select("roi_id", "event_idx", "frame", F.explode(F.sequence(F.lit(-n_pre), F.lit(n_post))).alias("offset"))
    asked = near.withColumn("at", clock(F.col("frame") + F.col("offset"))).withWatermark("at", late)
    told = samples.select(F.col("roi_id").alias("_roi"), clock(F.col("frame")).alias("_at"), "value").withWatermark("_at", late)
    met = asked.join(told, (F.col("roi_id") == F.col("_roi")) & (F.col("at") == F.col("_at")), "leftOuter")
    return met.select("roi_id", "event_idx", "frame", "offset", "value")
