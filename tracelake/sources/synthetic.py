"""Seeded fixtures, made on the executors: traces, spatial footprints, fluorescence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _traced(rows: DataFrame, make) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids]), pa.array([make(i).tolist() for i in ids], pa.list_(pa.float64()))], ["roi_id", "values"])

    return rows.mapInArrow(run, "roi_id string, values array<double>")


def generate_traces(spark: SparkSession, n: int, frames: int, decay: float = 0.95, seed: int = 0) -> DataFrame:
    """roi_id, values: first-order autoregressive traces driven by absolute normal noise."""

    def make(i):
        noise = np.abs(np.random.default_rng([seed, i]).standard_normal(frames))
        out = np.empty(frames)
        level = 0.0
        for k, e in enumerate(noise):
            level = decay * level + e
            out[k] = level
        return out

    return _traced(spark.range(n), make)


def generate_footprints(spark: SparkSession, n: int, height: int, width: int, exponent: float = 2.0, seed: int = 0) -> DataFrame:
    """roi_id, values (pixels row by row): smooth random fields whose cosine amplitudes fall as frequency to the exponent."""

    def basis(size):
        k = np.arange(size)
        return np.cos(np.pi * np.outer(k + 0.5, k) / size)

    def make(i):
        rng = np.random.default_rng([seed, i])
        f = np.hypot(*np.meshgrid(np.arange(height), np.arange(width), indexing="ij"))
        amplitude = rng.standard_normal((height, width)) / np.maximum(f, 1) ** exponent
        return (basis(height) @ amplitude @ basis(width).T).ravel()

    return _traced(spark.range(n), make)


def sample_fluorescence(expected: DataFrame, seed: int = 0) -> DataFrame:
    """roi_id, values: Poisson counts about the values expected."""

    def run(batches):
        for batch in batches:
            out = [np.random.default_rng([seed, *r.encode()]).poisson(np.maximum(np.array(x, float), 0)).astype(float).tolist() for r, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["roi_id", "values"])

    return expected.select("roi_id", F.col("values")).mapInArrow(run, "roi_id string, values array<double>")
