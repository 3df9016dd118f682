"""Fourier transforms of traces of any length: columns, then rows, of the trace as a matrix.

A trace of n samples, filled up to a power of two, is a matrix of size1 rows and size2 columns. Its transform is
that of the columns, a turn of each number, and that of the rows. Tasks hold some columns or some rows, so two
shuffles there and one back take the place of a task that holds the trace.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.blocks import grouped

#: Numbers that a task holds at once.
HELD = 1 << 20


def shape_of(n: int) -> tuple[int, int]:
    """size1 and size2 for a circular product of n samples: powers of two, of 2 n - 1 numbers at least."""
    m = max(1, math.ceil(math.log2(max(2 * n - 1, 2))))
    return 1 << (m - m // 2), 1 << (m // 2)


def analytic_weights(place: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a sample adds to the analytic signal ``place`` (mod total) samples later, in a trace of n samples that goes round."""
    j = np.where(place < n, place, place - total)
    inside = np.abs(j) < n
    j = np.where(inside, j, 0)
    sine = np.sin(np.pi * j / n)
    turn = np.where(j % 2 == 0, 1.0, -1.0)
    cosine = np.cos(np.pi * j / n)
    top = (1 - turn) * cosine if n % 2 == 0 else cosine - turn
    h = np.divide(top, n * sine, out=np.zeros(j.shape), where=sine != 0)
    return np.where(inside, (j == 0) + 1j * h, 0)


def turned(rows: np.ndarray, columns: np.ndarray, total: int) -> np.ndarray:
    return np.exp(-2j * np.pi * (rows[:, None] * columns[None, :]) / total)


def analytic(traces: DataFrame, held: int = HELD) -> DataFrame:
    """roi_id, frame, re, im: the analytic signal (the trace and its Hilbert transform) of traces (roi_id, frame, value).

    Frames number a trace from 0 without gaps. A NULL sample makes its whole trace NaN.
    """
    own = traces.select(F.col("roi_id").cast("string").alias("roi_id"), F.col("frame").cast("bigint").alias("frame"), F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"))
    n = own.groupBy("roi_id").agg((F.max("frame") + 1).alias("n"))
    m = F.greatest(F.lit(1), F.length(F.bin(2 * F.col("n") - 2)))  # the bits of 2 n - 2: the least m with 2 ** m > 2 n - 2
    sized = n.withColumn("m", m).selectExpr("roi_id", "n", "shiftleft(1L, cast(m div 2 AS int)) AS size2", "shiftleft(1L, cast(m - m div 2 AS int)) AS size1")
    sized = sized.withColumn("wide", F.expr(f"greatest(1L, least(size2, {held} div size1))"))
    placed = own.join(sized, "roi_id").select("roi_id", F.expr("(frame % size2) div wide").alias("part"), "n", "frame", "value")
    columns = placed.repartition("roi_id", "part").sortWithinPartitions("roi_id", "part")
    piece = "roi_id string, part bigint, n bigint, other bigint, x binary, h binary"
    names, kinds = ["roi_id", "part", "n", "other", "x", "h"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def sizes(n: int) -> tuple[int, int, int, int]:
        size1, size2 = shape_of(n)
        return size1, size2, max(1, min(size2, held // size1)), max(1, min(size1, held // size2))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def down(batches):
        for (roi, part), group in grouped(batches, 2):
            n = group["n"][0].as_py()
            size1, size2, wide, tall = sizes(n)
            place = part * wide + np.arange(min(wide, size2 - part * wide))
            frames = group["frame"].to_numpy()
            x = np.zeros((size1, len(place)), complex)
            x[frames // size2, frames % size2 - part * wide] = group["value"].to_numpy()
            if len(frames) != (-(-(n - place) // size2)).sum():
                raise ValueError(f"trace {roi}: frames are missing or repeated")
            h = analytic_weights(np.arange(size1)[:, None] * size2 + place[None, :], n, size1 * size2)
            turn = turned(np.arange(size1), place, size1 * size2)
            x, h = np.fft.fft(x, axis=0) * turn, np.fft.fft(h, axis=0) * turn
            yield batch_of([(roi, k, n, part, x[k * tall : (k + 1) * tall].tobytes(), h[k * tall : (k + 1) * tall].tobytes()) for k in range(-(-size1 // tall))])

    def pieces_of(group, column):
        """The pieces of a group, in order of where they come from."""
        pieces = sorted(zip(group["other"].to_pylist(), group[column].to_pylist(), strict=True), key=lambda p: p[0])
        return [np.frombuffer(raw, complex) for _, raw in pieces]

    def across(batches):
        for (roi, part), group in grouped(batches, 2):
            n = group["n"][0].as_py()
            size1, size2, wide, tall = sizes(n)
            rows = part * tall + np.arange(min(tall, size1 - part * tall))
            x, h = (np.concatenate([p.reshape(len(rows), -1) for p in pieces_of(group, c)], axis=1) for c in ("x", "h"))
            found = np.fft.ifft(np.fft.fft(x, axis=1) * np.fft.fft(h, axis=1), axis=1) * np.conj(turned(rows, np.arange(size2), size1 * size2))
            yield batch_of([(roi, k, n, part, np.ascontiguousarray(found[:, k * wide : (k + 1) * wide]).tobytes(), None) for k in range(-(-size2 // wide))])

    def up(batches):
        for (roi, part), group in grouped(batches, 2):
            n = group["n"][0].as_py()
            size1, size2, wide, _ = sizes(n)
            place = part * wide + np.arange(min(wide, size2 - part * wide))
            z = np.concatenate([p.reshape(-1, len(place)) for p in pieces_of(group, "x")])
            found = np.fft.ifft(z, axis=0)
            frames = np.arange(size1)[:, None] * size2 + place[None, :]
            inside = frames < n
            y = found[inside]
            yield pa.RecordBatch.from_arrays([pa.array([roi] * len(y), pa.string()), pa.array(frames[inside]), pa.array(y.real), pa.array(y.imag)], ["roi_id", "frame", "re", "im"])

    by = lambda df: df.repartition("roi_id", "part").sortWithinPartitions("roi_id", "part")
    return by(by(columns.mapInArrow(down, piece)).mapInArrow(across, piece)).mapInArrow(up, "roi_id string, frame bigint, re double, im double")


def phase(traces: DataFrame, held: int = HELD) -> DataFrame:
    """roi_id, frame, value: the phase of the analytic signal; NULL all along a trace with a NULL sample."""
    angle = F.atan2("im", "re")
    return analytic(traces, held).select("roi_id", "frame", F.when(~F.isnan(angle), angle).alias("value"))
