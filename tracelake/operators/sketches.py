"""Randomized singular value decompositions of videos, in passes that can be stopped and taken up again.

A pass sees frames in blocks. What it makes of a block is kept: the frames' sketch, and what they add to sums over
frames, added up for the blocks of a round. A round is committed by its rows in a ledger (block, frames, content
hash); parts of a round without such rows are never read. A restarted pass takes the blocks that the
ledger lacks, so no block is done twice, and frames of a block that is done are an error when they differ.

Two passes: a sketch of the rows, then projections onto its span. One pass: with the sketch of the rows also one of
the columns is taken, and the core between both comes from a small least-squares problem in place of the second
pass. Inner: the second pass goes over tiles of pixels in place of frames, each tile by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.blocks import column_of, samples
from tracelake.operators.video import _times, gramian
from tracelake.sources.tables import scratch, written

COLUMNS = 4096
BLOCK = 1000

MADE = "kind string, frame bigint, content bigint, start bigint, x array<double>"
LEDGER = "round string, block bigint, n bigint, first bigint, last bigint, content bigint"


def omega(seed: int, block: int, columns: int, over: int) -> np.ndarray:
    """The sketch's random numbers for one block of columns: made where they are needed, alike everywhere."""
    return np.random.default_rng([seed, block]).standard_normal((columns, over))


def omega_of_rows(seed: int, frames: np.ndarray, over: int) -> np.ndarray:
    """Random numbers of the sketch of the columns, a row for each frame, alike in any cut."""
    return np.stack([np.random.default_rng([seed, 1, int(f)]).standard_normal(over) for f in frames]) if len(frames) else np.zeros((0, over))


class Sketch:
    """A decomposition of frames (frame, pixels) of ``width`` pixels under way, its passes kept in the folder ``path``.

    rank is what is wanted; sketches have 8 directions more, those of the columns (for one pass) rank_rows in all.
    """

    def __init__(self, spark: SparkSession, path: str, width: int, rank: int, *, seed: int = 0, columns: int = COLUMNS, block: int = BLOCK, rank_rows: int | None = None):
        self.spark, self.path, self.width, self.rank, self.seed, self.columns, self.block = spark, path.rstrip("/"), width, rank, seed, columns, block
        self.over = min(rank + 8, width)
        self.over_rows = min(rank_rows or 2 * self.over + 1, width)
        told = [(width, rank, seed, columns, block, self.over_rows)]
        try:
            known = [tuple(r) for r in spark.read.parquet(f"{self.path}/settings").collect()]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            known = []
            spark.createDataFrame(told, "width int, rank int, seed long, columns int, block int, rank_rows int").write.parquet(f"{self.path}/settings")
        if known and known != told:
            raise ValueError(f"{self.path} was begun with other settings: {known[0]}")

    @cached_property
    def starts(self) -> range:
        return range(0, self.width, self.columns)

    def ledger(self, name: str) -> DataFrame:
        """round, block, n, first, last, content: the blocks that a pass has done."""
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.path}/{name}-ledger")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER)

    def _made(self, name: str, kind: str) -> DataFrame:
        rounds = [r[0] for r in self.ledger(name).select("round").distinct().collect()]
        if not rounds:
            raise ValueError(f"pass {name} has seen no frames")
        return self.spark.read.schema(MADE).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/round={r}" for r in sorted(rounds)]).where(F.col("kind") == kind)

    def _blocks(self, frames: DataFrame) -> DataFrame:
        return frames.groupBy(F.expr(f"frame div {self.block}").alias("block")).agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))

    def _missing(self, name: str, frames: DataFrame) -> list[int]:
        """Blocks of frames that the ledger lacks; only the column frame is read."""
        own = self._blocks(frames).withColumnsRenamed({c: f"_{c}" for c in ("n", "first", "last")})
        met = own.join(self.ledger(name).select("block", "n", "first", "last"), "block", "left")
        bad = met.where("n IS NOT NULL AND (n <> _n OR first <> _first OR last <> _last)").select("block").limit(1).collect()
        if bad:
            raise ValueError(f"block {bad[0][0]} has other frames than when it was done")
        again = met.where("_n <> _last - _first + 1").select("block").limit(1).collect()
        if again:
            raise ValueError(f"frames are missing or repeated in block {again[0][0]}")
        return sorted(r[0] for r in met.where("n IS NULL").select("block").collect())  # one number a block

    def verify(self, name: str, frames: DataFrame) -> None:
        """An error if a block that is done had other content; reads all of frames."""
        content = frames.groupBy(F.expr(f"frame div {self.block}").alias("block")).agg(F.bit_xor(F.xxhash64("frame", F.col("pixels").cast("array<double>"))).alias("_content"))
        bad = content.join(self.ledger(name), "block").where("content <> _content").select("block").limit(1).collect()
        if bad:
            raise ValueError(f"block {bad[0][0]} has other content than when it was done")

    def _round(self, name: str, frames: DataFrame, blocks: list[int], kernel: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray | None, dict[int, np.ndarray]]]) -> None:
        """One commit: kernel gives, for frames and their pixels, their sketch and what they add to the sums by start of columns."""
        low, high, size = min(blocks) * self.block, (max(blocks) + 1) * self.block, self.block
        own = frames.where((F.col("frame") >= low) & (F.col("frame") < high))
        if len(blocks) < max(blocks) - min(blocks) + 1:
            own = own.where(F.expr(f"frame div {size}").isin(blocks))
        pixels = F.col("pixels").cast("array<double>")
        told = own.select(F.col("frame").cast("bigint").alias("frame"), pixels.alias("pixels"), F.xxhash64(F.col("frame").cast("bigint"), pixels).alias("content"))
        width = self.width

        def run(batches):
            total: dict[int, np.ndarray] = {}
            names = ["kind", "frame", "content", "start", "x"]
            for batch in batches:
                if not batch.num_rows:
                    continue
                a = samples(pa.chunked_array([batch.column(1)]))
                if a.shape[1] != width:
                    raise ValueError(f"a frame has {a.shape[1]} pixels, not {width}")
                y, sums = kernel(batch.column(0).to_numpy(), a)
                for k, part in sums.items():
                    total[k] = total[k] + part if k in total else part
                n = len(a)
                x = pa.nulls(n, pa.list_(pa.float64())) if y is None else column_of(y)
                yield pa.RecordBatch.from_arrays([pa.array(["row"] * n), batch.column(0), batch.column(2), pa.nulls(n, pa.int64()), x], names)
            for k, part in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(["sum"]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([k], pa.int64()), pa.array([part.ravel()], pa.list_(pa.float64()))], names)

        # A task's sums are as large as a few dozen frames, so tasks are few and large.
        made = told.coalesce(max(1, self.spark.sparkContext.defaultParallelism)).mapInArrow(run, MADE)
        key = uuid4().hex
        made.write.partitionBy("kind").parquet(f"{self.path}/{name}/round={key}")
        done = self.spark.read.schema(MADE).parquet(f"{self.path}/{name}/round={key}").where("kind = 'row'")
        rows = done.groupBy(F.expr(f"frame div {size}").alias("block")).agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.bit_xor("content").alias("content"))
        rows.select(F.lit(key).alias("round"), *LEDGER.replace(" string", "").replace(" bigint", "").split(", ")[1:]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}-ledger")

    def _run(self, name: str, frames: DataFrame, kernel, each: int | None) -> None:
        missing = self._missing(name, frames)
        for k in range(0, len(missing), each or max(len(missing), 1)):
            self._round(name, frames, missing[k : k + (each or len(missing))], kernel)

    def receive(self, frames: DataFrame) -> None:
        """Frames of whole blocks for the first pass, in any order of blocks, as one round; of a block that is done they are an error."""
        overlap = self._blocks(frames).join(self.ledger("first"), "block", "left_semi").limit(1).collect()
        if overlap:
            raise ValueError(f"block {overlap[0].block} has been received before")
        self._run("first", frames, self._first_kernel(False), None)

    def _first_kernel(self, both: bool):
        seed, columns, width, over, over_rows, starts = self.seed, self.columns, self.width, self.over, self.over_rows, self.starts

        def kernel(frames, a):
            y = sum(a[:, k : k + columns] @ omega(seed, k // columns, min(columns, width - k), over) for k in starts)
            if not both:
                return y, {}
            rows = omega_of_rows(seed, frames, over_rows)
            return y, {k: rows.T @ a[:, k : k + columns] for k in starts}

        return kernel

    def first_pass(self, frames: DataFrame, *, both: bool = False, each: int | None = None) -> None:
        """Sketches the rows and, with both, the columns; ``each`` blocks are a round, all where it is None."""
        self._run("both" if both else "first", frames, self._first_kernel(both), each)

    def _sums(self, parts: DataFrame, n: int) -> DataFrame:
        """pixel, v: n sums for each pixel, parts (start, x: n rows of columns) added up."""
        columns = self.columns

        def lines(start, total):
            whole = total.reshape(n, -1).T
            for low in range(0, len(whole), columns):
                own = whole[low : low + columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start + low, start + low + len(own)), pa.int64()), column_of(own)], ["pixel", "v"])

        def add(batches):
            at, total = None, None
            for batch in batches:
                for start, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = part.values.to_numpy()
                    if start != at and at is not None:
                        yield from lines(at, total)
                    at, total = start, own if start != at else total + own
            if at is not None:
                yield from lines(at, total)

        ordered = parts.select("start", "x").repartition("start").sortWithinPartitions("start")
        return written(ordered.mapInArrow(add, "pixel bigint, v array<double>"), "projected")

    def _rows(self, name: str) -> tuple[DataFrame, np.ndarray]:
        """The sketch of the rows, and what makes it orthonormal."""
        y = self._made(name, "row").select("frame", F.col("x").alias("u"))
        w, q = np.linalg.eigh(gramian(y, "u", self.over))
        keep = w > 1e-12 * w.max()
        return y, q[:, keep] / np.sqrt(w[keep])

    def single_pass(self) -> tuple[DataFrame, list[float], DataFrame]:
        """u (frame, u), singular values and v (pixel, v) from a first pass over both sides, without a second look at the frames."""
        y, basis = self._rows("both")
        w = self._sums(self._made("both", "sum"), self.over_rows)
        values, q = np.linalg.eigh(gramian(w, "v", self.over_rows))
        keep = values > 1e-12 * values.max()
        across = q[:, keep] / np.sqrt(values[keep])
        gram = gramian(y, "u", self.over)
        seed, columns, width, over = self.seed, self.columns, self.width, self.over
        product = np.zeros((self.over_rows, over))

        def meet(batches: Iterator[pa.RecordBatch]):
            total = np.zeros((len(product), over))
            for batch in batches:
                pixels, v = batch.column(0).to_numpy(), samples(pa.chunked_array([batch.column(1)]))
                for k in np.unique(pixels // columns):
                    own = pixels // columns == k
                    total += v[own].T @ omega(seed, int(k), min(columns, width - int(k) * columns), over)[pixels[own] - k * columns]
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["x"])

        for r in w.mapInArrow(meet, "x array<double>").collect():  # a small matrix for each task
            product += np.array(r.x).reshape(product.shape)
        core = (basis.T @ gram) @ np.linalg.pinv(across.T @ product)
        left, sigma, right = np.linalg.svd(core, full_matrices=False)
        n = self.rank
        return _times(y, "u", basis @ left[:, :n]), sigma[:n].tolist(), _times(w, "v", across @ right[:n].T)

    def _decomposed(self, pixels: DataFrame, y: DataFrame, basis: np.ndarray) -> tuple[DataFrame, list[float], DataFrame]:
        w, left = np.linalg.eigh(gramian(pixels, "v", basis.shape[1]))
        order = np.argsort(w)[::-1][: self.rank]
        sigma, left = np.sqrt(np.clip(w[order], 0, None)), left[:, order]
        back = left * np.where(sigma > 1e-12 * sigma.max(initial=0), 1 / np.where(sigma > 0, sigma, 1), 0)
        return _times(y, "u", basis @ left), sigma.tolist(), _times(pixels, "v", back)

    def second_pass(self, frames: DataFrame, *, each: int | None = None) -> tuple[DataFrame, list[float], DataFrame]:
        """u, singular values and v: the frames projected onto the span of their sketch, which is made once more beside each frame in place of a join."""
        y, basis = self._rows("first")
        first, starts, columns = self._first_kernel(False), self.starts, self.columns

        def kernel(numbers, a):
            q = first(numbers, a)[0] @ basis
            return None, {k: q.T @ a[:, k : k + columns] for k in starts}

        self._run("second", frames, kernel, each)
        return self._decomposed(self._sums(self._made("second", "sum"), basis.shape[1]), y, basis)

    def inner_pass(self, tiles: DataFrame) -> tuple[DataFrame, list[float], DataFrame]:
        """The same from tiles (start, frame, pixels): the pixels from ``start`` on of each frame. Each tile is projected by itself, in chunks of frames."""
        y, basis = self._rows("first")
        n = basis.shape[1]
        told = tiles.select(F.col("start").cast("bigint").alias("start"), F.col("frame").cast("bigint").alias("frame"), F.col("pixels").cast("array<double>").alias("pixels"))
        met = told.join(_times(y, "u", basis), "frame").select("start", F.expr(f"frame div {self.block}").alias("chunk"), "u", "pixels")

        def project(batches):
            at, total = None, None
            for batch in batches:
                q, a = samples(pa.chunked_array([batch.column(2)])), samples(pa.chunked_array([batch.column(3)])) if batch.num_rows else None
                start = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(start)) + 1).tolist(), len(start)]
                for low, high in zip(edges, edges[1:], strict=False):
                    if low == high:
                        continue
                    if start[low] != at and at is not None:
                        yield told_of(at, total)
                        total = None
                    at = start[low]
                    part = q[low:high].T @ a[low:high]
                    total = part if total is None else total + part
            if at is not None:
                yield told_of(at, total)

        def told_of(start, total):
            return pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["start", "x"])

        ordered = met.repartition("start", "chunk").sortWithinPartitions("start", "chunk").select("start", "chunk", "u", "pixels")
        return self._decomposed(self._sums(ordered.mapInArrow(project, "start bigint, x array<double>"), n), y, basis)


def randomized_svd(
    frames: DataFrame,
    width: int,
    rank: int,
    seed: int = 0,
    columns: int = COLUMNS,
    *,
    passes: int = 2,
    path: str | None = None,
    each: int | None = None,
    block: int = BLOCK,
) -> tuple[DataFrame, list[float], DataFrame]:
    """u (frame, u), singular values, and v (pixel, v) of frames (frame, pixels of fixed width).

    passes is 1 or 2. With a path its passes are kept there: a call that was stopped goes on where it was when it
    is made again, ``each`` blocks of ``block`` frames at a time.
    """
    if passes not in (1, 2):
        raise ValueError("a decomposition takes one or two passes")
    sketch = Sketch(frames.sparkSession, path or scratch(frames.sparkSession, "svd"), width, rank, seed=seed, columns=columns, block=block)
    sketch.first_pass(frames, both=passes == 1, each=each)
    return sketch.single_pass() if passes == 1 else sketch.second_pass(frames, each=each)
