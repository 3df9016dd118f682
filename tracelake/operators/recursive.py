"""Filters with feedback over traces of any length, as an associative scan over blocks of frames.

A cascade of sections is a linear system: state' = A state + B x, y = C state + D x. What a block of
samples does to the state is therefore an affine map, known without the state it starts from: its matrix
depends on the block's length alone, its offset is the state that the block leaves behind from rest. The same
holds for the way back, since the reversed output is linear in the state the block started from too.

1. Blocks are packed (one row each) with the offsets of their maps, forwards and backwards.
2. Maps are combined in order: a few numbers per block stream past, forwards, then backwards.
3. Every block runs again from its true states.

So samples are dealt to blocks once, no task holds more than a batch of blocks, and a trace with a third of all rows is many
tasks. Within a block the same is done once more: products with fixed matrices over runs of RUN samples, no loop over samples.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracelake.functions import dsp
from tracelake.operators.blocks import BLOCK, column_of, grouped
from tracelake.sources.tables import written

RUN = 64


class Cascade:
    """Sections (b0 b1 b2 a0 a1 a2) as one linear system; states have two numbers a section."""

    def __init__(self, sections: list[np.ndarray]):
        self.sections = [np.asarray(s, float) for s in sections]
        n = 2 * len(sections)
        cols = [self._step(state, 0.0) for state in np.eye(n)]
        self.a = np.stack([after for after, _ in cols], axis=1)
        self.c = np.array([y for _, y in cols])
        self.b, self.d = self._step(np.zeros(n), 1.0)

    def _step(self, state: np.ndarray, x: float) -> tuple[np.ndarray, float]:
        after = np.empty(len(state))
        for k, s in enumerate(self.sections):
            y = s[0] * x + state[2 * k]
            after[2 * k] = s[1] * x - s[4] * y + state[2 * k + 1]
            after[2 * k + 1] = s[2] * x - s[5] * y
            x = y
        return after, x

    @cached_property
    def steady(self) -> np.ndarray:
        """The state after endless ones."""
        out, level = [], 1.0
        for s in self.sections:
            y = s[:3].sum() / s[3:].sum()
            z1 = s[2] - s[5] * y
            out += [level * (s[1] - s[4] * y + z1), level * z1]
            level *= y
        return np.array(out)

    @cached_property
    def runs(self) -> tuple[np.ndarray, ...]:
        """For RUN samples x and a state z before them (as rows): y = x @ fed + z @ free, state after = x @ left + z @ power."""
        powers = [np.eye(len(self.a))]
        for _ in range(RUN):
            powers.append(self.a @ powers[-1])
        response = np.array([self.d, *[self.c @ p @ self.b for p in powers[: RUN - 1]]])
        gap = np.arange(RUN)[None, :] - np.arange(RUN)[:, None]
        fed = np.where(gap >= 0, response[np.maximum(gap, 0)], 0.0)
        free = np.stack([p.T @ self.c for p in powers[:RUN]], axis=1)
        left = np.stack([powers[RUN - 1 - k] @ self.b for k in range(RUN)])
        return fed, free, left, powers[RUN].T

    def __call__(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and last states of rows of samples, from a state for each row."""
        fed, free, left, power = self.runs
        n = x.shape[1] // RUN
        out = np.empty(x.shape)
        if n:
            cut = x[:, : n * RUN].reshape(len(x), n, RUN)
            offsets = cut @ left
            before = np.empty((len(x), n, state.shape[1]))
            for k in range(n):
                before[:, k] = state
                state = state @ power + offsets[:, k]
            out[:, : n * RUN] = (cut @ fed + before @ free).reshape(len(x), -1)
        for k in range(n * RUN, x.shape[1]):
            out[:, k] = state @ self.c + self.d * x[:, k]
            state = state @ self.a.T + np.outer(x[:, k], self.b)
        return out, state

    def map_of(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a block of length samples and a state before it (as rows): what it adds to the state after, to the last output, and to the state after the way back."""
        free, after = self(np.zeros((len(self.a), length)), np.eye(len(self.a)))
        _, back = self(free[:, ::-1], np.zeros((len(self.a), len(self.a))))
        return after, free[:, -1], back


def extended(x: np.ndarray, pad: int, first: bool, last: bool) -> np.ndarray:
    """Own samples of a block, with the trace's ends mirrored through their values; x has up to pad more in front of the own ones unless first."""
    parts = [x]
    if pad and first:
        parts.insert(0, 2 * x[0] - x[pad:0:-1])
    if pad and last:
        parts.append(2 * x[-1] - x[-2 : -pad - 2 : -1])
    return np.concatenate(parts)


PACKED = "roi_id string, block bigint, first boolean, last boolean, pad int, samples array<double>, level double, after array<double>, final double, back array<double>"


def pack_blocks(traces: DataFrame, cascade: Cascade, block: int) -> DataFrame:
    """One row for each block: its samples (with the mirrored ends of the trace) and the offsets of its maps."""
    reach = 3 * (len(cascade.a) + 1)
    block = max(block, reach + 1)
    frame = F.col("frame")
    # A block also has the last samples before it, for the mirrored end, and the first behind it, to see whether there is one.
    ids = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.floor((frame - 1) / block)), F.floor((frame + reach) / block))
    dealt = traces.select(F.col("roi_id").cast("string").alias("roi_id"), F.explode(ids).alias("block"), frame.cast("bigint").alias("frame"), F.col("value").cast("double").alias("value"))
    ordered = dealt.repartition("roi_id", "block").sortWithinPartitions("roi_id", "block", "frame")

    def run(batches):
        waiting: dict[int, list] = {}

        def made(length):
            rows = waiting.pop(length)
            x = np.stack([r[-1] for r in rows])
            level = np.where([r[2] for r in rows], x[:, 0], 0.0)
            y, after = cascade(x, np.zeros((len(x), len(cascade.a))))
            _, back = cascade(y[:, ::-1], np.zeros((len(x), len(cascade.a))))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[:5], (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, column_of(x), column_of(level), column_of(after), column_of(y[:, -1]), column_of(back)], [c.split()[0] for c in PACKED.split(", ")])

        for (roi, number), group in grouped(batches, 2):
            frames, values = group["frame"].to_numpy(), group["value"].to_numpy().astype(float)
            own = (frames >= number * block) & (frames < (number + 1) * block)
            if not own.any():
                continue
            if (np.diff(frames) != 1).any() or (number == 0 and frames[0] != 0):
                raise ValueError(f"trace {roi}: frames are missing or repeated around {number * block}")
            first, last = number == 0, not (frames >= (number + 1) * block).any()
            pad = min(reach, len(values) - 1) if first and last else reach
            lead = 0 if first else int(np.flatnonzero(own)[0])
            x = extended(values[: np.flatnonzero(own)[-1] + 1], pad, first, last)[lead:]
            waiting.setdefault(len(x), []).append((roi, number, first, last, pad, x))
            if len(waiting[len(x)]) * len(x) > 1 << 20:
                yield from made(len(x))
        for length in list(waiting):
            yield from made(length)

    return ordered.mapInArrow(run, PACKED)


def numbers(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.array([math.nan if v is None else v for v in x], float) for x in column.to_pylist()]


def states(packed: DataFrame, cascade: Cascade) -> DataFrame:
    """roi_id, block, ahead, behind: the states before each block, on the way there and on the way back. Streams, so a trace has any number of blocks."""
    fields = packed.select("roi_id", "block", F.size("samples").alias("length"), "level", "after", "final", "back")
    there = fields.repartition("roi_id").sortWithinPartitions("roi_id", "block")

    def forwards(batches):
        at, maps, state = None, {}, None
        for batch in batches:
            out = []
            level, final = (c.to_numpy(zero_copy_only=False).astype(float) for c in (batch.column(3), batch.column(5)))
            rows = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), level, numbers(batch.column(4)), final, numbers(batch.column(6)), strict=True)
            for roi, length, start, after, y, back in rows:
                if roi != at:
                    at, state = roi, cascade.steady * start
                if length not in maps:
                    maps[length] = cascade.map_of(length)
                power, ends, returns = maps[length]
                out.append((state, y + state @ ends, back + state @ returns))
                state = after + state @ power
            if out:
                ahead, y, back = (np.array(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], column_of(ahead), column_of(y), column_of(back)], ["roi_id", "block", "length", "ahead", "final", "back"])

    been = written(there.mapInArrow(forwards, "roi_id string, block bigint, length int, ahead array<double>, final double, back array<double>"), "ahead")
    home = been.repartition("roi_id").sortWithinPartitions("roi_id", F.desc("block"))

    def backwards(batches):
        at, powers, state = None, {}, None
        for batch in batches:
            out = []
            final = batch.column(4).to_numpy(zero_copy_only=False).astype(float)
            for roi, length, y, back in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), final, numbers(batch.column(5)), strict=True):
                if roi != at:
                    at, state = roi, cascade.steady * y
                if length not in powers:
                    powers[length] = cascade.map_of(length)[0]
                out.append(state)
                state = back + state @ powers[length]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), column_of(np.array(out))], ["roi_id", "block", "ahead", "behind"])

    return home.mapInArrow(backwards, "roi_id string, block bigint, ahead array<double>, behind array<double>")


def zero_phase(traces: DataFrame, sections: list[np.ndarray], result: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, block: int = BLOCK) -> DataFrame:
    """roi_id, frame, value: traces filtered forwards and backwards, the ends mirrored through their values, steady at first.

    result (samples, filtered) makes something else of both. Frames number a trace from 0; one that is missing
    or there twice is an error. A NULL sample makes its trace NULL, as feedback carries it everywhere.
    """
    cascade = Cascade(sections)
    block = max(block, 3 * (len(cascade.a) + 1) + 1)
    packed = written(pack_blocks(traces, cascade, block), "blocks")
    told = written(states(packed, cascade), "states").withColumnsRenamed({"roi_id": "_roi", "block": "_block"})
    ready = packed.join(told, (F.col("roi_id") == F.col("_roi")) & (F.col("block") == F.col("_block"))).select("roi_id", "block", "first", "last", "pad", "samples", "ahead", "behind")

    def run(batches):
        for batch in batches:
            roi, number, first, last, pad = (batch.column(k).to_pylist() for k in range(5))
            samples, ahead, behind = (numbers(batch.column(k)) for k in (5, 6, 7))
            by_length: dict[int, list[int]] = {}
            for k, x in enumerate(samples):
                by_length.setdefault(len(x), []).append(k)
            for same in by_length.values():
                x = np.stack([samples[k] for k in same])
                y, _ = cascade(x, np.stack([ahead[k] for k in same]))
                y = cascade(y[:, ::-1], np.stack([behind[k] for k in same]))[0][:, ::-1]
                for k, before, filtered in zip(same, x, y, strict=True):
                    inner = slice(pad[k] if first[k] else 0, len(before) - (pad[k] if last[k] else 0))
                    own = filtered[inner] if result is None else result(before[inner], filtered[inner])
                    frames = np.arange(len(own), dtype=np.int64) + number[k] * block
                    yield pa.RecordBatch.from_arrays([pa.array([roi[k]] * len(own), pa.string()), pa.array(frames), column_of(own)], ["roi_id", "frame", "value"])

    found = ready.mapInArrow(run, "roi_id string, frame bigint, value double")
    kind = traces.schema["roi_id"].dataType
    return found if isinstance(kind, StringType) else found.withColumn("roi_id", F.col("roi_id").cast(kind))


def frequency_filter(traces: DataFrame, fs: float, specs: list[str], order: int = 4, block: int = BLOCK) -> DataFrame:
    """Specs in turn: '<f' keeps what is above f, '>f' what is below it, 'a-b' takes the band a to b off."""
    out = traces
    for spec in specs:
        if spec[0] in "<>":
            out = zero_phase(out, dsp.butterworth(order, float(spec[1:]) / (fs / 2), "high" if spec[0] == "<" else "low"), block=block)
        else:
            low, high = map(float, spec.split("-"))
            out = zero_phase(out, dsp.butterworth(order, (low / (fs / 2), high / (fs / 2)), "band"), lambda x, y: x - y, block)
    return out


def bandpass(traces: DataFrame, fs: float, low: float, high: float, order: int = 4, block: int = BLOCK) -> DataFrame:
    return zero_phase(traces, dsp.butterworth(order, (low / (fs / 2), high / (fs / 2)), "band"), block=block)
