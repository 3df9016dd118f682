"""Local kernels over traces of any length: blocks of frames with a halo on either side.

A trace that holds a third of all rows becomes many blocks, each the work of one
task and a few thousand samples in memory. Kernels that need no more than
``halo`` samples on either side give the same values as on the whole trace.
Frames number the samples of a trace from 0; a missing frame is a missing sample (NaN) to the kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

BLOCK = 8192


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first ``keys`` columns, over the ends of batches."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.ones(batch.num_rows, bool)
        codes = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in range(keys)]
        new[1:] = np.any([np.diff(c) != 0 for c in codes], axis=0)
        starts = np.flatnonzero(new).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            own = tuple(batch.column(k)[a].as_py() for k in range(keys))
            if held and own != name:
                yield name, pa.Table.from_batches(held)
                held = []
            name = own
            held.append(batch.slice(a, b - a))
    if held:
        yield name, pa.Table.from_batches(held)


def samples(column: pa.ChunkedArray) -> np.ndarray:
    """A column of numbers, or of lists of one length, as floats; NULL as NaN."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        whole = column.combine_chunks()
        flat = whole.flatten().to_numpy(zero_copy_only=False).astype(float)
        return flat.reshape(len(whole), -1) if len(whole) else flat.reshape(0, 0)
    return column.to_numpy().astype(float)


def column_of(values: np.ndarray) -> pa.Array:
    """Floats, or rows of them, as a column; NaN as NULL."""
    if values.ndim == 1:
        return pa.array(values, pa.float64(), from_pandas=True)
    flat = pa.array(values.ravel(), pa.float64(), from_pandas=True)
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32), flat)


Kernel = Callable[[np.ndarray, bool, bool], "np.ndarray | tuple[np.ndarray, ...]"]


def blockwise(rows: DataFrame, kernel: Kernel, halo: int, column: str = "value", results: tuple[str, ...] = ("value",), block: int = BLOCK) -> DataFrame:
    """roi_id, frame and what kernel makes of column, sample by sample.

    kernel gets the samples of a block with up to halo more on either side, and whether they
    begin and end the trace; it gives one array (or a tuple of them) of the same length.
    column may hold lists of one length, such as codes of frames: then samples are rows.
    """
    block = max(block, halo + 1)
    ids = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("frame") - halo) / block)), F.floor((F.col("frame") + halo) / block))
    kind = rows.schema[column].dataType
    dealt = rows.select("roi_id", F.explode(ids).alias("block"), F.col("frame").cast("bigint").alias("frame"), column)
    ordered = dealt.repartition("roi_id", "block").sortWithinPartitions("roi_id", "block", "frame")
    out = ArrayType(DoubleType()) if isinstance(kind, ArrayType) else DoubleType()
    schema = StructType([StructField("roi_id", rows.schema["roi_id"].dataType), StructField("frame", LongType()), *[StructField(r, out) for r in results]])

    def run(batches):
        for (_, number), group in grouped(batches, 2):
            frames = group["frame"].to_numpy()
            own = (frames >= number * block) & (frames < (number + 1) * block)
            if not own.any():
                continue
            values, place = samples(group[column]), frames - frames[0]
            if place[-1] + 1 != len(frames):  # a missing frame is a missing sample
                if (np.diff(frames) < 1).any():
                    raise ValueError(f"trace {group['roi_id'][0].as_py()}: a frame is there twice in block {number}")
                whole = np.full((place[-1] + 1, *values.shape[1:]), np.nan)
                whole[place] = values
                values = whole
            made = kernel(values, bool(frames[0] == 0), bool(frames[-1] < (number + 1) * block + halo - 1))
            made = made if isinstance(made, tuple) else (made,)
            kept = group.filter(pa.array(own))
            yield pa.RecordBatch.from_arrays([kept["roi_id"].combine_chunks(), kept["frame"].combine_chunks(), *[column_of(m[place][own]) for m in made]], schema.names)

    return ordered.mapInArrow(run, schema)
