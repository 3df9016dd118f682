"""Files: raw camera recordings as a data source, traces, events and regions as Parquet, session files, NPZ regions."""

from __future__ import annotations

import glob
import os
import re
import struct
import tomllib
import warnings
from collections import Counter
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Lines of a recording's import file, and the option that each gives.
IMPORT_LINES = {
    "width": r"- Width: (\d+)",
    "height": r"- Height: (\d+)",
    "gap": r"- Gap between images: (\d+)",
    "offset": r"- Offset to first image: (\d+)",
    "dtype": r"- Image Type: '(\d+)-bit\s*\w*'",
}
#: A header of this many bytes tells the camera's region, in these of its 16-bit numbers (from 0 on disk).
REGION_HEADER, REGION_PLACES = 80, (29, 30, 32, 33)


class FrameRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int, first: int):
        self.path, self.start, self.stop, self.first = path, start, stop, first


def read_import_file(folder: str) -> dict[str, str]:
    """The options that a folder's only *import*.txt file gives; none where there is no such file, or several."""
    found = glob.glob(os.path.join(folder, "*import*.txt"))
    if len(found) != 1:
        return {}
    with open(found[0], encoding="utf-8", errors="replace") as file:
        text = file.read()
    told = {name: m[1] for name, pattern in IMPORT_LINES.items() if (m := re.search(pattern, text))}
    return told | ({"dtype": f"uint{told['dtype']}"} if "dtype" in told else {})


def camera_region(path: str) -> list[int] | None:
    """The camera's region of a recording whose header has REGION_HEADER bytes, counted from 1; None of a shorter file."""
    with open(path, "rb") as file:
        head = file.read(REGION_HEADER)
    if len(head) < REGION_HEADER:
        return None
    numbers = struct.unpack(f"<{REGION_HEADER // 2}H", head)
    return [numbers[k] + 1 for k in REGION_PLACES]


class RawFrames(DataSource):
    """Frames of raw camera files: a header, then pictures of one size with gaps between them.

    Options: width, height, offset, gap, dtype (uint8 or uint16, little endian), batch
    (frames in a task), max_frames, start and stop (frames; stop exclusive). With pushdown, which
    needs spark.sql.python.filterPushdown.enabled, ranges of frame in a filter narrow what is read, too. What is not given is taken from the folder's import file. A folder
    is read file after file, by the number in the name. Paths must be open to all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> str:
        return "frame bigint, height int, width int, pixels array<int>"

    def reader(self, schema) -> RawReader:
        pushed = str(self.options.get("pushdown", "false")).lower() == "true"
        return PrunedRawReader(self.options) if pushed else RawReader(self.options)


class RawReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        told = read_import_file(self.path if os.path.isdir(self.path) else os.path.dirname(self.path))
        known = {**told, **dict(options)}
        if "width" not in known or "height" not in known:
            raise ValueError("width and height are neither given nor in an import file")
        self.width, self.height = int(known["width"]), int(known["height"])
        self.offset, self.gap = int(known.get("offset", 0)), int(known.get("gap", 0))
        if known.get("dtype", "uint8") not in ("uint8", "uint16"):
            raise ValueError(f"no such type of pixels: {known['dtype']}")
        self.kind = np.dtype(known.get("dtype", "uint8")).newbyteorder("<")
        self.batch = int(known.get("batch", 1000))
        self.most = int(known["max_frames"]) if "max_frames" in known else None
        self.low, self.high = int(known.get("start", 0)), int(known["stop"]) if "stop" in known else None
        self.size = self.width * self.height * self.kind.itemsize

    def files(self) -> list[str]:
        if not os.path.isdir(self.path):
            return [self.path]
        names = [x for x in os.listdir(self.path) if x.lower().endswith(".raw")]
        if not names:
            raise ValueError(f"no raw files in {self.path}")
        return [os.path.join(self.path, x) for x in sorted(names, key=lambda x: (int((re.findall(r"\d+", x) or ["0"])[-1]), x))]

    def count(self, path: str) -> int:
        """Whole pictures in a file; a warning where its size is more than a fiftieth of a picture off."""
        length = os.path.getsize(path) - self.offset
        exact = length / (self.size + self.gap)
        if abs(exact - round(exact)) > 1 / 50 and abs(length + self.gap - round(exact) * (self.size + self.gap)) > 0:
            warnings.warn(f"{path} holds {exact:.2f} pictures", stacklevel=2)
        return max(0, (length + self.gap) // (self.size + self.gap))

    def partitions(self):
        out, before = [], 0
        for path in self.files():
            n = self.count(path)
            if self.most is not None:
                n = min(n, self.most - before)
            low, high = max(self.low - before, 0), n if self.high is None else min(n, self.high - before)
            first = low - low % self.batch
            out += [FrameRange(path, max(k, low), min(high, k + self.batch), before) for k in range(first, high, self.batch)]
            before += n
        return out

    def read(self, part):
        pixels = self.width * self.height
        with open(part.path, "rb") as file:
            for low in range(part.start, part.stop, 64):
                high = min(low + 64, part.stop)
                file.seek(self.offset + low * (self.size + self.gap))
                raw = file.read((high - low) * (self.size + self.gap))
                pictures = [np.frombuffer(raw, self.kind, pixels, k * (self.size + self.gap)).astype(np.int32) for k in range(high - low)]
                n = len(pictures)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(part.first + low, part.first + high), pa.int64()),
                        pa.array(np.full(n, self.height), pa.int32()),
                        pa.array(np.full(n, self.width), pa.int32()),
                        pa.ListArray.from_arrays(np.arange(0, (n + 1) * pixels, pixels, dtype=np.int32), np.concatenate(pictures)),
                    ],
                    ["frame", "height", "width", "pixels"],
                )


class PrunedRawReader(RawReader):
    """A reader that takes filters; Spark lets no reader have the method where the setting is off."""

    def pushFilters(self, filters):
        """Narrows the range of frames; every filter is given back, as Spark may well look at what is left."""
        for x in filters:
            if getattr(x, "attribute", None) != ("frame",):
                continue
            if isinstance(x, In):
                known = [v for v in x.value if v is not None]
                low, high = min(known, default=0), max(known, default=-1) + 1
            elif isinstance(x, EqualTo):
                low, high = x.value, x.value + 1
            elif isinstance(x, (GreaterThan, GreaterThanOrEqual)):
                low, high = x.value + isinstance(x, GreaterThan), None
            elif isinstance(x, (LessThan, LessThanOrEqual)):
                low, high = 0, x.value + isinstance(x, LessThanOrEqual)
            else:
                continue
            self.low = max(self.low, low)
            self.high = high if self.high is None else self.high if high is None else min(self.high, high)
        return filters


def save_video(frames: DataFrame, path: str, block: int = 1000) -> None:
    """Frames as Parquet, a folder per block, so that a range of frames reads its blocks only."""
    frames.withColumn("block", F.expr(f"frame div {block}")).write.partitionBy("block").parquet(path)


def read_frames(spark: SparkSession, path: str, start: int, stop: int, block: int = 1000) -> DataFrame:
    """Frames start to stop (exclusive) of a video stored by save_video; other blocks are pruned."""
    return spark.read.parquet(path).where((F.col("block") >= start // block) & (F.col("block") <= (stop - 1) // block) & (F.col("frame") >= start) & (F.col("frame") < stop))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table on any file system that Spark reads, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def is_low_rank(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a low-rank video: tables u, s and v."""
    return all(stored(spark, f"{path}/{name}") is not None for name in "usv")


def save_codes(v: DataFrame, path: str, tile: int = 64, chunk: int = 16) -> None:
    """Codes of pixels (row, col, v) as Parquet, a folder for each tile of the image and chunk of components.

    So a part of the image, or the leading components, read their folders only.
    """
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("v") - 1) / chunk).cast("int"))), lambda k: F.struct(k.alias("chunk"), F.slice("v", k * chunk + 1, chunk).alias("v")))
    told = v.select("row", "col", F.explode(parts).alias("x"))
    placed = told.select("row", "col", "x.v", F.floor(F.col("row") / tile).cast("int").alias("tile_row"), F.floor(F.col("col") / tile).cast("int").alias("tile_col"), "x.chunk")
    keys = ["tile_row", "tile_col", "chunk"]
    placed.repartition(*keys).sortWithinPartitions("row", "col").write.partitionBy(*keys).option("parquet.enable.dictionary", "false").parquet(path)


def read_codes(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, components: tuple[int, int] | None = None, tile: int = 64, chunk: int = 16) -> DataFrame:
    """row, col, v of codes as save_codes stores them: rows, cols and components from the first to the second number (exclusive).

    Folders outside of the ranges are pruned. A table without folders is read whole and cut.
    """
    found = spark.read.parquet(path)
    for name, own in (("row", rows), ("col", cols)):
        if own is not None:
            found = found.where((F.col(name) >= own[0]) & (F.col(name) < own[1]))
            if f"tile_{name}" in found.columns:
                found = found.where((F.col(f"tile_{name}") >= own[0] // tile) & (F.col(f"tile_{name}") <= (own[1] - 1) // tile))
    if "chunk" not in found.columns:
        return found if components is None else found.withColumn("v", F.slice("v", components[0] + 1, components[1] - components[0]))
    low = 0
    if components is not None:
        low = components[0] // chunk
        found = found.where((F.col("chunk") >= low) & (F.col("chunk") <= (components[1] - 1) // chunk))
    whole = found.groupBy("row", "col").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "v"))), lambda x: x["v"])).alias("v"))
    return whole if components is None else whole.withColumn("v", F.slice("v", components[0] - low * chunk + 1, components[1] - components[0]))


def save_traces(traces: DataFrame, path: str) -> None:
    traces.write.parquet(path)


def save_events(events: DataFrame, path: str) -> None:
    """Events with 1-based frames on disk."""
    events.withColumn("frame", F.col("frame") + 1).write.parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("frame", F.col("frame") - 1)


def save_regions(pixels: DataFrame, path: str) -> None:
    """Regions (roi_id, row, col and whatever belongs to a pixel) as Parquet."""
    pixels.write.parquet(path)


def read_regions(spark: SparkSession, path: str, height: int | None = None) -> DataFrame:
    """Regions with row and col; where the table has a 1-based column-major index (pixel_idx or PixelIdxList) instead, these follow from it and the image's height."""
    found = spark.read.parquet(path)
    index = next((c for c in ("pixel_idx", "PixelIdxList") if c in found.columns), None)
    if index is None:
        return found
    if height is None:
        raise ValueError("an index of pixels needs the height of the image")
    at = F.col(index) - 1
    return found.withColumns({"row": (at % height).cast("int"), "col": F.floor(at / height).cast("int")}).drop(index)


def save_npz_regions(pixels: DataFrame, path: str) -> None:
    """Regions (roi_id, ord, row, col, weight) as an NPZ file of plain arrays: ids, offsets of their pixels, rows, cols, weights.

    The file is one list of pixels, read on the driver: for collections that a person drew.
    """
    rows = pixels.select("roi_id", "ord", "row", "col", "weight").orderBy("roi_id", "ord").collect()
    counts = Counter(r.roi_id for r in rows)  # in order of the ids
    ids, ends = list(counts), np.cumsum(list(counts.values()))
    np.savez(path, ids=np.array(ids, str), offsets=np.concatenate([[0], ends]).astype(int), rows=np.array([r.row for r in rows], int), cols=np.array([r.col for r in rows], int), weights=np.array([r.weight for r in rows], float))


def read_npz_regions(spark: SparkSession, path: str) -> DataFrame:
    """roi_id, ord, row, col, weight from a file of save_npz_regions. Nothing in the file is executed."""
    with np.load(path, allow_pickle=False) as held:
        sizes = np.diff(held["offsets"])
        ids = np.repeat(held["ids"], sizes).tolist()
        order = np.concatenate([np.arange(n) for n in sizes]).tolist() if len(sizes) else []
        rows = list(zip(ids, order, held["rows"].tolist(), held["cols"].tolist(), held["weights"].tolist(), strict=True))
    return spark.createDataFrame(rows, "roi_id string, ord int, row int, col int, weight double")


@dataclass(frozen=True)
class SessionConfig:
    """What a session file has to say."""

    name: str
    fs: float
    video: str
    output: str


def load_session(path: str) -> SessionConfig:
    """A session from TOML; a missing key is a ValueError."""
    with open(path, "rb") as file:
        found = tomllib.load(file)
    if missing := [f.name for f in fields(SessionConfig) if f.name not in found]:
        raise ValueError(f"missing: {', '.join(missing)}")
    return SessionConfig(**{f.name: found[f.name] for f in fields(SessionConfig)})


def session_rate(spark: SparkSession, video: str, fs: float) -> float:
    """The rate that the session file beside a video names, else fs. The file is read by Spark, wherever it lies."""
    path = f"{video.rstrip('/').rpartition('/')[0]}/session.toml"
    try:
        lines = [r.value for r in spark.read.text(path).collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return fs
    return float(tomllib.loads("\n".join(lines)).get("fs", fs))


def soma_ids(ids: DataFrame) -> DataFrame:
    return ids.where(F.lower("id").contains("soma"))
