"""Joins of traces and event lists: windows around events, bands, nearest neighbours, hopping counts."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.blocks import grouped
from tracelake.operators.smoothing import block_of, with_halo

#: Names of so many rois are broadcast where they meet each event or frame.
MOST_BROADCAST = 100_000


def samples(ms: float, fs: float) -> int:
    """Milliseconds as a number of samples, rounded up."""
    return math.ceil(ms * fs / 1000)


def event_windows(traces: DataFrame, events: DataFrame, n_pre: int, n_post: int) -> DataFrame:
    """roi_id, event_idx, frame, offset, value: the samples around each event.

    Samples outside of the trace are NULL, so every event has n_pre + n_post + 1 rows. The
    offsets are exploded and joined on (roi_id, frame), so a roi with many frames is not
    one task's work.
    """
    spine = events.select("roi_id", "event_idx", "frame", F.explode(F.sequence(F.lit(-n_pre), F.lit(n_post))).alias("offset"))
    right = traces.select(F.col("roi_id").alias("_r"), F.col("frame").alias("_f"), "value")
    return spine.join(right, (spine["roi_id"] == right["_r"]) & (spine["frame"] + spine["offset"] == right["_f"]), "left").select("roi_id", "event_idx", "frame", "offset", "value")


def packed_windows(traces: DataFrame, events: DataFrame, n_pre: int, n_post: int) -> DataFrame:
    """roi_id, event_idx, frame, window: the same as one array per event, from packed traces."""
    at = F.sequence(F.lit(-n_pre), F.lit(n_post))
    return events.join(traces.select("roi_id", "values"), "roi_id").select("roi_id", "event_idx", "frame", F.transform(at, lambda o: F.when(F.col("frame") + o >= 0, F.get("values", (F.col("frame") + o).cast("int")))).alias("window"))


def cross_windows(traces: DataFrame, events: DataFrame, n_pre: int, n_post: int) -> DataFrame:
    """trace_roi, roi_id (of the event), event_idx, frame, offset, value: events of every roi on the trace of every roi."""
    rois = traces.select(F.col("roi_id").alias("trace_roi")).distinct()
    paired = events.join(F.broadcast(rois) if _few(rois) else rois, how="cross")
    spine = paired.select("trace_roi", "roi_id", "event_idx", "frame", F.explode(F.sequence(F.lit(-n_pre), F.lit(n_post))).alias("offset"))
    right = traces.select(F.col("roi_id").alias("_r"), F.col("frame").alias("_f"), "value")
    return spine.join(right, (spine["trace_roi"] == right["_r"]) & (spine["frame"] + spine["offset"] == right["_f"]), "left").drop("_r", "_f")


def cross_means(traces: DataFrame, events: DataFrame, n_pre: int, n_post: int, block: int = 1024, span: int = 1024) -> DataFrame:
    """trace_roi, roi_id (of the event), offset, mean: the means of cross_windows over the events of each roi, NULL where no frame has a value.

    No event is paired with a trace as a row. Rois are dealt into blocks of about block and frames into spans; each
    pair of blocks is, per span, one product of event counts per (roi_id, offset, frame) with the samples of the
    traces. A task adds up the spans of a pair of blocks, so its sums are the result; where pairs are few, their spans are
    shared among tasks, whose sums are then added up. One row of NULL frame names each roi, so that every pair is there.
    """
    counts = events.select("roi_id", "frame", F.explode(F.sequence(F.lit(-n_pre), F.lit(n_post))).alias("offset")).groupBy("roi_id", "offset", (F.col("frame") + F.col("offset")).alias("frame")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    named = events.select("roi_id").distinct().select("roi_id", F.explode(F.sequence(F.lit(-n_pre), F.lit(n_post))).alias("offset"), F.lit(None).cast("bigint").alias("frame"), F.lit(0.0).alias("n"))
    samples = traces.select("roi_id", "frame", "value").union(traces.select("roi_id", F.lit(None).cast("bigint"), F.lit(None).cast("double")).distinct())
    total = block_sums(counts.union(named), samples, events, traces, n_pre + n_post + 1, _products, ("x", "n"), block, span)
    return total.select("trace_roi", "roi_id", "offset", F.try_divide("x", "n").alias("mean"))


#: Tasks to share the spans of few pairs of blocks among.
SHARED = 64
#: Samples of the traces that a task holds.
MOST_HELD = 2_000_000
#: Rows in a batch of sums.
ROWS = 1 << 18

Products = Callable[[np.ndarray, dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, ...]]


def block_sums(left: DataFrame, samples: DataFrame, events: DataFrame, traces: DataFrame, width: int, products: Products, names: tuple[str, ...], block: int, span: int) -> DataFrame:
    """trace_roi, roi_id, offset and sums by name, for every pair of (roi_id, offset) in left and trace in samples.

    left: (roi_id, offset, frame, n and other numbers), samples: (roi_id, frame, value), NULL frames naming those that may have no other row.
    products gets, for a span of frames, the places of left's rows in a matrix of lines by frames, as (lines, frames, shape), their numbers, and the samples as frames by
    traces, NaN for none; it gives a matrix of lines by traces for each name. Matrices have 4 block lines and block traces at most,
    about. Where no trace is longer than a span, more rois share a task, which takes their blocks one by one: each row is then sent to fewer tasks.
    """
    event_rois, trace_rois = (max(1, d.select("roi_id").distinct().count()) for d in (events, traces))
    last, rows = traces.agg(F.max("frame"), F.count(F.lit(1))).first()
    spans = (last or 0) // span + 1
    if spans == 1:
        n_events = max(math.ceil(event_rois * width / (24 * block)), min(8, math.ceil(event_rois / 128)))
        n_traces = max(math.ceil(trace_rois / (6 * block)), min(8, math.ceil(trace_rois / 128)), math.ceil(rows / MOST_HELD))
    else:
        n_events, n_traces = math.ceil(event_rois * width / (4 * block)), math.ceil(trace_rois / block)
    shares = max(1, min(spans, SHARED // (n_events * n_traces)))
    of = lambda k: F.pmod(F.xxhash64("roi_id"), F.lit(k)).cast("int")
    others = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    in_span = F.coalesce(F.floor(F.col("frame") / span), F.lit(0)).cast("int")
    numbers = [c for c in left.columns if c not in ("roi_id", "offset", "frame")]
    null = F.lit(None)
    one = left.select(of(n_events).alias("a"), others(n_traces).alias("b"), in_span.alias("s"), F.lit(0).alias("side"), F.col("roi_id").cast("string").alias("roi_id"), F.col("offset").cast("int").alias("offset"), F.col("frame").cast("bigint").alias("frame"), *[F.col(c).cast("double").alias(c) for c in numbers], null.cast("double").alias("value"))
    two = samples.select(others(n_events).alias("a"), of(n_traces).alias("b"), in_span.alias("s"), F.lit(1).alias("side"), F.col("roi_id").cast("string").alias("roi_id"), null.cast("int").alias("offset"), F.col("frame").cast("bigint").alias("frame"), *[null.cast("double").alias(c) for c in numbers], F.col("value").cast("double").alias("value"))
    share = F.pmod("s", F.lit(shares)).alias("g")
    keyed = one.union(two).select("a", "b", share, "s", "side", "roi_id", "offset", "frame", *numbers, "value")
    ordered = keyed.repartition(max(2 * n_events * n_traces * shares, 1), "a", "b", "g").sortWithinPartitions("a", "b", "g", "s", "side")
    fields = [("trace_roi", pa.string()), ("roi_id", pa.string()), ("offset", pa.int32()), *[(c, pa.float64()) for c in names]]

    def run(batches):
        if spans == 1:
            for _, group in grouped(batches, 3):
                for sums in _by_blocks(group, numbers, products, len(names), block):
                    yield from _told(sums, fields)
            return
        held, sums = None, None
        for (a, b, g, _), group in grouped(batches, 4):
            if held is not None and held != (a, b, g):
                yield from _told(sums, fields)
                sums = None
            held = (a, b, g)
            sums = _added(sums, group, numbers, products, len(names))
        if held is not None:
            yield from _told(sums, fields)

    parts = ordered.mapInArrow(run, f"trace_roi string, roi_id string, offset int, {', '.join(f'{c} double' for c in names)}")
    if shares == 1:
        return parts
    return parts.groupBy("trace_roi", "roi_id", "offset").agg(*[F.sum(c).alias(c) for c in names])


def _places(keys: list, known: dict) -> np.ndarray:
    """Where each key stands in known, to which new ones are added."""
    return np.array([known.setdefault(k, len(known)) for k in keys], int)


def _grown(m: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return m if m.shape == shape else np.pad(m, [(0, n - k) for n, k in zip(shape, m.shape, strict=True)])


def _added(sums, group: pa.Table, numbers: list[str], products: Products, n: int):
    """sums (lines, traces, matrices) with those of one span of a pair of blocks."""
    lines, rois, totals = sums or ({}, {}, [np.zeros((0, 0))] * n)
    split = int(np.searchsorted(group["side"].to_numpy(), 1))
    left, right = group.slice(0, split), group.slice(split)
    codes = left["roi_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    offsets = left["offset"].to_numpy().astype(np.int64)
    pair, back = np.unique(np.stack([codes.indices.to_numpy(), offsets]), axis=1, return_inverse=True)
    told = codes.dictionary.to_pylist()
    line = _places([(told[i], int(o)) for i, o in pair.T], lines)[back.ravel()] if split else np.zeros(0, int)
    its = right["roi_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    place = _places(its.dictionary.to_pylist(), rois)[its.indices.to_numpy()] if len(right) else np.zeros(0, int)
    totals = [_grown(m, (len(lines), len(rois))) for m in totals]
    known, sampled = (d["frame"].combine_chunks().is_valid().to_numpy(zero_copy_only=False) for d in (left, right))
    frames = np.unique(left["frame"].to_numpy().astype(float)[known])
    asked = right["frame"].to_numpy().astype(float)
    sampled &= np.isin(asked, frames)
    if len(frames) and sampled.any():
        at = np.searchsorted(frames, left["frame"].to_numpy().astype(float)[known])
        x = np.full((len(frames), len(rois)), np.nan)
        x[np.searchsorted(frames, asked[sampled]), place[sampled]] = right["value"].to_numpy().astype(float)[sampled]
        made = products((line[known], at, (len(lines), len(frames))), {c: left[c].to_numpy()[known] for c in numbers}, x)
        totals = [m + p for m, p in zip(totals, made, strict=True)]
    return lines, rois, totals


def _by_blocks(group: pa.Table, numbers: list[str], products: Products, n: int, block: int):
    """The sums of blocks of lines and blocks of traces of one span, one after the other."""
    split = int(np.searchsorted(group["side"].to_numpy(), 1))
    left, right = group.slice(0, split), group.slice(split)
    places = lambda d: d["roi_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    own, other = places(left), places(right)
    width = max(1, 4 * block // max(1, len(np.unique(left["offset"].to_numpy()))))
    for k in range(0, int(own.max(initial=-1)) + 1, width):
        near = left.filter(pa.array((own >= k) & (own < k + width)))
        for j in range(0, int(other.max(initial=-1)) + 1, block):
            yield _added(None, pa.concat_tables([near, right.filter(pa.array((other >= j) & (other < j + block)))]), numbers, products, n)


def _told(sums, fields):
    """The sums of all pairs, in batches; where a task has a share of the spans only, its sums are parts."""
    lines, rois, totals = sums
    if not lines or not rois:
        return
    own, offset, other = pa.array([r for r, _ in lines], pa.string()), pa.array([o for _, o in lines], pa.int32()), pa.array(list(rois), pa.string())
    step = max(1, ROWS // len(rois))
    for k in range(0, len(lines), step):
        n = min(step, len(lines) - k)
        at = pa.array(np.repeat(np.arange(k, k + n), len(rois)))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([other] * n), own.take(at), offset.take(at), *[pa.array(m[k : k + n].ravel()) for m in totals]], [f for f, _ in fields])


def _products(where, numbers: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums and numbers of samples, infinite ones among them."""
    line, at, shape = where
    e = np.zeros(shape)
    e[line, at] = numbers["n"]
    total = e @ np.where(np.isfinite(x), x, 0)
    if np.isinf(x).any():
        total = total + np.where(e @ (x == np.inf) > 0, np.inf, 0) + np.where(e @ (x == -np.inf) > 0, -np.inf, 0)
    return total, e @ ~np.isnan(x)


def _few(rows: DataFrame, most: int = MOST_BROADCAST) -> bool:
    return rows.limit(most + 1).count() <= most


def band_pairs(a: DataFrame, b: DataFrame, n_pre: int, n_post: int) -> DataFrame:
    """roi_id, event_idx, frame, other: pairs with -n_pre <= other - frame <= n_post.

    Frames are cut into bins as wide as the band, so each event of a meets at most two bins of
    b and the join is on (roi_id, bin).
    """
    width = n_pre + n_post + 1
    bin_of = lambda c: F.floor(c / width)
    left = a.select("roi_id", "event_idx", "frame", F.explode(F.sequence(bin_of(F.col("frame") - n_pre), bin_of(F.col("frame") + n_post))).alias("_bin"))
    right = b.select(F.col("roi_id").alias("_r"), F.col("frame").alias("other"), bin_of(F.col("frame")).alias("_b"))
    near = (F.col("other") - F.col("frame")).between(-n_pre, n_post)
    return left.join(right, (left["roi_id"] == right["_r"]) & (left["_bin"] == right["_b"]) & near).select("roi_id", "event_idx", "frame", "other")


def neighbor_events(a: DataFrame, b: DataFrame, n_pre: int, n_post: int, max_n: int | None = None) -> DataFrame:
    """roi_id, event_idx, frame, neighbors: frames of b in the band around each event of a, in order; an empty list for none.

    max_n keeps the nearest, the earlier one of two at the same distance.
    """
    pairs = band_pairs(a, b, n_pre, n_post)
    if max_n is not None:
        rank = Window.partitionBy("roi_id", "event_idx").orderBy(F.abs(F.col("other") - F.col("frame")), "other")
        pairs = pairs.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= max_n)
    lists = pairs.groupBy("roi_id", "event_idx").agg(F.array_sort(F.collect_list("other")).alias("neighbors"))
    return a.join(lists, ["roi_id", "event_idx"], "left").select("roi_id", "event_idx", "frame", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def nearest_event(a: DataFrame, b: DataFrame, n_pre: int, n_post: int) -> DataFrame:
    """roi_id, event_idx, frame, nearest: the closest frame of b in the band, NULL for none, the earlier of two as close."""
    pairs = band_pairs(a, b, n_pre, n_post)
    found = pairs.groupBy("roi_id", "event_idx").agg(F.min_by("other", F.struct(F.abs(F.col("other") - F.col("frame")), "other")).alias("nearest"))
    return a.join(found, ["roi_id", "event_idx"], "left").select("roi_id", "event_idx", "frame", "nearest")


def count_neighbors(events: DataFrame, n: int) -> DataFrame:
    """events with n_neighbors: others of the same roi within n frames. One shuffle, by blocks of frames, and no join."""
    near = Window.partitionBy("roi_id", "block").orderBy("frame").rangeBetween(-n, n)
    counted = with_halo(events, n, block_of(n, 8192)).withColumn("n_neighbors", F.count(F.lit(1)).over(near) - 1)
    return counted.where("own").drop("block", "own")


def hopping_counts(events: DataFrame, rois: DataFrame, hop: int, window: int, max_frame: int | None = None, least: int = 0) -> DataFrame:
    """roi_id, anchor, n: events within ceil(window / 2) frames of each anchor 0, hop, 2 hop, ... below max_frame, both ends closed.

    Without max_frame, rois has the frames of the traces: the anchors of each roi go on until
    they cover its last frame, and are those below least at any rate.
    """
    half = math.ceil(window / 2)
    low = F.greatest(F.ceil((F.col("frame") - half) / hop), F.lit(0))
    high = F.floor((F.col("frame") + half) / hop)
    hits = events.select("roi_id", F.explode(F.when(low <= high, F.sequence(low, high))).alias("k")).groupBy("roi_id", "k").agg(F.count(F.lit(1)).alias("n"))
    end = F.greatest(F.max("frame") + hop, F.lit(least)) if max_frame is None else F.lit(max_frame)
    spine = rois.groupBy("roi_id").agg(F.floor((end - 1) / hop).alias("last")).select("roi_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("k"))
    return spine.join(hits, ["roi_id", "k"], "left").select("roi_id", (F.col("k") * hop).alias("anchor"), F.coalesce("n", F.lit(0)).alias("n"))


def embed_events(events: DataFrame, value: Column, n_frames: DataFrame) -> DataFrame:
    """roi_id, frame, value over all frames of n_frames (roi_id, n): the value of an event at its frame, of the last where several share it, else NULL."""
    spine = n_frames.select("roi_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("frame"))
    at = events.groupBy("roi_id", "frame").agg(F.max_by(value, "event_idx").alias("value"))
    return spine.join(at, ["roi_id", "frame"], "left")


def match_labels(events: DataFrame, roots: DataFrame, labels: DataFrame, n_pre: int, n_post: int, default: str = "BS") -> DataFrame:
    """events matched to the nearest event of their root roi, with its label; events without a match are dropped.

    roots has (roi_id, root); labels has (roi_id, frame, event_idx, label) of root events, of which the first at a frame counts.
    """
    named = events.join(roots, "roi_id").select(F.col("roi_id").alias("own"), "event_idx", "frame", F.col("root").alias("roi_id"))
    keyed = named.select("own", "roi_id", "frame", F.struct("own", "event_idx").alias("event_idx"))
    pairs = band_pairs(keyed, labels.select("roi_id", "frame"), n_pre, n_post)
    best = pairs.groupBy("roi_id", "event_idx", "frame").agg(F.min_by("other", F.struct(F.abs(F.col("other") - F.col("frame")), "other")).alias("root_frame"))
    first = labels.groupBy(F.col("roi_id").alias("_r"), F.col("frame").alias("_f")).agg(F.min_by("label", "event_idx").alias("label"))
    return best.join(first, (best["roi_id"] == first["_r"]) & (best["root_frame"] == first["_f"]), "left").select(
        F.col("event_idx.own").alias("roi_id"), F.col("event_idx.event_idx").alias("event_idx"), "frame", "root_frame", F.coalesce("label", F.lit(default)).alias("label")
    )


def against_reference(windows: DataFrame, reference: str) -> DataFrame:
    """roi_id (of the event), event_idx, offset, trace_roi, value, reference: every cell of cross_windows beside that of one reference trace at the same event."""
    other = windows.where(F.col("trace_roi") == reference).select("roi_id", "event_idx", "offset", F.col("value").alias("reference"))
    return windows.join(other, ["roi_id", "event_idx", "offset"])


def beside_reference(traces: DataFrame, events: DataFrame, n_pre: int, n_post: int, reference: str, block: int = 512, event_block: int = 4096, rows: int = 1 << 21) -> DataFrame:
    """The rows of against_reference(cross_windows(...)) for all traces: none for events without a roi, none at all where there is no reference trace.

    Rois are dealt into blocks of about block where they have traces, of about event_block where they have events: at any one
    frame few rois have one. The reference is looked up once for each frame that a block of events asks for, and only such frames
    meet all traces. Then blocks of events meet blocks of traces frame by frame, so a frame that most events ask for is many keys.
    The tasks of that join are as many as its result needs, about rows in each (20,000 tasks at most), since what it reads says
    nothing about what it makes; the result is not shuffled.
    """
    events = events.where("roi_id IS NOT NULL")
    n_events, event_rois = events.agg(F.count("*"), F.count_distinct("roi_id")).first()
    n_traces, there = traces.agg(F.count_distinct("roi_id"), F.count_if(F.col("roi_id") == reference)).first()
    event_blocks, trace_blocks = max(1, math.ceil(event_rois / event_block)), max(1, math.ceil(n_traces / block))
    tasks = min(max(1, math.ceil(n_events * (n_pre + n_post + 1) * n_traces / rows)), 20_000)
    of = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    near = events.select("roi_id", "event_idx", "frame", of("roi_id", event_blocks).alias("_a"), F.explode(F.sequence(F.lit(-n_pre), F.lit(n_post))).alias("offset")).withColumn("_at", F.col("frame") + F.col("offset"))
    one = traces.where(F.col("roi_id") == reference).select(F.col("frame").alias("_at"), F.col("value").alias("reference"))
    asked = near.select("_at", "_a").distinct().join(one, "_at", "left").repartition(tasks, "_at", "_a")
    rois = traces.select(F.col("roi_id").alias("trace_roi")).distinct().where(F.lit(there > 0))
    samples = traces.select(F.col("roi_id").alias("trace_roi"), F.col("frame").alias("_at"), "value")
    grid = asked.join(F.broadcast(rois) if n_traces <= MOST_BROADCAST else rois, how="cross").join(samples, ["trace_roi", "_at"], "left").withColumn("_b", of("trace_roi", trace_blocks))
    dealt = near.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(trace_blocks - 1))))
    keys = ["_at", "_a", "_b"]
    return dealt.repartition(tasks, *keys).join(grid.repartition(tasks, *keys), keys).select("roi_id", "event_idx", "offset", "trace_roi", "value", "reference")


def trailing_mean(points: DataFrame, seconds: int, least: int) -> DataFrame:
    """points (roi_id, ts, value) with mean over the trailing time, its start left out; NULL with fewer than least points."""
    micros = F.unix_micros("ts")
    own = points.withColumn("_us", micros)
    at = Window.partitionBy("roi_id").orderBy("_us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return own.withColumn("mean", F.when(F.count("value").over(at) >= least, F.avg("value").over(at))).drop("_us")
