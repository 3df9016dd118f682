"""Hard negatives: for an anchor and one of its nearest rows of the same label, near rows of another label.

Segment summary filtering:

1. A vector is cut into 1, 4 and 16 segments, and every segment stores its mean and its deviation (the
   norm of what is left without the mean), both for the segment's length. An inner product is then the
   sum over segments of the means' product, give or take at most the deviations' product.
2. Rows are stored in packs of one label, up to PACK rows, with their summaries. Packs are dealt into
   chunks and anchors, the stated query set, into groups; a group meets each chunk in one task, which
   streams the packs of the chunk past the anchors. So memory is a group and a pack.
3. In a task, bounds of one segment are made for all anchors and rows of a pack; anchors and rows with no
   pair left are dropped before the bounds of 4 and 16 segments, and what is left is scored exactly. A
   pair is left while its upper bound reaches what the anchor's list still needs (its last score so
   far, or the lower end of its bands) and its lower bound the upper end of the bands.
4. First for the positives, whose lists are merged over chunks, then for the negatives in the bands that the positives set.

Scores are inner products of integers, exact: in floats while they fit, else in 64-bit integers.
A product that could exceed 64 bits is an error.

Defined results: rows with a null vec_id, label or vector, with an empty vector, or with a component that is null or not
finite take no part. Of rows with one vec_id the first by label and vector stands for all. Vectors of
different length do not meet. Ties go to the smaller vec_id. Vectors of any length are scored whole. A
positive of negative score has no band, one of score 0 the band 0 to 0. An empty table gives no rows.
Columns beside vec_id, embedding and label are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import written

SEGMENTS = (1, 4, 16)
PACK = 256
GROUP = 16384  # anchors
CHUNK = 65536  # rows
CHUNKS = (16, 256)
#: Anchors that meet a pack at once, and candidates held before a list is cut to its length.
SIDE, HELD = 1024, 500_000
PACKED = "chunk int, dim int, label bigint, ids binary, codes binary, summary binary"
EXACT = 2**53


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, q: of rows that take part, components as integers and one row for a vec_id."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.select("vec_id", "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)))
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    q = F.transform(x, lambda c: F.floor(256 * c.cast("double")))
    first = kept.groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min(F.struct(label.alias("label"), q.alias("q"))).alias("x"))
    return first.select("vec_id", "x.label", "x.q")


def summary_of(q: np.ndarray) -> np.ndarray:
    """Per row and number of segments: the segments' means, then their deviations, both scaled so that products need no length."""
    out, values = [], q.astype(float)
    for n in SEGMENTS:
        edges = np.linspace(0, q.shape[1], n + 1).astype(int)
        cut = [values[:, a:b] for a, b in zip(edges, edges[1:], strict=False)]
        means = [c.mean(axis=1) if c.shape[1] else np.zeros(len(c)) for c in cut]
        out += [m * math.sqrt(c.shape[1]) for m, c in zip(means, cut, strict=True)]
        out += [np.sqrt(((c - m[:, None]) ** 2).sum(axis=1)) for m, c in zip(means, cut, strict=True)]
    return np.stack(out, axis=1)


def bounds(a: np.ndarray, b: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest products of the vectors behind two sets of summaries."""
    at = 2 * sum(SEGMENTS[:level])
    n = SEGMENTS[level]
    middle = a[:, at : at + n] @ b[:, at : at + n].T
    reach = a[:, at + n : at + 2 * n] @ b[:, at + n : at + 2 * n].T
    # What rounding may have taken from either: far more than the last places of the sums.
    slack = 1e-9 * (np.linalg.norm(a[:, :2], axis=1)[:, None] * np.linalg.norm(b[:, :2], axis=1)[None, :]) + 1e-6
    return middle - reach - slack, middle + reach + slack


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    size = lambda x: max(abs(int(x.max())), abs(int(x.min())), 1)
    most = size(a) * size(b) * a.shape[1]
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    return a @ b.T


def packs_of(rows: DataFrame, chunks: int) -> DataFrame:
    """Rows of one dim and label, up to PACK of them, with summaries; packs are dealt into chunks in turn."""

    def run(batches):
        turn = TaskContext.get().partitionId()
        for batch in batches:
            labels, lists = batch.column(1).to_numpy(), batch.column(2)
            dims = lists.value_lengths().to_numpy()
            starts = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            ids = batch.column(0).to_numpy()
            order = np.lexsort((labels, dims))
            new = np.flatnonzero(np.diff(dims[order], prepend=-1).astype(bool) | np.diff(labels[order], prepend=labels[order[:1]] - 1).astype(bool))
            made = []
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True):
                for c in range(a, b, PACK):
                    own = order[c : min(c + PACK, b)]
                    dim = int(dims[own[0]])
                    q = flat[starts[own][:, None] + np.arange(dim)]
                    made.append((turn % chunks, dim, int(labels[own[0]]), ids[own].tobytes(), q.tobytes(), summary_of(q).tobytes()))
                    turn += 1
            if made:
                columns = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["chunk", "dim", "label", "ids", "codes", "summary"])

    return rows.select("vec_id", "label", "q").mapInArrow(run, PACKED)


@dataclass
class Lists:
    """The first ``k`` rows, by score and then id, of each of n lists, as candidates come in."""

    n: int
    k: int
    held: list = field(default_factory=list)
    count: int = 0

    def __post_init__(self):
        self.last = np.full(self.n, np.iinfo(np.int64).min)  # the score of the k-th row so far

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((owner, score, ids))
        self.count += len(owner)
        if self.count > HELD:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        owner, score, ids = (np.concatenate(x) for x in zip((none, none, none), *self.held, strict=True))
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        full = rank == self.k - 1
        self.last[owner[full]] = score[full]
        keep = rank < self.k
        self.held = [(owner[keep], score[keep], ids[keep])]
        self.count = int(keep.sum())
        return self.held[0]


def left_after_bounds(a: np.ndarray, b: np.ndarray, need: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors (of summaries a) and rows (of b) still have a pair between need and most of the anchor."""
    left, right = np.arange(len(a)), np.arange(len(b))
    for level in range(len(SEGMENTS)):
        low, high = bounds(a[left], b[right], level)
        alive = (high >= need[left, None]) & (low <= most[left, None])
        left, right = left[alive.any(axis=1)], right[alive.any(axis=0)]
        if not len(left):
            break
    return left, right


class Anchors:
    """A group of anchors of one dim, and what a chunk's packs have for them."""

    def __init__(self, rows: list[dict], k: int):
        self.ids = np.array([r["anchor_id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.codes = np.stack([np.frombuffer(r["codes"], np.int64) for r in rows])
        self.summary = np.stack([np.frombuffer(r["summary"]) for r in rows])
        self.bands = [r["positives"] for r in rows]  # of negatives only
        self.k, self.positives = k, max((len(p or ()) for p in self.bands), default=0)
        self.lists = Lists(len(rows) * max(self.positives, 1), k)
        if self.positives:
            # Scores n with 30 p <= 100 n <= 90 p; a missing positive has an empty band.
            low, high = np.full((len(rows), self.positives), np.iinfo(np.int64).max), np.full((len(rows), self.positives), np.iinfo(np.int64).min)
            for i, own in enumerate(self.bands):
                for j, p in enumerate(own):
                    if p["score"] >= 0:
                        low[i, j], high[i, j] = -(-30 * p["score"] // 100), 90 * p["score"] // 100
            self.low, self.high = low, high

    def meet(self, pack: dict) -> None:
        ids, b = np.frombuffer(pack["ids"], np.int64), np.frombuffer(pack["codes"], np.int64).reshape(-1, self.codes.shape[1])
        summary = np.frombuffer(pack["summary"]).reshape(len(ids), -1)
        mine = np.flatnonzero((self.labels != pack["label"]) if self.positives else (self.labels == pack["label"]))
        for a in range(0, len(mine), SIDE):
            (self._negatives if self.positives else self._positives)(mine[a : a + SIDE], ids, b, summary)

    def _positives(self, own, ids, b, summary):
        need = self.lists.last[own]
        left, right = left_after_bounds(self.summary[own], summary, need, np.full(len(own), np.inf))
        if not len(left):
            return
        own, ids = own[left], ids[right]
        scores = products(self.codes[own], b[right])
        i, j = np.nonzero((scores >= need[left, None]) & (self.ids[own][:, None] != ids[None, :]))
        self.lists.add(own[i], scores[i, j], ids[j])

    def _negatives(self, own, ids, b, summary):
        last = self.lists.last.reshape(-1, self.positives)[own]
        low, high = np.maximum(self.low[own], last), self.high[own]
        open_ = low <= high
        need, most = np.where(open_, low, np.iinfo(np.int64).max).min(axis=1), np.where(open_, high, np.iinfo(np.int64).min).max(axis=1)
        left, right = left_after_bounds(self.summary[own], summary, need, most)
        if not len(left):
            return
        ids = ids[right]
        scores = products(self.codes[own[left]], b[right])
        for p in range(self.positives):
            i, j = np.nonzero((scores >= low[left, p, None]) & (scores <= high[left, p, None]))
            self.lists.add(own[left][i] * self.positives + p, scores[i, j], ids[j])

    def found(self) -> pa.RecordBatch:
        owner, score, ids = self.lists.cut()
        n = max(self.positives, 1)
        told = [self.ids[owner // n]]
        if self.positives:
            positive = np.array([(p["id"], p["score"]) for own in self.bands for p in [*own, *[{"id": 0, "score": 0}] * (n - len(own))]], np.int64).reshape(-1, 2)
            told += [positive[owner, 0], positive[owner, 1]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*told, ids, score)], [*(("anchor_id", "positive_id", "positive_score") if self.positives else ("anchor_id",)), "id", "score"])


def candidates(anchors: DataFrame, packs: DataFrame, chunks: int, k: int, negatives: bool) -> DataFrame:
    """The first k rows that a chunk has for each list of an anchor: (anchor_id, id, score), for negatives with positive_id, positive_score."""
    groups = max(1, math.ceil(anchors.count() / GROUP))
    positives = F.col("positives") if negatives else F.lit(None).cast("array<struct<score:bigint,id:bigint>>").alias("positives")
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    fields = ["group", "chunk", "kind", "dim", "label", "anchor_id", "ids", "codes", "summary", "positives"]
    asking = anchors.select(F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int").alias("group"), each(chunks, "chunk"), F.lit(0).alias("kind"), "dim", "label", "anchor_id", nothing("binary", "ids"), "codes", "summary", positives)
    asked = packs.select(each(groups, "group"), "chunk", F.lit(1).alias("kind"), "dim", "label", nothing("bigint", "anchor_id"), "ids", "codes", "summary", nothing("array<struct<score:bigint,id:bigint>>", "positives"))
    met = asking.select(fields).union(asked.select(fields)).repartition("group", "chunk").sortWithinPartitions("group", "chunk", "kind")

    def run(batches):
        at, waiting, by_dim = None, {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                if (key := (row["group"], row["chunk"])) != at:
                    yield from (a.found() for a in by_dim.values())
                    at, waiting, by_dim = key, {}, {}
                if row["kind"] == 0:
                    waiting.setdefault(row["dim"], []).append(row)
                    continue
                if waiting:
                    by_dim, waiting = {dim: Anchors(rows, k) for dim, rows in waiting.items()}, {}
                if row["dim"] in by_dim:
                    by_dim[row["dim"]].meet(row)
        yield from (a.found() for a in by_dim.values())

    names = ["anchor_id", "positive_id", "positive_score", "id", "score"] if negatives else ["anchor_id", "id", "score"]
    return met.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def first(rows: DataFrame, lists: list[str], k: int) -> DataFrame:
    """The first k rows of each list, with ``rank`` from 1."""
    order = Window.partitionBy(*lists).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def unpacked(packs: DataFrame, every: int) -> DataFrame:
    """The rows of packs whose id is divisible by every: anchor_id, dim, label, codes, summary."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                own = np.flatnonzero(ids % every == 0)
                if len(own):
                    codes, summary = (np.frombuffer(row[c], kind).reshape(len(ids), -1)[own] for c, kind in (("codes", np.int64), ("summary", float)))
                    columns = [pa.array(ids[own]), pa.array([row["dim"]] * len(own), pa.int32()), pa.array([row["label"]] * len(own), pa.int64()), *[pa.array([x.tobytes() for x in c], pa.binary()) for c in (codes, summary)]]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "dim", "label", "codes", "summary"])

    return packs.mapInArrow(run, "anchor_id bigint, dim int, label bigint, codes binary, summary binary")


def hard_negatives(rows: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by every.
    """
    vectors = whole_vectors(rows)
    total = rows.count()
    chunks = min(max(math.ceil(total / chunk), CHUNKS[0]), CHUNKS[1])
    packs = written(packs_of(vectors, chunks), "packs")
    anchors = written(unpacked(packs, every), "anchors")
    near = first(candidates(anchors, packs, chunks, n_positives, negatives=False), ["anchor_id"], n_positives)
    listed = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("score", "id")), asc=False).alias("positives"))
    asking = written(anchors.join(listed, "anchor_id"), "asking")
    far = first(candidates(asking, packs, chunks, n_negatives, negatives=True), ["anchor_id", "positive_id"], n_negatives)
    return far.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
