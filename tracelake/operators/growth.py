"""Regions that grow: by codes that follow the grown set, and by a watershed as a shortest-path forest.

Growth by codes is a group state of each region, which meets the tiles of codes around it. The watershed is solved in tiles of the image: a tile relaxes its own pixels, then tiles exchange their rims, until
nothing changes. So an image of any size is many tasks, and rounds are as many as paths cross tiles.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.blocks import grouped
from tracelake.operators.masks import CROSS
from tracelake.sources.tables import written

KEYS = ["roi_id", "row", "col"]


GROWN = "roi_id string, done boolean, row binary, col binary, weight binary, code binary"


def _rim(own: set, new: set) -> set:
    return {(r + a, c + b) for r, c in new for a, b in CROSS[1:]} - own


def _asked(own: set, rim: set, tile: int) -> set:
    """The tiles of a region and its rim, and those around them."""
    held = {(r // tile, c // tile) for r, c in own | rim}
    return {(r + a, c + b) for r, c in held for a in (-1, 0, 1) for b in (-1, 0, 1)}


def _grow(own: set, code: np.ndarray, codes: dict, there: set, tile: int, share: float, most: int) -> tuple[set, np.ndarray, bool]:
    """Rounds of growth as far as the tiles that are there reach: the set, its code, and whether it has stopped for good."""
    rim = _rim(own, own)
    while len(own) < most:
        if any((r // tile, c // tile) not in there for r, c in rim):
            return own, code, False
        near = [p for p in rim if p in codes]
        if not near:
            break
        p = np.array([codes[q] for q in near]) @ code
        new = {q for q, x in zip(near, p.tolist(), strict=True) if x > max(0.0, p.max() * share)}
        if not new:
            break
        own |= new
        code = np.sum([codes[q] for q in sorted(own)], axis=0) / (len(own) + 1e-10)
        rim = (rim - new) | _rim(own, new)
    return own, code, True


def adaptive(seeds: DataFrame, pixels: DataFrame, rank: int, share: float = 0.2, most: int = 10_000, tile: int = 32) -> DataFrame:
    """roi_id, row, col, weight: regions grown from seeds (roi_id, row, col, weight if there is one) over pixels (row, col, v).

    In each round of growth the pixels beside a region are projected onto its code, and those above ``share`` of the
    round's greatest projection (and above 0) join it; then the code is the mean of the grown set. The first code is
    weighted. A region stops when a round adds nothing or when it has ``most`` pixels. Weights are the projections
    onto the last code, 0 at least, at unit length.

    Codes are stored by tiles. A region meets the tiles around it in one task, which holds nothing else, and grows as far as they reach;
    regions that came to the edge of their tiles meet those around them in another pass. As a region has ``most`` pixels at
    most (and the last round's more), so has what a task holds a bound.
    """
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    cells = pixels.select(at("row").alias("tr"), at("col").alias("tc"), F.struct("row", "col", "v").alias("p")).groupBy("tr", "tc").agg(F.collect_list("p").alias("cell"))  # tile * tile pixels at most
    cells = written(cells, "cells")
    weight = F.col("weight").cast("double") if "weight" in seeds.columns else F.lit(1.0)
    own = seeds.select("roi_id", "row", "col", weight.alias("weight")).join(pixels.select("row", "col"), ["row", "col"], "left_semi").dropDuplicates(KEYS)
    names, kinds = [c.split()[0] for c in GROWN.split(", ")], [pa.string(), pa.bool_(), *[pa.binary()] * 4]

    def batch_of(roi, done, own, weights, code):
        r, c = (np.array([p[k] for p in own], np.int32).tobytes() for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((roi, done, r, c, np.array(weights, float).tobytes(), code.tobytes()), kinds, strict=True)], names)

    def begin(batches):
        for (roi,), group in grouped(batches, 1):
            own = list(zip(group["row"].to_pylist(), group["col"].to_pylist(), strict=True))
            yield batch_of(roi, False, own, group["weight"].to_pylist(), np.zeros(0))

    def pixels_of(raw_rows, raw_cols):
        return list(zip(np.frombuffer(raw_rows, np.int32).tolist(), np.frombuffer(raw_cols, np.int32).tolist(), strict=True))

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = set(pixels_of(row["row"], row["col"]))
                tiles = sorted(_asked(own, _rim(own, own), tile))
                yield pa.RecordBatch.from_arrays([pa.array([row["roi_id"]] * len(tiles), pa.string()), *[pa.array([t[k] for t in tiles], pa.int32()) for k in (0, 1)]], ["roi_id", "tr", "tc"])

    def go_on(batches):
        for (roi,), group in grouped(batches, 1):
            rows = group.to_pylist()
            mine = next((r for r in rows if r["row"] is not None), None)
            if mine is None:
                continue
            codes = {(p["row"], p["col"]): np.array(p["v"], float) for r in rows if r["cell"] is not None for p in r["cell"]}
            begun, weights, code = pixels_of(mine["row"], mine["col"]), np.frombuffer(mine["weight"]), np.frombuffer(mine["code"])
            own = set(begun)
            if not len(code):
                code = (weights[:, None] * np.array([codes[p] for p in begun])).sum(axis=0) / (weights.sum() + 1e-10)
            own, code, done = _grow(own, code, codes, _asked(own, _rim(own, own), tile), tile, share, most)
            drawn = sorted(own)
            w = np.maximum(np.array([codes[p] for p in drawn]) @ code, 0.0)
            yield batch_of(roi, done, drawn, w / np.sqrt((w**2).sum() + 1e-10), code)

    dealt = own.select("roi_id", "row", "col", "weight").repartition("roi_id").sortWithinPartitions("roi_id")
    state, finished = written(dealt.mapInArrow(begin, GROWN), "regions"), []
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    while not state.isEmpty():
        asked = state.select("roi_id", "row", "col").mapInArrow(ask, "roi_id string, tr int, tc int")
        told = asked.join(cells, ["tr", "tc"]).select("roi_id", *[nothing("binary", c) for c in names[2:]], "cell")
        mine = state.select("roi_id", *names[2:], nothing(cells.schema["cell"].dataType, "cell"))
        met = mine.union(told).repartition("roi_id").sortWithinPartitions("roi_id")
        grown = written(met.mapInArrow(go_on, GROWN), "regions")
        finished.append(grown.where("done"))
        state = grown.where("NOT done")

    def flat(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = pixels_of(row["row"], row["col"])
                yield pa.RecordBatch.from_arrays([pa.array([row["roi_id"]] * len(own), pa.string()), *[pa.array([p[k] for p in own], pa.int32()) for k in (0, 1)], pa.array(np.frombuffer(row["weight"]))], [*KEYS, "weight"])

    ends = functools.reduce(DataFrame.union, finished, state)
    return ends.mapInArrow(flat, "roi_id string, row int, col int, weight double")


FAR, NONE = np.iinfo(np.int64).max, np.iinfo(np.int64).max
TILE = "picture string, tr int, tc int, elevation binary, cost binary, label binary, fixed binary, changed boolean"
RIM = "picture string, tr int, tc int, side int, elevation binary, cost binary, label binary"


class Tile:
    """Pixels of a tile by (row, col): elevation (WALL where there is no pixel), cost of the best path to a marker, label."""

    WALL = np.iinfo(np.int64).min

    def __init__(self, elevation, cost, label, fixed):
        self.elevation, self.cost, self.label, self.fixed = elevation, cost, label, fixed
        self.size = len(elevation)

    def _neighbours(self, r: int, c: int):
        for dr, dc in CROSS[1:]:
            if 0 <= r + dr < self.size and 0 <= c + dc < self.size and self.elevation[r + dr, c + dc] != self.WALL:
                yield r + dr, c + dc

    def relax(self, by_label: bool, rims: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], first: bool) -> bool:
        """Takes in the rims of other tiles (all of its own pixels at first), and says whether anything changed."""
        heap = []
        field = self.label if by_label else self.cost
        if first:
            heap = [(int(field[r, c]), r, c) for r, c in np.argwhere(field < FAR).tolist()]
        for side, elevation, cost, label in rims:
            for k in range(self.size):
                r, c = ((0, k), (self.size - 1, k), (k, 0), (k, self.size - 1))[side]
                if elevation[k] != self.WALL and self.elevation[r, c] != self.WALL:
                    self._offer(heap, by_label, (int(elevation[k]), int(cost[k]), int(label[k])), r, c)
        changed = bool(heap) and not first
        heapq.heapify(heap)
        while heap:
            value, r, c = heapq.heappop(heap)
            if value != field[r, c]:
                continue
            told = (int(self.elevation[r, c]), int(self.cost[r, c]), int(self.label[r, c]))
            for q in self._neighbours(r, c):
                changed |= self._offer(heap, by_label, told, *q, push=True)
        return changed

    def _offer(self, heap, by_label, told, r, c, push=False) -> bool:
        elevation, cost, label = told
        if cost == FAR:
            return False
        reached = max(cost, abs(elevation - int(self.elevation[r, c])))
        if by_label:
            if self.fixed[r, c] or reached != self.cost[r, c] or label >= self.label[r, c]:
                return False
            self.label[r, c] = label
            found = (label, r, c)
        else:
            if reached >= self.cost[r, c]:
                return False
            self.cost[r, c] = reached
            found = (reached, r, c)
        heapq.heappush(heap, found) if push else heap.append(found)
        return True


def watershed(image: DataFrame, markers: DataFrame, tile: int = 128) -> DataFrame:
    """picture, row, col, label, cost: each pixel with the marker that it belongs to, by an image foresting transform.

    image: (picture, row, col, elevation: whole numbers); markers: (picture, row, col, label). A path over side neighbours
    costs its greatest step in elevation, a pixel belongs to a marker that it reaches at least cost. Ties: of all markers
    from which least-cost paths lead to a pixel, each of whose pixels is reached at its own least cost, the least label.
    Of several labels of one pixel the least counts. Pixels that are not in image are walls; pixels without a way to a marker have NULL.
    """
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    placed = image.select(F.col("picture").cast("string").alias("picture"), at("row").alias("tr"), at("col").alias("tc"), "row", "col", F.col("elevation").cast("bigint").alias("elevation"))
    named = markers.groupBy(F.col("picture").cast("string").alias("picture"), "row", "col").agg(F.min("label").cast("bigint").alias("label"))
    rows = placed.join(named, ["picture", "row", "col"], "left").select("picture", "tr", "tc", "row", "col", "elevation", "label").repartition("picture", "tr", "tc").sortWithinPartitions("picture", "tr", "tc")
    names = [c.split()[0] for c in TILE.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.bool_()]

    def row_of(key, t: Tile, changed: bool):
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*key, t.elevation.tobytes(), t.cost.tobytes(), t.label.tobytes(), t.fixed.tobytes(), changed), kinds, strict=True)], names)

    def build(batches):
        for key, group in grouped(batches, 3):
            r, c = group["row"].to_numpy() - key[1] * tile, group["col"].to_numpy() - key[2] * tile
            label = group["label"].fill_null(NONE).to_numpy()
            t = Tile(np.full((tile, tile), Tile.WALL), np.full((tile, tile), FAR), np.full((tile, tile), NONE), np.zeros((tile, tile), bool))
            t.elevation[r, c], t.label[r, c], t.fixed[r, c] = group["elevation"].to_numpy(), label, label != NONE
            t.cost[t.fixed] = 0
            yield row_of(key, t, True)

    def whole(group, k) -> Tile:
        told = [np.frombuffer(group[c][k].as_py(), kind).reshape(tile, tile).copy() for c, kind in (("elevation", np.int64), ("cost", np.int64), ("label", np.int64), ("fixed", bool))]
        return Tile(*told)

    def rims(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for k in range(table.num_rows):
                t, (picture, tr, tc) = whole(table, k), [table[c][k].as_py() for c in names[:3]]
                out = []
                # My last row is above the tile below (side 0), my first below the tile above, and so on.
                for (dr, dc), side, cut in (((1, 0), 0, np.s_[-1, :]), ((-1, 0), 1, np.s_[0, :]), ((0, 1), 2, np.s_[:, -1]), ((0, -1), 3, np.s_[:, 0])):
                    if (t.cost[cut] < FAR).any():
                        out.append((picture, tr + dr, tc + dc, side, *[np.ascontiguousarray(x[cut]).tobytes() for x in (t.elevation, t.cost, t.label)]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (*kinds[:3], pa.int32(), *[pa.binary()] * 3), strict=True)], [c.split()[0] for c in RIM.split(", ")])

    def solve(by_label: bool, first: bool):
        def run(batches):
            for key, group in grouped(batches, 3):
                sides = group["side"].to_pylist()
                if -1 not in sides:  # a rim beyond the image
                    continue
                t = whole(group, sides.index(-1))
                come = [(s, *[np.frombuffer(group[c][k].as_py(), np.int64) for c in ("elevation", "cost", "label")]) for k, s in enumerate(sides) if s >= 0]
                changed = t.relax(by_label, come, first) if first or come else False
                yield row_of(key, t, changed or first)

        return run

    state = written(rows.mapInArrow(build, TILE), "tiles")
    for by_label in (False, True):
        first = True
        while True:
            own = state.select(*names[:3], F.lit(-1).alias("side"), "elevation", "cost", "label", "fixed")
            met = own
            if not first:
                come = state.where("changed").mapInArrow(rims, RIM).withColumn("fixed", F.lit(None).cast("binary"))
                met = own.unionByName(come)
            ordered = met.repartition(*names[:3]).sortWithinPartitions(*names[:3])
            state = written(ordered.mapInArrow(solve(by_label, first), TILE), "tiles")
            if state.where("changed").isEmpty():
                break
            first = False

    def flat(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for k in range(table.num_rows):
                t, (picture, tr, tc) = whole(table, k), [table[c][k].as_py() for c in names[:3]]
                r, c = np.nonzero(t.elevation != Tile.WALL)
                label, cost = t.label[r, c], t.cost[r, c]
                columns = [pa.array([picture] * len(r), pa.string()), pa.array(r + tr * tile, pa.int32()), pa.array(c + tc * tile, pa.int32()), pa.array(label, pa.int64(), mask=label == NONE), pa.array(cost, pa.int64(), mask=cost == FAR)]
                yield pa.RecordBatch.from_arrays(columns, ["picture", "row", "col", "label", "cost"])

    return state.mapInArrow(flat, "picture string, row int, col int, label bigint, cost bigint")


def extend_by_watershed(regions: DataFrame, image: DataFrame, margin: int, height: int, width: int, tile: int = 128) -> DataFrame:
    """roi_id, row, col: regions (roi_id, row, col) extended in an image (row, col, value) within margin pixels of their bounds.

    The region is one marker and the edge of that box the other. Values are taken times 255, as 8-bit numbers.
    Elevation is turned over where the region's median is above the box's; that moves no border, as only differences count.
    """
    box = regions.groupBy("roi_id").agg(
        F.greatest(F.min("row") - margin, F.lit(0)).alias("r0"), F.least(F.max("row") + margin, F.lit(height - 1)).alias("r1"), F.greatest(F.min("col") - margin, F.lit(0)).alias("c0"), F.least(F.max("col") + margin, F.lit(width - 1)).alias("c1")
    )
    inside = box.select("*", F.explode(F.sequence("r0", "r1")).alias("row")).select("*", F.explode(F.sequence("c0", "c1")).alias("col"))
    edge = (F.col("row") == F.col("r0")) | (F.col("row") == F.col("r1")) | (F.col("col") == F.col("c0")) | (F.col("col") == F.col("c1"))
    crop = written(inside.select("roi_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), edge.alias("edge")).join(image.select("row", "col", "value"), ["row", "col"]), "crop")
    own = crop.join(regions.select(*KEYS).distinct().withColumn("own", F.lit(True)), KEYS, "left")
    medians = own.groupBy("roi_id").agg(F.median("value").alias("all"), F.median(F.when(F.col("own"), F.col("value"))).alias("mine"))
    turned = own.join(medians, "roi_id").withColumn("value", F.when(F.col("mine") > F.col("all"), -F.col("value")).otherwise(F.col("value")))
    whole = turned.select(F.col("roi_id").alias("picture"), "row", "col", F.pmod((F.col("value") * 255).cast("int"), F.lit(256)).alias("elevation"), "edge", "own")
    whole = written(whole, "elevation")
    marked = whole.where(F.col("edge") | F.col("own")).select("picture", "row", "col", F.when(F.col("edge"), 2).otherwise(1).alias("label"))
    return watershed(whole, marked, tile).where("label = 1").select(F.col("picture").alias("roi_id"), "row", "col")
