"""Adaptive growth and watershed against plain versions on made images."""

import heapq
from collections import defaultdict

import numpy as np
import pytest

from tracelake.operators import growth as W

SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def plain_growth(seeds, codes, share, most):
    """Round by round; seeds: {pixel: weight}, codes: {pixel: vector}."""
    own = {p for p in seeds if p in codes}
    w = np.array([seeds[p] for p in own])
    code = (w[:, None] * np.array([codes[p] for p in own])).sum(axis=0) / (w.sum() + 1e-10)
    while len(own) < most:
        rim = {(r + a, c + b) for r, c in own for a, b in SIDES} - own
        rim = [p for p in rim if p in codes]
        if not rim:
            break
        p = {q: codes[q] @ code for q in rim}
        least = max(0, max(p.values()) * share)
        new = {q for q in rim if p[q] > least}
        if not new:
            break
        own |= new
        code = np.array([codes[q] for q in own]).sum(axis=0) / (len(own) + 1e-10)
    w = {q: max(0.0, codes[q] @ code) for q in own}
    length = np.sqrt(sum(x * x for x in w.values()) + 1e-10)
    return {q: x / length for q, x in w.items()}


@pytest.mark.parametrize(("share", "most"), [(0.2, 10_000), (0.8, 10_000), (0.2, 40)])
def test_adaptive_growth(spark, share, most):
    r = np.random.default_rng(1)
    y, x = np.mgrid[:18, :22]
    blobs = [np.exp(-((y - a) ** 2 + (x - b) ** 2) / 8) for a, b in ((5, 6), (12, 15))]
    codes = {(i, j): np.array([blobs[0][i, j], blobs[1][i, j], 0.05 * r.normal()]) for i in range(18) for j in range(22) if (i, j) != (5, 8)}
    seeds = {"a": {(5, 6): 1.0, (5, 7): 0.5}, "b": {(12, 15): 2.0}, "lost": {(5, 8): 1.0}, "dark": {(0, 21): 1.0}}
    long = spark.createDataFrame([(i, j, v.tolist()) for (i, j), v in codes.items()], "row int, col int, v array<double>")
    begun = spark.createDataFrame([(roi, i, j, w) for roi, own in seeds.items() for (i, j), w in own.items()], "roi_id string, row int, col int, weight double")
    got = defaultdict(dict)
    for q in W.adaptive(begun, long, 3, share, most, tile=4).collect():
        got[q.roi_id][q.row, q.col] = q.weight
    assert set(got) == {"a", "b", "dark"}
    for roi, found in got.items():
        want = plain_growth(seeds[roi], codes, share, most)
        assert set(found) == set(want), roi
        assert max(abs(found[q] - want[q]) for q in want) < 1e-9
    assert len(got["a"]) > 10


def plain_watershed(elevation, markers):
    """Costs by a heap over all pixels, then the least label along least-cost steps."""
    cost = {p: 0 for p in markers if p in elevation}
    heap = [(0, p) for p in cost]
    heapq.heapify(heap)
    step = lambda p, q: max(cost[p], abs(elevation[p] - elevation[q]))
    beside = lambda p: [q for q in ((p[0] + a, p[1] + b) for a, b in SIDES) if q in elevation]
    while heap:
        c, p = heapq.heappop(heap)
        if c > cost[p]:
            continue
        for q in beside(p):
            if q not in cost or step(p, q) < cost[q]:
                cost[q] = step(p, q)
                heapq.heappush(heap, (cost[q], q))
    label = {p: markers[p] for p in markers if p in elevation}
    heap = [(x, p) for p, x in label.items()]
    heapq.heapify(heap)
    while heap:
        x, p = heapq.heappop(heap)
        if x > label[p]:
            continue
        for q in beside(p):
            if q not in markers and step(p, q) == cost[q] and x < label.get(q, 1 << 60):
                label[q] = x
                heapq.heappush(heap, (x, q))
    return {p: (label.get(p), cost.get(p)) for p in elevation}


def pictures():
    r = np.random.default_rng(2)
    y, x = np.mgrid[:23, :31]
    smooth = (120 + 100 * np.sin(x / 4) * np.cos(y / 3)).astype(int)
    noise = r.integers(0, 256, (23, 31))
    out = {}
    for name, image, marks in (("smooth", smooth, 6), ("noise", noise, 9), ("flat", smooth * 0 + 7, 3), ("steps", smooth // 40, 5)):
        pixels = {(i, j): int(image[i, j]) for i in range(23) for j in range(31)}
        out[name] = (pixels, {(int(r.integers(23)), int(r.integers(31))): int(k) for k in r.permutation(marks) + 1})
    # A wall with a gap, and a part that no marker reaches.
    walled = {p: e for p, e in out["noise"][0].items() if p[1] != 12 or p[0] == 3}
    walled = {p: e for p, e in walled.items() if p not in {(20, 28), (20, 27), (20, 29), (20, 30), (21, 27), (22, 27)}}
    out["walled"] = (walled, {(0, 0): 4, (5, 20): 2})
    out["unmarked"] = ({(0, 0): 1, (0, 1): 2}, {})
    return out


@pytest.mark.parametrize("tile", [9, 64])
def test_watershed(spark, tile):
    made = pictures()
    image = spark.createDataFrame([(n, i, j, e) for n, (pixels, _) in made.items() for (i, j), e in pixels.items()], "picture string, row int, col int, elevation int")
    marks = spark.createDataFrame([(n, i, j, x) for n, (_, own) in made.items() for (i, j), x in own.items()], "picture string, row int, col int, label int")
    got = defaultdict(dict)
    for q in W.watershed(image, marks, tile).collect():
        got[q.picture][q.row, q.col] = (q.label, q.cost)
    for name, (pixels, own) in made.items():
        assert got[name] == plain_watershed(pixels, own), name


def test_regions_extend_to_their_rim(spark):
    y, x = np.mgrid[:40, :40]
    image = 0.2 + 0.5 * ((y - 20) ** 2 + (x - 18) ** 2 < 49)
    pixels = spark.createDataFrame([(i, j, float(image[i, j])) for i in range(40) for j in range(40)], "row int, col int, value double")
    seeds = spark.createDataFrame([("in", 20, 18), ("in", 20, 19), ("out", 2, 2)], "roi_id string, row int, col int")
    got = defaultdict(set)
    for q in W.extend_by_watershed(seeds, pixels, 12, 40, 40, tile=16).collect():
        got[q.roi_id].add((q.row, q.col))
    assert got["in"] == {(i, j) for i in range(40) for j in range(40) if image[i, j] > 0.5}
    assert (2, 2) in got["out"]
