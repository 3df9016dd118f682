"""Joins whose keys may be very frequent, and connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.sources.tables import written

#: A key is heavy when more than one row in this many carries it, so heavy keys are fewer than this.
HEAVY_SHARE = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right, whose keys are unique; a key that many rows of left carry is not shuffled to one task.

    Column ``rows`` of right says how many rows of left (of ``total``) carry the key. Keys of more
    than total / HEAVY_SHARE rows are fewer than HEAVY_SHARE, so they are broadcast; all others are
    joined as usual. left is read twice and should be a written table.
    """
    most = max(total // HEAVY_SHARE, 1)
    heavy = right.where(F.col(rows) > most).drop(rows)
    light = right.where(F.col(rows) <= most).drop(rows)
    broadcast = left.join(F.broadcast(heavy), key)
    others = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return broadcast.select(*others.columns).unionByName(others)


def _starred(pairs: DataFrame, total: int) -> DataFrame:
    """pairs (a, b) with m, the least b of each a; an a with many partners is split over tasks."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return spread_join(pairs, least, "a", "n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _starred(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them."""
    found = _starred(edges, total)
    # (a, m) itself comes with the row whose b is m.
    return found.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of edges (a, b) with the least node of its component, by alternating star steps (Kiveris et al., 2014).

    The tables of each step are written to the shared folder. Only counts and
    sums of the edges reach the driver.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    total, state = edges.count(), None
    while True:
        edges = written(_small_star(written(_large_star(edges, total), "edges"), total), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        total, state = now[0], now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
