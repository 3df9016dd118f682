"""Selection of traces, events and regions by id, position or mask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.quantiles import quantiles

RANGE = 100_000


def select_rois(rows: DataFrame, ids: list[str]) -> DataFrame:
    """rows of the rois asked for, with ord, their place in the list. The ids come as literals, so a plain filter is pushed to the scan."""
    places = F.create_map(*[x for k, i in enumerate(ids) for x in (F.lit(i), F.lit(k))])
    return rows.where(F.col("roi_id").isin(ids)).withColumn("ord", places[F.col("roi_id")])


def resolve_ids(rois: DataFrame, wanted: list[str]) -> DataFrame:
    """wanted, roi_id, roi_ord: by roi_id first, then by id_short; an id that is neither is a ValueError."""
    spark: SparkSession = rois.sparkSession
    asked = spark.createDataFrame([(k, w) for k, w in enumerate(wanted)], "k int, wanted string")
    by_id = asked.join(rois, asked["wanted"] == rois["roi_id"]).select("k", "wanted", "roi_id", "roi_ord")
    rest = asked.join(by_id, "k", "left_anti")
    by_short = rest.join(rois, rest["wanted"] == rois["id_short"]).select("k", "wanted", "roi_id", "roi_ord")
    found = by_id.union(by_short)
    missing = [r.wanted for r in asked.join(found, "k", "left_anti").collect()]  # of the list given
    if missing:
        raise ValueError(f"no such region: {', '.join(missing)}")
    return found.orderBy("k").drop("k")


def select_events_by_index(packed: DataFrame, picks: DataFrame) -> DataFrame:
    """roi_id, frames: those at the positions picks (roi_id, index); negative ones count from the end, others beyond are NULL."""
    size = F.size("frames")
    at = F.transform("index", lambda i: F.get("frames", F.when(i < 0, size + i).otherwise(i)))
    return packed.join(picks, "roi_id").select("roi_id", at.alias("frames"))


def select_events_by_mask(packed: DataFrame, masks: DataFrame) -> DataFrame:
    """roi_id, frames: those where masks (roi_id, mask) is true. A mask of another length raises."""
    same = F.when(F.size("frames") == F.size("mask"), F.arrays_zip("frames", "mask")).otherwise(F.raise_error(F.lit("a mask differs in length from its events")))
    return packed.join(masks, "roi_id").select("roi_id", F.transform(F.filter(same, lambda x: x["mask"]), lambda x: x["frames"]).alias("frames"))


def spiking(rois: DataFrame, events: DataFrame) -> DataFrame:
    """rois that have an event."""
    return rois.join(events.select("roi_id").distinct(), "roi_id", "left_semi")


def silent(rois: DataFrame, events: DataFrame) -> DataFrame:
    """rois that have none."""
    return rois.join(events.select("roi_id").distinct(), "roi_id", "left_anti")


def ordered_union(parts: list[DataFrame]) -> DataFrame:
    """roi_id, ord: ids of all parts (roi_id, ord) in the order in which they first appear.

    Places are cut into ranges; ids are numbered within a range, and the counts of the ranges before it are added.
    """
    numbered = [p.select("roi_id", F.struct(F.lit(k).alias("part"), F.col("ord").cast("bigint").alias("at")).alias("first")) for k, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p)
    first = out.groupBy("roi_id").agg(F.min("first").alias("first")).withColumn("range", F.struct("first.part", F.expr(f"first.at div {RANGE}").alias("no")))
    counts = first.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # one row for RANGE ids
    own = F.row_number().over(Window.partitionBy("range").orderBy("first")) - 1
    return first.withColumn("own", own).join(before, "range").select("roi_id", (F.col("own") + F.col("before")).cast("bigint").alias("ord"))


def top_share(image: DataFrame, percentile: float) -> DataFrame:
    """row, col of pixels at or above a percentile of the image (linear between values)."""
    cut = quantiles(image, "value", [percentile / 100])[0]
    return image.where(F.col("value") >= F.lit(cut)).select("row", "col")


def event_attributes(events: DataFrame, values: DataFrame) -> DataFrame:
    """events with the value at their frame, NULL where there is none."""
    return events.join(values, ["roi_id", "frame"], "left")
