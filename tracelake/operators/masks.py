"""Image masks as pixel sets: morphology by joins with the neighbours, dark masks, region growth, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import arrays as A
from tracelake.operators.event_joins import nearest_event
from tracelake.operators.images import gaussian_image
from tracelake.operators.quantiles import quantiles
from tracelake.operators.statistics import peak_to_trough, rank_average
from tracelake.sources.tables import written

CROSS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))


def _moved(pixels: DataFrame, moves=CROSS) -> DataFrame:
    m = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in moves])
    return pixels.select("row", "col", F.explode(m).alias("m")).select((F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col"))


def _inside(height: int, width: int):
    return (F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)


def within_steps(pixels: DataFrame, steps: int, height: int, width: int) -> DataFrame:
    """The pixels (of each roi_id, if there is one) that side steps inside the image reach, a few steps at a time."""
    keys = [c for c in ("roi_id", "row", "col") if c in pixels.columns]
    out, left = pixels.select(*keys).distinct(), steps
    while left:
        now = min(left, 4)  # a ball of 4 steps has 41 pixels: few rounds, few copies
        ball = [(r, c) for r in range(-now, now + 1) for c in range(-now, now + 1) if abs(r) + abs(c) <= now]
        m = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ball])
        moved = out.select("*", F.explode(m).alias("m")).withColumns({"row": F.col("row") + F.col("m.r"), "col": F.col("col") + F.col("m.c")}).select(*keys)
        out, left = moved.where(_inside(height, width)).distinct(), left - now
    return out


def dilate(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """row, col: pixels of the set or beside one, inside the image."""
    return _moved(pixels).where(_inside(height, width)).distinct()


def erode(pixels: DataFrame) -> DataFrame:
    """row, col: pixels whose four neighbours are in the set too; the image's edge counts as outside. Each member gives one vote to each neighbour."""
    votes = _moved(pixels.select("row", "col").distinct()).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    return votes.where("n = 5").select("row", "col")


def opened(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return dilate(erode(pixels), height, width)


def closed(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return erode(dilate(pixels, height, width))


def square(size: int) -> tuple[tuple[int, int], ...]:
    """Moves to all pixels of a square of odd size around one."""
    half = size // 2
    return tuple((r, c) for r in range(-half, half + 1) for c in range(-half, half + 1))


def closed_square(pixels: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """row, col: a set dilated, then eroded, by a square of odd size; beyond the image nothing is in the set."""
    moves = square(size)
    grown = _moved(pixels, moves).where(_inside(height, width)).distinct()
    votes = _moved(grown, moves).groupBy("row", "col").agg(F.count("*").alias("n"))
    return votes.where(F.col("n") == len(moves)).select("row", "col")


def opened_steps(pixels: DataFrame, steps: int, height: int, width: int) -> DataFrame:
    """roi_id, row, col: each region eroded by so many side steps, then dilated by as many, inside the image."""
    ball = [(r, c) for r in range(-steps, steps + 1) for c in range(-steps, steps + 1) if abs(r) + abs(c) <= steps]
    m = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ball])
    moved = lambda d: d.select("roi_id", "row", "col", F.explode(m).alias("m")).select("roi_id", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col"))
    kept = moved(pixels.select("roi_id", "row", "col").distinct()).groupBy("roi_id", "row", "col").agg(F.count("*").alias("n")).where(F.col("n") == len(ball))
    return moved(kept).where(_inside(height, width)).distinct()


def dark_mask(image: DataFrame, regions: DataFrame, share: float, keep_off: int, height: int, width: int) -> DataFrame:
    """row, col: the darkest share of the image, at least keep_off + 1 side steps from any region, opened."""
    cut = quantiles(image, "value", [share])[0]
    dark = image.where(F.col("value") <= F.lit(cut)).select("row", "col")
    near = regions.select("row", "col").distinct()
    for _ in range(keep_off):
        near = dilate(near, height, width)
    return opened(dark.join(near, ["row", "col"], "left_anti"), height, width)


def local_rank(image: DataFrame, sigma: float, height: int, width: int) -> DataFrame:
    """row, col, value: each pixel's rank (ties sharing their mean) less the Gaussian mean of the ranks around it; the image is mirrored at its edges."""
    ranks = written(rank_average(image.select("row", "col", "value")).select("row", "col", F.col("rank").cast("double").alias("value")), "ranks")
    smooth = gaussian_image(ranks, sigma, height, width).select("row", "col", F.col("value").alias("s"))
    return ranks.join(smooth, ["row", "col"]).select("row", "col", (F.col("value") - F.col("s")).alias("value"))


def dark_halos(
    image: DataFrame, regions: DataFrame, height: int, width: int, *, share: float = 0.3, local_share: float = 0.5, sigma: float = 20.0, keep_off: int = 10, radius: int = 30, least: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(roi_id, row, col) of the dark surroundings of each region, and the mask (row, col) they are cut from.

    The mask has pixels below the share quantile of the image, or below the local_share quantile of
    local_rank, that are more than keep_off side steps from every region. A region's surroundings are those
    within radius side steps of it, opened by least steps.
    """
    cut = quantiles(image, "value", [share])[0]
    ranks = written(local_rank(image, sigma, height, width), "local")
    local_cut = quantiles(ranks, "value", [local_share])[0]
    dark = image.where(F.col("value") < F.lit(cut)).select("row", "col").union(ranks.where(F.col("value") < F.lit(local_cut)).select("row", "col")).distinct()
    near = within_steps(regions.select("row", "col"), keep_off, height, width)
    mask = written(dark.join(near, ["row", "col"], "left_anti"), "mask")
    halo = within_steps(regions.select("roi_id", "row", "col"), radius, height, width).join(mask, ["row", "col"], "left_semi")
    return opened_steps(halo, least, height, width), mask


def grid_regions(pixels: DataFrame, cell: int, least: int) -> DataFrame:
    """roi_id, row, col: a mask cut by a grid of square cells; cells with fewer than least pixels go."""
    named = pixels.select(F.format_string("r=%d c=%d", F.expr(f"cast(row div {cell} AS int)"), F.expr(f"cast(col div {cell} AS int)")).alias("roi_id"), "row", "col")
    enough = named.groupBy("roi_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return named.join(enough, "roi_id", "left_semi")


def grow(seeds: DataFrame, pixels: DataFrame, threshold: float, rank: int) -> DataFrame:
    """roi_id, row, col: regions grown by side neighbours whose cosine with the seed's mean code is at least threshold, until none is left to add.

    Each round's new pixels are written to the shared folder. Sides are mutual, so a neighbour of
    a round's pixels that is known already is of that round or of the one before.
    """
    keys = ["roi_id", "row", "col"]
    image = pixels.select("row", "col", "v")
    codes = written(seeds.join(image, ["row", "col"]).groupBy("roi_id").agg(F.array(*[F.avg(F.get("v", F.lit(k))) for k in range(rank)]).alias("code")), "codes")
    m = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in CROSS[1:]])
    rounds = [written(seeds.select(*keys).distinct(), "grown")]
    while True:
        edge = rounds[-1].select("roi_id", F.explode(m).alias("m"), "row", "col").select("roi_id", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col")).distinct()
        for known in rounds[-2:]:
            edge = edge.join(known, keys, "left_anti")
        new = written(edge.join(image, ["row", "col"]).join(codes, "roi_id").where(A.cosine("v", "code") >= threshold).select(*keys), "grown")
        if new.isEmpty():
            break
        rounds.append(new)
    paths = [path for r in rounds for path in r.inputFiles()]
    return seeds.sparkSession.read.schema(rounds[0].schema).parquet(*paths)


def spatial_magnitudes(traces: DataFrame, reference: DataFrame, events: DataFrame, pixels: DataFrame, n_band: int, n_post: int) -> DataFrame:
    """roi_id, row, col, magnitude: on each region's pixels, the mean range of its events that match one of the reference events (event_idx, frame)."""
    rois = events.select("roi_id").distinct()
    asked = rois.crossJoin(reference.select("event_idx", "frame"))
    matched = nearest_event(asked, events, n_band, n_band).where("nearest IS NOT NULL").select("roi_id", "event_idx", F.col("nearest").alias("frame"))
    size = peak_to_trough(traces, matched, 0, n_post).groupBy("roi_id").agg(F.avg("ptt").alias("magnitude"))
    return pixels.join(size, "roi_id").select("roi_id", "row", "col", "magnitude")
