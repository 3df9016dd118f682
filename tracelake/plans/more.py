"""More registered queries: operators that have no place in the first list, over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import arrays as A
from tracelake.operators import display as D
from tracelake.operators import event_joins as J
from tracelake.operators import extract as Y
from tracelake.operators import extraction as X
from tracelake.operators import growth as W
from tracelake.operators import guided as Z
from tracelake.operators import images as N
from tracelake.operators import masks as M
from tracelake.operators import motion as MC
from tracelake.operators import regions as R
from tracelake.operators import selection as L
from tracelake.operators import signals as G
from tracelake.operators import spectra as SP
from tracelake.operators import spikes as E
from tracelake.operators import statistics as S
from tracelake.operators import video as V
from tracelake.operators.extract import LowRank
from tracelake.plans import registry as P
from tracelake.plans.registry import BASE, R5, RANK, WIDTH, query, rounded, rounded_made
from tracelake.sources import tables as T

ROWS = '(SELECT max("row") FROM px)'
_IDS = P._IDS


def _video(spark, sf) -> LowRank:
    """Frames and pixels that share the embeddings as codes."""
    return LowRank(P._codes_in_time(spark, sf), T.pixel_codes(spark, sf).select("row", "col", "v"), RANK)


# Video.


@query(BASE + f'SELECT e.vec_id AS frame, p."row", p.col, {R5("list_dot_product(p.v, CAST(e.embedding AS DOUBLE[]))", "value")} FROM px p CROSS JOIN embeddings e')
def reconstruct(spark, sf):
    video = _video(spark, sf)
    return rounded_made(V.reconstruct(video.u, video.v))


@query(BASE + f'SELECT e.vec_id AS frame, p."row", p.col, {R5("list_dot_product(p.v, CAST(e.embedding AS DOUBLE[]))", "value")} FROM px p CROSS JOIN embeddings e')
def reconstruct_frames(spark, sf):
    """The same pictures in bands of rows, as they are written to a store of frames."""
    video = _video(spark, sf)
    found = V.frames_of(video.u, video.v, 32_000).select("frame", "row0", F.posexplode("pixels").alias("p", "value"))
    place = (F.col("row0") + F.expr(f"cast(p div {WIDTH} AS int)")).alias("row"), F.expr(f"cast(p % {WIDTH} AS int)").alias("col")
    grid = found.select("frame", *place, "value")
    return rounded_made(grid.join(V.beside(video.v.select("row", "col")), ["row", "col"], "left_semi").select("frame", "row", "col", "value"))


@query(
    BASE
    + f""", f AS (SELECT e.vec_id AS frame, p."row", p.col, list_dot_product(p.v, CAST(e.embedding AS DOUBLE[])) AS x FROM px p CROSS JOIN embeddings e),
g AS (SELECT *, min(x) OVER (PARTITION BY frame) AS lo, max(x) OVER (PARTITION BY frame) AS hi FROM f)
SELECT frame, "row", col, {R5('coalesce((x - lo) / nullif(hi - lo, 0), 0)', 'value')} FROM g"""
)
def reconstruct_scaled(spark, sf):
    video = _video(spark, sf)
    return rounded_made(V.reconstruct_scaled(video.u, video.v))


@query(
    P._SLOW
    + f""", m AS (SELECT k, avg(x) AS m FROM e GROUP BY 1), b AS (SELECT sl.f, sum(sl.s * m.m) AS b FROM sl JOIN m USING (k) GROUP BY 1)
SELECT sl.f AS frame, sl.k, {R5('sl.x / CASE WHEN abs(b.b) >= 0.01 THEN b.b WHEN b.b < 0 THEN -0.01 ELSE 0.01 END', 'x', 3)} FROM sl JOIN b USING (f)"""
)
def divisive_lowpass(spark, sf):
    video = _video(spark, sf)
    found = X.divisive_lowpass(video.u, video.v, 11, 2, RANK, 0.01)
    return rounded(found.select("frame", F.posexplode("u").alias("k", "x")).select("frame", F.col("k").cast("bigint").alias("k"), "x"), 3)


@query(BASE + f'SELECT e.vec_id AS frame, p."row", p.col, {R5("list_dot_product(p.v, CAST(e.embedding AS DOUBLE[])) + 0.01 * e.vec_id * p.col", "value")} FROM px p CROSS JOIN embeddings e')
def add_component(spark, sf):
    video = _video(spark, sf)
    u, v = V.add_component(video.u, video.v, video.u.select("frame", (F.col("frame") * 0.01).alias("value")), video.v.select("row", "col", F.col("col").cast("double").alias("value")))
    return rounded_made(V.reconstruct(u, v))


@query(BASE + f'SELECT "row", col, {R5("v[1] * (1 + col / 10.0)", "first")}, {R5("v[64] * (1 + col / 10.0)", "last")} FROM px')
def spatial_gain(spark, sf):
    v = T.pixel_codes(spark, sf).select("row", "col", "v")
    found = V.gain_spatial(v, v.select("row", "col", (1 + F.col("col") / 10).alias("weight")))
    return rounded(found.select("row", "col", F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(RANK - 1)).alias("last")))


@query(
    BASE
    + f""", t AS (SELECT * FROM (VALUES (-1, 0.25), (0, 0.5), (1, 0.25)) AS t(o, w)), n AS (SELECT max("row") AS h FROM px),
a AS (SELECT p."row", p.col, sum(q.v[1] * t.w) AS x FROM px p CROSS JOIN t CROSS JOIN n JOIN px q ON q.col = p.col AND q."row" = greatest(0, least(p."row" - t.o, n.h)) GROUP BY ALL)
SELECT p."row", p.col, {R5('sum(q.x * t.w)', 'value')} FROM a p CROSS JOIN t JOIN a q ON q."row" = p."row" AND q.col = greatest(0, least(p.col - t.o, 24)) GROUP BY ALL"""
)
def separable_convolution(spark, sf):
    kernel = [0.25, 0.5, 0.25]
    return rounded(N.convolve_separable(P._first_component(spark, sf), (kernel, kernel), P._height(spark, sf), WIDTH, "nearest"))


@query(
    f"""WITH e AS (SELECT vec_id AS f, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(0, 63)) AS k FROM embeddings), n AS (SELECT max(f) AS last FROM e),
t AS (SELECT * FROM (VALUES (-2, 0.1), (-1, 0.2), (0, 0.4), (1, 0.2), (2, 0.1)) AS t(o, w))
SELECT a.f AS frame, a.k, {R5('sum(b.x * t.w)', 'x')} FROM e a CROSS JOIN t CROSS JOIN n JOIN e b ON b.k = a.k
AND b.f = CASE WHEN a.f - t.o < 0 THEN t.o - a.f - 1 WHEN a.f - t.o > n.last THEN 2 * n.last + 1 - a.f + t.o ELSE a.f - t.o END GROUP BY a.f, a.k"""
)
def mirrored_convolution(spark, sf):
    found = V.convolve_temporal(P._codes_in_time(spark, sf), [0.1, 0.2, 0.4, 0.2, 0.1], "reflect")
    return rounded(found.select("frame", F.posexplode("u").alias("k", "x")).select("frame", F.col("k").cast("bigint").alias("k"), "x"))


@query(BASE + f'SELECT CAST("row" // 2 AS INT) AS "row", CAST(col // 3 AS INT) AS col, {R5("v[3]", "first")}, {R5("v[6]", "second")} FROM px WHERE "row" % 2 = 0 AND col % 3 = 0')
def sliced_video(spark, sf):
    v = V.slice_components(V.slice_pixels(T.pixel_codes(spark, sf).select("row", "col", "v"), (None, None, 2), (0, None, 3)), "v", 2, 62, 3)
    return rounded(v.select("row", "col", F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(1)).alias("second")))


@query(
    BASE
    + P._CODES
    + f""", q AS (SELECT b.roi_id, count(*) AS n, list({P._COS} ORDER BY {P._COS} DESC) AS r FROM px a JOIN co b USING (roi_id) GROUP BY 1)
SELECT roi_id, {R5('CASE WHEN 5 >= n THEN 0 ELSE r[5] END', 'threshold')} FROM q"""
)
def refine_threshold(spark, sf):
    return rounded(V.refine_threshold(V.pixel_correlations(T.pixel_codes(spark, sf), RANK), 5))


@query(
    BASE
    + f""", s AS (SELECT min(v[1]) AS lo, max(v[1]) AS hi FROM px), z AS (SELECT "row", col, roi_id, (v[1] - lo) / (hi - lo) AS x FROM px, s),
g AS (SELECT avg(ln(greatest(x, 1e-12))) AS g FROM z) SELECT roi_id, "row", col, {R5('pow(x, ln(0.5) / g)', 'value')} FROM z, g"""
)
def gamma_shared(spark, sf):
    image = T.pixel_codes(spark, sf).select("roi_id", "row", "col", F.get("v", F.lit(0)).alias("value"))
    return rounded(V.gamma_correct(image, shared=True))


@query(
    BASE
    + f""", f AS (SELECT e.vec_id AS frame, p."row", p.col, list_dot_product(p.v, CAST(e.embedding AS DOUBLE[])) AS x FROM px p CROSS JOIN embeddings e WHERE e.vec_id % 4 = 0)
SELECT frame, "row", col, {R5('x', 'value')} FROM f UNION ALL SELECT frame, "row" + 1 + {ROWS}, col, {R5('x', 'value')} FROM f"""
)
def stacked(spark, sf):
    """Every fourth picture, which is the stride, twice, one below the other."""
    video = _video(spark, sf)
    frames = V.reconstruct(video.u.where(F.col("frame") % 4 == 0), video.v)
    return rounded_made(D.stacked(frames, frames, P._height(spark, sf), WIDTH, 4, vertical=True))


@query(
    BASE
    + f""", q AS (SELECT quantile_cont(v[1], [{', '.join(repr(k / 127) for k in range(128))}]) AS q FROM px)
SELECT k - 1 AS k, {R5('(q[k] + q[k + 1]) / 2', 'middle', 4)}, {R5('1 / greatest(q[k + 1] - q[k], 0.001)', 'density', 4)} FROM q, unnest(generate_series(1, 127)) AS u(k)"""
)
def quantile_density(spark, sf):
    found = D.quantile_density(P._first_component(spark, sf))
    held = [(k, a, min(b, 1000.0)) for k, (a, b) in enumerate(found)]  # as where the least distance is 0.001
    return rounded(spark.createDataFrame(held, "k bigint, middle double, density double"), 4)


# Extraction.


@query()
def extract_entry(spark, sf):
    """Least squares beside the mean image, rings subtracted and smoothed, as change against the median."""
    weights = _overlapping(spark, sf)
    found, _ = Y.extract_traces(_video(spark, sf), weights, P._height(spark, sf), WIDTH, (1, 2), normalize=True, smooth=5)
    return rounded(found, 3)


def _overlapping(spark, sf):
    """Regions that overlap: those of the labels, each joined by the pixels to its right, which weigh half."""
    own = T.pixel_codes(spark, sf).select("roi_id", "row", "col", F.lit(1.0).alias("weight"))
    right = own.select("roi_id", "row", (F.col("col") + 1).alias("col"), F.lit(0.5).alias("weight")).where(F.col("col") < WIDTH)
    image = own.select("row", "col").distinct()
    return own.unionByName(right.join(image, ["row", "col"], "left_semi")).groupBy("roi_id", "row", "col").agg(F.max("weight").alias("weight"))


@query()
def extract_frames(spark, sf):
    """The same without rings and change from frames, in two passes."""
    video = _video(spark, sf)
    found, _ = Y.extract_traces(V.reconstruct(video.u, video.v), _overlapping(spark, sf), P._height(spark, sf), WIDTH)
    return rounded(found, 4)


@query(
    BASE
    + """, w AS (SELECT roi_id, "row", col, v, 1.0 / count(*) OVER (PARTITION BY roi_id) AS w FROM px),
ex AS (SELECT roi_id, w * unnest(v) AS x, unnest(generate_series(1, 64)) AS k FROM w), cd AS (SELECT roi_id, k, sum(x) AS x FROM ex GROUP BY ALL), co AS (SELECT roi_id, list(x ORDER BY k) AS v FROM cd GROUP BY 1)
"""
    + f"SELECT 'all' AS kind, c.roi_id, e.vec_id AS frame, {R5('list_dot_product(c.v, CAST(e.embedding AS DOUBLE[]))', 'value')} FROM co c CROSS JOIN embeddings e"
)
def pair_traces(spark, sf):
    weights = T.pixel_codes(spark, sf).select("roi_id", "row", "col", F.lit(1.0).alias("weight"))
    return rounded(Y.pair_traces(_video(spark, sf), {"all": weights}, P._height(spark, sf), WIDTH, ring=(-1, -1)))


@query()
def corrected_video(spark, sf):
    """The pictures of motion_correct with their shifts taken back, from codes."""
    fixed, _ = MC.motion_correct(P._pictures(spark, sf), 8, 8, 3, hpf=2.0)
    return rounded(V.reconstruct(fixed.u, fixed.v), 3)


@query()
def guided_basis(spark, sf):
    """Singular values of the video in a basis that its regions guide to."""
    video = _video(spark, sf)
    regions = T.pixel_codes(spark, sf).select("roi_id", "row", "col")
    _, s, _ = Z.guided_svd(video, regions, sizes=(5, 3), hops=(3, 2), windows=(200, 50), clusters=3, rank=12, least=5)
    return rounded(spark.createDataFrame(list(enumerate(map(float, s))), "k bigint, s double"), 3)


@query()
def dark_halos(spark, sf):
    second = T.pixel_codes(spark, sf).select("row", "col", F.get("v", F.lit(1)).alias("value"))
    regions = L.top_share(second, 98).select(F.format_string("%d-%d", F.expr("cast(row div 5 AS int)"), F.expr("cast(col div 5 AS int)")).alias("roi_id"), "row", "col")
    return M.dark_halos(P._first_component(spark, sf), regions, P._height(spark, sf), WIDTH, share=0.5, local_share=0.6, sigma=2.0, keep_off=1, radius=4, least=1)[0]


@query()
def artifact_hulls(spark, sf):
    bright = L.top_share(P._first_component(spark, sf), 95)
    return MC.artifact_regions(bright.select(F.expr("cast(row div 8 AS string)").alias("roi_id"), "row", "col"))


# Events and traces.


@query(BASE + f"SELECT e.roi_id, e.event_idx, e.frame, {R5('t.value', 'value')} FROM ea e LEFT JOIN tr t USING (roi_id, frame)")
def event_attributes(spark, sf):
    return rounded(L.event_attributes(P._errors(spark, sf), T.traces(spark, sf)).select("roi_id", "event_idx", "frame", "value"))


@query(BASE + f"SELECT roi_id, event_idx, frame, {R5('max(abs(value))', 'magnitude')} FROM win GROUP BY ALL")
def event_magnitudes(spark, sf):
    """The callback gives the largest absolute value of a window."""
    largest = lambda w: F.array_max(F.transform(w, lambda x: F.abs(x)))
    return rounded(S.event_magnitudes(T.traces(spark, sf), P._errors(spark, sf), 3, 3, largest))


@query(
    BASE
    + P._LABELLED
    + """, rt AS (SELECT DISTINCT roi_id, CAST(CAST(roi_id AS BIGINT) // 5 * 5 AS VARCHAR) AS root FROM tr),
m AS (SELECT b.roi_id, b.event_idx, b.frame, arg_min(l.frame, abs(l.frame - b.frame) * 1000000 + l.frame) AS root_frame, any_value(rt.root) AS root
FROM eb b JOIN rt ON rt.roi_id = b.roi_id AND rt.root <> b.roi_id JOIN lb l ON l.roi_id = rt.root AND abs(l.frame - b.frame) <= 5 GROUP BY ALL)
SELECT m.roi_id, m.event_idx, m.frame, m.root_frame, coalesce(l.label, 'BS') AS label FROM m LEFT JOIN lb l ON l.roi_id = m.root AND l.frame = m.root_frame"""
)
def match_labels(spark, sf):
    roots = T.traces(spark, sf).select("roi_id").distinct().select("roi_id", F.expr("cast(cast(roi_id AS bigint) div 5 * 5 AS string)").alias("root")).where("roi_id <> root")
    labels = P._labels(spark, sf).select("roi_id", "frame", "event_idx", "label")
    return J.match_labels(P._purchases(spark, sf), roots, labels, 5, 5)


@query(
    BASE
    + P._LABELLED
    + """, gp AS (SELECT DISTINCT roi_id, CAST(roi_id AS BIGINT) % 3 AS grp FROM tr), rf AS (SELECT event_idx, frame, label FROM lb WHERE roi_id = '0'),
m AS (SELECT g.roi_id, g.grp, r.event_idx, r.label, arg_min(b.frame, abs(b.frame - r.frame) * 1000000 + b.frame) AS f FROM gp g CROSS JOIN rf r JOIN eb b ON b.roi_id = g.roi_id AND abs(b.frame - r.frame) <= 6 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY roi_id, label ORDER BY event_idx) AS no FROM m),
w AS (SELECT o.label, o.grp, o.no, f.f AS "offset", avg(t.value) AS value FROM o CROSS JOIN (SELECT unnest(generate_series(-2, 2)) AS f) f LEFT JOIN tr t ON t.roi_id = o.roi_id AND t.frame = o.f + f.f GROUP BY ALL)
"""
    + f'SELECT label, grp AS "group", "offset", {R5("avg(value)", "mean")}, {R5("stddev_pop(value)", "std")}, count(value) AS n FROM w GROUP BY ALL'
)
def grouped_by_reference(spark, sf):
    groups = T.traces(spark, sf).select("roi_id").distinct().select("roi_id", (F.col("roi_id").cast("bigint") % 3).alias("group"))
    return rounded(S.grouped_type_stats(T.traces(spark, sf), P._labels(spark, sf), P._purchases(spark, sf), 6, 2, 2, "mean", groups, "0"))


@query(
    BASE
    + f""", n AS (SELECT roi_id, max(frame) AS last FROM tr GROUP BY 1), g AS (SELECT roi_id, unnest(generate_series(-2, CAST(last + 2 AS BIGINT))) AS frame FROM n),
z AS (SELECT g.roi_id, g.frame, t.value, CASE WHEN t.frame IS NULL THEN 0 ELSE t.value END AS v FROM g LEFT JOIN tr t USING (roi_id, frame)),
m AS (SELECT roi_id, frame, quantile_cont(v, 0.5) OVER (PARTITION BY roi_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM z)
SELECT t.roi_id, t.frame, {R5('m.m', 'value')} FROM tr t JOIN m USING (roi_id, frame)"""
)
def rolling_median(spark, sf):
    return rounded(E.rolling_median(T.traces(spark, sf), 2))


@query(
    BASE
    + f""", r AS (SELECT roi_id, frame, value, CASE WHEN count(*) FILTER (value > 50) OVER w >= 3 THEN stddev_samp(CASE WHEN value > 50 THEN value - 50 END) OVER w END AS r
FROM tr WINDOW w AS (PARTITION BY roi_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
k AS (SELECT *, max(CASE WHEN r IS NOT NULL THEN frame END) OVER (PARTITION BY roi_id ORDER BY frame) AS a, min(CASE WHEN r IS NOT NULL THEN frame END) OVER (PARTITION BY roi_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM r)
SELECT k.roi_id, k.frame, {R5('coalesce(x.r + CASE WHEN k.b > k.a THEN (k.frame - k.a) * 1.0 / (k.b - k.a) ELSE 0 END * (y.r - x.r), x.r, y.r)', 'spread')}
FROM k LEFT JOIN r x ON x.roi_id = k.roi_id AND x.frame = k.a LEFT JOIN r y ON y.roi_id = k.roi_id AND y.frame = k.b"""
)
def positive_spread(spark, sf):
    t = T.traces(spark, sf).withColumn("value", F.col("value") - 50)
    return rounded(E.positive_spread(t, 6).select("roi_id", "frame", "spread"))


@query(
    BASE
    + f"""SELECT roi_id, frame, {R5('CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END', 'mean')} FROM tr
WINDOW w AS (PARTITION BY roi_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""
)
def rolling_windows_padded(spark, sf):
    """Windows of half a second and no hop, one row per frame; those over an end are left out."""
    found = E.rolling_windows_ms(T.traces(spark, sf), 500, P.FS, 0, pad=True)
    return rounded(found.select("roi_id", "frame", A.array_mean("window").alias("mean")))


@query(BASE + f"SELECT roi_id, frame, {R5('CASE WHEN max(abs(value)) OVER w > 0 THEN value * 2 / (2 * max(abs(value)) OVER w) ELSE value END', 'value')} FROM tr WINDOW w AS (PARTITION BY roi_id)")
def scaled_rows(spark, sf):
    return rounded(D.scaled_rows(T.traces(spark, sf), 2.0))


@query(
    """WITH o AS (SELECT o_custkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
g AS (SELECT DISTINCT o_custkey, n, k.k, k.k * (n - 1) / 4.0 AS p FROM o CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS k) k)
"""
    + f"SELECT g.o_custkey, g.k, {R5('a.x + (g.p - floor(g.p)) * (coalesce(b.x, a.x) - a.x)', 'x', 3)} FROM g JOIN o a ON a.o_custkey = g.o_custkey AND a.i = floor(g.p) LEFT JOIN o b ON b.o_custkey = g.o_custkey AND b.i = floor(g.p) + 1"
)
def resampled(spark, sf):
    found = P._lists(spark, sf).select("o_custkey", F.posexplode(A.resample("prices", 5)).alias("k", "x"))
    return rounded(found.select("o_custkey", F.col("k").cast("bigint").alias("k"), "x"), 3)


@query(f"SELECT o_custkey, {R5('median(o_totalprice)', 'middle', 3)}, {R5('max(o_totalprice) - min(o_totalprice)', 'range', 3)} FROM orders GROUP BY 1")
def reduced_by_hook(spark, sf):
    """Reducers that a user gives as functions of NumPy arrays."""
    import numpy as np

    middle, spread = A.reduce_lists(lambda x: float(np.median(x))), A.reduce_lists(lambda x: float(x.max() - x.min()))
    return rounded(P._lists(spark, sf).select("o_custkey", middle("prices").alias("middle"), spread("prices").alias("range")), 3)


@query(f"SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS k, {R5('o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey)', 'x')} FROM orders")
def mapped_by_hook(spark, sf):
    scaled = A.apply_lists(lambda x: x / x.max())
    found = P._lists(spark, sf).select("o_custkey", F.posexplode(scaled("prices")).alias("k", "x"))
    return rounded(found.select("o_custkey", F.col("k").cast("bigint").alias("k"), "x"))


@query(
    P._HOURLY
    + P.spectra_sql("ho")
    + f"""SELECT a.roi_id AS x, b.roi_id AS y, {R5('a.k / 16.0', 'frequency', 3)}, {R5('avg(a.re * b.re + a.im * b.im) * CASE WHEN a.k IN (0, 8) THEN 1 ELSE 2 END / (SELECT sum(h * h) FROM hn)', 're', 3)},
{R5('avg(a.im * b.re - a.re * b.im) * CASE WHEN a.k IN (0, 8) THEN 1 ELSE 2 END / (SELECT sum(h * h) FROM hn)', 'im', 3)}
FROM df a JOIN df b ON a.roi_id < b.roi_id AND a.seg = b.seg AND a.k = b.k GROUP BY a.roi_id, b.roi_id, a.k"""
)
def pairwise_cross_spectrum(spark, sf):
    return rounded(SP.pairwise_cross_spectrum(P._hourly(spark, sf), 1.0, 16, 8, unique=True), 3)


@query()
def robust_coherence(spark, sf):
    return rounded(X.robust_coherence(P._hourly(spark, sf), 1.0, 16, 8), 4)


@query()
def peaks_of_deviation(spark, sf):
    return rounded(X.peaks_of_deviation(T.traces(spark, sf), 7, "double_filt", 0.5, 3, 50), 4)


@query()
def exponential_fits(spark, sf):
    fit = G.exponential_fits(T.traces(spark, sf), 5)
    return rounded(fit.select("roi_id", *[F.get("fit", F.lit(k)).alias(n) for k, n in enumerate("abcde")]), 3)


# Ids and sets.


@query(_IDS + "SELECT id, string_split(id, '.')[1] AS root FROM ids")
def id_roots(spark, sf):
    return R.roots(T.region_ids(spark, sf))


@query(_IDS + "SELECT a.id, coalesce(string_agg(b.id, ',' ORDER BY b.id), '') AS children FROM ids a LEFT JOIN ids b ON starts_with(b.id, a.id || '.') AND len(string_split(b.id, '.')) = len(string_split(a.id, '.')) + 1 GROUP BY 1")
def id_children(spark, sf):
    return R.children(T.region_ids(spark, sf)).withColumn("children", F.array_join("children", ","))


@query(_IDS + "SELECT a.id AS root, b.id, row_number() OVER (PARTITION BY a.id ORDER BY replace(b.id, '.', chr(1))) - 1 AS place FROM ids a JOIN ids b ON b.id = a.id OR starts_with(b.id, a.id || '.')")
def id_subtrees(spark, sf):
    return R.subtrees(T.region_ids(spark, sf)).withColumn("place", F.col("place").cast("bigint"))


@query(
    _IDS
    + """SELECT id, CASE WHEN starts_with(last, 's') THEN 'soma' ELSE 'unk' END AS kind,
concat_ws('.', CASE WHEN len(p) > 1 THEN array_to_string(list_transform(p[:-2], lambda x: regexp_replace(x, '^s([0-9]|$)', '\\1')), '.') END, CASE WHEN starts_with(last, 's') THEN 's' ELSE 'u' END || regexp_replace(last, '^s([0-9]|$)', '\\1')) AS short,
concat_ws('.', CASE WHEN len(p) > 1 THEN array_to_string(list_transform(p[:-2], lambda x: regexp_replace(x, '^s([0-9]|$)', '\\1')), '.') END, CASE WHEN starts_with(last, 's') THEN 'soma' ELSE 'unk' END || regexp_replace(last, '^s([0-9]|$)', '\\1')) AS long
FROM (SELECT id, string_split(id, '.') AS p, string_split(id, '.')[-1] AS last FROM ids)"""
)
def process_ids(spark, sf):
    return R.process_ids(T.region_ids(spark, sf))


@query(
    _IDS
    + """, c AS (SELECT id, array_to_string(string_split(id, '.')[:-2], '.') AS up FROM ids), k AS (SELECT id, (row_number() OVER (PARTITION BY up ORDER BY id) - 1) % 4 AS k FROM c)
SELECT a.id, CAST(sum(k.k + 1) % 5 AS INT) AS color FROM ids a JOIN k ON k.id = a.id OR starts_with(a.id, k.id || '.') GROUP BY 1"""
)
def color_cycle(spark, sf):
    return R.color_cycle(T.region_ids(spark, sf), 5)


@query(_IDS + "SELECT id AS wanted, id AS roi_id FROM ids WHERE id IN ('r0', 'r1') UNION ALL SELECT string_split(id, '.')[-1], id FROM ids WHERE string_split(id, '.')[-1] IN ('n3', 's7')")
def resolve_ids(spark, sf):
    """Two ids by name, two by their last part, looked up in the whole table."""
    rois = T.region_ids(spark, sf).select(F.col("id").alias("roi_id"), F.xxhash64("id").alias("roi_ord"), F.element_at(F.split("id", r"\."), -1).alias("id_short"))
    return L.resolve_ids(rois, ["r0", "n3", "r1", "s7"]).select("wanted", "roi_id")


@query(
    BASE
    + """, u AS (SELECT roi_id, min(frame) * 1000000 + CAST(roi_id AS BIGINT) AS place, 0 AS part FROM ea GROUP BY roi_id
UNION ALL SELECT roi_id, min(frame) * 1000000 + CAST(roi_id AS BIGINT), 1 FROM eb GROUP BY roi_id),
f AS (SELECT roi_id, arg_min(place, part) AS place, min(part) AS first FROM u GROUP BY 1)
SELECT roi_id, row_number() OVER (ORDER BY first, place) - 1 AS ord FROM f"""
)
def ordered_union(spark, sf):
    """Rois in the order of their first error, then those that have only a purchase in the order of that."""

    def listed(events):
        return events.groupBy("roi_id").agg(F.min("frame").alias("at")).select("roi_id", (F.col("at") * 1_000_000 + F.col("roi_id").cast("bigint")).alias("ord"))

    return L.ordered_union([listed(P._errors(spark, sf)), listed(P._purchases(spark, sf))])


@query(
    BASE
    + """, ed AS (SELECT roi_id, "row" AS r0, col AS c0, "row" AS r1, col + 1 AS c1, v[1] > 0 AS up FROM px UNION ALL SELECT roi_id, "row" + 1, col, "row" + 1, col + 1, v[1] > 0 FROM px
UNION ALL SELECT roi_id, "row", col, "row" + 1, col, v[1] > 0 FROM px UNION ALL SELECT roi_id, "row", col + 1, "row" + 1, col + 1, v[1] > 0 FROM px),
a AS (SELECT roi_id, r0, c0, r1, c1 FROM ed GROUP BY ALL HAVING count(*) = 1), b AS (SELECT roi_id, r0, c0, r1, c1 FROM ed WHERE up GROUP BY ALL HAVING count(*) = 1)
SELECT roi_id, r0, c0, r1, c1 FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL HAVING count(*) % 2 = 1"""
)
def touched_edges(spark, sf):
    """The edges of all regions, after those of their pixels with a positive first component were taken out."""
    px = T.pixel_codes(spark, sf)
    return R.touched_edges(R.boundary_edges(px), R.boundary_edges(px.where(F.get("v", F.lit(0)) > 0)))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS roi_id, 10.0 AS fs FROM supplier UNION ALL SELECT CAST(c_custkey AS VARCHAR), 10.0 FROM customer")
def concatenate(spark, sf):
    named = lambda name, key: T.table(spark, sf, name).select(F.col(key).cast("string").alias("roi_id"), F.lit(10.0).alias("fs"))
    return S.concatenate([named("supplier", "s_suppkey"), named("customer", "c_custkey")])


# Growth.


def _brightest(spark, sf):
    """roi_id, row, col: of each label the pixel whose mean over the video is greatest."""
    px = T.pixel_codes(spark, sf)
    value = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    best = px.groupBy("roi_id").agg(F.max_by(F.struct("row", "col"), F.struct(value, -F.col("row"), -F.col("col"))).alias("p"))
    return best.select("roi_id", "p.row", "p.col")


@query()
def adaptive_regions(spark, sf):
    return rounded(W.adaptive(_brightest(spark, sf), T.pixel_codes(spark, sf), RANK, 0.5), 4)


@query()
def watershed_regions(spark, sf):
    """The image of the codes' sums, in whole numbers, as basins of the brightest pixels."""
    value = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    image = T.pixel_codes(spark, sf).select(F.lit("all").alias("picture"), "row", "col", F.round(value * 100).cast("bigint").alias("elevation"))
    marks = _brightest(spark, sf).select(F.lit("all").alias("picture"), "row", "col", F.col("roi_id").cast("bigint").alias("label"))
    return W.watershed(image, marks)


# Ragged arrays.


@query(
    """SELECT o_custkey, k.k AS bin, count(*) FILTER (o_totalprice < k.a) AS "left", count(*) FILTER (o_totalprice < k.b) AS "right"
FROM orders CROSS JOIN (VALUES (0, 0, 50000), (1, 50000, 100000), (2, 100000, 200000), (3, 200000, 400000)) AS k(k, a, b) GROUP BY ALL"""
)
def ragged_bounds(spark, sf):
    """Left and right index of each bin of prices in the sorted prices of each customer."""
    left, right = A.bounds("prices", F.array(*map(F.lit, P._EDGES)))
    both = F.arrays_zip(left.alias("left"), right.alias("right"))
    told = P._lists(spark, sf).select("o_custkey", F.posexplode(both).alias("bin", "b"))
    return told.select("o_custkey", "bin", F.col("b.left").cast("bigint").alias("left"), F.col("b.right").cast("bigint").alias("right"))


@query(
    """SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS place,
CAST(o_totalprice > 0 AS INT) + CAST(o_totalprice > 50000 AS INT) + CAST(o_totalprice > 100000 AS INT) + CAST(o_totalprice > 200000 AS INT) + CAST(o_totalprice > 400000 AS INT) AS bin FROM orders"""
)
def ragged_digitize(spark, sf):
    bins = A.digitize_list("prices", F.array(*map(F.lit, P._EDGES)))
    return P._lists(spark, sf).select("o_custkey", F.posexplode(bins).alias("place", "bin")).select("o_custkey", F.col("place").cast("bigint").alias("place"), "bin")


@query(
    """WITH n AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice, o_orderkey) AS i, o_totalprice AS v FROM orders),
g AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS k FROM g),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 * k AS before FROM s)
SELECT o_custkey, CAST(before + i - 1 AS BIGINT) AS place, v AS value FROM n JOIN b USING (o_custkey, o_orderpriority)"""
)
def nan_joined(spark, sf):
    """The prices of each customer's priorities end to end, two NULLs between them; only what is not NULL is listed."""
    rows = T.table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))), lambda x: x["o_totalprice"]).alias("prices"))
    packed = rows.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderpriority", "prices"))), lambda x: x["prices"]).alias("parts"))
    whole = packed.select("o_custkey", F.posexplode(A.nan_concat("parts", 2)).alias("place", "value"))
    return whole.where("value IS NOT NULL").select("o_custkey", F.col("place").cast("bigint").alias("place"), "value")
