"""Registered queries of the core library over the driver's tables, and the same in DuckDB's SQL.

Numbers are rounded on both sides. Queries without SQL run kernels that SQL does not have;
tests hold them against closed forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import arrays as A
from tracelake.operators import display as D
from tracelake.operators import event_joins as J
from tracelake.operators import extraction as X
from tracelake.operators import images as N
from tracelake.operators import masks as M
from tracelake.operators import motion as MC
from tracelake.operators import recursive as RF
from tracelake.operators import references as RS
from tracelake.operators import regions as R
from tracelake.operators import selection as L
from tracelake.operators import signals as G
from tracelake.operators import sketches as K
from tracelake.operators import spectra as SP
from tracelake.operators import spikes as E
from tracelake.operators import statistics as S
from tracelake.operators import video as V
from tracelake.operators.extract import LowRank
from tracelake.operators.quantiles import quantiles
from tracelake.sources import tables as T
from tracelake.streaming import incremental as I

FS = 10.0
RANK = 64
WIDTH = 25
NUDGE = 1.234e-9

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """df with doubles rounded, negative zero as zero. The nudge takes sums of short decimals off exact halves."""
    return df.select(*[(F.round(F.col(c) + NUDGE, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_made(df: DataFrame, digits: int = 5) -> DataFrame:
    """The same for results of very many rows: by the nearest whole number, not by way of decimals, which take longer than all else there."""
    scale = F.lit(10.0**digits)
    return df.select(*[(F.rint((F.col(c) + NUDGE) * scale) / scale + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


BASE = """WITH fe AS (SELECT CAST(user_id AS VARCHAR) AS roi_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_type FROM events),
tr AS (SELECT roi_id, frame, value FROM fe),
ea AS (SELECT roi_id, row_number() OVER (PARTITION BY roi_id ORDER BY frame) - 1 AS event_idx, frame FROM fe WHERE event_type = 'error'),
eb AS (SELECT roi_id, row_number() OVER (PARTITION BY roi_id ORDER BY frame) - 1 AS event_idx, frame FROM fe WHERE event_type = 'purchase'),
ch AS (SELECT CAST(l_suppkey AS VARCHAR) AS roi_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS frame, l_extendedprice AS value, l_quantity AS background FROM lineitem),
win AS (SELECT e.roi_id, e.event_idx, e.frame, o.o AS "offset", t.value FROM ea e CROSS JOIN (SELECT unnest(generate_series(-3, 3)) AS o) o LEFT JOIN tr t ON t.roi_id = e.roi_id AND t.frame = e.frame + o.o),
px AS (SELECT CAST(vec_id // 25 AS INT) AS "row", CAST(vec_id % 25 AS INT) AS col, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS VARCHAR) AS roi_id FROM embeddings)
"""


def R5(x: str, name: str, digits: int = 5) -> str:
    return f"ROUND({x} + {NUDGE}, {digits}) + 0.0 AS {name}"


def _height(spark, sf) -> int:
    """Rows of the image that the table's pixels are laid out on."""
    return (T.pixel_codes(spark, sf, WIDTH).agg(F.max("row")).first()[0] or 0) + 1


def _errors(spark, sf):
    return T.events(spark, sf, "error")


def _purchases(spark, sf):
    return T.events(spark, sf, "purchase")


# Windows around events.


@query(BASE + f'SELECT roi_id, "offset", {R5("avg(value)", "mean")}, {R5("stddev_pop(value)", "std")}, {R5("stddev_pop(value) / sqrt(nullif(count(value), 0))", "sem")}, count(value) AS n FROM win GROUP BY ALL')
def peri_event_mean(spark, sf):
    return rounded(S.event_template(T.traces(spark, sf), _errors(spark, sf), 3, 3))


@query(BASE + f'SELECT roi_id, event_idx, frame, "offset", {R5("value", "value")} FROM win')
def event_windows(spark, sf):
    return rounded(J.event_windows(T.traces(spark, sf), _errors(spark, sf), 3, 3))


@query(BASE + f'SELECT roi_id, event_idx, frame, {R5("avg(value)", "mean")}, count(value) AS n FROM win GROUP BY ALL')
def packed_event_windows(spark, sf):
    w = J.packed_windows(T.pack(T.traces(spark, sf)), _errors(spark, sf), 3, 3)
    return rounded(w.select("roi_id", "event_idx", "frame", A.array_mean("window").alias("mean"), F.size(F.filter("window", lambda x: x.isNotNull())).cast("bigint").alias("n")))


@query(BASE + "SELECT a.roi_id, a.event_idx, a.frame, coalesce(string_agg(CAST(b.frame AS VARCHAR), ',' ORDER BY b.frame), '') AS neighbors FROM ea a LEFT JOIN eb b ON a.roi_id = b.roi_id AND b.frame - a.frame BETWEEN -5 AND 8 GROUP BY ALL")
def neighbor_events(spark, sf):
    return J.neighbor_events(_errors(spark, sf), _purchases(spark, sf), 5, 8).withColumn("neighbors", F.array_join(F.col("neighbors").cast("array<string>"), ","))


@query(
    BASE
    + """, p AS (SELECT a.roi_id, a.event_idx, a.frame, b.frame AS o, row_number() OVER (PARTITION BY a.roi_id, a.event_idx ORDER BY abs(b.frame - a.frame), b.frame) AS k
FROM ea a JOIN eb b ON a.roi_id = b.roi_id AND b.frame - a.frame BETWEEN -5 AND 8)
SELECT a.roi_id, a.event_idx, a.frame, coalesce(string_agg(CAST(p.o AS VARCHAR), ',' ORDER BY p.o), '') AS neighbors FROM ea a LEFT JOIN p ON p.roi_id = a.roi_id AND p.event_idx = a.event_idx AND p.k <= 2 GROUP BY ALL"""
)
def neighbor_topn(spark, sf):
    return J.neighbor_events(_errors(spark, sf), _purchases(spark, sf), 5, 8, 2).withColumn("neighbors", F.array_join(F.col("neighbors").cast("array<string>"), ","))


@query(BASE + "SELECT a.roi_id, a.event_idx, a.frame, arg_min(b.frame, abs(b.frame - a.frame) * 1000000 + b.frame) AS nearest FROM ea a LEFT JOIN eb b ON a.roi_id = b.roi_id AND b.frame - a.frame BETWEEN -5 AND 8 GROUP BY ALL")
def nearest_event(spark, sf):
    return J.nearest_event(_errors(spark, sf), _purchases(spark, sf), 5, 8)


@query(BASE + "SELECT a.roi_id, a.event_idx, a.frame, (SELECT count(*) FROM ea b WHERE b.roi_id = a.roi_id AND abs(b.frame - a.frame) <= 4) - 1 AS n_neighbors FROM ea a")
def count_neighbors(spark, sf):
    return J.count_neighbors(_errors(spark, sf), 4)


@query(
    BASE
    + """, r AS (SELECT roi_id, greatest(max(frame) + 10, 200) AS n FROM tr GROUP BY 1),
k AS (SELECT roi_id, unnest(generate_series(0, CAST(n - 1 AS BIGINT), 10)) AS anchor FROM r)
SELECT k.roi_id, k.anchor, count(e.frame) AS n FROM k LEFT JOIN ea e ON e.roi_id = k.roi_id AND abs(e.frame - k.anchor) <= 8 GROUP BY ALL"""
)
def events_to_trace(spark, sf):
    return J.hopping_counts(_errors(spark, sf), T.traces(spark, sf), 10, 15, least=200)


@query(
    BASE
    + f""", r AS (SELECT roi_id AS trace_roi FROM tr  GROUP BY 1)
SELECT r.trace_roi, e.roi_id, o.o AS "offset", {R5("avg(t.value)", "mean")} FROM ea e CROSS JOIN r CROSS JOIN (SELECT unnest(generate_series(-1, 1)) AS o) o LEFT JOIN tr t ON t.roi_id = r.trace_roi AND t.frame = e.frame + o.o GROUP BY ALL"""
)
def cross_event_means(spark, sf):
    """Events of every roi on the traces of every roi."""
    return rounded_made(J.cross_means(T.traces(spark, sf), _errors(spark, sf), 1, 1))


@query(BASE + f", n AS (SELECT roi_id, count(*) AS n FROM tr GROUP BY 1), s AS (SELECT roi_id, unnest(generate_series(0, n - 1)) AS frame FROM n) SELECT s.roi_id, s.frame, {R5('e.event_idx * 1.5', 'value')} FROM s LEFT JOIN ea e ON e.roi_id = s.roi_id AND e.frame = s.frame")
def embed_events(spark, sf):
    n = T.traces(spark, sf).groupBy("roi_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(J.embed_events(_errors(spark, sf), F.col("event_idx") * 1.5, n))


# Statistics of events.


@query(BASE + f"SELECT roi_id, event_idx, frame, {R5('max(value) - min(value)', 'ptt')} FROM win GROUP BY ALL")
def peak_to_trough(spark, sf):
    return rounded(S.peak_to_trough(T.traces(spark, sf), _errors(spark, sf), 3, 3))


@query(
    BASE
    + f""", tp AS (SELECT roi_id, "offset", avg(value) AS t FROM win GROUP BY ALL), sz AS (SELECT roi_id, sqrt(sum(t * t)) AS size FROM tp GROUP BY 1)
SELECT w.roi_id, w.event_idx, w.frame, {R5('sum(tp.t * w.value) / CASE WHEN any_value(sz.size) = 0 THEN 1 ELSE any_value(sz.size) END', 'magnitude')} FROM win w JOIN tp USING (roi_id, "offset") JOIN sz USING (roi_id) GROUP BY ALL"""
)
def template_magnitude(spark, sf):
    return rounded(S.template_magnitudes(T.traces(spark, sf), _errors(spark, sf), 3, 3))


@query(
    BASE
    + f""", a AS (SELECT roi_id, event_idx, frame, avg(value) FILTER ("offset" >= 2) - avg(value) FILTER ("offset" <= -2) AS diff,
sqrt((var_pop(value) FILTER ("offset" >= 2) + var_pop(value) FILTER ("offset" <= -2)) / 2) AS pooled FROM win GROUP BY ALL)
SELECT roi_id, event_idx, frame, {R5('diff', 'diff', 4)}, {R5("CASE WHEN pooled > 0 THEN diff / pooled WHEN diff = 0 THEN 0 WHEN diff > 0 THEN CAST('inf' AS DOUBLE) WHEN diff < 0 THEN CAST('-inf' AS DOUBLE) END", 'd_prime', 4)} FROM a"""
)
def onset_offset(spark, sf):
    return rounded(S.onset_offset(T.traces(spark, sf), _errors(spark, sf), 3, 3, 2), 4)


_LABELLED = """, l0 AS (SELECT a.roi_id, a.event_idx, a.frame, (SELECT count(*) FROM ea b WHERE b.roi_id = a.roi_id AND abs(b.frame - a.frame) <= 4) - 1 AS n_neighbors,
(SELECT avg(t.value) FROM tr t WHERE t.roi_id = a.roi_id AND t.frame BETWEEN a.frame + 2 AND a.frame + 4)
- (SELECT avg(t.value) FROM tr t WHERE t.roi_id = a.roi_id AND t.frame BETWEEN a.frame - 4 AND a.frame - 2) AS mean_diff FROM ea a),
lb AS (SELECT *, CASE WHEN n_neighbors > 0 THEN 'BS' WHEN mean_diff > 0 THEN 'SS-ADP' ELSE 'SS-noADP' END AS label FROM l0)
"""


def _labels(spark, sf):
    return S.classify_events(T.traces(spark, sf), _errors(spark, sf), 4, 3)


@query(BASE + _LABELLED + f"SELECT roi_id, event_idx, frame, n_neighbors, {R5('mean_diff', 'mean_diff')}, label FROM lb")
def classify_events(spark, sf):
    return rounded(_labels(spark, sf))


_KINDS = ["BS", "SS-ADP", "SS-noADP"]


@query(
    BASE
    + _LABELLED
    + "SELECT roi_id, "
    + ", ".join(f"count(*) FILTER (label = '{k}') AS \"n_{k}\", ROUND(count(*) FILTER (label = '{k}') / count(*), 5) + 0.0 AS \"p_{k}\"" for k in _KINDS)
    + " FROM lb GROUP BY 1"
)
def label_proportions(spark, sf):
    return rounded(S.label_proportions(_labels(spark, sf), _KINDS))


@query(
    BASE
    + _LABELLED
    + f""", m AS (SELECT l.roi_id, l.event_idx, l.label, arg_min(b.frame, abs(b.frame - l.frame) * 1000000 + b.frame) AS f FROM lb l JOIN eb b ON b.roi_id = l.roi_id AND abs(b.frame - l.frame) <= 6 GROUP BY ALL)
SELECT m.label, o.o AS "offset", {R5("avg(t.value)", "mean")}, {R5("stddev_pop(t.value)", "std")}, count(t.value) AS n FROM m CROSS JOIN (SELECT unnest(generate_series(-2, 2)) AS o) o LEFT JOIN tr t ON t.roi_id = m.roi_id AND t.frame = m.f + o.o GROUP BY ALL"""
)
def grouped_type_stats(spark, sf):
    return rounded(S.grouped_type_stats(T.traces(spark, sf), _labels(spark, sf), _purchases(spark, sf), 6, 2, 2))


_BACK = """, bk AS (SELECT roi_id, frame, value, CASE WHEN count(*) OVER w = 21 THEN 2 * stddev_pop(CASE WHEN value > 0 THEN value END) OVER w END AS background FROM tr WINDOW w AS (PARTITION BY roi_id ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))
"""


@query(BASE + _BACK + f"SELECT roi_id, frame, {R5('value', 'value')}, {R5('background', 'background')} FROM bk")
def rolling_background(spark, sf):
    return rounded(S.rolling_background(T.traces(spark, sf), 10))


_METRICS = (
    _BACK
    + """, me AS (SELECT e.roi_id, e.event_idx, e.frame, any_value(b.value) AS raw_dff, any_value(b.background) AS background, max(t.value) - min(t.value) AS ptt
FROM ea e JOIN bk b USING (roi_id, frame) LEFT JOIN tr t ON t.roi_id = e.roi_id AND t.frame BETWEEN e.frame AND e.frame + 3 GROUP BY ALL),
mt AS (SELECT *, ptt / nullif(background, 0) AS sbr FROM me)
"""
)


def _metrics(spark, sf):
    return S.spike_metrics(T.traces(spark, sf), _errors(spark, sf), FS, 10, 3)


@query(BASE + _METRICS + f"SELECT roi_id, event_idx, frame, {R5('frame / 10.0', 'spike_time_s')}, {R5('raw_dff', 'raw_dff')}, {R5('ptt', 'peak_to_trough_dff')}, {R5('background', 'background')}, {R5('sbr', 'sbr')} FROM mt")
def spike_metrics(spark, sf):
    return rounded(_metrics(spark, sf))


_BINS = (
    _METRICS
    + """, b1 AS (SELECT roi_id, frame // 20 AS bin, avg(value) AS mean_F, count(*) AS frames FROM tr GROUP BY ALL),
b2 AS (SELECT roi_id, frame // 20 AS bin, count(sbr) AS n, avg(sbr) AS mean_sbr, avg(background) AS background_noise FROM mt GROUP BY ALL),
bn AS (SELECT roi_id, bin * 2.0 AS bin_time_s, mean_F, coalesce(n, 0) / frames * 10.0 AS spike_rate, mean_sbr, mean_F AS mean_dff, background_noise FROM b1 LEFT JOIN b2 USING (roi_id, bin))
"""
)


def _binned(spark, sf):
    t = T.traces(spark, sf)
    return S.binned_stats(t, t, _metrics(spark, sf), FS, 2.0)


@query(BASE + _BINS + "SELECT roi_id, " + ", ".join(R5(c, c) for c in ("bin_time_s", "mean_F", "spike_rate", "mean_sbr", "mean_dff", "background_noise")) + " FROM bn")
def binned_stats(spark, sf):
    return rounded(_binned(spark, sf))


_TREND = """, lg AS (SELECT roi_id, bin_time_s AS x, 'mean_F' AS metric, mean_F AS y FROM bn UNION ALL SELECT roi_id, bin_time_s, 'mean_sbr', mean_sbr FROM bn),
ft AS (SELECT roi_id, metric, count(y) AS n, min(y) AS least, regr_slope({y}, x) AS a, regr_intercept({y}, x) AS b, regr_r2({y}, x) AS r FROM lg WHERE y IS NOT NULL GROUP BY ALL)
"""


@query(BASE + _BINS + _TREND.format(y="y") + f"SELECT roi_id, metric, {R5('CASE WHEN n >= 2 THEN a * 60 END', 'change_per_min', 4)}, {R5('CASE WHEN n >= 2 THEN b END', 'intercept', 4)}, {R5('CASE WHEN n >= 2 THEN r END', 'r2', 4)} FROM ft")
def trend_fits(spark, sf):
    return rounded(S.trend_fits(_binned(spark, sf), ["mean_F", "mean_sbr"]), 4)


@query(
    BASE
    + _BINS
    + _TREND.format(y="CASE WHEN y > 0 THEN ln(y) END")
    + f"SELECT roi_id, metric, {R5('CASE WHEN n >= 2 AND least > 0 THEN (exp(a) - 1) * 6000 END', 'pct_per_min', 4)}, {R5('CASE WHEN n >= 2 AND least > 0 THEN exp(b) END', 'initial', 4)}, {R5('CASE WHEN n >= 2 AND least > 0 THEN r END', 'r2', 4)} FROM ft"
)
def log_trend_fits(spark, sf):
    return rounded(S.trend_fits(_binned(spark, sf), ["mean_F", "mean_sbr"], log=True), 4)


# Traces.


@query(BASE + f"SELECT roi_id, frame, {R5('(value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END', 'value')} FROM tr WINDOW w AS (PARTITION BY roi_id)")
def zscore(spark, sf):
    return rounded(S.zscore(T.traces(spark, sf)))


@query(BASE + f", m AS (SELECT roi_id, CASE WHEN median(value) = 0 THEN 1 ELSE median(value) END AS m FROM tr GROUP BY 1) SELECT roi_id, frame, {R5('100 * (value - m) / m', 'value', 4)} FROM tr JOIN m USING (roi_id)")
def dff_median(spark, sf):
    return rounded(S.dff_median(T.traces(spark, sf)), 4)


@query(
    BASE
    + f", s AS (SELECT roi_id, avg(value) + 1.5 * stddev_pop(value) AS top FROM tr GROUP BY 1), h AS (SELECT roi_id, frame, least(value, top) AS v FROM tr JOIN s USING (roi_id)), m AS (SELECT roi_id, median(v) AS m FROM h GROUP BY 1) SELECT roi_id, frame, {R5('v - m', 'value')} FROM h JOIN m USING (roi_id)"
)
def clip_center(spark, sf):
    return rounded(S.clip_center(T.traces(spark, sf), 1.5))


@query("SELECT p_partkey, p_size, ROUND(rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0, 1) + 0.0 AS rank FROM part")
def rank_average(spark, sf):
    return rounded(S.rank_average(T.table(spark, sf, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "p_size", F.col("rank").cast("double").alias("rank")), 1)


@query(BASE + f", f AS (SELECT roi_id, regr_slope(value, background) AS a, regr_intercept(value, background) AS b FROM ch GROUP BY 1) SELECT roi_id, frame, {R5('value - a * background - b', 'value', 3)} FROM ch JOIN f USING (roi_id)")
def regress_background(spark, sf):
    return rounded(S.regress_background(T.channels(spark, sf)), 3)


@query(BASE + f", f AS (SELECT roi_id, sum(value * background) / nullif(sum(background * background), 0) AS a FROM ch GROUP BY 1) SELECT roi_id, frame, {R5('value - a * background', 'value', 3)} FROM ch JOIN f USING (roi_id)")
def regress_through_origin(spark, sf):
    return rounded(S.regress_background(T.channels(spark, sf), intercept=False), 3)


@query(BASE + f"SELECT roi_id, frame, {R5('CASE WHEN count(*) OVER w = 15 THEN value - quantile_cont(value, 0.5) OVER w ELSE 0 END', 'value')} FROM tr WINDOW w AS (PARTITION BY roi_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)")
def rolling_median_hpf(spark, sf):
    return rounded(E.rolling_median_highpass(T.traces(spark, sf), 7))


@query(BASE + f"SELECT roi_id, frame, {R5('avg(value) OVER w', 'mean')} FROM tr WINDOW w AS (PARTITION BY roi_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) QUALIFY count(*) OVER w = 5 AND (frame - 2) % 3 = 0")
def rolling_window_means(spark, sf):
    return rounded(E.rolling_windows(T.traces(spark, sf), 5, 3).select("roi_id", "frame", A.array_mean("window").alias("mean")))


@query(BASE + f"SELECT frame, {R5('avg(value)', 'mean')}, {R5('quantile_cont(value, 0.0)', 'q0')}, {R5('quantile_cont(value, 0.25)', 'q25')}, {R5('quantile_cont(value, 0.75)', 'q75')}, {R5('quantile_cont(value, 1.0)', 'q100')} FROM tr GROUP BY 1")
def quantile_spread(spark, sf):
    return rounded(S.quantile_spread(T.traces(spark, sf)))


@query(
    BASE
    + f""", k AS (SELECT roi_id, (frame - 5) // 15 AS k, frame, value FROM tr WHERE frame >= 5), w AS (SELECT roi_id, k FROM k GROUP BY ALL HAVING count(*) = 15)
SELECT roi_id, printf('%.2f-%.2fs', (5 + k * 15) / 10.0, (5 + k * 15) / 10.0 + 1.5) AS id, frame - 5 - k * 15 AS frame, {R5('value', 'value')} FROM k JOIN w USING (roi_id, k)"""
)
def segment_traces(spark, sf):
    return rounded(S.segment_traces(T.traces(spark, sf), 5, 15, FS))


@query(BASE + "SELECT roi_id, (frame - 5) // 15 AS segment, (frame - 5) % 15 AS frame FROM ea WHERE frame >= 5")
def segment_events(spark, sf):
    return S.segment_events(_errors(spark, sf), 5, 15)


# Detection.


def _quadratic(size: int, at: int) -> list[float]:
    """What each of size samples counts in the value at one of them of the parabola nearest to all: by the normal equations."""
    x = [k - at for k in range(size)]
    p = [sum(v**n for v in x) for n in range(5)]
    c = (p[2] * p[4] - p[3] ** 2, p[2] * p[3] - p[1] * p[4], p[1] * p[3] - p[2] ** 2)
    whole = p[0] * c[0] + p[1] * c[1] + p[2] * c[2]
    return [(c[0] + c[1] * v + c[2] * v * v) / whole for v in x]


def smoothed(size: int, source: str = "tr") -> str:
    """sg (roi_id, frame, s): parabolas through windows of a table of traces, those of the first and last window near the ends."""
    half = size // 2
    weights = ", ".join(f"({a}, {k}, {w!r})" for a in range(size) for k, w in enumerate(_quadratic(size, a)))
    return f""", sw AS (SELECT * FROM (VALUES {weights}) AS t(a, k, w)), ln AS (SELECT roi_id, max(frame) + 1 AS n FROM {source} GROUP BY 1),
ps AS (SELECT t.roi_id, t.frame, CASE WHEN t.frame < {half} THEN t.frame WHEN t.frame >= n - {half} THEN t.frame - n + {size} ELSE {half} END AS a,
CASE WHEN t.frame < {half} THEN 0 WHEN t.frame >= n - {half} THEN n - {size} ELSE t.frame - {half} END AS b FROM {source} t JOIN ln USING (roi_id) WHERE n >= {size}),
sg AS (SELECT p.roi_id, p.frame, sum(w.w * x.value) AS s FROM ps p JOIN sw w ON w.a = p.a JOIN {source} x ON x.roi_id = p.roi_id AND x.frame = p.b + w.k GROUP BY ALL)
"""


_SPIKES = (
    smoothed(11)
    + """, ma AS (SELECT t.roi_id, t.frame, -t.value AS raw, -(t.value - sg.s) AS v FROM tr t LEFT JOIN sg USING (roi_id, frame)),
nz AS (SELECT *, coalesce(stddev_pop(CASE WHEN v < 0 THEN v END) OVER r, stddev_pop(v) OVER r) AS noise,
min(raw) OVER (PARTITION BY roi_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM ma WINDOW r AS (PARTITION BY roi_id)),
ab AS (SELECT *, coalesce(v > 1.0 * noise, false) AS above FROM nz),
st AS (SELECT *, CASE WHEN above AND NOT coalesce(lag(above) OVER (PARTITION BY roi_id ORDER BY frame), false) THEN 1 ELSE 0 END AS s FROM ab),
il AS (SELECT *, sum(s) OVER (PARTITION BY roi_id ORDER BY frame) AS island FROM st),
pk AS (SELECT *, row_number() OVER (PARTITION BY roi_id, island ORDER BY v DESC, frame) AS k FROM il WHERE above),
sp AS (SELECT roi_id, row_number() OVER (PARTITION BY roi_id ORDER BY frame) - 1 AS event_idx, frame, coalesce(raw - before, 0) AS amplitude,
CASE WHEN noise > 0 THEN coalesce(raw - before, 0) / noise ELSE coalesce(raw - before, 0) END AS sbr FROM pk WHERE k = 1)
"""
)


def _spikes(spark, sf):
    return E.detect_spikes(T.traces(spark, sf), 1.0, 11)


@query(BASE + _SPIKES + f"SELECT roi_id, event_idx, frame, {R5('amplitude', 'amplitude')}, {R5('sbr', 'sbr')} FROM sp")
def detect_spikes(spark, sf):
    return rounded(_spikes(spark, sf))


@query(
    BASE
    + """, g AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY roi_id ORDER BY frame) > 4 THEN 1 ELSE 0 END AS s FROM ea), b AS (SELECT *, sum(s) OVER (PARTITION BY roi_id ORDER BY frame) AS burst FROM g)
SELECT roi_id, CAST(burst AS BIGINT) AS burst, string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame) AS frames FROM b GROUP BY ALL UNION ALL SELECT DISTINCT roi_id, 0, '' FROM tr WHERE roi_id NOT IN (SELECT roi_id FROM ea)"""
)
def group_bursts(spark, sf):
    return E.group_bursts(_errors(spark, sf), 4, T.traces(spark, sf)).withColumn("frames", F.array_join(F.col("frames").cast("array<string>"), ","))


@query(BASE + f""", wv AS (SELECT roi_id, "offset", avg(value) AS w FROM win GROUP BY ALL), pt AS (SELECT n.roi_id, n.frame + n."offset" AS frame, sum(wv.w) AS w FROM win n JOIN wv USING (roi_id, "offset") GROUP BY ALL)
SELECT t.roi_id, t.frame, {R5('t.value - coalesce(pt.w, 0)', 'value')} FROM tr t LEFT JOIN pt ON pt.roi_id = t.roi_id AND pt.frame = t.frame""")
def despike(spark, sf):
    return rounded(E.despike(T.traces(spark, sf), _errors(spark, sf), 3, 3))


@query(
    BASE
    + smoothed(11)
    + f"""SELECT t.roi_id, t.frame, {R5('CASE WHEN t.frame < 2 OR t.frame > ln.n - 3 OR EXISTS (SELECT 1 FROM ea e WHERE e.roi_id = t.roi_id AND abs(e.frame - t.frame) <= 2) THEN sg.s ELSE t.value END', 'value')}
FROM tr t JOIN ln USING (roi_id) LEFT JOIN sg USING (roi_id, frame)"""
)
def despike_impute(spark, sf):
    return rounded(E.despike_impute(T.traces(spark, sf), _errors(spark, sf), 5, 11))


@query(BASE + "SELECT roi_id, frame FROM (SELECT *, lag(value) OVER (PARTITION BY roi_id ORDER BY frame) AS b FROM tr) WHERE b < 50 AND value > 50")
def rising_crossings(spark, sf):
    return E.crossings(T.traces(spark, sf), 50.0)


@query(
    BASE
    + f""", m AS (SELECT roi_id, frame, value - avg(value) OVER (PARTITION BY roi_id) AS v, background - avg(background) OVER (PARTITION BY roi_id) AS b, count(*) OVER (PARTITION BY roi_id) AS n FROM ch)
SELECT x.roi_id, l.lag, {R5('sum(x.v * y.b) / max(x.n)', 'r', 3)} FROM m x CROSS JOIN (SELECT unnest(generate_series(-3, 3)) AS lag) l JOIN m y ON y.roi_id = x.roi_id AND x.frame = y.frame + l.lag GROUP BY ALL"""
)
def cross_correlation(spark, sf):
    c = T.channels(spark, sf)
    return rounded(E.cross_correlate(c.select("roi_id", "frame", "value"), c.select("roi_id", "frame", F.col("background").alias("value")), 3), 3)


# Ragged arrays.


def _lists(spark, sf):
    return T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_totalprice")).alias("prices"))


_EDGES = [0.0, 50000.0, 100000.0, 200000.0, 400000.0]


@query("SELECT o_custkey, k.k AS bin, count(*) FILTER (o_totalprice >= k.a AND o_totalprice < k.b) AS n FROM orders CROSS JOIN (VALUES (0, 0, 50000), (1, 50000, 100000), (2, 100000, 200000), (3, 200000, 400000)) AS k(k, a, b) GROUP BY ALL")
def boundsorted_counts(spark, sf):
    counts = A.boundsorted_counts("prices", F.array(*map(F.lit, _EDGES)))
    return _lists(spark, sf).select("o_custkey", F.posexplode(counts).alias("bin", "n")).select("o_custkey", "bin", F.col("n").cast("bigint").alias("n"))


_DIGITS = "SELECT p_partkey, CAST((p_size {op} 10) AS INT) + CAST((p_size {op} 20) AS INT) + CAST((p_size {op} 30) AS INT) + CAST((p_size {op} 40) AS INT) AS bin FROM part"


@query(_DIGITS.format(op=">"))
def digitize_left(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", A.digitize("p_size", F.array(*map(F.lit, (10, 20, 30, 40)))).alias("bin"))


@query(_DIGITS.format(op=">="))
def digitize_right(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", A.digitize("p_size", F.array(*map(F.lit, (10, 20, 30, 40))), right=True).alias("bin"))


@query(f"SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS k, {R5('o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey)', 'x', 3)} FROM orders")
def ragged_demean(spark, sf):
    return rounded(_lists(spark, sf).select("o_custkey", F.posexplode(A.demean("prices")).alias("k", "x")).select("o_custkey", F.col("k").cast("bigint").alias("k"), "x"), 3)


@query(f"SELECT o_custkey, {R5('min(o_totalprice)', 'least', 3)}, {R5('max(o_totalprice)', 'most', 3)}, {R5('avg(o_totalprice)', 'mean', 3)}, {R5('stddev_pop(o_totalprice)', 'std', 3)} FROM orders GROUP BY 1")
def ragged_reduce(spark, sf):
    return rounded(_lists(spark, sf).select("o_custkey", F.array_min("prices").alias("least"), F.array_max("prices").alias("most"), A.array_mean("prices").alias("mean"), A.array_std("prices").alias("std")), 3)


@query("SELECT DISTINCT p_size FROM part")
def ragged_unique(spark, sf):
    return T.table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_size").alias("a")).select(F.explode("a").alias("p_size")).distinct()


@query("SELECT least(CAST(floor((p_retailprice - a) / nullif(b - a, 0) * 20) AS INT), 19) AS bin, count(*) AS n FROM part CROSS JOIN (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part) GROUP BY 1")
def histogram(spark, sf):
    return S.histogram(T.table(spark, sf, "part").select("p_retailprice"), "p_retailprice", 20)


# Pixels.


_COS = "list_dot_product(a.v, b.v) / (greatest(sqrt(list_dot_product(a.v, a.v)), 1e-10) * greatest(sqrt(list_dot_product(b.v, b.v)), 1e-10))"
_CODES = ', ex AS (SELECT roi_id, unnest(v) AS x, unnest(generate_series(1, 64)) AS k FROM px), cd AS (SELECT roi_id, k, avg(x) AS x FROM ex GROUP BY ALL), co AS (SELECT roi_id, list(x ORDER BY k) AS v FROM cd GROUP BY 1)\n'


@query(BASE + _CODES + f"SELECT roi_id, k - 1 AS k, {R5('x', 'x')} FROM cd")
def roi_codes(spark, sf):
    return rounded(V.roi_codes(T.pixel_codes(spark, sf), RANK).select("roi_id", F.posexplode("code").alias("k", "x")).select("roi_id", F.col("k").cast("bigint").alias("k"), "x"))


@query(BASE + _CODES + f'SELECT b.roi_id, a."row", a.col, {R5(_COS, "r")} FROM px a CROSS JOIN co b')
def correlation_map(spark, sf):
    px = T.pixel_codes(spark, sf)
    return rounded(V.correlation_map(px.select("row", "col", "v"), V.roi_codes(px, RANK)))


@query(BASE + _CODES + f'SELECT b.roi_id, a."row", a.col, {R5(_COS, "r")} FROM px a JOIN co b USING (roi_id)')
def pixel_correlations(spark, sf):
    return rounded(V.pixel_correlations(T.pixel_codes(spark, sf), RANK))


@query(
    BASE
    + f"""SELECT a."row", a.col, {R5(f'avg({_COS})', 'r')} FROM px a CROSS JOIN (SELECT unnest(generate_series(-1, 1)) AS dr) dr CROSS JOIN (SELECT unnest(generate_series(-1, 1)) AS dc) dc
JOIN px b ON b."row" = greatest(0, least(a."row" + dr, (SELECT max("row") FROM px))) AND b.col = greatest(0, least(a.col + dc, 24)) WHERE dr <> 0 OR dc <> 0 GROUP BY ALL"""
)
def local_correlation(spark, sf):
    return rounded(V.local_correlation(T.pixel_codes(spark, sf), _height(spark, sf), WIDTH))


@query(BASE + _CODES + f', c AS (SELECT b.roi_id, a."row", a.col, {_COS} AS r FROM px a JOIN co b USING (roi_id)), k AS (SELECT *, row_number() OVER (PARTITION BY roi_id ORDER BY ROUND(r, 9) DESC, "row", col) AS rank FROM c) SELECT roi_id, "row", col, {R5("r", "r")}, rank FROM k WHERE rank <= 5')
def refine_ranking(spark, sf):
    found = V.pixel_correlations(T.pixel_codes(spark, sf), RANK).withColumn("r", F.round("r", 9))
    return rounded(V.refine(found, 5).withColumn("rank", F.col("rank").cast("bigint")))


def _codes_in_time(spark, sf):
    """frame, u: the embeddings read as the codes of consecutive frames."""
    return T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("u"))


@query(BASE + f', ex AS (SELECT unnest(v) AS x, unnest(generate_series(1, 64)) AS k FROM px), m AS (SELECT k, avg(x) AS x FROM ex GROUP BY 1), l AS (SELECT list(x ORDER BY k) AS v FROM m) SELECT a."row", a.col, {R5("list_dot_product(a.v, l.v)", "value")} FROM px a CROSS JOIN l')
def mean_image(spark, sf):
    return rounded(V.mean_image(_codes_in_time(spark, sf), T.pixel_codes(spark, sf), RANK))


@query(BASE + ', w AS (SELECT "row", col, roi_id, 1.0 / count(*) OVER (PARTITION BY roi_id) AS w, v FROM px), ex AS (SELECT roi_id, w * unnest(v) AS x, unnest(generate_series(1, 64)) AS k FROM w), cd AS (SELECT roi_id, k, sum(x) AS x FROM ex GROUP BY ALL), co AS (SELECT roi_id, list(x ORDER BY k) AS v FROM cd GROUP BY 1)\n' + f"SELECT c.roi_id, e.vec_id AS frame, {R5('list_dot_product(c.v, CAST(e.embedding AS DOUBLE[]))', 'value')} FROM co c CROSS JOIN embeddings e")
def extract_traces(spark, sf):
    px = T.pixel_codes(spark, sf)
    weights = R.uniform_weights(px.select("roi_id", "row", "col"))
    return rounded(V.extract_from_codes(_codes_in_time(spark, sf), px, weights, RANK))


@query(
    BASE
    + f""", e AS (SELECT CAST(label AS VARCHAR) AS roi_id, vec_id AS frame FROM embeddings), s AS (SELECT e.roi_id, o.o AS "offset", unnest(CAST(m.embedding AS DOUBLE[])) AS x, unnest(generate_series(0, 63)) AS k FROM e CROSS JOIN (SELECT unnest(generate_series(-1, 2)) AS o) o JOIN embeddings m ON m.vec_id = e.frame + o.o)
SELECT roi_id, "offset", k, {R5('avg(x)', 'x')} FROM s GROUP BY ALL"""
)
def event_mean_codes(spark, sf):
    found = T.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("roi_id"), F.col("vec_id").alias("frame"))
    mean = V.event_mean_codes(_codes_in_time(spark, sf), found, 1, 2, RANK)
    return rounded(mean.select("roi_id", "offset", F.posexplode("code").alias("k", "x")).select("roi_id", "offset", F.col("k").cast("bigint").alias("k"), "x"))


@query(
    BASE
    + """, e AS (SELECT DISTINCT roi_id, "row" AS r, col AS c FROM px), d AS (SELECT roi_id, r AS r0, c AS c0, r AS r1, c + 1 AS c1 FROM e UNION ALL SELECT roi_id, r + 1, c, r + 1, c + 1 FROM e UNION ALL SELECT roi_id, r, c, r + 1, c FROM e UNION ALL SELECT roi_id, r, c + 1, r + 1, c + 1 FROM e)
SELECT roi_id, r0, c0, r1, c1 FROM d GROUP BY ALL HAVING count(*) = 1"""
)
def boundary_edges(spark, sf):
    return R.boundary_edges(T.pixel_codes(spark, sf))


@query(
    BASE
    + """, o AS (SELECT * FROM (SELECT unnest(generate_series(-3, 3)) AS dr) CROSS JOIN (SELECT unnest(generate_series(-3, 3)) AS dc)),
bg AS (SELECT DISTINCT roi_id, CAST("row" + dr AS INT) AS "row", CAST(col + dc AS INT) AS col FROM px, o WHERE abs(dr) + abs(dc) <= 3), sm AS (SELECT DISTINCT roi_id, "row" + dr AS "row", col + dc AS col FROM px, o WHERE abs(dr) + abs(dc) <= 1)
SELECT roi_id, "row", col FROM bg WHERE "row" BETWEEN 0 AND (SELECT max("row") FROM px) AND col BETWEEN 0 AND 24 AND NOT EXISTS (SELECT 1 FROM sm WHERE sm.roi_id = bg.roi_id AND sm."row" = bg."row" AND sm.col = bg.col)"""
)
def annulus_pixels(spark, sf):
    return R.annuli(T.pixel_codes(spark, sf), 1, 3, _height(spark, sf), WIDTH, threshold=2.0)


@query(
    BASE
    + """SELECT roi_id, greatest(min("row") - 2, 0) AS row0, least(max("row") + 3, (SELECT max("row") FROM px) + 1) AS row1,
greatest(min(col) - 2, 0) AS col0, least(max(col) + 3, 25) AS col1 FROM px GROUP BY 1"""
)
def crop_bounds(spark, sf):
    return R.crop_bounds(T.pixel_codes(spark, sf), 2, _height(spark, sf), WIDTH)


@query(BASE + f', e AS (SELECT "row", col, roi_id, v[1] AS value FROM px), s AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM e WINDOW w AS (PARTITION BY roi_id)), z AS (SELECT *, coalesce((value - lo) / nullif(hi - lo, 0), 0) AS x FROM s), g AS (SELECT *, avg(ln(greatest(x, 1e-12))) OVER (PARTITION BY roi_id) AS g FROM z) SELECT roi_id, "row", col, {R5("pow(x, coalesce(ln(0.5) / nullif(g, 0), 1))", "value")} FROM g')
def gamma_correct(spark, sf):
    image = T.pixel_codes(spark, sf).select("roi_id", "row", "col", F.get("v", F.lit(0)).alias("value"))
    return rounded(V.gamma_correct(image))


@query(
    BASE
    + f""", q AS (SELECT unnest(quantile_cont(v[1], [{', '.join(repr(k / 255) for k in range(256))}])) AS e, unnest(generate_series(0, 255)) AS k FROM px),
ed AS (SELECT e, min(k) / 255.0 AS p FROM q GROUP BY 1), st AS (SELECT e AS a, p, lead(e) OVER w AS b, lead(p) OVER w AS r FROM ed WINDOW w AS (ORDER BY e)),
lo AS (SELECT * FROM st WHERE b IS NOT NULL)
SELECT x."row", x.col, {R5('s.p + (least(x.v[1], s.b) - s.a) / (s.b - s.a) * (s.r - s.p)', 'value')} FROM px x ASOF JOIN lo s ON x.v[1] >= s.a"""
)
def quantile_normalize(spark, sf):
    return rounded(V.quantile_normalize(T.pixel_codes(spark, sf).select("row", "col", F.get("v", F.lit(0)).alias("value"))))


@query(BASE + 'SELECT "row", col, ROUND(max(value), 5) + 0.0 AS value FROM (SELECT "row", col, arg_max(CAST(roi_id AS DOUBLE) / 2, CAST(roi_id AS INT)) AS value FROM px GROUP BY ALL) GROUP BY ALL')
def paint_regions(spark, sf):
    px = T.pixel_codes(spark, sf)
    values = px.select("roi_id").distinct().select("roi_id", F.col("roi_id").cast("int").alias("roi_ord"), (F.col("roi_id").cast("double") / 2).alias("value"))
    return rounded(R.paint(px, values))


# Ids.


_IDS = """WITH ids AS (SELECT 'r' || r_regionkey AS id FROM region UNION SELECT 'r' || n_regionkey || '.n' || n_nationkey FROM nation UNION SELECT 'r' || n_regionkey || '.n' || n_nationkey || '.s' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


@query(_IDS + "SELECT id, len(string_split(id, '.')) AS depth, CASE WHEN len(string_split(id, '.')) > 1 THEN array_to_string(string_split(id, '.')[:-2], '.') END AS parent FROM ids")
def id_tree(spark, sf):
    return R.id_columns(T.region_ids(spark, sf)).select("id", F.col("depth").cast("bigint").alias("depth"), "parent")


@query(_IDS + "SELECT a.id, b.id AS ancestor, len(string_split(a.id, '.')) - len(string_split(b.id, '.')) AS distance FROM ids a JOIN ids b ON starts_with(a.id, b.id || '.')")
def roi_tree_closure(spark, sf):
    return R.ancestors(T.region_ids(spark, sf)).withColumn("distance", F.col("distance").cast("bigint"))


@query(_IDS + "SELECT id, len(string_split(id, '.')) AS depth, repeat('  ', len(string_split(id, '.')) - 1) || string_split(id, '.')[-1] AS label FROM ids")
def id_outline(spark, sf):
    return R.topological(T.region_ids(spark, sf)).select("id", F.col("depth").cast("bigint").alias("depth"), "label")


# Sets of sessions.


@query(f"SELECT o_orderkey, o_orderstatus AS session, {R5('CASE WHEN o_orderstatus = ' + chr(39) + 'F' + chr(39) + ' THEN o_totalprice * 2 ELSE o_totalprice END', 'value', 3)} FROM orders")
def update_session(spark, sf):
    rows = T.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("session"), F.col("o_totalprice").alias("value"))
    return rounded(S.update_session(rows, rows.where("session = 'F'").withColumn("value", F.col("value") * 2)), 3)


# Kernels on packed traces.


def _packed(spark, sf):
    return T.pack(T.traces(spark, sf))


@query(BASE + smoothed(7) + f"SELECT t.roi_id, t.frame, {R5('sg.s', 'value')} FROM tr t LEFT JOIN sg USING (roi_id, frame)")
def savgol_smooth(spark, sf):
    return rounded(E.savgol(T.traces(spark, sf), 7))


@query(BASE + smoothed(11) + f"SELECT t.roi_id, t.frame, {R5('t.value / nullif(sg.s, 0)', 'dff')}, {R5('sg.s', 'baseline')} FROM tr t LEFT JOIN sg USING (roi_id, frame)")
def savgol_dff(spark, sf):
    return rounded(G.filter_dff(T.traces(spark, sf), "savgol_mult", 11))


@query()
def double_exponential_dff(spark, sf):
    return rounded(G.filter_dff(T.traces(spark, sf), "2exp", 5), 3)


@query()
def highpass_filter(spark, sf):
    return rounded(RF.frequency_filter(T.traces(spark, sf), FS, ["<0.5"]))


def spectra_sql(source: str) -> str:
    """df (roi_id, seg, k, re, im): transforms of segments of 16 samples, 8 apart, under a Hann window, of a table (roi_id, frame, value)."""
    return f""", j AS (SELECT unnest(generate_series(0, 15)) AS j), hn AS (SELECT j, 0.5 - 0.5 * cos(2 * pi() * j / 16) AS h FROM j), kk AS (SELECT unnest(generate_series(0, 8)) AS k),
n0 AS (SELECT roi_id, max(frame) + 1 AS n FROM {source} GROUP BY 1), sn AS (SELECT roi_id, unnest(generate_series(0, CAST((n - 16) // 8 AS BIGINT))) AS seg FROM n0 WHERE n >= 16),
df AS (SELECT s.roi_id, s.seg, kk.k, sum(x.value * hn.h * cos(2 * pi() * kk.k * hn.j / 16)) AS re, -sum(x.value * hn.h * sin(2 * pi() * kk.k * hn.j / 16)) AS im
FROM sn s CROSS JOIN hn CROSS JOIN kk JOIN {source} x ON x.roi_id = s.roi_id AND x.frame = s.seg * 8 + hn.j GROUP BY ALL)
"""


_HOURLY = """WITH hh AS (SELECT event_type AS roi_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, avg(value) AS value FROM events GROUP BY ALL),
ho AS (SELECT roi_id, row_number() OVER (PARTITION BY roi_id ORDER BY hour) - 1 AS frame, value FROM hh)
"""


@query(
    BASE
    + spectra_sql("tr")
    + f"""SELECT roi_id, k / 16.0 * 10 AS frequency, {R5('avg(re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / (10 * (SELECT sum(h * h) FROM hn))', 'power', 4)} FROM df GROUP BY roi_id, k"""
)
def power_spectrum(spark, sf):
    return rounded(SP.power_spectrum(T.traces(spark, sf), FS, 16, 8), 4)


@query(
    _HOURLY
    + spectra_sql("ho")
    + f"""SELECT a.roi_id AS x, b.roi_id AS y, a.k / 16.0 AS frequency, {R5('least(1, greatest(0, coalesce((avg(a.re * b.re + a.im * b.im) ** 2 + avg(a.im * b.re - a.re * b.im) ** 2) / nullif(avg(a.re * a.re + a.im * a.im) * avg(b.re * b.re + b.im * b.im), 0), 0)))', 'coherence', 4)}
FROM df a JOIN df b ON a.roi_id <= b.roi_id AND a.seg = b.seg AND a.k = b.k GROUP BY a.roi_id, b.roi_id, a.k"""
)
def pairwise_coherence(spark, sf):
    """Coherence among event types on an hourly clock, all pairs."""
    return rounded(SP.pairwise_coherence(_hourly(spark, sf), 1.0, 16, 8), 4)


@query(
    _HOURLY
    + f""", n0 AS (SELECT roi_id, count(*) AS n FROM ho GROUP BY 1), pr AS (SELECT a.roi_id AS x, b.roi_id AS y, least(a.n, b.n) AS n FROM n0 a JOIN n0 b ON a.roi_id <= b.roi_id),
z AS (SELECT p.x, p.y, p.n, h.frame, h.roi_id = p.x AS own, h.roi_id = p.y AS other, h.value FROM pr p JOIN ho h ON h.roi_id IN (p.x, p.y) AND h.frame < p.n),
m AS (SELECT x, y, n, avg(value) FILTER (own) AS mx, stddev_pop(value) FILTER (own) AS sx, avg(value) FILTER (other) AS my, stddev_pop(value) FILTER (other) AS sy FROM z GROUP BY ALL)
SELECT m.x, m.y, l.lag, {R5('sum((a.value - mx) / CASE WHEN sx = 0 THEN 1 ELSE sx END * (b.value - my) / CASE WHEN sy = 0 THEN 1 ELSE sy END) / any_value(m.n)', 'r', 4)}
FROM m CROSS JOIN (SELECT unnest(generate_series(-5, 5)) AS lag) l JOIN ho a ON a.roi_id = m.x AND a.frame < m.n JOIN ho b ON b.roi_id = m.y AND b.frame < m.n AND a.frame = b.frame + l.lag
GROUP BY m.x, m.y, l.lag"""
)
def pairwise_cross_correlation(spark, sf):
    return rounded(G.pairwise_cross_correlation(T.pack(_hourly(spark, sf)), 5), 4)


def _hourly(spark, sf):
    rows = T.table(spark, sf, "events").select(F.col("event_type").alias("roi_id"), F.expr("cast(floor(unix_micros(cast(ts AS timestamp)) / 3600000000) AS bigint)").alias("frame"), "value")
    return SP.renumbered(rows.groupBy("roi_id", "frame").agg(F.avg("value").alias("value")))


@query()
def band_phase(spark, sf):
    return rounded(G.phase(_hourly(spark, sf), 1.0, 0.05, 0.2), 3)


@query()
def detect_peaks(spark, sf):
    return rounded(G.detect_peaks(_packed(spark, sf), 60.0, 3, 20.0, 50))


@query()
def randomized_svd(spark, sf):
    frames = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("pixels"))
    u, s, _ = K.randomized_svd(frames, RANK, 8)
    return rounded(u.select("frame", *[F.abs(F.get("u", F.lit(k)) * s[k]).alias(f"c{k}") for k in range(8)]), 3)


# Selections.


def _loud(spark, sf):
    cut = quantiles(T.traces(spark, sf), "value", [0.99])[0]
    return T.framed_events(spark, sf).where((F.col("event_type") == "error") & (F.col("value") > F.lit(cut)))


@query(BASE + "SELECT DISTINCT roi_id FROM tr WHERE roi_id IN (SELECT roi_id FROM ea)")
def spiking_rois(spark, sf):
    return L.spiking(T.traces(spark, sf).select("roi_id").distinct(), _errors(spark, sf))


@query(BASE + "SELECT DISTINCT roi_id FROM tr WHERE roi_id NOT IN (SELECT roi_id FROM fe WHERE event_type = 'error' AND value > (SELECT quantile_cont(value, 0.99) FROM tr))")
def silent_rois(spark, sf):
    """Rois without an error among the loudest hundredth of all samples."""
    return L.silent(T.traces(spark, sf).select("roi_id").distinct(), _loud(spark, sf))


@query(BASE + f"SELECT roi_id, frame, {R5('value', 'value')}, CASE roi_id WHEN '7' THEN 0 WHEN '3' THEN 1 ELSE 2 END AS ord FROM tr WHERE roi_id IN ('7', '3', '11')")
def select_rois(spark, sf):
    return rounded(L.select_rois(T.traces(spark, sf), ["7", "3", "11"]))


def _event_lists(spark, sf):
    return _errors(spark, sf).groupBy("roi_id").agg(F.array_sort(F.collect_list("frame")).alias("frames"))


@query(BASE + "SELECT roi_id, min(frame) AS first, max(frame) AS last FROM ea GROUP BY 1")
def select_events_by_index(spark, sf):
    lists = _event_lists(spark, sf)
    picks = lists.select("roi_id", F.array(F.lit(0), F.lit(-1)).alias("index"))
    found = L.select_events_by_index(lists, picks)
    return found.select("roi_id", F.get("frames", F.lit(0)).alias("first"), F.get("frames", F.lit(1)).alias("last"))


@query(BASE + "SELECT roi_id, frame FROM ea WHERE frame % 2 = 0")
def select_events_by_mask(spark, sf):
    lists = _event_lists(spark, sf)
    masks = lists.select("roi_id", F.transform("frames", lambda x: x % 2 == 0).alias("mask"))
    return L.select_events_by_mask(lists, masks).select("roi_id", F.explode("frames").alias("frame"))


@query(BASE + ', q AS (SELECT quantile_cont(v[1], 0.9) AS cut FROM px) SELECT "row", col FROM px, q WHERE v[1] >= cut')
def top_share_pixels(spark, sf):
    return L.top_share(_first_component(spark, sf), 90)


# Masks.


def _first_component(spark, sf):
    return T.pixel_codes(spark, sf).select("row", "col", F.get("v", F.lit(0)).alias("value"))


_SET = """, st AS (SELECT "row" AS r, col AS c FROM px WHERE v[1] >= 0), nb AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(dr, dc)),
er AS (SELECT CAST(r + dr AS INT) AS r, CAST(c + dc AS INT) AS c FROM st, nb GROUP BY ALL HAVING count(*) = 5)
"""


def _mask(spark, sf):
    """Pixels whose first component is not negative."""
    return _first_component(spark, sf).where("value >= 0").select("row", "col")


@query(BASE + _SET + 'SELECT r AS "row", c AS col FROM er')
def eroded_mask(spark, sf):
    return M.erode(_mask(spark, sf))


@query(BASE + _SET + 'SELECT DISTINCT CAST(r + dr AS INT) AS "row", CAST(c + dc AS INT) AS col FROM er, nb WHERE r + dr BETWEEN 0 AND (SELECT max("row") FROM px) AND c + dc BETWEEN 0 AND 24')
def opened_mask(spark, sf):
    return M.opened(_mask(spark, sf), _height(spark, sf), WIDTH)


@query(
    BASE
    + """, q AS (SELECT quantile_cont(v[1], 0.9) AS cut, quantile_cont(v[2], 0.98) AS top FROM px),
nb AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(dr, dc)), rg AS (SELECT DISTINCT "row" + dr AS r, col + dc AS c FROM px, nb, q WHERE v[2] >= top),
st AS (SELECT "row" AS r, col AS c FROM px, q WHERE v[1] <= cut AND NOT EXISTS (SELECT 1 FROM rg WHERE rg.r = px."row" AND rg.c = px.col)), er AS (SELECT r + dr AS r, c + dc AS c FROM st, nb GROUP BY ALL HAVING count(*) = 5)
SELECT DISTINCT CAST(r + dr AS INT) AS "row", CAST(c + dc AS INT) AS col FROM er, nb WHERE r + dr BETWEEN 0 AND (SELECT max("row") FROM px) AND c + dc BETWEEN 0 AND 24"""
)
def dark_mask(spark, sf):
    """Dark pixels of the first component, off the brightest of the second."""
    second = T.pixel_codes(spark, sf).select("row", "col", F.get("v", F.lit(1)).alias("value"))
    return M.dark_mask(_first_component(spark, sf), L.top_share(second, 98), 0.9, 1, _height(spark, sf), WIDTH)


@query(
    BASE
    + """, q AS (SELECT quantile_cont(v[1], 0.5) AS cut FROM px),
g AS (SELECT printf('r=%d c=%d', "row" // 5, col // 5) AS roi_id, "row", col FROM px, q WHERE v[1] >= cut) SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY roi_id) >= 12"""
)
def grid_regions(spark, sf):
    return M.grid_regions(L.top_share(_first_component(spark, sf), 50), 5, 12)


@query(
    BASE
    + f""", ref AS (SELECT event_idx, frame FROM ea WHERE roi_id = '0'), m AS (SELECT r.event_idx, e.roi_id, arg_min(e.frame, abs(e.frame - r.frame) * 1000000 + e.frame) AS f FROM ref r JOIN ea e ON abs(e.frame - r.frame) <= 3 GROUP BY ALL),
p AS (SELECT m.roi_id, m.event_idx, max(t.value) - min(t.value) AS ptt FROM m LEFT JOIN tr t ON t.roi_id = m.roi_id AND t.frame BETWEEN m.f AND m.f + 3 GROUP BY ALL), g AS (SELECT roi_id, avg(ptt) AS g FROM p GROUP BY 1)
SELECT px.roi_id, "row", col, {R5('g', 'magnitude')} FROM px JOIN g USING (roi_id)"""
)
def spatial_magnitudes(spark, sf):
    found = _errors(spark, sf)
    reference = found.where("roi_id = '0'").select("event_idx", "frame")
    return rounded(M.spatial_magnitudes(T.traces(spark, sf), reference, found, T.pixel_codes(spark, sf).select("roi_id", "row", "col"), 3, 3))


@query(
    BASE.replace("WITH ", "WITH RECURSIVE ", 1)
    + _CODES
    + f""", fit AS (SELECT b.roi_id, a."row" AS r, a.col AS c FROM px a CROSS JOIN co b WHERE {_COS} >= 0.05),
nb AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(dr, dc)),
g AS (SELECT roi_id, "row" AS r, col AS c FROM px UNION SELECT f.roi_id, f.r, f.c FROM g CROSS JOIN nb JOIN fit f ON f.roi_id = g.roi_id AND f.r = g.r + nb.dr AND f.c = g.c + nb.dc)
SELECT roi_id, r AS "row", c AS col FROM g"""
)
def grown_regions(spark, sf):
    px = T.pixel_codes(spark, sf)
    return M.grow(px.select("roi_id", "row", "col"), px, 0.05, RANK)


# Extraction.


@query(
    BASE
    + """, o AS (SELECT * FROM (SELECT unnest(generate_series(-3, 3)) AS dr) CROSS JOIN (SELECT unnest(generate_series(-3, 3)) AS dc)), z AS (SELECT * FROM px),
bg AS (SELECT DISTINCT roi_id, "row" + dr AS r, col + dc AS c FROM z, o WHERE abs(dr) + abs(dc) <= 2), sm AS (SELECT DISTINCT roi_id, "row" + dr AS r, col + dc AS c FROM z, o WHERE abs(dr) + abs(dc) <= 1),
rg AS (SELECT bg.roi_id, p.v FROM bg JOIN px p ON p."row" = bg.r AND p.col = bg.c WHERE NOT EXISTS (SELECT 1 FROM sm WHERE sm.roi_id = bg.roi_id AND sm.r = bg.r AND sm.c = bg.c)),
ex AS (SELECT roi_id, unnest(v) AS x, unnest(generate_series(1, 64)) AS k FROM rg), cd AS (SELECT roi_id, k, avg(x) AS x FROM ex GROUP BY ALL), co AS (SELECT roi_id, list(x ORDER BY k) AS v FROM cd GROUP BY 1)
"""
    + f"SELECT c.roi_id, e.vec_id AS frame, {R5('list_dot_product(c.v, CAST(e.embedding AS DOUBLE[]))', 'value')} FROM co c CROSS JOIN embeddings e"
)
def neuropil_traces(spark, sf):
    px = T.pixel_codes(spark, sf)
    return rounded(X.neuropil_traces(_codes_in_time(spark, sf), px, px, 1, 2, _height(spark, sf), WIDTH, RANK))


@query(
    BASE
    + _CODES
    + f""", t AS (SELECT c.roi_id, e.vec_id AS frame, list_dot_product(c.v, CAST(e.embedding AS DOUBLE[])) AS x FROM co c CROSS JOIN embeddings e)
SELECT roi_id, frame, {R5('x - sum(x) OVER (PARTITION BY frame) / (1 + count(*) OVER (PARTITION BY frame))', 'value', 4)} FROM t"""
)
def ols_traces(spark, sf):
    """All pixels are in one region each, so the background is a mixture of regions: of all solutions the SQL has the one of least norm."""
    px = T.pixel_codes(spark, sf)
    weights = px.select("roi_id", "row", "col", F.lit(1.0).alias("weight"))
    return rounded(X.ols_traces(_codes_in_time(spark, sf), px, weights, RANK), 4)


_SLOW = f"""WITH e AS (SELECT vec_id AS f, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(0, 63)) AS k FROM embeddings),
w AS (SELECT * FROM (VALUES {", ".join(f"({k - 5}, {w!r})" for k, w in enumerate(_quadratic(11, 5)))}) AS t(j, w)), n AS (SELECT max(f) AS last FROM e),
sl AS (SELECT a.f, a.k, any_value(a.x) AS x, sum(w.w * b.x) AS s FROM e a CROSS JOIN n CROSS JOIN w JOIN e b ON b.k = a.k AND b.f = greatest(0, least(a.f + w.j, n.last)) GROUP BY a.f, a.k)
"""


@query(_SLOW + f"SELECT f AS frame, k, {R5('x - s', 'x', 4)} FROM sl")
def subtractive_lowpass(spark, sf):
    found = X.subtractive_lowpass(_codes_in_time(spark, sf), 11, 2)
    return rounded(found.select("frame", F.posexplode("u").alias("k", "x")).select("frame", F.col("k").cast("bigint").alias("k"), "x"), 4)


@query()
def motion_correct(spark, sf):
    """Shifts of the embeddings read as pictures of 8 by 8 pixels, a component for each pixel."""
    return MC.find_shifts(_pictures(spark, sf), 8, 8, 3, hpf=2.0)


def _pictures(spark, sf) -> LowRank:
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(k == F.col("id"), 1.0).otherwise(0.0))
    v = spark.range(64).select(F.expr("cast(id div 8 AS int)").alias("row"), F.expr("cast(id % 8 AS int)").alias("col"), one.alias("v"))
    return LowRank(_codes_in_time(spark, sf), v, RANK)


@query()
def phase_window_means(spark, sf):
    return rounded(X.phase_means(X.phase_windows(T.traces(spark, sf), FS, 0.5, 2.0, 0.0, 10, 3)), 4)


@query(BASE + f", q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM tr) SELECT roi_id, frame, {R5('value', 'value')}, CAST(value >= e[1] AS INT) + CAST(value >= e[2] AS INT) + CAST(value >= e[3] AS INT) AS bin FROM tr, q")
def phase_bins(spark, sf):
    return rounded(X.phase_bins(T.traces(spark, sf), 4))


# Display.


@query(BASE + f"SELECT roi_id, frame, {R5('value', 'value')}, {R5('(frame - 5) / 10.0', 't')} FROM tr")
def time_axis(spark, sf):
    return rounded(D.time_axis(T.traces(spark, sf), FS, 5))


@query(BASE + f", s AS (SELECT 2.4 * max(abs(value)) AS s FROM tr), r AS (SELECT DISTINCT roi_id FROM tr) SELECT roi_id, {R5('CAST(roi_id AS INT) * CASE WHEN s > 0 THEN s ELSE 1 END', 'offset', 3)} FROM r, s")
def trace_offsets(spark, sf):
    t = T.traces(spark, sf)
    return rounded(D.trace_offsets(t, t.select("roi_id", F.col("roi_id").cast("int").alias("roi_ord")).distinct()), 3)


@query(BASE + f', e AS (SELECT max(abs(v[1])) AS m FROM px) SELECT "row", col, {R5("v[1]", "value")}, {R5("greatest(0, least(1, (v[1] + m) / (2 * m)))", "shade")} FROM px, e')
def color_scale_centered(spark, sf):
    return rounded(D.color_scale(_first_component(spark, sf), centered=True))


@query(BASE + f', e AS (SELECT quantile_cont(v[1], 0.02) AS a, quantile_cont(v[1], 0.98) AS b FROM px) SELECT "row", col, {R5("v[1]", "value")}, {R5("greatest(0, least(1, (v[1] - a) / (b - a)))", "shade")} FROM px, e')
def color_scale_robust(spark, sf):
    return rounded(D.color_scale(_first_component(spark, sf), robust=True))


@query(BASE + f'SELECT "row", col, {R5("greatest(0, least(1, v[1] * 0.5 * 2 + v[2] * 0.25))", "r")}, {R5("greatest(0, least(1, v[1] * 0.25 * 2))", "g")}, {R5("greatest(0, least(1, v[2] * 1.0))", "b")} FROM px')
def compose_rgb(spark, sf):
    px = T.pixel_codes(spark, sf)
    layer = lambda k: px.select("row", "col", F.get("v", F.lit(k)).alias("value"))
    return rounded(V.compose_rgb([(layer(0), (0.5, 0.25, 0.0), 2.0), (layer(1), (0.25, 0.0, 1.0), 1.0)]))


# Clocks.


def _points(spark, sf):
    return T.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("roi_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


@query(f"SELECT CAST(user_id AS VARCHAR) AS roi_id, event_id, {R5('CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END', 'mean')} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW)")
def trailing_mean(spark, sf):
    return rounded(J.trailing_mean(_points(spark, sf), 43200, 2).select("roi_id", "event_id", "mean"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS roi_id, epoch_us(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) AS bin_start, {R5('avg(value)', 'mean')}, count(*) AS n FROM events GROUP BY ALL")
def tumbling_stats(spark, sf):
    found = I.tumbling_stats(_points(spark, sf), "6 hours", "0 seconds")
    return rounded(found.withColumn("bin_start", F.unix_micros("bin_start")))


@query(f"SELECT CAST(user_id AS VARCHAR) AS roi_id, epoch_us(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) - k.k * 21600000000 AS bin_start, {R5('avg(value)', 'mean')}, count(*) AS n FROM events CROSS JOIN (VALUES (0), (1)) AS k(k) GROUP BY ALL")
def hopping_stats(spark, sf):
    found = I.hopping_stats(_points(spark, sf), "12 hours", "6 hours", "0 seconds")
    return rounded(found.withColumn("bin_start", F.unix_micros("bin_start")))


@query(
    """WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 14400000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, us, sum(s) OVER (PARTITION BY user_id ORDER BY us) AS b FROM g) SELECT CAST(user_id AS VARCHAR) AS roi_id, min(us) AS start, count(*) AS n FROM b GROUP BY user_id, b"""
)
def session_bursts(spark, sf):
    return I.session_bursts(_points(spark, sf), "4 hours", "0 seconds").withColumn("start", F.unix_micros("start"))


# Codes in time.


@query(
    f"""WITH e AS (SELECT vec_id AS f, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(0, 63)) AS k FROM embeddings), t AS (SELECT * FROM (VALUES (-1, 0.25), (0, 0.5), (1, 0.25)) AS t(o, w))
SELECT f + o AS frame, k, {R5('sum(x * w)', 'x')} FROM e CROSS JOIN t WHERE f + o BETWEEN 0 AND (SELECT max(vec_id) FROM embeddings) GROUP BY ALL"""
)
def temporal_convolution(spark, sf):
    found = V.convolve_temporal(_codes_in_time(spark, sf), [0.25, 0.5, 0.25])
    return rounded(found.select("frame", F.posexplode("u").alias("k", "x")).select("frame", F.col("k").cast("bigint").alias("k"), "x"))


@query(
    BASE
    + f""", e AS (SELECT "row" AS r, col AS c, unnest(v) AS x, unnest(generate_series(0, 63)) AS k FROM px), t AS (SELECT dr, dc, CASE WHEN dr = 0 AND dc = 0 THEN 0.5 ELSE 0.0625 END AS w FROM (SELECT unnest(generate_series(-1, 1)) AS dr) CROSS JOIN (SELECT unnest(generate_series(-1, 1)) AS dc))
SELECT r + dr AS "row", c + dc AS col, k, {R5('sum(x * w)', 'x')} FROM e CROSS JOIN t WHERE r + dr BETWEEN 0 AND (SELECT max("row") FROM px) AND c + dc BETWEEN 0 AND 24 GROUP BY ALL"""
)
def spatial_convolution(spark, sf):
    kernel = [[0.0625, 0.0625, 0.0625], [0.0625, 0.5, 0.0625], [0.0625, 0.0625, 0.0625]]
    found = N.convolve_image(T.pixel_codes(spark, sf), kernel, _height(spark, sf), WIDTH, RANK, fill=True).select("row", "col", F.posexplode("v").alias("k", "x"))
    return rounded(found.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("k").cast("bigint").alias("k"), "x"))


@query(f"SELECT vec_id AS frame, {R5('list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id / 100.0)))', 'total')} FROM embeddings")
def temporal_gain(spark, sf):
    u = _codes_in_time(spark, sf)
    weighted = V.gain(u, u.select("frame", (1 + F.col("frame") / 100).alias("weight")))
    return rounded(weighted.select("frame", A.array_sum("u").alias("total")))


@query(
    f"""WITH q AS (SELECT quantile_cont(CAST(embedding[1] AS DOUBLE), [0.25, 0.5, 0.75]) AS e FROM embeddings), b AS (SELECT CAST(embedding[1] >= e[1] AS INT) + CAST(embedding[1] >= e[2] AS INT) + CAST(embedding[1] >= e[3] AS INT) AS bin, embedding FROM embeddings, q),
x AS (SELECT bin, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(0, 63)) AS k FROM b) SELECT bin, k, {R5('avg(x)', 'x')} FROM x GROUP BY ALL"""
)
def phase_keyframes(spark, sf):
    u = _codes_in_time(spark, sf)
    phases = u.select("frame", F.get("u", F.lit(0)).alias("value"))
    return rounded(X.keyframes(phases, u, 4, RANK).select("bin", F.posexplode("code").alias("k", "x")).select("bin", F.col("k").cast("bigint").alias("k"), "x"))


@query(f"SELECT CAST(e.label AS VARCHAR) AS roi_id, e.vec_id AS event_idx, o.o AS \"offset\", {R5('CAST(m.embedding[1] AS DOUBLE)', 'x')} FROM embeddings e CROSS JOIN (SELECT unnest(generate_series(-1, 2)) AS o) o LEFT JOIN embeddings m ON m.vec_id = e.vec_id + o.o")
def event_codes(spark, sf):
    found = T.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("roi_id"), F.col("vec_id").alias("event_idx"), F.col("vec_id").alias("frame"))
    return rounded(X.event_codes(_codes_in_time(spark, sf), found, 1, 2).select("roi_id", "event_idx", "offset", F.get("u", F.lit(0)).alias("x")))


@query()
def orthogonal_video(spark, sf):
    px = T.pixel_codes(spark, sf)
    u, s, _ = V.orthogonal(_codes_in_time(spark, sf), [1.0] * RANK, px)
    return rounded(u.select("frame", F.abs(F.get("u", F.lit(0)) * s[0]).alias("first")), 4)


# More of regions and events.


@query(
    BASE
    + f""", r AS (SELECT DISTINCT roi_id AS trace_roi FROM tr), c AS (SELECT r.trace_roi, e.roi_id, e.event_idx, o.o AS "offset", t.value FROM ea e CROSS JOIN r CROSS JOIN (SELECT unnest(generate_series(0, 1)) AS o) o LEFT JOIN tr t ON t.roi_id = r.trace_roi AND t.frame = e.frame + o.o)
SELECT a.roi_id, a.event_idx, a."offset", a.trace_roi, {R5('a.value', 'value')}, {R5('b.value', 'reference')} FROM c a JOIN c b ON b.trace_roi = '0' AND b.roi_id = a.roi_id AND b.event_idx = a.event_idx AND b."offset" = a."offset" """
)
def against_reference(spark, sf):
    """All traces around each event of all rois, beside the trace of roi 0. Values are rounded before they meet the events: each is asked for many times."""
    return J.beside_reference(rounded(T.traces(spark, sf)), _errors(spark, sf), 0, 1, "0")


@query(
    BASE
    + f""", r AS (SELECT DISTINCT roi_id AS trace_roi FROM tr),
w AS (SELECT e.roi_id, o.o AS "offset", e.frame + o.o AS at, b.value AS ref FROM ea e CROSS JOIN (SELECT unnest(generate_series(0, 1)) AS o) o LEFT JOIN tr b ON b.roi_id = '0' AND b.frame = e.frame + o.o),
m AS (SELECT t.roi_id AS trace_roi, w.roi_id, w."offset", count(*) AS n, avg(t.value) AS x, stddev_pop(t.value) AS sx, avg(ref) AS r, stddev_pop(ref) AS sr, covar_pop(t.value, ref) AS c FROM w JOIN tr t ON t.frame = w.at WHERE t.value IS NOT NULL AND ref IS NOT NULL GROUP BY ALL)
SELECT r.trace_roi, g.roi_id, g."offset", coalesce(m.n, 0) AS n, {R5('m.x', 'mean')}, {R5('m.sx', 'std')}, {R5('m.r', 'ref_mean')}, {R5('m.sr', 'ref_std')}, {R5('m.c', 'cov')}
FROM r CROSS JOIN (SELECT DISTINCT roi_id, "offset" FROM w) g LEFT JOIN m ON m.trace_roi = r.trace_roi AND m.roi_id = g.roi_id AND m."offset" = g."offset" """
)
def reference_stats(spark, sf):
    """The same summed up over the events of a roi."""
    return rounded_made(RS.reference_stats(T.traces(spark, sf), _errors(spark, sf), 0, 1, "0"))


@query(
    BASE
    + """, c AS (SELECT roi_id, frame FROM (SELECT *, lag(value) OVER (PARTITION BY roi_id ORDER BY frame) AS b FROM tr) WHERE b < 50 AND value > 50), n AS (SELECT roi_id, count(*) AS n FROM tr GROUP BY 1),
i AS (SELECT c.roi_id, c.frame, row_number() OVER (PARTITION BY c.roi_id ORDER BY c.frame) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY c.roi_id) // 4) AS s FROM c JOIN n USING (roi_id) WHERE c.frame >= 3 AND c.frame < n.n - 3)
SELECT roi_id, frame FROM i WHERE k % s = 0 AND k // s < 4"""
)
def thinned_crossings(spark, sf):
    t = T.traces(spark, sf)
    return E.thin_events(E.crossings(t, 50.0), t.groupBy("roi_id").agg(F.count(F.lit(1)).alias("n")), 3, 4)


@query(BASE + """, a AS (SELECT roi_id, "row", col FROM px), b AS (SELECT roi_id, CAST("row" + 1 AS INT) AS "row", col FROM px)
SELECT *, 1 AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, -1 FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def pixel_changes(spark, sf):
    px = T.pixel_codes(spark, sf).select("roi_id", "row", "col")
    return R.pixel_changes(px, px.withColumn("row", F.col("row") + 1))


@query(
    """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
t AS (SELECT p AS root, c AS node, 1 AS depth FROM e UNION ALL SELECT t.root, e.c, t.depth + 1 FROM t JOIN e ON e.p = t.node) SELECT root, node, depth FROM t"""
)
def recursive_closure(spark, sf):
    n, s = T.table(spark, sf, "nation"), T.table(spark, sf, "supplier")
    named = lambda tag, c: F.concat(F.lit(tag), c)
    edges = n.select(named("r", "n_regionkey").alias("parent"), named("n", "n_nationkey").alias("child")).union(s.select(named("n", "s_nationkey"), named("s", "s_suppkey")))
    return R.recursive_closure(spark, edges)


@query(BASE + f'SELECT roi_id, "row", col, {R5("1.0 / count(*) OVER (PARTITION BY roi_id)", "weight")} FROM px')
def uniform_weights(spark, sf):
    return rounded(R.uniform_weights(T.pixel_codes(spark, sf).select("roi_id", "row", "col")))


@query()
def normalized_peaks(spark, sf):
    return rounded(X.normalized_peaks(T.traces(spark, sf), 5, 20, 0.5, 3, 0.5, 50), 4)


@query()
def spatial_survey(spark, sf):
    px = T.pixel_codes(spark, sf)
    options = {"grid": 4, "percentile": 40, "closing": 3, "least": 3, "dff_window": 51, "spike_window": 21, "sd_threshold": 1.5, "despike_window": 3, "despike_smooth": 21}
    return rounded(X.spatial_survey(_codes_in_time(spark, sf), px, _height(spark, sf), WIDTH, RANK, **options).events, 4)


from tracelake.plans import more  # noqa: E402, F401  its queries are registered too
