"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions.columns import rounded
from lithos.operators import cleaning as C
from lithos.operators import interpolation as I
from lithos.operators import petrophysics as P
from lithos.operators import seismic as S
from lithos.operators import spatial as X
from lithos.operators import reports, spectral, ties
from lithos.operators import wells as W
from lithos.plans import standins as D

FLAGSHIP = "interpretation"
_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    def add(f):
        name = f.__name__.lstrip("_")
        _queries[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


r = "round({0}, 6) + 0.0::DOUBLE AS {0}".format


def as_r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE AS {name}"


def clip(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END"


WELL = "PARTITION BY well_id"
INTERPRETED = f"""WITH {D.LOGS_SQL},
gaps AS (SELECT *, DEPT - lag(DEPT) OVER ({WELL} ORDER BY row_idx) AS gap FROM logs),
base AS (SELECT well_id, quantile_cont(GR, 0.05) AS lo, quantile_cont(GR, 0.95) AS hi, quantile_cont(gap, 0.5) AS step FROM gaps GROUP BY well_id),
a AS (SELECT logs.*, lo, hi, step, CASE WHEN hi IS NULL OR hi = lo THEN 0.0::DOUBLE ELSE (GR - lo) / (hi - lo) END AS igr0 FROM logs JOIN base USING (well_id)),
b AS (SELECT *, {clip("igr0", "0.0::DOUBLE", "1.0::DOUBLE")} AS igr FROM a),
c0 AS (SELECT *, 0.33::DOUBLE * (pow(2.0::DOUBLE, 2.0::DOUBLE * igr) - 1) AS v0, (2.65::DOUBLE - RHOB) / (2.65::DOUBLE - 1.0::DOUBLE) AS p0 FROM b),
c AS (SELECT *, {clip("v0", "0.0::DOUBLE", "1.0::DOUBLE")} AS VSH, {clip("p0", "0.0::DOUBLE", "0.5::DOUBLE")} AS PHIT FROM c0),
mx AS (SELECT well_id, PHIT AS shale FROM (SELECT *, row_number() OVER ({WELL} ORDER BY VSH DESC NULLS LAST, row_idx) AS k FROM c) WHERE k = 1),
d0 AS (SELECT c.*, PHIT - VSH * shale AS x FROM c JOIN mx USING (well_id)),
d AS (SELECT *, CASE WHEN x < 0 THEN 0.0::DOUBLE WHEN x > PHIT THEN PHIT ELSE x END AS PHIE FROM d0),
e0 AS (SELECT *, CASE WHEN PHIE > 1e-4 AND pow(PHIE, 2.0::DOUBLE) * RESISTIVITY > 0 THEN pow(0.05::DOUBLE / (pow(PHIE, 2.0::DOUBLE) * RESISTIVITY), 0.5::DOUBLE) END AS s0 FROM d),
e AS (SELECT *, CASE WHEN s0 IS NULL THEN 1.0::DOUBLE WHEN s0 > 1 THEN 1.0::DOUBLE WHEN s0 < 0 THEN 0.0::DOUBLE ELSE s0 END AS SWE FROM e0),
sw AS (SELECT well_id, SWE AS s1 FROM (SELECT *, row_number() OVER ({WELL} ORDER BY PHIE DESC NULLS LAST, row_idx) AS k FROM e) WHERE k = 1),
f AS (SELECT e.*, sum(coalesce(DT, 0.0::DOUBLE) * step / (2 * 3.28084::DOUBLE * 1e6::DOUBLE)) OVER ({WELL} ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS DPTM,
  coalesce(250.0::DOUBLE * pow(pow(PHIE, 3.0::DOUBLE) / greatest(CASE WHEN s1 IS NULL OR s1 <= 0 THEN 0.25::DOUBLE ELSE s1 END, 1e-3::DOUBLE), 2.0::DOUBLE), 0.0::DOUBLE) AS PERM_TIXIER,
  CASE WHEN RHOB > 2.7 AND NPHI < 0.15 AND GR < 0.6 * hi THEN {clip("(RHOB - 2.7::DOUBLE) / (2.9::DOUBLE - 2.7::DOUBLE)", "0.0::DOUBLE", "1.0::DOUBLE")} ELSE 0.0::DOUBLE END AS VVOLC,
  {clip("(CASE WHEN NPHI < PHIT THEN sqrt((PHIT * PHIT + NPHI * NPHI) / 2) ELSE (PHIT + NPHI) / 2 END)", "0.0::DOUBLE", "0.5::DOUBLE")} AS PHIE_DN,
  CASE WHEN VSH < 0.4 AND PHIE > 0.08 AND SWE < 0.5 THEN 1 WHEN VSH < 0.4 AND PHIE > 0.08 AND SWE < 0.65 THEN 2 ELSE 3 END AS ZONES FROM e JOIN sw USING (well_id)),
it AS (SELECT *, CASE ZONES WHEN 1 THEN 'Pay' WHEN 2 THEN 'Reservoir (non-pay)' ELSE 'Non-reservoir' END AS ZONES_LABEL FROM f)
"""


def interpreted(spark, sf_dir: str, wells: DataFrame | None = None) -> DataFrame:
    return P.interpretation(D.logs(spark, sf_dir, wells))


@query(INTERPRETED + f"SELECT well_id, row_idx, {', '.join(r(c) for c in ('VSH', 'PHIT', 'PHIE', 'PHIE_DN', 'SWE', 'PERM_TIXIER', 'VVOLC'))}, {as_r('DPTM * 1000', 'dptm_ms')}, {as_r('DEPT', 'tvd')}, ZONES AS zone, ZONES_LABEL AS label FROM it")
def interpretation(spark, sf_dir):
    d = interpreted(spark, sf_dir)
    return d.select("well_id", "row_idx", "VSH", "PHIT", "PHIE", "PHIE_DN", "SWE", "PERM_TIXIER", "VVOLC", (F.col("DPTM") * 1000).alias("dptm_ms"), F.col("TVD").alias("tvd"), F.col("ZONES").alias("zone"), F.col("ZONES_LABEL").alias("label"))


SUMMARY = """SELECT well_id, max_by(DEPT, row_idx) - min_by(DEPT, row_idx) AS footage, avg(VSH) AS mean_vsh, avg(PHIE) AS mean_phie, avg(SWE) AS mean_swe, count(*) FILTER (ZONES = 1) * max(step) AS net_pay FROM it GROUP BY well_id"""


@query(INTERPRETED + f"SELECT well_id, {', '.join(r(c) for c in ('footage', 'mean_vsh', 'mean_phie', 'mean_swe', 'net_pay'))} FROM ({SUMMARY})")
def well_summary(spark, sf_dir):
    return W.well_summary(interpreted(spark, sf_dir))


@query(INTERPRETED + f"""SELECT well_id, z.zone, z.label, coalesce(n, 0) AS n_samples, {as_r('coalesce(n, 0) * step', 'thickness')}, {r('mean_vsh')}, {r('mean_phie')}, {r('mean_swe')}
FROM (SELECT well_id, max(step) AS step FROM it GROUP BY well_id) w
CROSS JOIN (VALUES (1, 'Pay'), (2, 'Reservoir (non-pay)'), (3, 'Non-reservoir')) z(zone, label)
LEFT JOIN (SELECT well_id, ZONES AS zone, count(*) AS n, avg(VSH) AS mean_vsh, avg(PHIE) AS mean_phie, avg(SWE) AS mean_swe FROM it GROUP BY well_id, ZONES) s USING (well_id, zone)""")
def zone_summary(spark, sf_dir):
    return W.zone_summary(interpreted(spark, sf_dir))


@query(INTERPRETED + f"SELECT count(*) AS n_wells, {as_r('sum(footage)', 'total_footage')}, {as_r('sum(net_pay)', 'total_net_pay')}, {', '.join(as_r(f'avg({c})', c) for c in ('mean_vsh', 'mean_phie', 'mean_swe'))} FROM ({SUMMARY})")
def field_summary(spark, sf_dir):
    return W.field_summary(interpreted(spark, sf_dir))


@query(INTERPRETED + f"SELECT well_id, {as_r('coalesce(net_pay, 0)', 'net_pay')}, CAST(row_number() OVER (ORDER BY coalesce(net_pay, 0) DESC, well_id) AS INTEGER) AS rank FROM ({SUMMARY})")
def net_pay_ranking(spark, sf_dir):
    return W.net_pay_ranking(interpreted(spark, sf_dir))


@query(f"{INTERPRETED.rstrip()}, {D.NUMBERS_SQL} SELECT w.well_id, {as_r('mean_phie', 'value')} FROM (SELECT well_id FROM wn UNION ALL SELECT 'NONE') w LEFT JOIN ({SUMMARY}) s ON s.well_id = w.well_id")
def compare_wells(spark, sf_dir):
    none = spark.createDataFrame([("NONE",)], "well_id string")
    return W.compare(interpreted(spark, sf_dir), D.numbers(spark, sf_dir).select("well_id").unionByName(none), "mean_phie")


@query(INTERPRETED + f"SELECT well_id, row_idx, {r('DEPT')}, {as_r('NPHI', 'x')}, {as_r('RHOB', 'y')}, {as_r('VSH', 'color')} FROM it")
def crossplot_neutron_density(spark, sf_dir):
    return W.crossplot(interpreted(spark, sf_dir), "NPHI", "RHOB", "VSH")


@query(INTERPRETED + f"SELECT well_id, row_idx, {as_r('ln(RESISTIVITY) / ln(10.0::DOUBLE)', 'log_rt')}, {as_r('ln(PHIE) / ln(10.0::DOUBLE)', 'log_phie')} FROM it WHERE RESISTIVITY > 0 AND PHIE > 0")
def crossplot_pickett(spark, sf_dir):
    d = interpreted(spark, sf_dir).where("RESISTIVITY > 0 AND PHIE > 0")
    return d.select("well_id", "row_idx", F.log10("RESISTIVITY").alias("log_rt"), F.log10("PHIE").alias("log_phie"))


@query(f"WITH {D.LOGS_SQL} SELECT well_id, count(*) AS n, {as_r('avg(GR)', 'mean')}, {as_r('min(GR)', 'low')}, {as_r('max(GR)', 'high')} FROM logs WHERE DEPT >= 1010 AND DEPT <= 1080 AND GR IS NOT NULL GROUP BY well_id")
def curve_statistics(spark, sf_dir):
    return W.curve_statistics(D.logs(spark, sf_dir), "GR", 1010.0, 1080.0)


@query(f"WITH {D.LOGS_SQL} SELECT well_id, k, {r('DEPT')}, {as_r('GR', 'value')} FROM (SELECT *, CAST(row_number() OVER ({WELL} ORDER BY row_idx) AS INTEGER) AS k FROM logs WHERE GR IS NOT NULL) WHERE k <= 50")
def curve_head(spark, sf_dir):
    return W.curve_head(D.logs(spark, sf_dir), "GR")


@query(f"WITH {D.RAW_SQL} SELECT well_id, {', '.join(f'count(*) FILTER (abs({c} + 9999.25) <= 0.11) AS n_{c}' for c in C.CURVES)} FROM raw GROUP BY well_id")
def null_counts(spark, sf_dir):
    return C.null_counts(D.raw_logs(spark, sf_dir))


@query(f"WITH {D.LOGS_SQL}, g AS (SELECT *, DEPT - lag(DEPT) OVER ({WELL} ORDER BY row_idx) AS gap FROM logs) SELECT well_id, {as_r('min_by(DEPT, row_idx)', 'start_depth')}, {as_r('max_by(DEPT, row_idx)', 'stop_depth')}, {as_r('quantile_cont(gap, 0.5)', 'step')} FROM g GROUP BY well_id")
def depth_profile(spark, sf_dir):
    return C.depth_profile(D.logs(spark, sf_dir))


@query(f"WITH {D.LOGS_SQL}, m AS (SELECT well_id, quantile_cont(DT, 0.5) AS median FROM logs GROUP BY well_id) SELECT well_id, {r('median')}, CASE WHEN median BETWEEN 20 AND 160 THEN 'us_per_ft' WHEN median BETWEEN 100 AND 550 THEN 'us_per_m' END AS unit FROM m")
def unit_inference(spark, sf_dir):
    return C.infer_unit(D.logs(spark, sf_dir))


WASHOUT = f"""WITH {D.LOGS_SQL},
w AS (SELECT *, count(*) OVER ({WELL}) AS n, row_number() OVER ({WELL} ORDER BY row_idx) AS k, stddev_pop(DT) OVER ({WELL}) AS alld,
  quantile_cont(DT, 0.5) OVER f AS med, stddev_pop(DT) OVER f AS dev FROM logs WINDOW f AS ({WELL} ORDER BY row_idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
v AS (SELECT *, greatest(dev, 0.1 * alld) AS s FROM w),
u AS (SELECT well_id, row_idx, DEPT, DT IS NOT NULL AND NPHI IS NOT NULL AND RHOB IS NOT NULL AND (coalesce(abs((2.65 - RHOB) / 1.65 - NPHI) > 0.15, false)
  OR (k > 10 AND k <= n - 10 AND coalesce(CASE WHEN s > 0 THEN abs(DT - med) / s ELSE 0 END > 3.0, false))) AS washout FROM v)
"""


@query(WASHOUT + "SELECT well_id, row_idx, washout FROM u")
def washout(spark, sf_dir):
    return C.washout(D.logs(spark, sf_dir)).select("well_id", "row_idx", "washout")


@query(WASHOUT + f", i AS (SELECT *, row_idx - row_number() OVER ({WELL} ORDER BY row_idx) AS g FROM u WHERE washout) SELECT well_id, {as_r('min(DEPT)', 'top')}, {as_r('max(DEPT)', 'bottom')}, count(*) AS n FROM i GROUP BY well_id, g")
def washout_intervals(spark, sf_dir):
    return W.intervals(C.washout(D.logs(spark, sf_dir)), "washout")


@query(f"""WITH {D.LOGS_SQL}, m AS (SELECT well_id, row_idx, RESISTIVITY AS x, quantile_cont(RESISTIVITY, 0.5) OVER ({WELL}) AS med, sqrt(avg(RESISTIVITY * RESISTIVITY) OVER ({WELL})) AS q FROM logs),
d AS (SELECT *, quantile_cont(abs(x - med), 0.5) OVER ({WELL}) AS mad FROM m)
SELECT well_id, row_idx, round(CASE WHEN abs(x - med) > 1.5 * greatest(mad, 0.15 * q) THEN 0.0::DOUBLE ELSE x END, 6) + 0.0::DOUBLE AS despiked FROM d""")
def despike(spark, sf_dir):
    return C.despike(D.logs(spark, sf_dir), "RESISTIVITY", ["well_id"], k=1.5).select("well_id", "row_idx", "despiked")


@query(f"WITH {D.WELLS_SQL}, h AS (SELECT well_id, wx AS x, wy AS y, value AS kb, 1000.0::DOUBLE + point_id % 5 * 1000 AS td, 1000.0::DOUBLE AS stop FROM wells), g AS (SELECT *, coalesce(td / stop BETWEEN 2.8 AND 4.2, false) AS in_feet FROM h) SELECT well_id, in_feet, {', '.join(as_r(f'CASE WHEN in_feet THEN {c} * 0.3048 ELSE {c} END', c) for c in ('x', 'y', 'kb', 'td'))} FROM g")
def header_units(spark, sf_dir):
    w = D.wells(spark, sf_dir).select("well_id", F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("value").alias("kb"), (1000.0 + F.col("point_id") % 5 * 1000).alias("td"), F.lit(1000.0).alias("stop"))
    return C.standardise_header(w).drop("stop")


NEAR = f"WITH {D.WELLS_SQL}, {D.TRACES_SQL}, d AS (SELECT point_id, trace_idx, sqrt((wx - tx) ** 2 + (wy - ty) ** 2) AS distance FROM wells JOIN traces ON wx IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, trace_idx) AS rank FROM d WHERE distance <= 150)"


def points(spark, sf_dir):
    return D.wells(spark, sf_dir).select("point_id", F.col("wx").alias("px"), F.col("wy").alias("py"))


def targets(spark, sf_dir):
    return D.traces(spark, sf_dir).withColumnRenamed("trace_idx", "target_id")


@query(NEAR + f" SELECT w.point_id, k.trace_idx AS target_id, {r('distance')} FROM wells w LEFT JOIN k ON k.point_id = w.point_id AND rank = 1")
def nearest_trace(spark, sf_dir):
    return X.nearest(points(spark, sf_dir), targets(spark, sf_dir), 150.0)


@query(NEAR.replace("WHERE distance <= 150", "") + f" SELECT w.point_id, k.trace_idx AS target_id, {r('distance')} FROM wells w LEFT JOIN k ON k.point_id = w.point_id AND rank = 1")
def nearest_trace_anywhere(spark, sf_dir):
    return X.nearest(points(spark, sf_dir), targets(spark, sf_dir))


@query(NEAR + f" SELECT point_id, trace_idx AS target_id, {r('distance')}, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 12")
def neighbour_traces(spark, sf_dir):
    return X.neighbours(points(spark, sf_dir), targets(spark, sf_dir), 150.0, 12)


@query(f"WITH {D.WELLS_SQL}, {D.TRACES_SQL}, j AS (SELECT trace_idx, value, pow(greatest(sqrt((wx - tx) ** 2 + (wy - ty) ** 2), 1.0), -2.0) AS w FROM traces JOIN wells ON wx IS NOT NULL) SELECT trace_idx AS cell_id, {as_r('sum(w * value) / sum(w)', 'value')} FROM j GROUP BY trace_idx")
def idw_map(spark, sf_dir):
    w = D.wells(spark, sf_dir).where("wx IS NOT NULL").select("wx", "wy", "value")
    return X.idw(D.traces(spark, sf_dir).select(F.col("trace_idx").alias("cell_id"), F.col("tx").alias("x"), F.col("ty").alias("y")), w)


FIT = f"WITH {D.WELLS_SQL}, {D.TRACES_SQL}, w AS (SELECT count(*) AS n, min(wx) AS lx, max(wx) AS hx, min(wy) AS ly, max(wy) AS hy FROM wells WHERE wx IS NOT NULL), s AS (SELECT min(tx) AS ltx, max(tx) AS htx, min(ty) AS lty, max(ty) AS hty FROM traces), f AS (SELECT n, (htx - ltx) / (hx - lx) AS a, ltx - (htx - ltx) / (hx - lx) * lx AS b, (hty - lty) / (hy - ly) AS c, lty - (hty - lty) / (hy - ly) * ly AS d FROM w, s)"


@query(FIT + f" SELECT n, {', '.join(r(c) for c in 'abcd')} FROM f")
def axis_calibration(spark, sf_dir):
    return X.axis_fit(D.wells(spark, sf_dir), targets(spark, sf_dir))


@query(FIT + f" SELECT well_id, {as_r('a * wx + b', 'cx')}, {as_r('c * wy + d', 'cy')} FROM wells, f")
def calibrated_wells(spark, sf_dir):
    w = D.wells(spark, sf_dir)
    return X.calibrated(w, X.axis_fit(w, targets(spark, sf_dir))).select("well_id", "cx", "cy")


@query(f"""WITH {D.WELLS_SQL}, {D.TRACES_SQL}, o AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS well_id, CAST(s_suppkey % 10 AS INTEGER) AS inline, CAST(s_suppkey AS INTEGER) AS crossline FROM supplier WHERE s_suppkey % 4 = 0),
b AS (SELECT well_id, min(trace_idx) AS t FROM o JOIN traces USING (inline, crossline) GROUP BY well_id),
k AS (SELECT well_id, trace_idx, sqrt((wx - tx) ** 2 + (wy - ty) ** 2) AS distance FROM wells JOIN traces ON wx IS NOT NULL),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY distance, trace_idx) AS q FROM k WHERE distance <= 150) WHERE q = 1)
SELECT w.well_id, coalesce(b.t, n.trace_idx) AS trace_idx, CASE WHEN b.t IS NOT NULL THEN 'override' WHEN n.trace_idx IS NOT NULL THEN 'nearest' END AS method, round(CASE WHEN b.t IS NULL THEN distance END, 6) + 0.0::DOUBLE AS distance
FROM wells w LEFT JOIN b ON b.well_id = w.well_id LEFT JOIN n ON n.well_id = w.well_id""")
def resolve_trace(spark, sf_dir):
    w = D.wells(spark, sf_dir)
    o = w.where("point_id % 4 = 0").select("well_id", (F.col("point_id") % 10).cast("int").alias("inline"), F.col("point_id").cast("int").alias("crossline"))
    return X.resolve_trace(w, o, targets(spark, sf_dir), 150.0)


@query(f"""WITH {D.WELLS_SQL}, s AS (SELECT DISTINCT 's' || CAST(s_nationkey AS VARCHAR) AS sheet FROM supplier), w AS (SELECT well_id || CASE WHEN point_id % 2 = 0 THEN '_RAW' ELSE '' END AS well_id FROM wells),
m AS (SELECT w.well_id, sheet, row_number() OVER (PARTITION BY w.well_id ORDER BY length(sheet) DESC, sheet) AS k FROM w JOIN s ON lower(w.well_id) = sheet OR (starts_with(lower(w.well_id), sheet) AND NOT regexp_matches(substr(w.well_id, length(sheet) + 1, 1), '[A-Za-z0-9]')))
SELECT w.well_id, m.sheet FROM w LEFT JOIN m ON m.well_id = w.well_id AND k = 1""")
def checkshot_sheet(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    sheets = s.select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("sheet")).distinct()
    w = D.wells(spark, sf_dir).select(F.concat("well_id", F.when(F.col("point_id") % 2 == 0, "_RAW").otherwise("")).alias("well_id"))
    return X.prefix_match(sheets, w)


ASKS = "asks AS (SELECT 'W' || CAST(p_partkey % 20 AS VARCHAR) AS well_id, p_partkey AS ask_id, 995.0::DOUBLE + (p_partkey * 53 % 1150) * 0.1::DOUBLE AS x FROM part)"


def asks(spark, sf_dir):
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("W"), (k % 20).cast("string")).alias("well_id"), k.alias("ask_id"), (995.0 + (k * 53 % 1150) * 0.1).alias("x"))


def interpolation_sql(outside: str) -> str:
    return f"""WITH {D.LOGS_SQL}, {ASKS}, k AS (SELECT well_id, DEPT AS kx, GR AS y FROM logs WHERE GR IS NOT NULL),
lo AS (SELECT a.*, k.kx AS x0, k.y AS y0 FROM asks a ASOF LEFT JOIN k ON a.well_id = k.well_id AND a.x >= k.kx),
bo AS (SELECT a.*, k.kx AS x1, k.y AS y1 FROM lo a ASOF LEFT JOIN k ON a.well_id = k.well_id AND a.x <= k.kx)
SELECT well_id, ask_id, {r('x')}, round(CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END ELSE {outside} END, 6) + 0.0::DOUBLE AS value FROM bo"""


def interpolated(spark, sf_dir, ends):
    return I.interpolate(asks(spark, sf_dir), D.logs(spark, sf_dir).select("well_id", F.col("DEPT").alias("x"), F.col("GR").alias("y")), ["well_id"], ends)


@query(interpolation_sql("NULL"))
def curve_at_depth(spark, sf_dir):
    return interpolated(spark, sf_dir, "null")


@query(interpolation_sql("coalesce(y0, y1)"))
def curve_at_depth_clamped(spark, sf_dir):
    return interpolated(spark, sf_dir, "clamp")


TWT = f"""WITH {D.LOGS_SQL}, s AS (SELECT * FROM logs WHERE DT > 0 AND RHOB > 0),
t AS (SELECT *, coalesce((DEPT - lag(DEPT) OVER w) / 0.3048 * (DT + lag(DT) OVER w), 0) AS rise, 0.3048 * 1e6 / DT * RHOB AS ai FROM s WINDOW w AS ({WELL} ORDER BY row_idx)),
tw AS (SELECT *, sum(rise) OVER ({WELL} ORDER BY row_idx ROWS UNBOUNDED PRECEDING) / 1000.0 AS twt_ms, lead(ai) OVER ({WELL} ORDER BY row_idx) AS nxt FROM t)"""


def valid(spark, sf_dir, wells=None):
    return D.logs(spark, sf_dir, wells).where("DT > 0 AND RHOB > 0")


@query(TWT + f" SELECT well_id, row_idx, {r('twt_ms')} FROM tw")
def depth_to_time(spark, sf_dir):
    return ties.depth_to_twt(valid(spark, sf_dir)).select("well_id", "row_idx", "twt_ms")


@query(TWT + f" SELECT well_id, row_idx, {as_r('ai', 'AI')}, round(CASE WHEN nxt + ai <> 0 THEN (nxt - ai) / (nxt + ai) ELSE 0 END, 9) + 0.0::DOUBLE AS rc FROM tw WHERE nxt IS NOT NULL".replace("round(ai, 6)", "round(ai, 3)"))
def reflectivity(spark, sf_dir):
    return ties.reflectivity(ties.impedance(valid(spark, sf_dir))).select("well_id", "row_idx", F.round("AI", 3).alias("AI"), F.round("RC", 9).alias("rc"))


_queries["reflectivity"] = reflectivity

RICKER = "ricker AS (SELECT f AS frequency, i, -64.0::DOUBLE + i * 2.0::DOUBLE AS t_ms, (1 - 2 * pow(pi() * f * (-64.0 + i * 2.0) / 1000.0, 2)) * exp(-pow(pi() * f * (-64.0 + i * 2.0) / 1000.0, 2)) AS amplitude FROM (SELECT DISTINCT 8.0::DOUBLE + 2.0::DOUBLE * s_nationkey AS f FROM supplier UNION SELECT 30.0::DOUBLE), (SELECT CAST(unnest(range(64)) AS INTEGER) AS i))"


@query(f"WITH {RICKER} SELECT frequency, i, t_ms, {r('amplitude')} FROM ricker")
def ricker_wavelets(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((8.0 + 2.0 * F.col("s_nationkey")).alias("frequency"))
    return ties.wavelet_table(asked.union(spark.createDataFrame([(30.0,)], "frequency double")).distinct(), 2.0)


@query(TWT + f""", {RICKER}, rc AS (SELECT well_id, row_number() OVER ({WELL} ORDER BY row_idx) - 1 AS i, (nxt - ai) / (nxt + ai) AS x FROM tw WHERE nxt IS NOT NULL),
p AS (SELECT well_id, rc.i + w.i - 31 AS i, x * amplitude AS p FROM rc, ricker w WHERE frequency = 30), n AS (SELECT well_id, max(i) + 1 AS n FROM rc GROUP BY well_id)
SELECT well_id, i, {as_r('sum(p)', 'value')} FROM p JOIN n USING (well_id) WHERE i >= 0 AND i < n GROUP BY well_id, i""")
def synthetic_seismogram(spark, sf_dir):
    from pyspark.sql import Window

    rc = ties.reflectivity(ties.impedance(valid(spark, sf_dir)))
    rc = rc.withColumn("i", F.row_number().over(Window.partitionBy("well_id").orderBy("row_idx")) - 1).select("well_id", "i", F.col("RC").alias("x"))
    w = ties.wavelet_table(spark.createDataFrame([(30.0,)], "frequency double"), 2.0).select(F.col("i").alias("k"), F.col("amplitude").alias("w"))
    out = ties.convolve(rc, w, ["well_id"])
    return out.select("well_id", F.col("i").cast("long").alias("i"), "value")


LAGS = f"""WITH {D.TRACES_SQL}, s AS (SELECT trace_idx AS key, generate_subscripts(samples, 1) - 1 AS i, unnest(samples) AS a FROM traces),
b AS (SELECT key, i, a, CASE WHEN i % 64 >= 3 THEN lag(a, 3) OVER (PARTITION BY key ORDER BY i) END AS b FROM s),
l AS (SELECT x.key, lag AS lag, x.a AS a, y.b AS b FROM b x, (SELECT CAST(unnest(range(-5, 6)) AS INTEGER) AS lag) JOIN b y ON y.key = x.key AND y.i = x.i + lag WHERE y.b IS NOT NULL AND x.a IS NOT NULL),
c AS (SELECT key, lag, CASE WHEN count(*) >= 2 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS r FROM l GROUP BY key, lag)"""


@query(LAGS + " SELECT key, round(r, 6) + 0.0::DOUBLE AS r, lag FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(r, 9) DESC NULLS LAST, lag) AS q FROM c) WHERE q = 1")
def best_lag(spark, sf_dir):
    from pyspark.sql import Window

    s = D.traces(spark, sf_dir).select(F.col("trace_idx").alias("key"), F.posexplode("samples").alias("i", "a"))
    s = s.withColumn("b", F.lag("a", 3).over(Window.partitionBy("key").orderBy("i")))
    return ties.best_lag(ties.lag_correlation(s, 5))


SPEC = f"""WITH {D.TRACES_SQL}, s AS (SELECT dataset_id, trace_idx, generate_subscripts(samples, 1) - 1 AS i, unnest(samples) AS x FROM traces),
g AS (SELECT dataset_id, trace_idx, bin, sum(x * cos(2 * pi() * (bin * i % 64) / 64)) AS re, sum(x * sin(2 * pi() * (bin * i % 64) / 64)) AS im FROM s, (SELECT CAST(unnest(range(33)) AS INTEGER) AS bin) GROUP BY ALL),
sp AS (SELECT dataset_id, trace_idx, bin, bin * 1000.0::DOUBLE / 128.0::DOUBLE AS frequency, sqrt(re * re + im * im) AS magnitude FROM g)"""


@query(SPEC + f" SELECT dataset_id, trace_idx, bin, frequency, {r('magnitude')} FROM sp")
def spectrum(spark, sf_dir):
    return S.spectrum(D.traces(spark, sf_dir))


@query(SPEC + f" SELECT dataset_id, bin, frequency, {as_r('avg(magnitude)', 'magnitude')} FROM sp GROUP BY dataset_id, bin, frequency")
def average_spectrum(spark, sf_dir):
    return S.average_spectrum(S.spectrum(D.traces(spark, sf_dir)))


@query(SPEC + " SELECT dataset_id, trace_idx, frequency AS dominant_freq_hz FROM (SELECT *, row_number() OVER (PARTITION BY trace_idx ORDER BY round(magnitude, 9) DESC, bin) AS q FROM sp) WHERE q = 1")
def dominant_frequency(spark, sf_dir):
    return S.dominant_frequency(S.spectrum(D.traces(spark, sf_dir)))


RMS = f"WITH {D.TRACES_SQL}, attr AS (SELECT dataset_id, trace_idx, sqrt(list_sum([x * x FOR x IN samples]) / len(samples)) AS rms_amplitude, list_sum([abs(x) FOR x IN samples]) / len(samples) AS avg_envelope FROM traces)"


@query(RMS + f" SELECT trace_idx, {r('rms_amplitude')} FROM attr")
def rms_amplitude(spark, sf_dir):
    return D.traces(spark, sf_dir).select("trace_idx", S.rms().alias("rms_amplitude"))


@query(RMS + f""", q AS (SELECT quantile_cont(rms_amplitude, 0.02) AS rl, quantile_cont(rms_amplitude, 0.98) AS rh, quantile_cont(avg_envelope, 0.02) AS el, quantile_cont(avg_envelope, 0.98) AS eh, quantile_cont(avg_envelope, 0.9) AS b FROM attr),
n AS (SELECT trace_idx, avg_envelope > b AS bright, ({clip('rms_amplitude', 'rl', 'rh')} - rl) / (rh - rl) AS rn, ({clip('avg_envelope', 'el', 'eh')} - el) / (eh - el) AS en FROM attr, q)
SELECT trace_idx, {as_r('en', 'vsh_proxy')}, {as_r('1 - rn', 'phie_proxy')}, {as_r('CASE WHEN bright THEN (1 - rn) * 0.4 ELSE 1 - rn END', 'swe_proxy')} FROM n""")
def amplitude_proxies(spark, sf_dir):
    t = D.traces(spark, sf_dir).select("dataset_id", "trace_idx", S.rms().alias("rms_amplitude"), (S.total("samples", F.abs) / F.size("samples")).alias("avg_envelope"))
    return S.proxies(t).select("trace_idx", "vsh_proxy", "phie_proxy", "swe_proxy")


SAMPLES = "smp AS (SELECT trace_idx, CAST(generate_subscripts(samples, 1) - 1 AS INTEGER) AS i, unnest(samples) AS x FROM traces)"
#: The analytic signal of 64 samples by the kernel of the discrete Hilbert transform.
HILBERT = f"""{SAMPLES},
hk AS (SELECT CAST(unnest(range(-63, 64)) AS INTEGER) AS lag), hil AS (SELECT lag, CASE WHEN lag % 2 <> 0 THEN 2.0::DOUBLE / 64 / tan(pi() * lag / 64) ELSE 0.0::DOUBLE END AS h FROM hk),
ana AS (SELECT o.trace_idx, o.i, any_value(o.x) AS x, sum(s.x * h) AS y FROM smp o JOIN smp s ON s.trace_idx = o.trace_idx JOIN hil ON lag = o.i - s.i GROUP BY o.trace_idx, o.i)"""


@query(f"""WITH {SPEC[5:]}, {HILBERT}, env AS (SELECT trace_idx, avg(sqrt(x * x + y * y)) AS avg_envelope FROM ana GROUP BY trace_idx),
dom AS (SELECT trace_idx, frequency AS dominant_freq_hz FROM (SELECT *, row_number() OVER (PARTITION BY trace_idx ORDER BY round(magnitude, 9) DESC, bin) AS q FROM sp) WHERE q = 1),
attr AS (SELECT dataset_id, trace_idx, sqrt(list_sum([v * v FOR v IN samples]) / len(samples)) AS rms_amplitude, avg_envelope, dominant_freq_hz FROM traces JOIN env USING (trace_idx) JOIN dom USING (trace_idx)),
q AS (SELECT quantile_cont(rms_amplitude, 0.02) AS rl, quantile_cont(rms_amplitude, 0.98) AS rh, quantile_cont(avg_envelope, 0.02) AS el, quantile_cont(avg_envelope, 0.98) AS eh, quantile_cont(avg_envelope, 0.9) AS b FROM attr),
n AS (SELECT attr.*, avg_envelope > b AS bright, ({clip('rms_amplitude', 'rl', 'rh')} - rl) / (rh - rl) AS rn, ({clip('avg_envelope', 'el', 'eh')} - el) / (eh - el) AS en FROM attr, q)
SELECT dataset_id, trace_idx, {r('rms_amplitude')}, {r('avg_envelope')}, dominant_freq_hz, {as_r('en', 'vsh_proxy')}, {as_r('1 - rn', 'phie_proxy')}, {as_r('CASE WHEN bright THEN (1 - rn) * 0.4 ELSE 1 - rn END', 'swe_proxy')} FROM n""")
def seismic_interpretation(spark, sf_dir):
    t = D.traces(spark, sf_dir)
    a = t.select("dataset_id", "trace_idx", S.rms().alias("rms_amplitude")).join(spectral.envelopes(t), ["dataset_id", "trace_idx"]).join(S.dominant_frequency(S.spectrum(t)), ["dataset_id", "trace_idx"])
    return S.proxies(a)


@query(f"""WITH {D.TRACES_SQL} SELECT dataset_id, count(*) AS n_traces, min(inline) AS inline_min, max(inline) AS inline_max, count(DISTINCT inline) AS n_inlines, min(crossline) AS crossline_min, max(crossline) AS crossline_max,
count(DISTINCT crossline) AS n_crosslines, CAST(max(len(samples)) AS INTEGER) AS n_samples, min(delay_ms) AS time_start, max(delay_ms + (len(samples) - 1) * dt_ms) AS time_end FROM traces GROUP BY dataset_id""")
def survey_info(spark, sf_dir):
    return S.survey_info(D.traces(spark, sf_dir))


@query(f"""WITH {D.TRACES_SQL}, l AS (SELECT *, CAST(row_number() OVER (ORDER BY crossline, trace_idx) - 1 AS INTEGER) AS position FROM traces WHERE inline = 3)
SELECT dataset_id, position, crossline AS other, trace_idx, CAST(generate_subscripts(samples, 1) - 1 AS INTEGER) AS sample_idx, unnest([round(x, 6) + 0.0::DOUBLE FOR x IN samples]) AS amplitude FROM l""")
def inline_section(spark, sf_dir):
    return S.section(D.traces(spark, sf_dir), "inline", 3)


@query(f"""WITH {D.TRACES_SQL}, g AS (SELECT * FROM (SELECT DISTINCT inline FROM traces), (SELECT DISTINCT crossline FROM traces)), f AS (SELECT inline, crossline, min_by(samples[11], trace_idx) AS a FROM traces GROUP BY inline, crossline)
SELECT 'SURVEY' AS dataset_id, inline, crossline, round(nullif(a, 0), 6) + 0.0::DOUBLE AS amplitude FROM g LEFT JOIN f USING (inline, crossline)""")
def time_slice(spark, sf_dir):
    return S.time_slice(D.traces(spark, sf_dir), 2050.4)


@query(f"""WITH {D.TRACES_SQL}, g AS (SELECT * FROM (SELECT DISTINCT inline FROM traces), (SELECT DISTINCT crossline FROM traces)), f AS (SELECT inline, crossline, count(*) AS n FROM traces GROUP BY inline, crossline)
SELECT 'SURVEY' AS dataset_id, inline, crossline, coalesce(n, 0) AS n FROM g LEFT JOIN f USING (inline, crossline) WHERE coalesce(n, 0) <> 1""")
def grid_coverage(spark, sf_dir):
    return S.coverage(D.traces(spark, sf_dir))


@query(f"WITH {D.TRACES_SQL}, s AS (SELECT CAST(generate_subscripts(samples, 1) - 1 AS INTEGER) AS sample_idx, unnest(samples) AS a FROM traces) SELECT 'SURVEY' AS dataset_id, sample_idx, {as_r('avg(CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE 0 END)', 'zero_fraction')} FROM s GROUP BY sample_idx")
def mute_profile(spark, sf_dir):
    return S.zero_profile(D.traces(spark, sf_dir))


@query(f"WITH {D.TRACES_SQL}, t AS (SELECT *, row_number() OVER (ORDER BY trace_idx) - 1 AS k, count(*) OVER () AS n FROM traces) SELECT trace_idx, round(list_sum(samples[1:64:4]), 6) + 0.0::DOUBLE AS checksum, CAST(len(samples[1:64:4]) AS INTEGER) AS n_kept FROM t WHERE k % greatest(1, n // 100) = 0")
def section_stride(spark, sf_dir):
    return S.strided(D.traces(spark, sf_dir), 100, 16).select("trace_idx", S.total("samples").alias("checksum"), F.size("samples").alias("n_kept"))


#: Morlet wavelets of six cycles on lags of 2 ms, cut at three deviations.
MORLET = """mf AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS band), ms AS (SELECT band, 5.0::DOUBLE * (band + 1) AS f, 6.0::DOUBLE / (2 * pi() * 5.0 * (band + 1)) AS sg FROM mf),
mk AS (SELECT band, f, lag, pow(pi(), -0.25) / sqrt(sg) * exp(-pow(lag * 0.002, 2) / (2 * sg * sg)) * cos(2 * pi() * f * lag * 0.002) AS c, pow(pi(), -0.25) / sqrt(sg) * exp(-pow(lag * 0.002, 2) / (2 * sg * sg)) * sin(2 * pi() * f * lag * 0.002) AS d
  FROM ms, (SELECT CAST(unnest(range(-63, 64)) AS INTEGER) AS lag) WHERE abs(lag) <= greatest(1, ceil(3 * sg / 0.002)))"""


@query(f"""WITH {D.TRACES_SQL}, {SAMPLES}, {MORLET},
w AS (SELECT o.trace_idx, o.i, band, any_value(f) AS frequency, sum(s.x * c) AS re, sum(s.x * d) AS im FROM smp o JOIN smp s ON s.trace_idx = o.trace_idx JOIN mk ON lag = o.i - s.i GROUP BY o.trace_idx, o.i, band)
SELECT trace_idx, band, any_value(frequency) AS frequency, {as_r('avg(sqrt(re * re + im * im))', 'mean_energy')} FROM w GROUP BY trace_idx, band""")
def time_frequency_cwt(spark, sf_dir):
    return spectral.decompose(D.traces(spark, sf_dir), "cwt").select("trace_idx", "band", "frequency", (S.total("energy") / F.size("energy")).alias("mean_energy"))


#: Least squares on the density itself, from a line through the logarithms on by steps of Gauss and Newton.
GARDNER = f"""WITH {D.LOGS_SQL}, gp AS (SELECT well_id, 0.3048::DOUBLE * 1e6 / DT AS v, RHOB AS y FROM logs WHERE DT > 0 AND RHOB > 0), gn AS (SELECT well_id, count(*) FILTER (DT IS NOT NULL AND RHOB IS NOT NULL) AS n FROM logs GROUP BY well_id),
g0 AS (SELECT well_id, exp(regr_intercept(ln(y), ln(v))) AS a, regr_slope(ln(y), ln(v)) AS b FROM gp GROUP BY well_id HAVING count(*) >= 20)""" + "".join(f""",
s{k} AS (SELECT well_id, a, b, sum(p * p) AS aa, sum(p * q) AS ab, sum(q * q) AS bb, sum(p * e) AS ae, sum(q * e) AS be FROM (SELECT well_id, a, b, pow(v, b) AS p, a * pow(v, b) * ln(v) AS q, y - a * pow(v, b) AS e FROM gp JOIN g{k - 1} USING (well_id)) GROUP BY well_id, a, b),
g{k} AS (SELECT well_id, a + (bb * ae - ab * be) / (aa * bb - ab * ab) AS a, b + (aa * be - ab * ae) / (aa * bb - ab * ab) AS b FROM s{k})""" for k in range(1, 13))


@query(GARDNER + f" SELECT gn.well_id, n, {r('a')}, {r('b')} FROM gn LEFT JOIN g12 ON g12.well_id = gn.well_id")
def gardner_coefficients(spark, sf_dir):
    return ties.gardner_coefficients(D.logs(spark, sf_dir))


#: Of the wavelet transform at 5, 10, .. 100 Hz: peak, centroid, width, entropy and the shares of three bands, by sample.
CWT_FEATURES = f"""{MORLET}, cw AS (SELECT o.trace_idx, o.i, band, any_value(f) AS f, sqrt(pow(sum(s.x * c), 2) + pow(sum(s.x * d), 2)) AS e FROM smp o JOIN smp s ON s.trace_idx = o.trace_idx JOIN mk ON lag = o.i - s.i GROUP BY o.trace_idx, o.i, band),
ct AS (SELECT *, sum(e) OVER w + 1e-12 AS t FROM cw WINDOW w AS (PARTITION BY trace_idx, i)), cc AS (SELECT *, e / t AS p, sum(e / t * f) OVER w AS centre FROM ct WINDOW w AS (PARTITION BY trace_idx, i)),
ft AS (SELECT trace_idx, i, arg_max(f, round(e, 9)) AS cwt_dominant_freq_hz, max(e) AS cwt_peak_amp, sqrt(sum(p * pow(f - centre, 2))) AS cwt_bandwidth_hz, any_value(centre) AS cwt_centroid_hz, -sum(p * ln(p + 1e-12)) / ln(20.0::DOUBLE) AS cwt_entropy,
  sum(p) FILTER (f < 5 + 95.0::DOUBLE / 3) AS cwt_energy_low, sum(p) FILTER (f >= 5 + 95.0::DOUBLE / 3 AND f < 5 + 190.0::DOUBLE / 3) AS cwt_energy_mid, sum(p) FILTER (f >= 5 + 190.0::DOUBLE / 3) AS cwt_energy_high FROM cc GROUP BY trace_idx, i)"""
CWT_NAMES = [f"cwt_{n}" for n in spectral.FEATURES]


@query(f"WITH {D.TRACES_SQL}, {SAMPLES}, {CWT_FEATURES} SELECT trace_idx, CAST(i AS INTEGER) AS time_idx, {', '.join(r(c) for c in CWT_NAMES)} FROM ft")
def cwt_features(spark, sf_dir):
    return spectral.trace_features(D.traces(spark, sf_dir), CWT_NAMES)


@query(f"""WITH {D.WELLS_SQL}, {D.TRACES_SQL}, b AS (SELECT min(tx) AS lx, max(tx) AS hx, min(ty) AS ly, max(ty) AS hy FROM traces)
SELECT well_id, coalesce(wx BETWEEN lx - greatest(0.2 * (hx - lx), 500) AND hx + greatest(0.2 * (hx - lx), 500) AND wy BETWEEN ly - greatest(0.2 * (hy - ly), 500) AND hy + greatest(0.2 * (hy - ly), 500), false) AS aligned
FROM (SELECT well_id, wx * 2 AS wx, wy FROM wells), b""")
def crs_check(spark, sf_dir):
    return reports.crs_check(D.wells(spark, sf_dir).withColumn("wx", F.col("wx") * 2), targets(spark, sf_dir))


@query(FIT + f""", near AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY d, trace_idx) AS k FROM (SELECT well_id, wx, wy, a * wx + b AS cx, c * wy + d AS cy, trace_idx, sqrt((a * wx + b - tx) ** 2 + (c * wy + d - ty) ** 2) AS d FROM wells, f, traces WHERE wx IS NOT NULL)),
g AS (SELECT near.*, d <= 10 AS within_tolerance, NOT (wx BETWEEN lx AND hx AND wy BETWEEN ly AND hy) AND NOT (cx BETWEEN ltx AND htx AND cy BETWEEN lty AND hty) AS extrapolated FROM near, w, (SELECT min(tx) AS ltx, max(tx) AS htx, min(ty) AS lty, max(ty) AS hty FROM traces) WHERE k = 1)
SELECT well_id, {r('cx')}, {r('cy')}, trace_idx, {as_r('d', 'distance')}, within_tolerance, extrapolated, within_tolerance AND NOT extrapolated AS trustworthy FROM g""")
def calibration_report(spark, sf_dir):
    return reports.calibration_report(D.wells(spark, sf_dir), targets(spark, sf_dir), spacing=5.0)


#: Overrides of every fourth supplier's well; some name lines that the survey doesn't have.
OVERRIDES = "ov AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS well_id, CAST(s_suppkey % 12 AS INTEGER) AS inline, CAST(s_suppkey % 60 AS INTEGER) AS crossline FROM supplier WHERE s_suppkey % 4 = 0)"


def overrides(spark, sf_dir):
    k = F.col("point_id")
    return D.wells(spark, sf_dir).where("point_id % 4 = 0").select("well_id", (k % 12).cast("int").alias("inline"), (k % 60).cast("int").alias("crossline"))


def calibrated_sql(fitted: str) -> str:
    """g: the report of the fit on the chosen wells; rw: the nearest trace to each well as it is."""
    fit = FIT.replace("FROM wells WHERE wx IS NOT NULL)", f"FROM wells WHERE wx IS NOT NULL AND {fitted})")
    return fit + f""", {OVERRIDES}, near AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY d, trace_idx) AS k FROM (SELECT well_id, point_id, wx, wy, a * wx + b AS cx, c * wy + d AS cy, trace_idx, sqrt((a * wx + b - tx) ** 2 + (c * wy + d - ty) ** 2) AS d FROM wells, f, traces WHERE wx IS NOT NULL)),
g AS (SELECT near.*, d <= 10 AS within_tolerance, NOT (wx BETWEEN lx AND hx AND wy BETWEEN ly AND hy) AND NOT (cx BETWEEN ltx AND htx AND cy BETWEEN lty AND hty) AS extrapolated FROM near, w, s WHERE k = 1),
rw AS (SELECT * FROM (SELECT well_id, trace_idx AS raw_trace_idx, sqrt((wx - tx) ** 2 + (wy - ty) ** 2) AS raw_distance, row_number() OVER (PARTITION BY well_id ORDER BY sqrt((wx - tx) ** 2 + (wy - ty) ** 2), trace_idx) AS q FROM wells, traces WHERE wx IS NOT NULL) WHERE q = 1)"""


@query(calibrated_sql("point_id % 3 <> 0") + f""" SELECT g.well_id, {r('cx')}, {r('cy')}, g.trace_idx, {as_r('d', 'distance')}, within_tolerance, extrapolated, within_tolerance AND NOT extrapolated AS trustworthy, t.inline AS fit_inline, t.crossline AS fit_crossline,
raw_trace_idx, {as_r('raw_distance', 'raw_distance')}, u.inline AS raw_inline, u.crossline AS raw_crossline, ov.inline AS override_inline, ov.crossline AS override_crossline, ov.well_id IS NOT NULL AS has_override, point_id % 3 <> 0 AS used_in_fit
FROM g JOIN traces t ON t.trace_idx = g.trace_idx JOIN rw ON rw.well_id = g.well_id JOIN traces u ON u.trace_idx = raw_trace_idx LEFT JOIN ov ON ov.well_id = g.well_id""")
def calibration_details(spark, sf_dir):
    w = D.wells(spark, sf_dir)
    return reports.calibration_details(w, targets(spark, sf_dir), overrides(spark, sf_dir), 5.0, w.where("point_id % 3 <> 0"))


@query(calibrated_sql("true") + f""", gd AS (SELECT inline, crossline, min(trace_idx) AS o FROM traces GROUP BY inline, crossline),
al AS (SELECT wells.well_id, wells.wx IS NOT NULL AS placed, ov.well_id IS NOT NULL AS asked, o, ov.inline IN (SELECT inline FROM traces) AND ov.crossline IN (SELECT crossline FROM traces) AS lines, g.trace_idx AS f, d, within_tolerance, extrapolated FROM wells LEFT JOIN ov ON ov.well_id = wells.well_id LEFT JOIN gd ON gd.inline = ov.inline AND gd.crossline = ov.crossline LEFT JOIN g ON g.well_id = wells.well_id),
er AS (SELECT *, CASE WHEN asked THEN CASE WHEN o IS NOT NULL THEN NULL WHEN lines THEN 'no trace at the override' ELSE 'override outside the survey' END WHEN NOT placed THEN 'no coordinates' WHEN within_tolerance AND NOT extrapolated THEN NULL ELSE concat_ws(' and ', CASE WHEN extrapolated THEN 'extrapolated' END, CASE WHEN NOT within_tolerance THEN 'too far from a trace' END) END AS error FROM al)
SELECT well_id, CASE WHEN error IS NULL THEN CASE WHEN asked THEN o ELSE f END END AS trace_idx, {as_r('CASE WHEN error IS NULL AND NOT asked THEN d END', 'distance')}, CASE WHEN error IS NULL THEN CASE WHEN asked THEN 'manual_override' ELSE 'calibrated_fit' END END AS method, error FROM er""")
def calibrated_traces(spark, sf_dir):
    return reports.resolve_calibrated(D.wells(spark, sf_dir), overrides(spark, sf_dir), targets(spark, sf_dir), 5.0)


PAY = INTERPRETED + f""", {D.TRACES_SQL}, {D.NUMBERS_SQL}, {D.HEADS_SQL},
nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY distance, trace_idx) AS q FROM (SELECT well_id, trace_idx, sqrt((wx - tx) ** 2 + (wy - ty) ** 2) AS distance FROM h, traces WHERE wx IS NOT NULL) WHERE distance <= 200) WHERE q = 1),
py AS (SELECT well_id, avg(VSH) AS mean_vsh_pay, count(*) AS n_pay FROM it WHERE ZONES = 1 AND VSH IS NOT NULL GROUP BY well_id),
pp AS (SELECT h.well_id, wx, wy, trace_idx, distance, mean_vsh_pay, n_pay, CASE WHEN wx IS NULL THEN 'no coordinates' WHEN trace_idx IS NULL THEN 'no trace near' WHEN n_pay IS NULL THEN 'no pay' END AS reason FROM h LEFT JOIN nr USING (well_id) LEFT JOIN py USING (well_id))
"""


@query(PAY + f"SELECT well_id, wx, wy, trace_idx, {r('distance')}, {r('mean_vsh_pay')}, n_pay, reason FROM pp")
def pay_points(spark, sf_dir):
    return reports.pay_points(D.heads(spark, sf_dir), interpreted(spark, sf_dir), targets(spark, sf_dir), 200.0)


@query(PAY + f", j AS (SELECT traces.trace_idx, mean_vsh_pay AS v, pow(greatest(sqrt((wx - tx) ** 2 + (wy - ty) ** 2), 1.0), -2.0) AS wt FROM traces, pp WHERE reason IS NULL) SELECT trace_idx AS cell_id, {as_r('sum(wt * v) / sum(wt)', 'value')} FROM j GROUP BY trace_idx")
def zone_tie_map(spark, sf_dir):
    return reports.zone_tie_map(reports.pay_points(D.heads(spark, sf_dir), interpreted(spark, sf_dir), targets(spark, sf_dir), 200.0), targets(spark, sf_dir))


@query(f"WITH {D.MUTED_SQL} SELECT dataset_id, trace_idx FROM muted WHERE list_max([abs(x) FOR x IN samples]) = 0")
def dead_traces(spark, sf_dir):
    return S.dead_traces(D.muted(spark, sf_dir))


@query(f"WITH {D.TRACES_SQL}, z AS (SELECT CAST(generate_subscripts(samples, 1) - 1 AS INTEGER) AS i, unnest(samples) AS a FROM traces), p AS (SELECT i, avg(CASE WHEN a = 0 THEN 1.0 ELSE 0 END) AS f FROM z GROUP BY i) SELECT 'SURVEY' AS dataset_id, i AS sample_idx FROM p ORDER BY f, i LIMIT 1")
def best_time(spark, sf_dir):
    return S.best_time(D.traces(spark, sf_dir))


from lithos.plans import catalog_ties, catalog_views  # noqa: E402, F401  add their queries
