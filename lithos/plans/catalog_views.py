"""Queries of ties in context, of views and of exports, with their SQL; they join the catalogue when it is imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.operators import context as K
from lithos.operators import interpolation as I
from lithos.operators import petrophysics as P
from lithos.operators import seismic as S
from lithos.operators import spatial as X
from lithos.operators import models, quality, reports, spectral, ties
from lithos.operators import views as V
from lithos.operators import wells as W
from lithos.plans import catalog as C
from lithos.plans import standins as D
from lithos.plans.catalog import HILBERT, INTERPRETED, MORLET, SAMPLES, SPEC, TWT, as_r, query, r
from lithos.sources.segy import coordinates


def interp(name: str, asks: str, knots: str) -> str:
    """Tables that give `value` of asks (well_id, x) between knots (well_id, kx, y)."""
    return f"""{name}_lo AS (SELECT a.*, k.kx AS x0, k.y AS y0 FROM {asks} a ASOF LEFT JOIN {knots} k ON a.well_id = k.well_id AND a.x >= k.kx),
{name}_bo AS (SELECT a.*, k.kx AS x1, k.y AS y1 FROM {name}_lo a ASOF LEFT JOIN {knots} k ON a.well_id = k.well_id AND a.x <= k.kx),
{name} AS (SELECT * EXCLUDE (x0, y0, x1, y1), CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END END AS value, coalesce(y0, y1) AS ended FROM {name}_bo)"""


# logs on the time axis of their own trace
TIMED = TWT + ", dp AS (SELECT *, twt_ms + 2040.0::DOUBLE AS DPTM FROM tw)"
CONTEXT = TIMED + f""", {D.TRACES_SQL}, {D.TIES_SQL},
kn AS (SELECT well_id, DPTM AS kx, min(DEPT) AS y FROM dp WHERE DPTM IS NOT NULL GROUP BY well_id, DPTM),
tm0 AS (SELECT well_id, ties.trace_idx, shift_ms, delay_ms, CAST(generate_subscripts(samples, 1) - 1 AS INTEGER) AS time_idx FROM ties JOIN traces USING (trace_idx)),
tm AS (SELECT *, delay_ms + time_idx * 2.0::DOUBLE AS time_ms, delay_ms + time_idx * 2.0::DOUBLE - shift_ms AS x FROM tm0),
{interp('dd', 'tm', 'kn')}, cx AS (SELECT well_id, trace_idx, time_idx, time_ms, value AS depth, value AS x FROM dd WHERE value IS NOT NULL)"""
CURVES = ["GR", "NPHI"]
PROPERTIES = CONTEXT + "".join(f""", kn_{c} AS (SELECT well_id, DEPT AS kx, min({c}) AS y FROM dp WHERE {c} IS NOT NULL GROUP BY well_id, DEPT), {interp(f'at_{c}', 'cx', f'kn_{c}')}""" for c in CURVES) + """,
px AS (SELECT a.well_id, a.trace_idx, a.time_idx, a.time_ms, a.depth, a.value AS GR, b.value AS NPHI FROM at_GR a JOIN at_NPHI b USING (well_id, time_idx))"""


def of_seven():
    """The number of a stand-in well modulo 7."""
    return F.substring("well_id", 2, 9).cast("int") % 7


def timed(spark, sf_dir, wells=None):
    return ties.depth_to_twt(C.valid(spark, sf_dir, wells), t0=2040.0).withColumn("DPTM", F.col("twt_ms"))


def in_context(spark, sf_dir):
    logs = timed(spark, sf_dir, D.tied(spark, sf_dir))
    n = D.parts(spark, sf_dir)
    return K.properties(K.overlap(D.ties(spark, sf_dir), D.traces(spark, sf_dir), logs, parts=n), logs, CURVES, n)


@query(PROPERTIES + f" SELECT well_id, trace_idx, time_idx, time_ms, {r('depth')}, {r('GR')}, {r('NPHI')} FROM px")
def tie_context(spark, sf_dir):
    return in_context(spark, sf_dir).select("well_id", "trace_idx", "time_idx", "time_ms", "depth", *CURVES)


SECTION = TIMED + f""", {D.TRACES_SQL}, {D.TIES_SQL}, good AS (SELECT * FROM ties WHERE correlation >= 0.3 AND NOT boundary_pinned),
sec AS (SELECT dp.well_id, crossline AS position, dp.row_idx, DPTM + shift_ms AS twt, GR, NPHI FROM dp JOIN good USING (well_id) JOIN traces USING (trace_idx) WHERE DPTM + shift_ms BETWEEN delay_ms AND delay_ms + 63 * 2.0)"""


@query(SECTION + f" SELECT well_id, position, row_idx, {as_r('twt', 'twt_ms')}, {r('GR')}, {r('NPHI')} FROM sec")
def section_logs(spark, sf_dir):
    return K.section_logs(D.ties(spark, sf_dir), D.traces(spark, sf_dir), timed(spark, sf_dir), CURVES)


@query(SECTION + " SELECT well_id, CASE WHEN correlation >= 0.3 AND NOT boundary_pinned THEN 'outside the time range' ELSE 'low confidence' END AS reason FROM ties WHERE well_id NOT IN (SELECT well_id FROM sec)")
def section_skipped(spark, sf_dir):
    t = D.ties(spark, sf_dir)
    return K.section_skipped(t, K.section_logs(t, D.traces(spark, sf_dir), timed(spark, sf_dir), CURVES))


def energies(spark, sf_dir):
    """The 30 Hz band and the envelope of the tied traces, sample by sample."""
    own = D.traces(spark, sf_dir).join(D.ties(spark, sf_dir).select("trace_idx"), "trace_idx", "left_semi")
    cwt = spectral.nearest_band(spectral.decompose(own, "cwt"), 30.0)
    cwt = cwt.select(F.lit("cwt").alias("method"), "trace_idx", F.posexplode("energy").alias("time_idx", "e"))
    env = spectral.trace_features(own, ["inst_envelope"]).select(F.lit("envelope").alias("method"), "trace_idx", "time_idx", F.col("inst_envelope").alias("e"))
    return cwt.unionByName(env)


CORRELATED = PROPERTIES + f""", {HILBERT.replace('FROM traces', 'FROM traces SEMI JOIN ties USING (trace_idx)')}, {MORLET},
en AS (SELECT 'envelope' AS method, trace_idx, i AS time_idx, sqrt(x * x + y * y) AS e FROM ana
  UNION ALL SELECT 'cwt', trace_idx, i, sqrt(re * re + im * im) FROM (SELECT o.trace_idx, o.i, sum(s.x * c) AS re, sum(s.x * d) AS im FROM smp o JOIN smp s ON s.trace_idx = o.trace_idx JOIN mk ON lag = o.i - s.i WHERE band = 5 GROUP BY o.trace_idx, o.i)),
lg AS (SELECT well_id, trace_idx, time_idx, 'GR' AS curve, GR AS v FROM px UNION ALL SELECT well_id, trace_idx, time_idx, 'NPHI', NPHI FROM px),
co AS (SELECT well_id, method, curve, count(v) AS n, CASE WHEN count(v) >= 2 AND stddev_pop(v) > 0 THEN corr(CASE WHEN v IS NOT NULL THEN e END, v) END AS r FROM lg JOIN en USING (trace_idx, time_idx) GROUP BY well_id, method, curve)"""


def correlated(spark, sf_dir):
    return K.correlate(in_context(spark, sf_dir), energies(spark, sf_dir), CURVES)


@query(CORRELATED + f" SELECT well_id, method, curve, {r('r')}, n, n < 20 AS low_sample_warning FROM co")
def spectral_correlation(spark, sf_dir):
    return correlated(spark, sf_dir)


@query(CORRELATED + f" SELECT method, curve, {as_r('avg(r)', 'r')}, count(r) AS n_wells FROM co GROUP BY method, curve")
def spectral_correlation_field(spark, sf_dir):
    return K.across_wells(correlated(spark, sf_dir))


@query(CORRELATED + """, mn AS (SELECT curve, avg(r) FILTER (method = 'cwt') AS a, avg(r) FILTER (method = 'envelope') AS b FROM co GROUP BY curve)
SELECT curve, CASE WHEN a IS NULL AND b IS NULL THEN 'insufficient data' WHEN a IS NULL THEN 'only envelope' WHEN b IS NULL THEN 'only cwt' WHEN abs(b) >= abs(a) THEN 'envelope more strongly than cwt' ELSE 'cwt more strongly than envelope' END AS wording FROM mn""")
def spectral_correlation_wording(spark, sf_dir):
    return K.compare_methods(K.across_wells(correlated(spark, sf_dir)), "envelope")


NEIGHBOURS = PROPERTIES + """, own AS (SELECT well_id, tx AS px, ty AS py FROM ties JOIN traces USING (trace_idx)),
nb AS (SELECT * FROM (SELECT well_id, trace_idx, sqrt((px - tx) ** 2 + (py - ty) ** 2) AS distance, row_number() OVER (PARTITION BY well_id ORDER BY sqrt((px - tx) ** 2 + (py - ty) ** 2), trace_idx) AS k FROM own, traces WHERE sqrt((px - tx) ** 2 + (py - ty) ** 2) <= 150) WHERE k <= 12)"""


def amplitude_features(spark, sf_dir):
    return D.traces(spark, sf_dir).select("trace_idx", F.posexplode("samples").alias("time_idx", "amplitude"))


#: What models are fed: the instantaneous attributes and the shape of the wavelet transform (synchrosqueezed shapes come on top in time_frequency_features).
MODEL_SQL = ["inst_amplitude", "inst_envelope", "inst_freq_hz", *C.CWT_NAMES]
INSTANT = """ph AS (SELECT trace_idx, i, x, sqrt(x * x + y * y) AS e, atan2(y, x) AS p FROM ana),
df AS (SELECT *, p - lag(p) OVER w AS d FROM ph WINDOW w AS (PARTITION BY trace_idx ORDER BY i)), un AS (SELECT *, d - 2 * pi() * round(d / (2 * pi())) AS u FROM df),
fi AS (SELECT trace_idx, i, x AS inst_amplitude, e AS inst_envelope, CASE WHEN u IS NULL THEN lead(u) OVER w WHEN lead(u) OVER w IS NULL THEN u ELSE (u + lead(u) OVER w) / 2 END / (2 * pi() * 0.002) AS inst_freq_hz FROM un WINDOW w AS (PARTITION BY trace_idx ORDER BY i))"""
MODEL_FEATURES = f"{HILBERT}, {INSTANT}, {C.CWT_FEATURES}"


#: The same shape of the synchrosqueezed transform: 32 bins from 250 / 60 to 250 Hz, coefficients moved to the bin of their own frequency.
SQUEEZED_FEATURES = """qf AS (SELECT bin, f, 6.0::DOUBLE / (2 * pi() * f) AS sg FROM (SELECT bin, (250.0::DOUBLE / 60) * pow(60.0::DOUBLE, bin / 31.0::DOUBLE) AS f FROM (SELECT CAST(unnest(range(32)) AS INTEGER) AS bin))),
qk AS (SELECT bin, lag, pow(pi(), -0.25) / sqrt(sg) * exp(-pow(lag * 0.002, 2) / (2 * sg * sg)) * cos(2 * pi() * f * lag * 0.002) AS c, pow(pi(), -0.25) / sqrt(sg) * exp(-pow(lag * 0.002, 2) / (2 * sg * sg)) * sin(2 * pi() * f * lag * 0.002) AS d FROM qf, (SELECT CAST(unnest(range(-63, 64)) AS INTEGER) AS lag) WHERE abs(lag) <= greatest(1, ceil(3 * sg / 0.002))),
qw AS (SELECT o.trace_idx, o.i, bin, sum(s.x * c) AS re, sum(s.x * d) AS im FROM smp o JOIN smp s ON s.trace_idx = o.trace_idx JOIN qk ON lag = o.i - s.i GROUP BY o.trace_idx, o.i, bin),
qd AS (SELECT *, CASE WHEN i = 0 THEN lead(re) OVER w - re WHEN i = 63 THEN re - lag(re) OVER w ELSE (lead(re) OVER w - lag(re) OVER w) / 2 END / 0.002 AS dr,
  CASE WHEN i = 0 THEN lead(im) OVER w - im WHEN i = 63 THEN im - lag(im) OVER w ELSE (lead(im) OVER w - lag(im) OVER w) / 2 END / 0.002 AS di, max(sqrt(re * re + im * im)) OVER (PARTITION BY trace_idx) AS top FROM qw WINDOW w AS (PARTITION BY trace_idx, bin ORDER BY i)),
qi AS (SELECT trace_idx, i, re, im, abs((di * re - dr * im) / (re * re + im * im)) / (2 * pi()) AS inst FROM qd WHERE sqrt(re * re + im * im) > 1e-8 * top),
qs AS (SELECT trace_idx, i, bin, sqrt(pow(sum(re), 2) + pow(sum(im), 2)) AS e FROM (SELECT *, CAST(greatest(0, least(31, ceil(ln(greatest(inst, 1e-9) / (250.0::DOUBLE / 60)) / (ln(60.0::DOUBLE) / 31) - 0.5))) AS INTEGER) AS bin FROM qi) GROUP BY trace_idx, i, bin),
qe AS (SELECT smp.trace_idx, smp.i, qf.bin, f, coalesce(e, 0.0::DOUBLE) AS e FROM smp CROSS JOIN qf LEFT JOIN qs ON qs.trace_idx = smp.trace_idx AND qs.i = smp.i AND qs.bin = qf.bin),
qt AS (SELECT *, sum(e) OVER w + 1e-12 AS t FROM qe WINDOW w AS (PARTITION BY trace_idx, i)), qc AS (SELECT *, e / t AS p, sum(e / t * f) OVER w AS centre FROM qt WINDOW w AS (PARTITION BY trace_idx, i)),
fq AS (SELECT trace_idx, i, arg_max(f, round(e, 9)) AS sswt_dominant_freq_hz, max(e) AS sswt_peak_amp, sqrt(sum(p * pow(f - centre, 2))) AS sswt_bandwidth_hz, any_value(centre) AS sswt_centroid_hz, -sum(p * ln(p + 1e-12)) / ln(32.0::DOUBLE) AS sswt_entropy,
  sum(p) FILTER (f < 250.0::DOUBLE / 60 + (250 - 250.0::DOUBLE / 60) / 3) AS sswt_energy_low, sum(p) FILTER (f >= 250.0::DOUBLE / 60 + (250 - 250.0::DOUBLE / 60) / 3 AND f < 250.0::DOUBLE / 60 + (250 - 250.0::DOUBLE / 60) * 2 / 3) AS sswt_energy_mid, sum(p) FILTER (f >= 250.0::DOUBLE / 60 + (250 - 250.0::DOUBLE / 60) * 2 / 3) AS sswt_energy_high FROM qc GROUP BY trace_idx, i)"""


@query(f"WITH {D.TRACES_SQL}, {MODEL_FEATURES}, {SQUEEZED_FEATURES} SELECT fi.trace_idx, CAST(fi.i AS INTEGER) AS time_idx, {', '.join(r(c) for c in spectral.TRACE_FEATURES)} FROM fi JOIN ft USING (trace_idx, i) JOIN fq USING (trace_idx, i)")
def time_frequency_features(spark, sf_dir):
    return spectral.trace_features(D.traces(spark, sf_dir))


@query(NEIGHBOURS + f""", {MODEL_FEATURES} SELECT px.well_id, nb.trace_idx, time_idx, {r('depth')}, {r('GR')}, {r('NPHI')}, {', '.join(r(c) for c in MODEL_SQL)}, {as_r('distance', 'distance')}, {as_r('1.0::DOUBLE / (1.0::DOUBLE + distance)', 'weight')}
FROM (SELECT well_id, time_idx, depth, GR, NPHI FROM px) px JOIN nb USING (well_id) JOIN fi ON fi.trace_idx = nb.trace_idx AND fi.i = time_idx JOIN ft ON ft.trace_idx = nb.trace_idx AND ft.i = time_idx""")
def model_samples(spark, sf_dir):
    t = D.traces(spark, sf_dir)
    near = K.around(D.ties(spark, sf_dir), t)
    used = t.join(near.select("trace_idx").distinct(), "trace_idx", "left_semi")  # the transforms of neighbours alone
    out = K.samples(in_context(spark, sf_dir), near, spectral.trace_features(used, MODEL_SQL))
    return out.select("well_id", "trace_idx", "time_idx", "depth", *CURVES, *MODEL_SQL, "distance", "weight")


#: Leave one well out: a ridge regression of GR on two features, its moments from the samples of all other wells.
FOLDS = NEIGHBOURS + f""", {MODEL_FEATURES}, mo AS (SELECT px.well_id, nb.trace_idx, time_idx, GR AS y, inst_envelope AS a, cwt_centroid_hz AS b FROM px JOIN nb USING (well_id) JOIN fi ON fi.trace_idx = nb.trace_idx AND fi.i = time_idx JOIN ft ON ft.trace_idx = nb.trace_idx AND ft.i = time_idx WHERE GR IS NOT NULL),
fd AS (SELECT w.well_id, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS rho, covar_pop(a, y) / stddev_pop(a) AS ca, covar_pop(b, y) / stddev_pop(b) AS cb FROM (SELECT DISTINCT well_id FROM mo) w JOIN mo m ON m.well_id <> w.well_id GROUP BY w.well_id HAVING count(*) >= 5),
sl AS (SELECT *, (2 * ca - rho * cb) / (4 - rho * rho) / sa AS ka, (2 * cb - rho * ca) / (4 - rho * rho) / sb AS kb FROM fd),
po AS (SELECT mo.*, my + ka * (a - ma) + kb * (b - mb) AS prediction FROM mo JOIN sl USING (well_id))"""


def held_out(spark, sf_dir):
    t = D.traces(spark, sf_dir)
    near = K.around(D.ties(spark, sf_dir), t)
    chosen = ["inst_envelope", "cwt_centroid_hz"]
    used = t.join(near.select("trace_idx").distinct(), "trace_idx", "left_semi")
    samples = K.samples(in_context(spark, sf_dir), near, spectral.trace_features(used, chosen))
    return models.leave_one_out_ridge(samples, chosen, "GR")


@query(FOLDS + f" SELECT well_id, trace_idx, time_idx, {as_r('y', 'GR')}, {r('prediction')} FROM po")
def held_out_predictions(spark, sf_dir):
    return held_out(spark, sf_dir).select("well_id", "trace_idx", "time_idx", "GR", "prediction")


@query(FOLDS + f", mn AS (SELECT *, avg(y) OVER (PARTITION BY well_id) AS m FROM po) SELECT well_id, count(*) AS n, {as_r('CASE WHEN sum(pow(y - m, 2)) > 0 THEN 1 - sum(pow(y - prediction, 2)) / sum(pow(y - m, 2)) END', 'r2')}, {as_r('sqrt(avg(pow(y - prediction, 2)))', 'rmse')} FROM mn GROUP BY well_id")
def held_out_skill(spark, sf_dir):
    return models.skill(held_out(spark, sf_dir), "GR", ["well_id"])


@query(PROPERTIES + f""", {MODEL_FEATURES} SELECT well_id, px.trace_idx, time_idx, {r('depth')}, {r('GR')}, {r('NPHI')}, {', '.join(r(c) for c in MODEL_SQL)}, 1.0::DOUBLE AS weight
FROM px JOIN fi ON fi.trace_idx = px.trace_idx AND fi.i = time_idx JOIN ft ON ft.trace_idx = px.trace_idx AND ft.i = time_idx""")
def blind_samples(spark, sf_dir):
    t, own = D.traces(spark, sf_dir), D.ties(spark, sf_dir)
    out = K.centre_samples(in_context(spark, sf_dir), spectral.trace_features(t.join(own, "trace_idx", "left_semi"), MODEL_SQL))
    return out.select("well_id", "trace_idx", "time_idx", "depth", *CURVES, *MODEL_SQL, "weight")


@query(NEIGHBOURS + f""", {SAMPLES} SELECT px.well_id, nb.trace_idx, time_idx, {r('GR')}, {as_r('x', 'amplitude')}, {as_r('1.0::DOUBLE / (1.0::DOUBLE + distance)', 'weight')}
FROM (SELECT well_id, time_idx, GR FROM px) px JOIN nb USING (well_id) JOIN smp ON smp.trace_idx = nb.trace_idx AND i = time_idx""")
def tie_samples(spark, sf_dir):
    t = D.traces(spark, sf_dir)
    out = K.samples(in_context(spark, sf_dir), K.around(D.ties(spark, sf_dir), t), amplitude_features(spark, sf_dir))
    return out.select("well_id", "trace_idx", "time_idx", "GR", "amplitude", "weight")


@query(PROPERTIES + f", {SAMPLES} SELECT well_id, px.trace_idx, time_idx, {r('depth')}, {r('NPHI')}, {as_r('x', 'amplitude')}, 1.0::DOUBLE AS weight FROM px JOIN smp ON smp.trace_idx = px.trace_idx AND i = time_idx")
def centre_samples(spark, sf_dir):
    return K.centre_samples(in_context(spark, sf_dir), amplitude_features(spark, sf_dir)).select("well_id", "trace_idx", "time_idx", "depth", "NPHI", "amplitude", "weight")


@query(f"""WITH {D.TRACES_SQL}, {HILBERT}, ph AS (SELECT trace_idx, i, x, sqrt(x * x + y * y) AS e, atan2(y, x) AS p FROM ana),
df AS (SELECT *, p - lag(p) OVER w AS d FROM ph WINDOW w AS (PARTITION BY trace_idx ORDER BY i)), un AS (SELECT *, d - 2 * pi() * round(d / (2 * pi())) AS u FROM df),
gr AS (SELECT *, CASE WHEN u IS NULL THEN lead(u) OVER w WHEN lead(u) OVER w IS NULL THEN u ELSE (u + lead(u) OVER w) / 2 END AS g FROM un WINDOW w AS (PARTITION BY trace_idx ORDER BY i))
SELECT trace_idx, i AS time_idx, {as_r('x', 'inst_amplitude')}, {as_r('e', 'inst_envelope')}, {as_r('g / (2 * pi() * 0.002)', 'inst_freq_hz')} FROM gr""")
def instantaneous_attributes(spark, sf_dir):
    return spectral.trace_features(D.traces(spark, sf_dir), spectral.TRACE_FEATURES[:3])


# time, depth and density
@query(TWT + f" SELECT well_id, row_idx, {as_r('(twt_ms + lead(twt_ms) OVER w) / 2', 'mid_ms')}, {as_r('(DEPT + lead(DEPT) OVER w) / 2', 'mid_depth')} FROM tw WINDOW w AS ({C.WELL} ORDER BY row_idx) QUALIFY lead(row_idx) OVER w IS NOT NULL")
def midpoints(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("well_id").orderBy("row_idx")
    d = ties.depth_to_twt(C.valid(spark, sf_dir))
    mid = lambda c: (F.col(c) + F.lead(c).over(w)) / 2
    return d.select("well_id", "row_idx", mid("twt_ms").alias("mid_ms"), mid("DEPT").alias("mid_depth")).where("mid_ms IS NOT NULL")


@query(INTERPRETED + f", dn AS (SELECT *, (1 - PHIE) * ((1 - VSH) * 2.65::DOUBLE + VSH * 2.55::DOUBLE) + PHIE AS rp, CASE WHEN DT > 0 THEN 0.31::DOUBLE * pow(0.3048::DOUBLE * 1e6 / DT, 0.25::DOUBLE) END AS ga FROM it) SELECT well_id, row_idx, {as_r('RHOB', 'rhob')}, {as_r('rp', 'rock_physics')}, {as_r('ga', 'gardner')} FROM dn")
def density_estimates(spark, sf_dir):
    d = ties.densities(ties.densities(C.interpreted(spark, sf_dir), "rhob").withColumnRenamed("density", "rhob_").drop("density_note"), "rock_physics")
    v = F.when(F.col("DT") > 0, ties.FOOT * 1e6 / F.when(F.col("DT") > 0, F.col("DT")))
    return d.select("well_id", "row_idx", F.col("rhob_").alias("rhob"), F.col("density").alias("rock_physics"), ties.gardner(v).alias("gardner"))


@query(TIMED + f", {D.NUMBERS_SQL}, {D.POINTS_SQL}, sa AS (SELECT well_id, row_idx, DEPT AS x, DPTM FROM dp), {interp('sq', 'sa', 'tp')} SELECT well_id, row_idx, {as_r('DPTM + coalesce(value, ended, 0)', 'twt')} FROM sq")
def stretch_squeeze(spark, sf_dir):
    times = timed(spark, sf_dir).select("well_id", F.col("row_idx").alias("ask_id"), F.col("DEPT").alias("x"), F.col("DPTM").alias("twt"))
    return I.stretch(times, D.tie_points(spark, sf_dir)).select("well_id", F.col("ask_id").alias("row_idx"), "twt")


@query(TIMED + f""", {D.NUMBERS_SQL}, {D.SHOTS_SQL}, kn AS (SELECT well_id, DEPT AS kx, min(DPTM) AS y FROM dp GROUP BY well_id, DEPT), tops AS (SELECT well_id, min(DEPT) AS top FROM dp GROUP BY well_id),
fs AS (SELECT sh.well_id, arg_min(depth, depth) AS x, arg_min(twt, depth) AS twt FROM sh JOIN tops USING (well_id) WHERE depth >= top GROUP BY sh.well_id), {interp('an', 'fs', 'kn')} SELECT well_id, {as_r('twt - value', 'shift_ms')} FROM an""")
def checkshot_anchor(spark, sf_dir):
    return I.checkshot_shift(D.shots(spark, sf_dir), timed(spark, sf_dir))


@query(f"WITH {D.NUMBERS_SQL}, {D.SHOTS_SQL} SELECT well_id, count(*) AS n_points FROM sh GROUP BY well_id")
def checkshot_status(spark, sf_dir):
    return D.shots(spark, sf_dir).groupBy("well_id").agg(F.count("*").alias("n_points"))


@query(TIMED + f""", d AS (SELECT well_id, min(DEPT) - 1000 + CASE WHEN CAST(substr(well_id, 2) AS INTEGER) % 7 = 0 THEN 0 ELSE 2000 END AS top, 2030.0::DOUBLE AS delay_ms FROM dp GROUP BY well_id), e AS (SELECT *, delay_ms / 2000.0 * 3000.0::DOUBLE AS implied FROM d)
SELECT well_id, {as_r('implied', 'implied_depth')}, {as_r('CASE WHEN top > 0 THEN abs(implied - top) / top END', 'relative_error')}, coalesce(CASE WHEN top > 0 THEN abs(implied - top) / top END <= 0.5, false) AS plausible FROM e""")
def datum_check(spark, sf_dir):
    top = F.min("DEPT") - 1000 + F.when(of_seven() == 0, 0).otherwise(2000)
    w = timed(spark, sf_dir).groupBy("well_id").agg(top.alias("top")).withColumn("delay_ms", F.lit(2030.0))
    return ties.datum_check(w).select("well_id", "implied_depth", "relative_error", "plausible")


# ties in reports
LABELS = f"WITH {D.TIES_SQL}, lb AS (SELECT *, CASE WHEN correlation IS NULL THEN 'unknown' WHEN correlation >= 0.7 THEN 'good' WHEN correlation >= 0.4 THEN 'marginal' ELSE 'poor' END AS label, boundary_pinned OR coalesce(correlation < 0.3, false) AS low_confidence FROM ties)"


@query(LABELS + " SELECT well_id, trace_idx, shift_ms, correlation, boundary_pinned, label, low_confidence FROM lb")
def tie_labels(spark, sf_dir):
    return V.labelled(D.ties(spark, sf_dir))


@query(LABELS + " SELECT well_id, correlation, CAST(row_number() OVER (ORDER BY correlation DESC NULLS LAST, well_id) AS INTEGER) AS down, CAST(row_number() OVER (ORDER BY correlation ASC NULLS LAST, well_id) AS INTEGER) AS up FROM lb")
def tie_table(spark, sf_dir):
    t = V.ranked(D.ties(spark, sf_dir), "correlation", True).withColumnRenamed("rank", "down")
    return V.ranked(t, "correlation").select("well_id", "correlation", "down", F.col("rank").alias("up"))


@query(LABELS + " SELECT well_id, correlation FROM lb WHERE correlation IS NOT NULL ORDER BY correlation DESC, well_id LIMIT 1")
def best_tied_well(spark, sf_dir):
    return V.best_tie(D.ties(spark, sf_dir)).select("well_id", "correlation")


@query(LABELS + f", {D.HEADS_SQL} SELECT h.well_id, point_id, wx, wy, correlation FROM h JOIN lb USING (well_id) WHERE wx IS NOT NULL AND correlation IS NOT NULL")
def tie_map(spark, sf_dir):
    return V.on_map(D.ties(spark, sf_dir), D.heads(spark, sf_dir))


@query(LABELS + " SELECT well_id, CASE WHEN CAST(substr(well_id, 2) AS INTEGER) % 7 = 4 THEN 'no trace' WHEN boundary_pinned THEN 'boundary pinned' WHEN low_confidence THEN 'low confidence' END AS reason FROM lb")
def eligible_wells(spark, sf_dir):
    t = V.labelled(D.ties(spark, sf_dir)).withColumn("error", F.when(of_seven() == 4, "no trace"))
    return reports.eligible(t).select("well_id", "reason")


@query(LABELS + ", g AS (SELECT well_id FROM lb WHERE NOT low_confidence) SELECT well_id FROM (SELECT 'W' || CAST(s_suppkey AS VARCHAR) AS well_id FROM supplier) ANTI JOIN g USING (well_id)")
def excluded_wells(spark, sf_dir):
    every = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("W"), F.col("s_suppkey").cast("string")).alias("well_id"))
    return every.join(V.labelled(D.ties(spark, sf_dir)).where("NOT low_confidence"), "well_id", "left_anti")


@query(INTERPRETED + f"""{', ' + D.TIES_SQL}, sm AS ({C.SUMMARY}), z AS (SELECT well_id, count(*) AS n_pay, count(*) * max(step) AS pay_thickness FROM it WHERE ZONES = 1 GROUP BY well_id)
SELECT sm.well_id, {r('footage')}, {r('mean_vsh')}, {r('mean_phie')}, {r('mean_swe')}, {r('net_pay')}, {as_r('coalesce(pay_thickness, 0)', 'pay_thickness')}, coalesce(n_pay, 0) AS n_pay, correlation, shift_ms, boundary_pinned AS low_confidence, CAST(NULL AS VARCHAR) AS tie_error
FROM sm LEFT JOIN z USING (well_id) LEFT JOIN ties ON ties.well_id = sm.well_id""")
def field_overview_of_ties(spark, sf_dir):
    d = C.interpreted(spark, sf_dir)
    t = D.ties(spark, sf_dir).withColumn("low_confidence", F.col("boundary_pinned")).withColumn("error", F.lit(None).cast("string"))
    return reports.field_overview(W.well_summary(d), W.zone_summary(d), t)


# seismic views
@query(f"WITH {D.MUTED_SQL}, t AS (SELECT trace_idx, samples, k FROM (SELECT *, row_number() OVER (ORDER BY trace_idx) - 1 AS k, count(*) OVER () AS n FROM muted)) SELECT trace_idx, list_max([abs(x) FOR x IN samples[26:36]]) = 0 AS all_around FROM t WHERE samples[31] = 0")
def slice_zeros(spark, sf_dir):
    return S.slice_zeros(D.muted(spark, sf_dir), 30).select("trace_idx", "all_around")


@query(f"WITH {D.MUTED_SQL} SELECT dataset_id, count(*) AS n, count(*) FILTER (list_max([abs(x) FOR x IN samples]) = 0) AS n_dead, CAST(0 AS BIGINT) AS n_odd FROM muted GROUP BY dataset_id")
def survey_quality(spark, sf_dir):
    return S.quality(D.muted(spark, sf_dir))


@query(f"""WITH {D.TRACES_SQL}, c AS (SELECT CASE trace_idx % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS dataset_id, trace_idx, tx, ty FROM traces)
SELECT dataset_id, trace_idx, CASE dataset_id WHEN 'A' THEN tx + 1 WHEN 'B' THEN tx END AS tx, CASE dataset_id WHEN 'A' THEN ty + 1 WHEN 'B' THEN ty END AS ty FROM c""")
def trace_coordinates(spark, sf_dir):
    kind = F.col("trace_idx") % 3
    t = D.traces(spark, sf_dir).select(F.when(kind == 0, "A").when(kind == 1, "B").otherwise("C").alias("dataset_id"), "trace_idx", F.col("tx").alias("x"), F.col("ty").alias("y"))
    pick = lambda c, k, add: F.when(F.col("dataset_id").isin(*k), F.col(c) + add).otherwise(0.0)
    t = t.select("dataset_id", "trace_idx", pick("x", "A", 1).alias("cdp_x"), pick("y", "A", 1).alias("cdp_y"), pick("x", "AB", 0).alias("source_x"), pick("y", "AB", 0).alias("source_y"))
    return coordinates(t).select("dataset_id", "trace_idx", "tx", "ty")


def fields(spark, sf_dir):
    """Three datasets: coordinates in both pairs of fields, in the source's alone, in none."""
    kind = F.col("trace_idx") % 3
    t = D.traces(spark, sf_dir).withColumn("dataset_id", F.when(kind == 0, "A").when(kind == 1, "B").otherwise("C"))
    pick = lambda c, k: F.when(F.col("dataset_id").isin(*k), F.col(c) - 1000).otherwise(0.0)
    return t.select("dataset_id", pick("tx", "A").alias("cdp_x"), pick("ty", "A").alias("cdp_y"), pick("tx", "AB").alias("source_x"), F.when(F.col("dataset_id") != "C", F.col("ty")).alias("source_y"))


@query(f"""WITH {D.TRACES_SQL}, c AS (SELECT CASE trace_idx % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS dataset_id, tx - 1000 AS x, ty - 1000 AS y, ty FROM traces)
SELECT dataset_id, count(*) AS n, count(*) FILTER (dataset_id = 'A' AND x <> 0) AS n_cdp_x, count(*) FILTER (dataset_id = 'A' AND y <> 0) AS n_cdp_y, count(*) FILTER (dataset_id <> 'C' AND x <> 0) AS n_source_x, count(*) FILTER (dataset_id <> 'C' AND ty <> 0) AS n_source_y, dataset_id <> 'C' AS has_coordinates FROM c GROUP BY dataset_id""")
def coordinate_fields(spark, sf_dir):
    return quality.coordinate_fields(fields(spark, sf_dir))


@query(f"""WITH {D.MUTED_SQL}, l AS (SELECT *, list_max([abs(x) FOR x IN samples]) > 0 AS live FROM muted)
SELECT dataset_id, count(*) AS n, count(*) FILTER (NOT live) AS n_dead, {', '.join(f'{f}({c}) AS {c}_{f}' for c in ('inline', 'crossline') for f in ('min', 'max'))}, {', '.join(f'{f}({c}) FILTER (live) AS live_{c}_{f}' for c in ('inline', 'crossline') for f in ('min', 'max'))} FROM l GROUP BY dataset_id""")
def footprint_report(spark, sf_dir):
    return quality.footprint_report(D.muted(spark, sf_dir))


@query(f"""WITH {D.MUTED_SQL}, z AS (SELECT dataset_id, CAST(generate_subscripts(samples, 1) - 1 AS INTEGER) AS i, unnest(samples) AS a FROM muted), p AS (SELECT dataset_id, i, 100 * avg(CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM z GROUP BY dataset_id, i),
v AS (SELECT dataset_id, min_by(p, i) AS first, max_by(p, i) AS last, min(p) AS least, max(p) AS most FROM p GROUP BY dataset_id)
SELECT dataset_id, {', '.join(r(c) for c in ('first', 'last', 'least', 'most'))}, (SELECT i FROM p ORDER BY p, i LIMIT 1) AS clearest, CASE WHEN most - least < 5 THEN 'constant' WHEN last < first - 20 THEN 'clears' ELSE 'mixed' END AS verdict FROM v""")
def mute_verdict(spark, sf_dir):
    return quality.mute_verdict(S.zero_profile(D.muted(spark, sf_dir)))


@query(f"WITH {D.TRACES_SQL}, f AS (SELECT trace_idx, tx, ty, row_number() OVER (ORDER BY trace_idx) - 1 AS k, count(*) OVER () AS n FROM traces) SELECT trace_idx, tx, ty FROM f WHERE k % greatest(1, n // 50) = 0")
def footprint(spark, sf_dir):
    return S.every_kth(D.traces(spark, sf_dir), 50).select("trace_idx", "tx", "ty")


@query(SPEC + f""", keep AS (SELECT trace_idx FROM (SELECT trace_idx, row_number() OVER (ORDER BY trace_idx) - 1 AS k, count(*) OVER () AS n FROM traces WHERE inline = 3) WHERE k % greatest(1, n // 20) = 0),
av AS (SELECT bin, frequency, avg(magnitude) AS m FROM sp SEMI JOIN keep USING (trace_idx) GROUP BY bin, frequency), pk AS (SELECT frequency AS f, m AS a FROM av WHERE bin > 0 ORDER BY round(m, 9) DESC, bin LIMIT 1),
b AS (SELECT av.*, f, m >= a / sqrt(2.0::DOUBLE) AS inside FROM av, pk)
SELECT 'SURVEY' AS dataset_id, max(f) AS dominant_freq_hz, max(frequency) FILTER (inside) - min(frequency) FILTER (inside) AS bandwidth_hz, {as_r('avg(m) FILTER (inside) / avg(m) FILTER (NOT inside)', 'snr_proxy')} FROM b""")
def amplitude_report(spark, sf_dir):
    line = D.traces(spark, sf_dir).where("inline = 3")
    return S.amplitude_report(S.average_spectrum(S.spectrum(S.every_kth(line, 20))))


@query(f"WITH {D.TRACES_SQL}, a AS (SELECT CAST(p_partkey % 12 AS INTEGER) AS inline, CAST(p_partkey % 25 AS INTEGER) AS crossline, p_partkey FROM part) SELECT p_partkey, a.inline, a.crossline, min(trace_idx) AS trace_idx FROM a LEFT JOIN traces USING (inline, crossline) GROUP BY p_partkey, a.inline, a.crossline")
def trace_at_lines(spark, sf_dir):
    k = F.col("p_partkey")
    asked = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (k % 12).cast("int").alias("inline"), (k % 25).cast("int").alias("crossline"))
    return S.at_lines(D.traces(spark, sf_dir), asked)


@query(f"WITH {D.TRACES_SQL}, {SAMPLES} SELECT trace_idx, i AS sample_idx, 2030.0::DOUBLE + i * 2.0::DOUBLE AS time_ms, {as_r('x', 'amplitude')} FROM smp WHERE trace_idx = 17")
def one_trace(spark, sf_dir):
    return S.one_trace(D.traces(spark, sf_dir), "SURVEY", 17)


@query(f"WITH {D.TRACES_SQL} SELECT 'SURVEY' AS dataset_id, inline, crossline, min(trace_idx) AS trace_idx, CAST(dense_rank() OVER (ORDER BY inline) - 1 AS INTEGER) AS inline_pos, CAST(dense_rank() OVER (ORDER BY crossline) - 1 AS INTEGER) AS crossline_pos FROM traces GROUP BY inline, crossline")
def survey_grid(spark, sf_dir):
    return S.grid(D.traces(spark, sf_dir))


INTERPRETATION = C.oracle_sql()["seismic_interpretation"]


@query(f"SELECT dataset_id, count(*) AS n_traces, {', '.join(f'round(avg({c}), 4) + 0.0::DOUBLE AS avg_{c}' for c in ('rms_amplitude', 'vsh_proxy', 'phie_proxy', 'swe_proxy'))} FROM ({INTERPRETATION}) GROUP BY dataset_id", digits=4)
def seismic_summary(spark, sf_dir):
    return S.summary(C.seismic_interpretation(spark, sf_dir))


@query(f"SELECT dataset_id, trace_idx, rms_amplitude, vsh_proxy FROM ({INTERPRETATION})")
def attribute_series(spark, sf_dir):
    s = S.series(C.seismic_interpretation(spark, sf_dir).select("dataset_id", "trace_idx", "rms_amplitude", "vsh_proxy"))
    return s.select("dataset_id", F.explode(F.arrays_zip("trace_idx", "rms_amplitude", "vsh_proxy")).alias("z")).select("dataset_id", "z.*")


@query(f"WITH {D.MUTED_SQL}, r AS (SELECT trace_idx, samples, sqrt(list_sum([x * x FOR x IN samples]) / len(samples)) AS q FROM muted), s AS (SELECT trace_idx, list_sum([abs(x) FOR x IN samples]) / CASE WHEN q > 1e-12 THEN q ELSE 1 END AS t FROM r) SELECT trace_idx, {as_r('t', 'total')} FROM s")
def rms_display(spark, sf_dir):
    return V.rms_scaled(D.muted(spark, sf_dir)).select("trace_idx", S.total("samples", F.abs).alias("total"))


@query(f"WITH {D.LOGS_SQL}, m AS (SELECT *, CASE WHEN CAST(substr(well_id, 2) AS INTEGER) % 7 = 2 THEN CASE WHEN GR IS NOT NULL THEN 5.0::DOUBLE END ELSE GR END AS g FROM logs), e AS (SELECT *, min(g) OVER ({C.WELL}) AS lo, max(g) OVER ({C.WELL}) AS hi FROM m) SELECT well_id, row_idx, round(CASE WHEN g IS NULL THEN NULL WHEN hi > lo THEN (g - lo) / (hi - lo) ELSE 0.5::DOUBLE END, 6) + 0.0::DOUBLE AS scaled FROM e")
def unit_display(spark, sf_dir):
    flat = F.when(of_seven() == 2, F.when(F.col("GR").isNotNull(), 5.0)).otherwise(F.col("GR"))
    return V.unit_scaled(D.logs(spark, sf_dir).withColumn("g", flat), "g", ["well_id"]).select("well_id", "row_idx", "scaled")


@query(f"WITH {D.WELLS_SQL}, s AS (SELECT point_id % 9 AS k, avg(CASE WHEN point_id % 9 <> 4 THEN value END) AS vsh, avg(value * 2) AS phie FROM wells GROUP BY point_id % 9) SELECT {as_r('avg(vsh)', 'vsh')}, {as_r('avg(phie)', 'phie')} FROM s")
def proxy_means(spark, sf_dir):
    k = F.col("point_id") % 9
    s = D.wells(spark, sf_dir).groupBy(k.alias("k")).agg(F.avg(F.when(F.col("point_id") % 9 != 4, F.col("value"))).alias("vsh"), F.avg(F.col("value") * 2).alias("phie"))
    return V.mean_of_means(s, ["vsh", "phie"])


# logs: tracks, crossplots, exports
@query(f"WITH {D.LOGS_SQL}, t AS (SELECT *, CASE WHEN row_idx % 5 = 0 THEN 'clay' ELSE CAST(row_idx AS VARCHAR) END AS note FROM logs) SELECT well_id, row_idx, {r('DEPT')}, 'GR' AS track, {as_r('GR', 'value')} FROM t UNION ALL SELECT well_id, row_idx, {r('DEPT')}, 'note', try_cast(note AS DOUBLE) FROM t")
def log_tracks(spark, sf_dir):
    d = D.logs(spark, sf_dir).withColumn("note", F.when(F.col("row_idx") % 5 == 0, "clay").otherwise(F.col("row_idx").cast("string")))
    return V.tracks(d, ["GR", "note"])


def _preset(name: str):
    x, y, color, logs = V.CROSSPLOTS[name]
    axis = lambda c, a: f"ln({c}) / ln(10.0::DOUBLE)" if a in logs else c
    where = " AND ".join([f"{x} IS NOT NULL", f"{y} IS NOT NULL"] + [f"{c} > 0" for a, c in (("x", x), ("y", y)) if a in logs])

    def run(spark, sf_dir):
        return V.preset(C.interpreted(spark, sf_dir), name)

    run.__name__ = f"crossplot_preset_{name}"
    return query(INTERPRETED + f"SELECT well_id, row_idx, {as_r(axis(x, 'x'), 'x')}, {as_r(axis(y, 'y'), 'y')}, {as_r(f'CAST({color} AS DOUBLE)', 'color')} FROM it WHERE {where}")(run)


for _name in V.CROSSPLOTS:
    _preset(_name)


@query(f"WITH {D.LOGS_SQL} SELECT well_id, row_idx, well_id || ',' || CAST(row_idx AS VARCHAR) || ',' || printf('%.4f', DEPT) || ',' || coalesce(printf('%.4f', GR), '') AS line FROM logs")
def csv_export(spark, sf_dir):
    d = D.logs(spark, sf_dir)
    return V.csv_lines(d.withColumn("w", F.col("well_id")), "well_id", "row_idx", ["w", "row_idx", "DEPT", "GR"])


@query(f"WITH {D.LOGS_SQL} SELECT well_id, row_idx, {r('GR')}, {r('NPHI')}, GR IS NULL AS said_null FROM logs")
def json_records(spark, sf_dir):
    lines = V.json_lines(D.logs(spark, sf_dir), ["GR", "NPHI"])
    return V.from_json_lines(lines, "GR double, NPHI double").join(lines, ["well_id", "row_idx"]).select("well_id", "row_idx", "GR", "NPHI", F.col("json").contains('"GR":null').alias("said_null"))


@query(f"WITH {D.LOGS_SQL}, u AS (SELECT well_id, GR, CAST(NULL AS DOUBLE) AS core FROM logs WHERE CAST(substr(well_id, 2) AS INTEGER) % 7 < 4 UNION ALL SELECT well_id, NULL, NPHI FROM logs WHERE CAST(substr(well_id, 2) AS INTEGER) % 7 > 2) SELECT well_id, count(*) AS n, count(GR) AS n_gr, count(core) AS n_core FROM u GROUP BY well_id")
def concatenated_wells(spark, sf_dir):
    d = D.logs(spark, sf_dir)
    u = d.where(of_seven() < 4).select("well_id", "GR").unionByName(d.where(of_seven() > 2).select("well_id", F.col("NPHI").alias("core")), allowMissingColumns=True)
    return u.groupBy("well_id").agg(F.count("*").alias("n"), F.count("GR").alias("n_gr"), F.count("core").alias("n_core"))


# results that are kept
CACHE = f"""WITH {D.TIES_SQL}, cache AS (SELECT well_id AS key, CASE trace_idx % 4 WHEN 1 THEN 'ready' WHEN 3 THEN 'processing' ELSE 'error' END AS status, CASE WHEN trace_idx % 4 = 1 THEN shift_ms END AS value, CASE WHEN trace_idx % 4 NOT IN (1, 3) THEN 'failed' END AS error FROM ties WHERE CAST(substr(well_id, 2) AS INTEGER) % 7 <> 6),
live AS (SELECT well_id AS key, correlation AS value FROM ties WHERE correlation IS NOT NULL), keys AS (SELECT 'W' || CAST(s_suppkey AS VARCHAR) AS key FROM supplier),
j AS (SELECT keys.key, coalesce(status IN ('ready', 'error'), false) AS hit, cache.value AS cv, cache.error AS ce, live.value AS lv FROM keys LEFT JOIN cache ON cache.key = keys.key LEFT JOIN live ON live.key = keys.key),
an AS (SELECT key, CASE WHEN hit THEN cv ELSE lv END AS value, CASE WHEN hit THEN ce WHEN lv IS NULL THEN 'not available' END AS error, CASE WHEN hit THEN 'cache' WHEN lv IS NOT NULL THEN 'live' ELSE 'none' END AS source FROM j)"""


def _answered(spark, sf_dir):
    t = D.ties(spark, sf_dir)
    k = F.col("trace_idx") % 4
    cache = t.where(of_seven() != 6).select(F.col("well_id").alias("key"), F.when(k == 1, "ready").when(k == 3, "processing").otherwise("error").alias("status"), F.when(k == 1, F.col("shift_ms")).alias("value"), F.when(~k.isin(1, 3), "failed").alias("error"))
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("W"), F.col("s_suppkey").cast("string")).alias("key"))
    live = t.where("correlation IS NOT NULL").select(F.col("well_id").alias("key"), F.col("correlation").alias("value"))
    return cache, V.cached(keys, cache, live)


@query(CACHE + " SELECT * FROM an")
def cached_results(spark, sf_dir):
    return _answered(spark, sf_dir)[1]


@query(CACHE + " SELECT key, status, value, error FROM cache WHERE key NOT IN (SELECT key FROM an WHERE source = 'live') UNION ALL SELECT key, 'ready', value, NULL FROM an WHERE source = 'live'")
def cache_after_write_back(spark, sf_dir):
    return V.write_back(*_answered(spark, sf_dir))


@query(C.FIT.replace("FROM wells WHERE wx IS NOT NULL)", "FROM wells WHERE wx IS NOT NULL AND point_id % 2 = 0)") + f" SELECT n, {', '.join(r(c) for c in 'abcd')} FROM f")
def calibration_on_chosen_wells(spark, sf_dir):
    chosen = D.wells(spark, sf_dir).where("point_id % 2 = 0").select("well_id")
    return X.fit_on(D.wells(spark, sf_dir), chosen, C.targets(spark, sf_dir))


@query(f"WITH {D.WELLS_SQL} SELECT a.well_id FROM (SELECT 'S' || CAST(p_partkey AS VARCHAR) AS well_id FROM part) a ANTI JOIN wells USING (well_id)")
def unknown_wells(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("well_id"))
    return X.unknown(asked, D.wells(spark, sf_dir))


@query(f"WITH {D.LOGS_SQL}, u AS (SELECT well_id, quantile_cont(DT, 0.5) AS m FROM logs GROUP BY well_id) SELECT logs.well_id, row_idx, round(CASE WHEN CAST(substr(logs.well_id, 2) AS INTEGER) % 7 IN (1, 4) THEN DT * 0.3048 ELSE DT END, 6) + 0.0::DOUBLE AS DT FROM logs")
def normalised_sonic(spark, sf_dir):
    from lithos.operators import cleaning

    d = D.logs(spark, sf_dir)
    units = d.select("well_id").distinct().withColumn("unit", F.when(of_seven().isin(1, 4), "us_per_m").otherwise("us_per_ft"))
    return cleaning.normalise_dt(d, units).select("well_id", "row_idx", "DT")


DECLARED = """dc AS (SELECT well_id, 'DT' AS curve, CASE m WHEN 1 THEN 'US/M ' WHEN 2 THEN 'furlong' WHEN 3 THEN 'us/f' END AS declared FROM wn UNION ALL SELECT well_id, 'RHOB', CASE WHEN m < 3 THEN 'K/M3' END FROM wn UNION ALL SELECT well_id, 'NPHI', 'frac' FROM wn WHERE m > 3)"""


@query(f"""WITH {D.LOGS_SQL}, {D.NUMBERS_SQL}, {DECLARED}, me AS (SELECT well_id, unnest(['DT', 'RHOB', 'GR', 'NPHI']) AS curve, unnest([dt, rhob, gr, nphi]) AS median FROM (SELECT well_id, quantile_cont(DT * CASE WHEN CAST(substr(well_id, 2) AS INTEGER) % 7 = 5 THEN 3.2808 ELSE 1 END, 0.5) AS dt, quantile_cont(RHOB, 0.5) AS rhob, quantile_cont(GR * 4, 0.5) AS gr, quantile_cont(NPHI, 0.5) AS nphi FROM logs GROUP BY well_id)),
un AS (SELECT me.*, declared, CASE lower(trim(declared)) WHEN 'us/m' THEN 'us_per_m' WHEN 'us/f' THEN 'us_per_ft' WHEN 'k/m3' THEN 'kg_m3' WHEN 'frac' THEN 'v_v' END AS own FROM me LEFT JOIN dc USING (well_id, curve)),
to_ AS (SELECT *, CASE WHEN own IS NOT NULL THEN NULL WHEN curve = 'DT' AND median BETWEEN 20 AND 160 THEN ['us_per_ft', '20', '160'] WHEN curve = 'DT' AND median BETWEEN 100 AND 550 THEN ['us_per_m', '100', '550'] WHEN curve = 'RHOB' AND median BETWEEN 1 AND 3.2 THEN ['g_cc', '1', '3.2'] WHEN curve = 'GR' AND median BETWEEN 0 AND 300 THEN ['api', '0', '300'] WHEN curve = 'NPHI' AND median BETWEEN 0 AND 1 THEN ['v_v', '0', '1'] END AS told FROM un)
SELECT well_id, curve, declared, coalesce(own, told[1]) AS unit, own IS NULL AS inferred, CAST(told[2] AS DOUBLE) AS low, CAST(told[3] AS DOUBLE) AS high, curve = 'DT' AND coalesce(coalesce(own, told[1]) = 'us_per_m', false) AS converted FROM to_""")
def unit_audit(spark, sf_dir):
    from lithos.operators import cleaning
    from lithos.sources.las import UNITS

    m = F.col("m")
    n = D.numbers(spark, sf_dir)
    declared = n.select("well_id", F.lit("DT").alias("curve"), F.when(m == 1, "US/M ").when(m == 2, "furlong").when(m == 3, "us/f").alias("declared"))
    declared = declared.unionByName(n.select("well_id", F.lit("RHOB").alias("curve"), F.when(m < 3, "K/M3").alias("declared"))).unionByName(n.where("m > 3").select("well_id", F.lit("NPHI").alias("curve"), F.lit("frac").alias("declared")))
    d = D.logs(spark, sf_dir).withColumn("GR", F.col("GR") * 4).withColumn("DT", F.when(of_seven() == 5, F.col("DT") * 3.2808).otherwise(F.col("DT")))
    return cleaning.resolve_units(d, declared, UNITS)
