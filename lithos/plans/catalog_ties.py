"""Queries of ties: the search over a grid, synthetic seismograms and their views, spectra against logs at a matched frequency."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.operators import context as K
from lithos.operators import records, reports, spectral, synthetics, ties
from lithos.operators import wells as W
from lithos.plans import catalog as C
from lithos.plans import standins as D
from lithos.plans.catalog import INTERPRETED, SUMMARY, as_r, query, r
from lithos.plans.catalog_views import TIMED, interp, timed


def resolved(spark, sf_dir):
    """The trace of each well; some name a trace that isn't there."""
    t = D.ties(spark, sf_dir)
    return t.select("well_id", F.when(F.col("trace_idx") % 50 == 41, F.col("trace_idx") + 10**9).otherwise(F.col("trace_idx")).alias("trace_idx"))


RESOLVED = f"""{D.TIES_SQL}, {D.TRACES_SQL}, rs AS (SELECT well_id, trace_idx + CASE WHEN trace_idx % 50 = 41 THEN 1000000000 ELSE 0 END AS trace_idx FROM ties),
tr AS (SELECT well_id, rs.trace_idx, samples FROM rs LEFT JOIN traces ON traces.trace_idx = rs.trace_idx)"""

#: The logs in order of their own time, distinct times alone.
KEPT = """so AS (SELECT well_id, DEPT, DT, RHOB, DPTM AS t, row_number() OVER w AS q, DPTM - lag(DPTM) OVER w AS d FROM dp WINDOW w AS (PARTITION BY well_id ORDER BY DPTM, row_idx)),
ke AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY q) AS k FROM so WHERE d IS NULL OR d > 1e-6)"""

#: Every frequency with every shift of every well: 29 wavelets, 21 shifts of 2 ms.
GRID = f"""{RESOLVED}, {KEPT},
kp AS (SELECT well_id, t AS kx, RHOB / DT AS y FROM ke),
ends AS (SELECT well_id, min(kx) AS t0, max(kx) AS t1 FROM kp GROUP BY well_id HAVING count(*) >= 10 AND max(kx) > min(kx)),
ax AS (SELECT well_id, unnest(range(CAST(ceil((t1 - t0) / 2.0) AS BIGINT))) AS i, t0 FROM ends),
ap AS (SELECT well_id, i, t0 + i * 2.0::DOUBLE AS x FROM ax), {interp('am', 'ap', 'kp')},
rc AS (SELECT well_id, i, x AS t, (nxt - value) / (nxt + value) AS rc FROM (SELECT *, lead(value) OVER (PARTITION BY well_id ORDER BY i) AS nxt FROM am) WHERE nxt IS NOT NULL),
nn AS (SELECT well_id, count(*) AS n, least(0.1::DOUBLE, greatest(0.03::DOUBLE, 0.6::DOUBLE * count(*) * 2.0::DOUBLE / 1000.0::DOUBLE)) AS len FROM rc GROUP BY well_id HAVING count(*) >= 5),
nw AS (SELECT *, least(30, greatest(10, n // 2)) AS least_n, CAST(ceil(len / 0.002::DOUBLE - 1e-9) AS BIGINT) AS m FROM nn),
fr AS (SELECT 8.0::DOUBLE + 2 * unnest(range(29)) AS f),
wv AS (SELECT well_id, f, k, pow(pi() * f * (-len / 2 + 0.002::DOUBLE * k), 2) AS a FROM (SELECT well_id, f, len, unnest(range(m)) AS k FROM nw, fr)),
sy AS (SELECT rc.well_id, f, rc.i + k - (m - 1) // 2 AS i, sum(rc * (1 - 2 * a) * exp(-a)) AS s FROM rc JOIN nw USING (well_id) JOIN wv ON wv.well_id = rc.well_id GROUP BY rc.well_id, f, rc.i + k - (m - 1) // 2),
lk AS (SELECT rc.well_id, i, sh, least(greatest(CAST(floor((t + sh - 2030) / 2) AS BIGINT), 0), 62) AS lo, (t + sh - 2030) / 2 AS p, samples FROM rc JOIN tr USING (well_id), (SELECT -20.0::DOUBLE + 2 * unnest(range(21)) AS sh) WHERE samples IS NOT NULL AND t + sh >= 2030 - 1e-6 AND t + sh <= 2156 + 1e-6),
sn AS (SELECT well_id, i, sh, samples[lo + 1] + (samples[lo + 2] - samples[lo + 1]) * (p - lo) AS y FROM lk),
gr AS (SELECT sn.well_id, f, sh, count(*) AS n_used, CASE WHEN stddev_pop(y) > 0 AND stddev_pop(s) > 0 THEN corr(s, y) END AS r FROM sn JOIN sy ON sy.well_id = sn.well_id AND sy.i = sn.i GROUP BY sn.well_id, f, sh),
pk AS (SELECT well_id, r * p AS correlation, f AS frequency, p AS polarity, sh AS shift_ms, n_used, row_number() OVER (PARTITION BY well_id ORDER BY round(r * p, 12) DESC, f, p DESC, sh) AS q
  FROM gr JOIN nw USING (well_id), (SELECT CAST(unnest([1, -1]) AS INTEGER) AS p) WHERE n_used >= least_n AND r IS NOT NULL),
wt AS (SELECT tr.well_id, trace_idx, correlation, frequency, polarity, shift_ms, n_used, abs(shift_ms) >= 0.95::DOUBLE * 20 AS boundary_pinned, correlation < 0.3 OR abs(shift_ms) >= 0.95::DOUBLE * 20 AS low_confidence,
  CASE WHEN samples IS NULL THEN 'no trace' WHEN ends.well_id IS NULL THEN 'too few samples' WHEN pk.well_id IS NULL THEN 'no overlap' END AS error
  FROM tr LEFT JOIN ends ON ends.well_id = tr.well_id LEFT JOIN pk ON pk.well_id = tr.well_id AND q = 1)"""


def searched(spark, sf_dir):
    return ties.tie_wells(timed(spark, sf_dir), resolved(spark, sf_dir), D.traces(spark, sf_dir), max_shift=20.0)


@query(TIMED + f", {GRID} SELECT well_id, trace_idx, {r('correlation')}, frequency, polarity, shift_ms, n_used, boundary_pinned, low_confidence, error FROM wt")
def well_ties(spark, sf_dir):
    return searched(spark, sf_dir)


@query(INTERPRETED.rstrip() + f""", {TIMED[TIMED.index('s AS (SELECT * FROM logs'):]}, {GRID}, sm AS ({SUMMARY}), z AS (SELECT well_id, count(*) AS n_pay, count(*) * max(step) AS pay_thickness FROM it WHERE ZONES = 1 GROUP BY well_id)
SELECT sm.well_id, {r('footage')}, {r('mean_vsh')}, {r('mean_phie')}, {r('mean_swe')}, {r('net_pay')}, {as_r('coalesce(pay_thickness, 0)', 'pay_thickness')}, coalesce(n_pay, 0) AS n_pay, {r('correlation')}, shift_ms, low_confidence, error AS tie_error
FROM sm LEFT JOIN z USING (well_id) LEFT JOIN wt ON wt.well_id = sm.well_id""")
def field_overview(spark, sf_dir):
    d = C.interpreted(spark, sf_dir)
    return reports.field_overview(W.well_summary(d), W.zone_summary(d), searched(spark, sf_dir))


# synthetic seismograms with a wavelet as it is, from measured densities, moved by stretch points
SEISMOGRAM = TIMED + f""", {RESOLVED}, {D.POINTS_SQL}, {KEPT},
ai AS (SELECT well_id, k, DEPT, t, 0.3048::DOUBLE * 1e6 / DT * RHOB AS ai FROM ke),
r0 AS (SELECT well_id, k, (lead(ai) OVER w - ai) / (lead(ai) OVER w + ai) AS x0, (t + lead(t) OVER w) / 2 AS tm, (DEPT + lead(DEPT) OVER w) / 2 AS x FROM ai WINDOW w AS (PARTITION BY well_id ORDER BY k) QUALIFY lead(k) OVER w IS NOT NULL),
md AS (SELECT *, quantile_cont(x0, 0.5) OVER (PARTITION BY well_id) AS mid, sqrt(avg(x0 * x0) OVER (PARTITION BY well_id)) AS rms FROM r0),
mm AS (SELECT *, greatest(quantile_cont(abs(x0 - mid), 0.5) OVER (PARTITION BY well_id), 0.15::DOUBLE * rms) AS mad FROM md),
r1 AS (SELECT well_id, k, tm, x, CASE WHEN mad > 0 AND abs(x0 - mid) > 5 * mad THEN 0.0::DOUBLE ELSE x0 END AS rc FROM mm), {interp('mv', 'r1', 'tp')},
r2 AS (SELECT well_id, k, x AS depth, tm + coalesce(value, ended, 0) AS kx, rc AS y FROM mv JOIN tr USING (well_id) WHERE samples IS NOT NULL),
en AS (SELECT well_id, min_by(kx, k) AS t0, max_by(kx, k) AS t1 FROM r2 GROUP BY well_id),
rg AS (SELECT well_id, i, t0 + i * 2.0::DOUBLE AS x FROM (SELECT well_id, t0, unnest(range(CAST(ceil((t1 - t0) / 2.0 - 1e-9) AS BIGINT))) AS i FROM en)), {interp('ra', 'rg', 'r2')},
n2 AS (SELECT well_id, max(i) AS top FROM ra GROUP BY well_id),
wl AS (SELECT k, (1 - 2 * a) * exp(-a) AS w FROM (SELECT k, pow(pi() * 25 * (-0.064::DOUBLE + 0.002::DOUBLE * k), 2) AS a FROM (SELECT unnest(range(64)) AS k))),
cv AS (SELECT well_id, i + k - 31 AS i, sum(value * w) AS s FROM ra, wl GROUP BY well_id, i + k - 31),
sg AS (SELECT well_id, t0 + cv.i * 2.0::DOUBLE AS kx, s AS y FROM cv JOIN n2 USING (well_id) JOIN en USING (well_id) WHERE cv.i BETWEEN 0 AND top),
sx AS (SELECT well_id, i, 2030.0::DOUBLE + i * 2.0::DOUBLE AS x, samples[i + 1] AS real FROM (SELECT well_id, samples, unnest(range(64)) AS i FROM tr WHERE samples IS NOT NULL AND well_id IN (SELECT well_id FROM en))), {interp('sa', 'sx', 'sg')},
st AS (SELECT well_id, i, x AS time_ms, real, coalesce(value, 0.0::DOUBLE) AS s FROM sa),
ms AS (SELECT well_id, avg(s) AS a, stddev_pop(s) + 1e-12 AS b, avg(real) AS c, stddev_pop(real) + 1e-12 AS d FROM st GROUP BY well_id),
xc AS (SELECT y.well_id, y.i - x.i AS lag, sum((y.real - c) / d * (x.s - a) / b) AS v FROM st x JOIN st y ON y.well_id = x.well_id JOIN ms ON ms.well_id = x.well_id GROUP BY y.well_id, y.i - x.i),
bl AS (SELECT well_id, lag FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY round(v, 9) DESC, lag) AS q FROM xc) WHERE q = 1),
sd AS (SELECT st.well_id, st.i, st.time_ms, st.real, st.s AS synthetic, coalesce(o.s, 0.0::DOUBLE) AS shifted FROM st JOIN bl USING (well_id) LEFT JOIN st o ON o.well_id = st.well_id AND o.i = st.i - lag),
cc AS (SELECT well_id, CASE WHEN count(*) FILTER (shifted <> 0) >= 5 THEN coalesce(corr(CASE WHEN shifted <> 0 THEN shifted END, CASE WHEN shifted <> 0 THEN real END), 0) ELSE 0 END AS correlation FROM sd GROUP BY well_id),
tp1 AS (SELECT well_id, min_by(DEPT, row_idx) AS top FROM dp GROUP BY well_id)"""


def made(spark, sf_dir, **options):
    return synthetics.seismograms(timed(spark, sf_dir), resolved(spark, sf_dir), D.traces(spark, sf_dir), points=D.tie_points(spark, sf_dir), **{"wavelet": "ricker"} | options)


@query(SEISMOGRAM + f""" SELECT tr.well_id, trace_idx, {r('correlation')}, lag * 2.0::DOUBLE AS shift_ms, abs(lag * 2.0::DOUBLE) >= 285 AS boundary_pinned, CASE WHEN samples IS NOT NULL THEN 'dptm' END AS time_source,
CASE WHEN samples IS NOT NULL THEN 3045.0::DOUBLE END AS implied_depth, {as_r('CASE WHEN samples IS NOT NULL THEN abs(3045 - top) / top END', 'relative_error')}, CASE WHEN samples IS NOT NULL THEN abs(3045 - top) / top <= 0.5 END AS plausible,
CASE WHEN samples IS NULL THEN 'no trace' END AS error FROM tr LEFT JOIN cc ON cc.well_id = tr.well_id LEFT JOIN bl ON bl.well_id = tr.well_id LEFT JOIN tp1 ON tp1.well_id = tr.well_id""")
def seismogram_ties(spark, sf_dir):
    out = synthetics.summary(made(spark, sf_dir))
    return out.select("well_id", "trace_idx", "correlation", "shift_ms", "boundary_pinned", "time_source", "implied_depth", "relative_error", "plausible", "error")


@query(SEISMOGRAM + f" SELECT well_id, CAST(i AS INTEGER) AS i, time_ms, {r('synthetic')}, {r('shifted')}, {r('real')} FROM sd")
def seismogram_traces(spark, sf_dir):
    return synthetics.view(made(spark, sf_dir), "traces")


@query(SEISMOGRAM + f" SELECT well_id, CAST(k - 1 AS INTEGER) AS i, {r('depth')}, {as_r('kx', 'twt_ms')}, {as_r('y', 'rc')} FROM r2")
def seismogram_reflectivity(spark, sf_dir):
    return synthetics.view(made(spark, sf_dir), "reflectivity")


@query(SEISMOGRAM + f""", sb AS (SELECT well_id, bin, sum(real * cos(2 * pi() * (bin * i % 64) / 64)) AS a, sum(real * sin(2 * pi() * (bin * i % 64) / 64)) AS b, sum(shifted * cos(2 * pi() * (bin * i % 64) / 64)) AS c, sum(shifted * sin(2 * pi() * (bin * i % 64) / 64)) AS d FROM sd, (SELECT unnest(range(33)) AS bin) GROUP BY well_id, bin)
SELECT well_id, CAST(bin AS INTEGER) AS i, bin * 1000.0::DOUBLE / 128 AS frequency, {as_r('sqrt(a * a + b * b)', 'real')}, {as_r('sqrt(c * c + d * d)', 'synthetic')} FROM sb""")
def seismogram_spectra(spark, sf_dir):
    return synthetics.view(made(spark, sf_dir), "spectra")


# spectra against logs at a matched frequency
CURVES = ["VSH", "PHIE", "SWE"]
LOGGED = INTERPRETED.rstrip() + ", " + TIMED[TIMED.index("s AS (SELECT * FROM logs"):] + f""", {D.TRACES_SQL}, {D.TIES_SQL},
kn AS (SELECT well_id, DPTM AS kx, min(DEPT) AS y FROM dp WHERE DPTM IS NOT NULL GROUP BY well_id, DPTM),
tm AS (SELECT *, 2030.0::DOUBLE + time_idx * 2.0::DOUBLE - shift_ms AS x FROM (SELECT well_id, trace_idx, shift_ms, unnest(range(64)) AS time_idx FROM ties SEMI JOIN traces USING (trace_idx))),
{interp('dd', 'tm', 'kn')}, cx AS (SELECT well_id, trace_idx, time_idx, value AS depth, value AS x FROM dd WHERE value IS NOT NULL)""" + "".join(f""",
kn_{c} AS (SELECT well_id, DEPT AS kx, min({c}) AS y FROM it WHERE {c} IS NOT NULL GROUP BY well_id, DEPT), {interp(f'at_{c}', 'cx', f'kn_{c}')}""" for c in CURVES) + """,
px AS (SELECT v.well_id, v.trace_idx, v.time_idx, v.depth, v.value AS VSH, p.value AS PHIE, w.value AS SWE FROM at_VSH v JOIN at_PHIE p USING (well_id, time_idx) JOIN at_SWE w USING (well_id, time_idx)),
ow AS (SELECT trace_idx, CAST(generate_subscripts(samples, 1) - 1 AS INTEGER) AS i, unnest(samples) AS x FROM traces SEMI JOIN ties USING (trace_idx))"""


def morlet(name: str, f: str) -> str:
    """name: the CWT (re, im) of the tied traces at a frequency, by time; name_f: bin and frequency."""
    return f"""{name}_f AS (SELECT bin, f, 6.0::DOUBLE / (2 * pi() * f) AS sg FROM ({f})),
{name}_k AS (SELECT bin, f, lag, pow(pi(), -0.25) / sqrt(sg) * exp(-pow(lag * 0.002, 2) / (2 * sg * sg)) AS a FROM {name}_f, (SELECT CAST(unnest(range(-63, 64)) AS INTEGER) AS lag) WHERE abs(lag) <= greatest(1, ceil(3 * sg / 0.002))),
{name} AS (SELECT o.trace_idx, o.i, bin, any_value(f) AS f, sum(s.x * a * cos(2 * pi() * f * lag * 0.002)) AS re, sum(s.x * a * sin(2 * pi() * f * lag * 0.002)) AS im FROM ow o JOIN ow s ON s.trace_idx = o.trace_idx JOIN {name}_k ON lag = o.i - s.i GROUP BY o.trace_idx, o.i, bin)"""


TAPS = "fl AS (SELECT CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS j, unnest(v) AS lo FROM (SELECT [" + ", ".join(f"{x!r}::DOUBLE" for x in spectral.SYM8) + "] AS v)), ft AS (SELECT j, lo, (SELECT lo FROM fl b WHERE b.j = 15 - a.j) * CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END AS hi FROM fl a)"


def level(k: int) -> str:
    """Approximation and detail of one more level, of 64 samples."""
    return f"w{k} AS (SELECT a.trace_idx, a.i, sum(lo * b.a) AS a, sum(hi * b.a) AS d FROM w{k - 1} a, ft JOIN w{k - 1} b ON b.trace_idx = a.trace_idx AND b.i = (a.i - (j - 8) * {1 << k - 1} + 1024) % 64 GROUP BY a.trace_idx, a.i)"


def kernel(name: str, of: str, x: str) -> str:
    """name: the envelope e of 64 samples x of a table, by trace."""
    return f"""{name} AS (SELECT o.trace_idx, o.i, sqrt(pow(any_value(o.{x}), 2) + pow(sum(s.{x} * CASE WHEN (o.i - s.i) % 2 <> 0 THEN 2.0::DOUBLE / 64 / tan(pi() * (o.i - s.i) / 64) ELSE 0 END), 2)) AS e FROM {of} o JOIN {of} s ON s.trace_idx = o.trace_idx GROUP BY o.trace_idx, o.i)"""


#: Level 3 is 31.25 to 62.5 Hz: its centre, 46.875, is nearest to the bin at 45 Hz.
SWT = f"""{TAPS}, w0 AS (SELECT trace_idx, i, x AS a FROM ow), {level(1)}, {level(2)}, {level(3)}, {kernel('ev', 'w3', 'd')}, {morlet('cw', 'SELECT 0 AS bin, 45.0::DOUBLE AS f')},
am AS (SELECT ev.trace_idx, ev.i, sqrt(re * re + im * im) AS cwt, e AS other FROM ev JOIN cw USING (trace_idx, i))"""
BINS = "SELECT bin, (250.0::DOUBLE / 60) * pow(60.0::DOUBLE, bin / 31.0::DOUBLE) AS f FROM (SELECT CAST(unnest(range(32)) AS INTEGER) AS bin)"
SQUEEZED = f"""{morlet('cw', 'SELECT 0 AS bin, 30.0::DOUBLE AS f')}, {morlet('sq', BINS)},
sg1 AS (SELECT *, CASE WHEN i = 0 THEN lead(re) OVER w - re WHEN i = 63 THEN re - lag(re) OVER w ELSE (lead(re) OVER w - lag(re) OVER w) / 2 END / 0.002 AS dr,
  CASE WHEN i = 0 THEN lead(im) OVER w - im WHEN i = 63 THEN im - lag(im) OVER w ELSE (lead(im) OVER w - lag(im) OVER w) / 2 END / 0.002 AS di, max(sqrt(re * re + im * im)) OVER (PARTITION BY trace_idx) AS top FROM sq WINDOW w AS (PARTITION BY trace_idx, bin ORDER BY i)),
sg2 AS (SELECT trace_idx, i, re, im, abs((di * re - dr * im) / (re * re + im * im)) / (2 * pi()) AS inst FROM sg1 WHERE sqrt(re * re + im * im) > 1e-8 * top),
edge AS (SELECT a.bin, sqrt(a.f * b.f) AS e FROM sq_f a JOIN sq_f b ON b.bin = a.bin + 1),
pick AS (SELECT bin FROM sq_f ORDER BY abs(f - 30), bin LIMIT 1),
sg3 AS (SELECT trace_idx, i, sum(re) AS re, sum(im) AS im FROM sg2, pick WHERE (SELECT count(*) FROM edge WHERE e < inst) = bin GROUP BY trace_idx, i),
am AS (SELECT cw.trace_idx, cw.i, sqrt(cw.re * cw.re + cw.im * cw.im) AS cwt, coalesce(sqrt(sg3.re * sg3.re + sg3.im * sg3.im), 0.0::DOUBLE) AS other FROM cw LEFT JOIN sg3 USING (trace_idx, i))"""
METHODS = """lg AS (SELECT well_id, trace_idx, time_idx, unnest(['VSH', 'PHIE', 'SWE']) AS curve, unnest([VSH, PHIE, SWE]) AS v FROM px),
pr AS (SELECT well_id, curve, v, CASE WHEN v IS NOT NULL THEN cwt END AS cwt, CASE WHEN v IS NOT NULL THEN other END AS other FROM lg JOIN am ON am.trace_idx = lg.trace_idx AND i = time_idx),
co AS (SELECT well_id, curve, count(v) AS n, CASE WHEN count(v) >= 2 AND stddev_pop(v) > 0 AND stddev_pop(cwt) > 0 THEN corr(cwt, v) END AS cwt_r, CASE WHEN count(v) >= 2 AND stddev_pop(v) > 0 AND stddev_pop(other) > 0 THEN corr(other, v) END AS other_r FROM pr GROUP BY well_id, curve)"""
PER_WELL = f" SELECT well_id, curve, {r('cwt_r')}, n AS cwt_n, {r('other_r')}, n AS other_n, min(n) OVER (PARTITION BY well_id) < 20 AS low_sample_warning FROM co"
MEANS = f" SELECT curve, {as_r('avg(cwt_r)', 'cwt_r')}, {as_r('avg(other_r)', 'other_r')}, greatest(count(cwt_r), count(other_r)) AS n_wells FROM co GROUP BY curve"


def logged(spark, sf_dir):
    """Each tied well's curves at the times of its trace, and the tied traces."""
    t, traces = D.ties(spark, sf_dir), D.traces(spark, sf_dir)
    own = traces.join(t.select("trace_idx"), "trace_idx", "left_semi")
    here, n = D.tied(spark, sf_dir), D.parts(spark, sf_dir)
    return K.properties(K.overlap(t, traces, timed(spark, sf_dir, here), parts=n), C.interpreted(spark, sf_dir, here), CURVES, n), own


@query(f"{LOGGED}, {SWT}, {METHODS}{PER_WELL}")
def cwt_swt_correlation(spark, sf_dir):
    context, own = logged(spark, sf_dir)
    return K.method_correlation(context, spectral.matched_bands(own, 3), CURVES)


@query(f"{LOGGED}, {SWT}, {METHODS}{MEANS}")
def cwt_swt_averages(spark, sf_dir):
    return K.method_averages(cwt_swt_correlation(spark, sf_dir))


@query(f"{LOGGED}, {SQUEEZED}, {METHODS}{PER_WELL}")
def cwt_sswt_correlation(spark, sf_dir):
    context, own = logged(spark, sf_dir)
    return K.method_correlation(context, spectral.matched_squeezed(own, 30.0), CURVES)


@query(f"{LOGGED}, {SQUEEZED}, {METHODS}{MEANS}")
def cwt_sswt_averages(spark, sf_dir):
    return K.method_averages(cwt_sswt_correlation(spark, sf_dir))


@query(f"{LOGGED}, {SQUEEZED} SELECT well_id, CAST(time_idx AS INTEGER) AS time_idx, {', '.join(r(c) for c in ('depth', 'VSH', 'PHIE', 'SWE', 'cwt', 'other'))} FROM px JOIN am ON am.trace_idx = px.trace_idx AND i = time_idx")
def cwt_sswt_scatter(spark, sf_dir):
    context, own = logged(spark, sf_dir)
    return K.scatter(context, spectral.matched_squeezed(own, 30.0), CURVES)


@query(f"""WITH {D.TRACES_SQL}, {TAPS}, cut AS (SELECT trace_idx, samples, CASE WHEN trace_idx % 2 = 0 THEN 64 ELSE 50 END AS n FROM traces),
w0 AS (SELECT trace_idx, i, samples[CASE WHEN i < n THEN i ELSE 2 * n - 2 - i END + 1] AS a FROM (SELECT *, CAST(unnest(range(64)) AS INTEGER) AS i FROM cut)), {', '.join(level(k) for k in range(1, 7))},
al AS ({' UNION ALL '.join(f'SELECT trace_idx, i, {k - 1} AS band, d FROM w{k}' for k in range(1, 7))}), af AS (SELECT al.* FROM al JOIN cut USING (trace_idx) WHERE i < n),
en AS (SELECT o.trace_idx, o.band, o.i, sqrt(pow(any_value(o.d), 2) + pow(sum(s.d * CASE WHEN (o.i - s.i) % 2 <> 0 THEN 2.0::DOUBLE / n / tan(pi() * (o.i - s.i) / n) ELSE 0 END), 2)) AS e FROM af o JOIN af s ON s.trace_idx = o.trace_idx AND s.band = o.band JOIN cut ON cut.trace_idx = o.trace_idx GROUP BY o.trace_idx, o.band, o.i)
SELECT trace_idx, CAST(band AS INTEGER) AS band, {as_r('avg(e)', 'mean_energy')} FROM en GROUP BY trace_idx, band""")
def time_frequency_swt(spark, sf_dir):
    short = F.when(F.col("trace_idx") % 2 == 0, F.col("samples")).otherwise(F.slice("samples", 1, 50))
    e = spectral.decompose(D.traces(spark, sf_dir).withColumn("samples", short), "swt")
    return e.select("trace_idx", "band", (F.aggregate("energy", F.lit(0.0), lambda a, x: a + x) / F.size("energy")).alias("mean_energy"))


# records of wells: tie, synthetic and line spectrum in one row
RECORDS = SEISMOGRAM + "," + GRID[len(f"{RESOLVED}, {KEPT},") :] + f""",
ls AS (SELECT inline, bin, avg(sqrt(re * re + im * im)) AS m FROM (SELECT inline, trace_idx, bin, sum(x * cos(2 * pi() * (bin * i % 64) / 64)) AS re, sum(x * sin(2 * pi() * (bin * i % 64) / 64)) AS im
  FROM (SELECT inline, trace_idx, generate_subscripts(samples, 1) - 1 AS i, unnest(samples) AS x FROM traces), (SELECT unnest(range(33)) AS bin) GROUP BY inline, trace_idx, bin) GROUP BY inline, bin),
lp AS (SELECT inline, bin AS pb, m AS pm FROM (SELECT *, row_number() OVER (PARTITION BY inline ORDER BY round(m, 9) DESC, bin) AS q FROM ls WHERE bin > 0) WHERE q = 1),
lb AS (SELECT inline, any_value(pb) * 7.8125::DOUBLE AS dominant, (max(bin) FILTER (m >= pm / sqrt(2.0::DOUBLE)) - min(bin) FILTER (m >= pm / sqrt(2.0::DOUBLE))) * 7.8125::DOUBLE AS bandwidth, avg(m) FILTER (m >= pm / sqrt(2.0::DOUBLE)) / avg(m) FILTER (m < pm / sqrt(2.0::DOUBLE)) AS snr FROM ls JOIN lp USING (inline) GROUP BY inline),
rl AS (SELECT wt.*, inline, crossline, wt.error IS NULL AS ok FROM wt LEFT JOIN traces ON traces.trace_idx = wt.trace_idx),
ry AS (SELECT tr.well_id, samples IS NOT NULL AS avail, cc.correlation AS c, bl.lag * 2.0::DOUBLE AS s, abs(3045 - top) / top <= 0.5 AS plausible FROM tr LEFT JOIN cc ON cc.well_id = tr.well_id LEFT JOIN bl ON bl.well_id = tr.well_id LEFT JOIN tp1 ON tp1.well_id = tr.well_id)"""


@query(RECORDS + f""" SELECT rl.well_id, ok AS tie_available, error AS tie_error, {as_r('CASE WHEN ok THEN rl.correlation END', 'tie_correlation')}, CASE WHEN ok THEN boundary_pinned END AS tie_boundary_pinned, CASE WHEN ok THEN low_confidence END AS tie_low_confidence,
CASE WHEN ok THEN frequency END AS tie_frequency, CASE WHEN ok THEN polarity END AS tie_polarity, CASE WHEN ok THEN shift_ms END AS tie_shift_ms, CASE WHEN ok THEN trace_idx END AS tie_trace_idx, CASE WHEN ok THEN rl.inline END AS tie_inline, CASE WHEN ok THEN crossline END AS tie_crossline,
avail AS synthetic_available, CASE WHEN NOT avail THEN 'no trace' END AS synthetic_error, {as_r('CASE WHEN avail THEN c END', 'synthetic_correlation')}, CASE WHEN avail THEN c < 0.3 OR abs(s) >= 285 OR NOT plausible END AS synthetic_low_confidence, CASE WHEN avail THEN s END AS synthetic_shift_ms,
ok AND lb.inline IS NOT NULL AS spectral_available, CASE WHEN ok THEN lb.inline END AS spectral_inline, CASE WHEN ok THEN dominant END AS spectral_dominant_freq_hz, CASE WHEN ok THEN bandwidth END AS spectral_bandwidth_hz, {as_r('CASE WHEN ok THEN snr END', 'spectral_snr_proxy')}
FROM rl JOIN ry ON ry.well_id = rl.well_id LEFT JOIN lb ON lb.inline = rl.inline""")
def well_records(spark, sf_dir):
    out = records.well_records(searched(spark, sf_dir), made(spark, sf_dir), D.traces(spark, sf_dir))
    return out.drop("tie_distance", "synthetic_boundary_pinned", "synthetic_datum_plausible", "synthetic_washout_count", "synthetic_polarity")
