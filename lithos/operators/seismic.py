"""Attributes and views of seismic traces.

Tables: dataset_id, trace_idx, inline, crossline, delay_ms, dt_ms, samples (array of double). Sums over
samples are higher-order functions of the array: no row is made for a sample unless asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.columns import clip, is_true
from lithos.plans.config import SEISMIC


def total(array, f=lambda x: x):
    return F.aggregate(F.transform(array, f), F.lit(0.0), lambda a, x: a + x)


def rms(samples="samples"):
    return F.sqrt(total(samples, lambda x: x * x) / F.size(samples))


def spectrum(traces: DataFrame) -> DataFrame:
    """trace_idx, bin, frequency, magnitude: Fourier transforms of whole batches of traces, those of one length together."""

    def run(batches):
        for b in batches:
            lists, steps = b.column("samples"), b.column("dt_ms").to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == n)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                z = np.abs(np.fft.rfft(np.nan_to_num(x), axis=1))
                bins = z.shape[1]
                rows = pa.array(np.repeat(at, bins))
                k = np.tile(np.arange(bins, dtype=np.int32), len(at))
                yield pa.RecordBatch.from_arrays([b.column("dataset_id").take(rows), b.column("trace_idx").take(rows), pa.array(k), pa.array(k * 1000.0 / (n * np.repeat(steps[at], bins))), pa.array(z.ravel())], ["dataset_id", "trace_idx", "bin", "frequency", "magnitude"])

    return traces.select("dataset_id", "trace_idx", "dt_ms", "samples").mapInArrow(run, "dataset_id string, trace_idx long, bin int, frequency double, magnitude double")


def dominant_frequency(spec: DataFrame, digits: int = 9) -> DataFrame:
    """The frequency of the largest magnitude, the lowest of equals (to `digits`)."""
    best = F.max(F.struct(F.round("magnitude", digits), (-F.col("bin")).alias("k"), F.col("frequency")))
    return spec.groupBy("dataset_id", "trace_idx").agg(best["frequency"].alias("dominant_freq_hz"))


def average_spectrum(spec: DataFrame) -> DataFrame:
    return spec.groupBy("dataset_id", "bin", "frequency").agg(F.avg("magnitude").alias("magnitude"))


def amplitude_report(spec: DataFrame) -> DataFrame:
    """dominant_freq_hz (without the bin of the mean), bandwidth_hz at half power and snr_proxy of each average spectrum (dataset_id, bin, frequency, magnitude)."""
    best = F.max(F.when(F.col("bin") > 0, F.struct(F.round("magnitude", 9).alias("m"), (-F.col("bin")).alias("k"), F.col("frequency").alias("f"), F.col("magnitude").alias("a"))))
    peak = spec.groupBy("dataset_id").agg(best.alias("p"))
    d = spec.join(F.broadcast(peak), "dataset_id").withColumn("__in", F.col("magnitude") >= F.col("p.a") / math.sqrt(2))
    inside, outside = F.when(F.col("__in"), F.col("frequency")), F.avg(F.when(~F.col("__in"), F.col("magnitude")))
    signal = F.avg(F.when(F.col("__in"), F.col("magnitude")))
    snr = F.when(outside > 0, signal / F.when(outside > 0, outside))
    return d.groupBy("dataset_id").agg(F.max("p.f").alias("dominant_freq_hz"), F.coalesce(F.max(inside) - F.min(inside), F.lit(0.0)).alias("bandwidth_hz"), snr.alias("snr_proxy"))


def proxies(attributes: DataFrame, config: dict = SEISMIC) -> DataFrame:
    """Lithology, porosity and saturation proxies from rms_amplitude and avg_envelope: the percentiles of a dataset are one row, joined back."""
    null = F.lit(None).cast("double")
    a = config["attributes"]
    cut = lambda c, p: F.percentile(c, F.lit(p / 100.0))
    low, high = a["normalize_low_percentile"], a["normalize_high_percentile"]
    stats = attributes.groupBy("dataset_id").agg(*[cut(c, p).alias(f"__{c}_{k}") for c in ("avg_envelope", "rms_amplitude") for k, p in (("lo", low), ("hi", high))], cut("avg_envelope", config["swe_proxy"]["bright_spot_percentile"]).alias("__b"))
    df = attributes.join(stats, "dataset_id")

    def normalised(c: str):
        lo, hi = F.col(f"__{c}_lo"), F.col(f"__{c}_hi")
        return F.when(hi <= lo, 0.0).otherwise((clip(F.col(c), lo, hi) - lo) / F.when(hi > lo, hi - lo))

    base = 1.0 - normalised("rms_amplitude")
    df = df.withColumn("vsh_proxy", normalised("avg_envelope") if config["vsh_proxy"]["enabled"] else null)
    df = df.withColumn("phie_proxy", base if config["phie_proxy"]["enabled"] else null)
    df = df.withColumn("swe_proxy", clip(F.when(is_true(F.col("avg_envelope") > F.col("__b")), base * 0.4).otherwise(base), 0.0, 1.0))
    return df.drop(*stats.columns[1:])


def survey_info(traces: DataFrame) -> DataFrame:
    return traces.groupBy("dataset_id").agg(
        F.count("*").alias("n_traces"), F.min("inline").alias("inline_min"), F.max("inline").alias("inline_max"), F.countDistinct("inline").alias("n_inlines"),
        F.min("crossline").alias("crossline_min"), F.max("crossline").alias("crossline_max"), F.countDistinct("crossline").alias("n_crosslines"),
        F.max(F.size("samples")).alias("n_samples"), F.min("delay_ms").alias("time_start"), (F.max(F.col("delay_ms") + (F.size("samples") - 1) * F.col("dt_ms"))).alias("time_end"),
    )


def section(traces: DataFrame, line: str, number: int) -> DataFrame:
    """The traces of one inline or crossline in order of the other; the filter reaches the scan."""
    other = {"inline": "crossline", "crossline": "inline"}[line]
    at = F.row_number().over(Window.partitionBy("dataset_id").orderBy(other, "trace_idx")) - 1
    out = traces.where(F.col(line) == number)
    return out.withColumn("position", at).select("dataset_id", "position", F.col(other).alias("other"), "trace_idx", F.posexplode("samples").alias("sample_idx", "amplitude"))


def nearest_sample(t: float):
    """The first sample nearest to a time."""
    x = (t - F.col("delay_ms")) / F.col("dt_ms")
    return F.greatest(F.lit(0), F.least(F.size("samples") - 1, F.ceil(x - 0.5).cast("int")))


def time_slice(traces: DataFrame, t: float) -> DataFrame:
    """The amplitude of every cell of the grid of lines at a time; NULL in gaps and where it is exactly 0 (padding)."""
    axis = lambda c: traces.select("dataset_id", c).where(F.col(c).isNotNull()).distinct()
    grid = axis("inline").join(axis("crossline"), "dataset_id")
    first = traces.groupBy("dataset_id", "inline", "crossline").agg(F.min(F.struct("trace_idx", F.try_element_at("samples", nearest_sample(t) + 1).alias("a"))).alias("b"))
    out = grid.join(first, ["dataset_id", "inline", "crossline"], "left")
    return out.select("dataset_id", "inline", "crossline", F.nullif(F.col("b.a"), F.lit(0.0)).alias("amplitude"))


def zero_profile(traces: DataFrame) -> DataFrame:
    """The share of zeros at each sample, of the traces that have a value there.

    A task adds up its traces element by element; a row for each sample is made of the sums alone.
    """

    def run(batches):
        sums: dict = {}  # zeros and values by sample, of each dataset
        for b in batches:
            column = b.column("samples")
            off, values = column.offsets.to_numpy(), column.values
            zero, there = (values.to_numpy(zero_copy_only=False) == 0), values.is_valid().to_numpy(zero_copy_only=False)
            names = b.column("dataset_id").dictionary_encode()
            length, code = np.diff(off), names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for n, k in {(n, k) for n, k in zip(length.tolist(), code.tolist()) if n}:
                at = off[:-1][(length == n) & (code == k)][:, None] + np.arange(n)
                name = names.dictionary[k].as_py() if k >= 0 else None
                have = sums.setdefault(name, np.zeros((2, n), np.int64))
                if have.shape[1] < n:
                    have = sums[name] = np.pad(have, ((0, 0), (0, n - have.shape[1])))
                have[:, :n] += np.stack([(zero[at] & there[at]).sum(0), there[at].sum(0)])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([x[i].tolist() for x in sums.values()], pa.list_(pa.int64())) for i in (0, 1))], ["dataset_id", "zeros", "n"])

    parts = traces.select("dataset_id", "samples").mapInArrow(run, "dataset_id string, zeros array<long>, n array<long>")
    flat = parts.select("dataset_id", F.posexplode(F.arrays_zip("zeros", "n")).alias("sample_idx", "z"))
    g = flat.groupBy("dataset_id", "sample_idx").agg(F.sum("z.zeros").alias("zeros"), F.sum("z.n").alias("n"))
    return g.select("dataset_id", "sample_idx", (F.col("zeros") / F.when(F.col("n") > 0, F.col("n"))).alias("zero_fraction"))


def best_time(traces: DataFrame) -> DataFrame:
    """The first sample with the least share of zeros."""
    return zero_profile(traces).groupBy("dataset_id").agg(F.min(F.struct("zero_fraction", "sample_idx"))["sample_idx"].alias("sample_idx"))


def dead_traces(traces: DataFrame) -> DataFrame:
    return traces.where(F.coalesce(F.forall("samples", lambda x: x == 0), F.lit(True))).select("dataset_id", "trace_idx")


def coverage(traces: DataFrame) -> DataFrame:
    """Cells of the rectangle of lines with no trace or several: inline, crossline, n."""
    axis = lambda c: traces.select("dataset_id", c).where(F.col(c).isNotNull()).distinct()
    n = traces.groupBy("dataset_id", "inline", "crossline").agg(F.count("*").alias("n"))
    out = axis("inline").join(axis("crossline"), "dataset_id").join(n, ["dataset_id", "inline", "crossline"], "left")
    return out.select("dataset_id", "inline", "crossline", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


#: Traces that are numbered in one task.
TOGETHER = 4096


def numbered(traces: DataFrame, name: str = "__k") -> DataFrame:
    """traces with their number in the order of trace_idx: counts of ranges of ids give each range its start, so no dataset is in one task."""
    part = F.floor(F.col("trace_idx") / TOGETHER)
    counts = traces.groupBy("dataset_id", part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("dataset_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("dataset_id", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    at = F.row_number().over(Window.partitionBy("dataset_id", "__part").orderBy("trace_idx")) - 1
    ids = traces.select("dataset_id", "trace_idx", part.alias("__part")).withColumn("__at", at).join(start, ["dataset_id", "__part"])
    return ids.select("dataset_id", "trace_idx", (F.col("__start") + F.col("__at")).alias(name))


def every_kth(traces: DataFrame, most: int) -> DataFrame:
    """Every k-th trace, k being the floor of the number over the most."""
    n = traces.groupBy("dataset_id").agg(F.count("*").alias("__n"))
    step = F.greatest(F.lit(1), F.expr(f"__n div {most}"))
    chosen = numbered(traces).join(n, "dataset_id").where(F.col("__k") % step == 0).select("dataset_id", "trace_idx")
    return traces.join(chosen, ["dataset_id", "trace_idx"], "left_semi")


def strided(traces: DataFrame, max_traces: int, max_samples: int) -> DataFrame:
    """Every k-th trace and sample: ids alone are numbered, and the samples fetched for those that stay."""
    inner = F.greatest(F.lit(1), F.expr(f"size(samples) div {max_samples}"))
    return every_kth(traces, max_traces).withColumn("samples", F.filter("samples", lambda x, i: i % inner == 0))


def at_lines(traces: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (inline, crossline) with the least trace_idx there; NULL where no trace is."""
    found = traces.groupBy("inline", "crossline").agg(F.min("trace_idx").alias("trace_idx"))
    return asked.join(found, ["inline", "crossline"], "left")


def one_trace(traces: DataFrame, dataset: str, index: int) -> DataFrame:
    """The samples of one trace with their times; IndexError if there is none of that number."""
    t = traces.where((F.col("dataset_id") == dataset) & (F.col("trace_idx") == index))
    if t.isEmpty():
        raise IndexError(index)
    return t.select("trace_idx", F.posexplode("samples").alias("sample_idx", "amplitude"), "delay_ms", "dt_ms").select("trace_idx", "sample_idx", (F.col("delay_ms") + F.col("sample_idx") * F.col("dt_ms")).alias("time_ms"), "amplitude")


def grid(traces: DataFrame) -> DataFrame:
    """The cells that have a trace: positions of their lines on both axes, and the first trace."""
    axis = lambda c: traces.select("dataset_id", c).distinct().withColumn(f"{c}_pos", F.row_number().over(Window.partitionBy("dataset_id").orderBy(c)) - 1)
    cells = traces.groupBy("dataset_id", "inline", "crossline").agg(F.min("trace_idx").alias("trace_idx"))
    return cells.join(axis("inline"), ["dataset_id", "inline"]).join(axis("crossline"), ["dataset_id", "crossline"])


def slice_zeros(traces: DataFrame, sample: int, around: int = 5) -> DataFrame:
    """Traces with a zero at a sample, and whether all samples within `around` of it are zero, too."""
    near = F.slice("samples", F.lit(max(1, sample + 1 - around)), F.lit(sample + around - max(0, sample - around) + 1))
    return traces.where(F.try_element_at("samples", F.lit(sample + 1)) == 0).select("dataset_id", "trace_idx", F.forall(near, lambda x: x == 0).alias("all_around"))


def summary(attributes: DataFrame) -> DataFrame:
    """Numbers of traces and the means of the attributes of each dataset; NULL for an attribute that is missing throughout."""
    names = ("rms_amplitude", "vsh_proxy", "phie_proxy", "swe_proxy")
    return attributes.groupBy("dataset_id").agg(F.count("*").alias("n_traces"), *[F.avg(c).alias(f"avg_{c}") for c in names])


def series(attributes: DataFrame) -> DataFrame:
    """The attributes of each dataset as arrays in the order of the traces, a row for each TOGETHER traces."""
    names = [c for c in attributes.columns if c not in ("dataset_id", "trace_idx")]
    part = F.floor(F.col("trace_idx") / TOGETHER).alias("part")
    rows = attributes.groupBy("dataset_id", part).agg(F.array_sort(F.collect_list(F.struct("trace_idx", *names))).alias("r"))
    return rows.select("dataset_id", "part", *[F.col(f"r.{c}").alias(c) for c in ("trace_idx", *names)])


def quality(traces: DataFrame) -> DataFrame:
    """Counts of traces, dead ones and those with a value that isn't finite."""
    odd = F.exists("samples", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    dead = F.forall("samples", lambda x: x == 0)
    return traces.groupBy("dataset_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(dead, F.lit(False)).cast("long")).alias("n_dead"), F.sum(F.coalesce(odd, F.lit(False)).cast("long")).alias("n_odd"))
