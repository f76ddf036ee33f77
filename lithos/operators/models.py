"""Property models with leave-one-well-out validation, on pyspark.ml.

Samples: well_id, the feature columns, a property column, and a weight. Wells are the folds: the
loops of trees run over wells, the fits and predictions over their samples on the executors; ridge
regressions of all folds come from one aggregation. Fits differ from other libraries' in detail, so the
tests ask for skill on planted data and for no leakage.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.columns import pearson

SEED = 42
RIDGE = 1.0
TREES, DEPTH = 200, 8
LEAST_WELLS, LEAST_TRAINING_WELLS, LEAST_SAMPLES = 2, 3, 5
TOP, COLLINEAR, UNSTABLE = 8, 0.95, 0.3
#: Outcomes of a blind-well run.
VALIDATED, UNUSABLE, TOO_FEW, NO_FEATURES, NO_BLIND = "validated", "blind_well_unusable", "insufficient_data", "no_stable_features", "blind_well_no_valid_samples"


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows without a missing or unbounded value in these columns."""
    ok = reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), columns, F.lit(True))
    return df.where(ok)


def vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__features").transform(complete(df, features))


def forest(target: str, trees: int = TREES, depth: int = DEPTH, **more):
    return RandomForestRegressor(featuresCol="__features", labelCol=target, predictionCol="prediction", numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy=more.pop("subset", "all"), **more)


PERM = ["PHIE", "VSH", "LOG_PERM"]


def _perm_inputs(df: DataFrame) -> DataFrame:
    return df.withColumn("LOG_PERM", F.log10(F.greatest(F.col("PERM_TIXIER"), F.lit(1e-3))))


def train_core_perm(df: DataFrame, core: str, trees: int = TREES):
    """A forest of PHIE, VSH and log permeability for the logarithm of core permeability."""
    d = complete(_perm_inputs(df), [core]).withColumn("__y", F.log10(F.greatest(F.col(core), F.lit(1e-3))))
    return forest("__y", trees).fit(vectors(d, PERM))


def predict_core_perm(df: DataFrame, model, keys=("well_id", "row_idx")) -> DataFrame:
    """df with CORE_PERM_PRED; NULL on rows that miss an input."""
    d = _perm_inputs(df)
    out = model.transform(vectors(d, PERM)).select(*keys, F.pow(F.lit(10.0), F.col("prediction")).alias("CORE_PERM_PRED"))
    return df.join(out, list(keys), "left")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark, path: str):
    """A saved forest; None where nothing was saved."""
    from pyspark.ml.regression import RandomForestRegressionModel

    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return RandomForestRegressionModel.load(path) if there else None


def with_core_perm(df: DataFrame, path: str) -> DataFrame:
    """df with CORE_PERM_PRED from the saved model; without the column if no model was saved."""
    model = load_model(df.sparkSession, path)
    return df if model is None else predict_core_perm(df, model)


def skill(scored: DataFrame, target: str, by: list[str] = ()) -> DataFrame:
    """n, r2 and rmse of column prediction against target, for all rows or by group."""
    mean = F.avg(target).over(Window.partitionBy(*by)) if by else F.avg(target).over(Window.partitionBy(F.lit(0)))
    if not by:  # one number for all: no window over the table
        m = scored.agg(F.avg(target).alias("__m"))
        d = scored.join(F.broadcast(m), F.lit(True))
    else:
        d = scored.withColumn("__m", mean)
    e = F.pow(F.col(target) - F.col("prediction"), F.lit(2.0))
    t = F.pow(F.col(target) - F.col("__m"), F.lit(2.0))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.sum(t) > 0, 1 - F.sum(e) / F.when(F.sum(t) > 0, F.sum(t))).alias("r2"), F.sqrt(F.avg(e)).alias("rmse"))


def wells_of(df: DataFrame) -> list[str]:
    """The wells, in order: as many as there are folds."""
    return [r[0] for r in df.select("well_id").distinct().orderBy("well_id").collect()]


def leave_one_out(samples: DataFrame, features: list[str], target: str, make, least: int = LEAST_SAMPLES) -> DataFrame | None:
    """Every well's rows with the prediction of a model fitted on the other wells; None with fewer than two wells."""
    ready = vectors(complete(samples, [target]), features)
    counts = {r["well_id"]: r["count"] for r in ready.groupBy("well_id").count().collect()}
    wells = sorted(counts)
    if len(wells) < LEAST_WELLS:
        return None
    parts = []
    for w in wells:
        if sum(n for k, n in counts.items() if k != w) < least:
            continue
        parts.append(make(target).fit(ready.where(F.col("well_id") != w)).transform(ready.where(F.col("well_id") == w)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def fold_fits(samples: DataFrame, features: list[str], target: str, strength: float = RIDGE, weight: str | None = None) -> DataFrame:
    """(well_id, n, intercept, slopes): for each well a ridge regression fitted on all *other* wells' samples.

    The moments of all wells less a well's own are those of its fold, so one aggregation serves every
    fold: a row of sums for each well, one for all, and a small system of equations for each well. No
    job is run for a well, and no well's samples reach its own fit. Features are scaled to deviation 1
    within the fold before the penalty; the intercept is free. slopes are NULL for folds with fewer than
    LEAST_SAMPLES samples. Samples that lack a number don't count.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    good = complete(samples, [*features, target, *([weight] if weight else [])])
    names = [*features, target]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    sums = [F.count("*").alias("n"), F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(names)], *[F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]]
    own = good.groupBy("well_id").agg(*sums)
    every = own.agg(*[F.sum(c).alias(f"all_{c}") for c in own.columns if c != "well_id"])  # one row
    folds = own.join(F.broadcast(every), F.lit(True))
    rest = [(F.col(f"all_{c}") - F.col(c)).alias(c) for c in own.columns if c != "well_id"]
    k = len(features)

    def solve(batches):
        for b in batches:
            t = {c: b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in b.schema.names if c != "well_id"}
            n, total = len(b), np.maximum(t["w"], 1e-300)
            mean = np.stack([t[f"s{i}"] / total for i in range(k + 1)], 1)
            cov = np.empty((n, k + 1, k + 1))
            for i, j in pairs:
                cov[:, i, j] = cov[:, j, i] = t[f"p{i}_{j}"] / total - mean[:, i] * mean[:, j]
            sd = np.sqrt(np.maximum(cov[:, range(k), range(k)], 0.0))
            scale = np.where(sd > 1e-12 * (1 + np.abs(mean[:, :k])), sd, np.inf)  # a constant feature has no slope
            r = cov[:, :k, :k] / (scale[:, :, None] * scale[:, None, :]) + strength * np.eye(k)
            slopes = np.linalg.solve(r, (cov[:, :k, k] / scale)[..., None])[..., 0] / scale
            enough = t["n"] >= LEAST_SAMPLES
            intercept = np.where(enough, mean[:, k] - (slopes * mean[:, :k]).sum(1), np.nan)
            lists = pa.array([x.tolist() if ok else None for x, ok in zip(slopes, enough)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("well_id"), pa.array(t["n"].astype(np.int64)), pa.array(intercept, mask=~enough), lists], ["well_id", "n", "intercept", "slopes"])

    return folds.select("well_id", *rest).mapInArrow(solve, "well_id string, n long, intercept double, slopes array<double>")


def leave_one_out_ridge(samples: DataFrame, features: list[str], target: str, strength: float = RIDGE, weight: str | None = None) -> DataFrame:
    """Every well's samples with the prediction of a fit on the other wells, in one plan however many wells there are."""
    fits = fold_fits(samples, features, target, strength, weight).where("slopes IS NOT NULL").select("well_id", "intercept", "slopes")
    good = complete(samples, [*features, target]).join(fits, "well_id")
    terms = F.zip_with(F.array(*[F.col(c).cast("double") for c in features]), "slopes", lambda x, b: x * b)
    return good.withColumn("prediction", F.col("intercept") + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)).drop("intercept", "slopes")


def property_model(samples: DataFrame, features: list[str], target: str, trees: int = TREES) -> dict:
    """Status, pooled and per-well skill, and importances from a fit of all wells."""
    out = leave_one_out(samples, features, target, lambda t: forest(t, trees))
    if out is None:
        return {"status": TOO_FEW}
    out = out.persist()
    try:
        fit = forest(target, trees).fit(vectors(complete(samples, [target]), features))
        return {"status": VALIDATED, "pooled": skill(out, target).first().asDict(), "wells": {r["well_id"]: r.asDict() for r in skill(out, target, ["well_id"]).collect()}, "importance": dict(zip(features, map(float, fit.featureImportances)))}
    finally:
        out.unpersist()


def rank_features(samples: DataFrame, features: list[str], target: str) -> list[dict]:
    """Mean correlation over wells of each feature; a sign that differs between wells costs it seven tenths."""
    both = samples.select("well_id", target, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("f")).select("well_id", target, "f.*")
    both = both.where(F.col("x").isNotNull() & ~F.isnan("x") & F.col(target).isNotNull())
    r = both.groupBy("feature", "well_id").agg(pearson("x", target, LEAST_SAMPLES).alias("r")).where("r IS NOT NULL")
    g = r.groupBy("feature").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.min(F.signum("r")).alias("lo"), F.max(F.signum("r")).alias("hi")).where("n >= 2")
    rows = []
    for x in g.collect():  # a row for each feature
        stable = x["mean"] != 0 and x["lo"] == x["hi"]
        rows.append({"feature": x["feature"], "mean": x["mean"], "stable": stable, "score": abs(x["mean"]) * (1 if stable else UNSTABLE)})
    return sorted(rows, key=lambda x: (-x["score"], x["feature"]))


def select_features(samples: DataFrame, features: list[str], target: str, most: int = TOP) -> list[str]:
    """The best features, leaving out those that nearly repeat a better one."""
    ranked = [x["feature"] for x in rank_features(samples, features, target) if x["score"] > 0]
    if not ranked:
        return []
    pairs = [(a, b) for i, a in enumerate(ranked) for b in ranked[:i]]
    r = samples.agg(*[F.abs(pearson(a, b, 11)).alias(f"{a}|{b}") for a, b in pairs]).first().asDict() if pairs else {}
    chosen: list[str] = []
    for f in ranked:
        if len(chosen) < most and all((r.get(f"{f}|{c}") or 0) <= COLLINEAR for c in chosen):
            chosen.append(f)
    return chosen


def base_models(target: str, trees: int = TREES) -> dict:
    more = {"weightCol": "weight"}
    return {
        "boosted": GBTRegressor(featuresCol="__features", labelCol=target, predictionCol="prediction", maxIter=max(10, trees // 10), maxDepth=4, stepSize=0.1, seed=SEED, **more),
        "forest": forest(target, trees, **more),
        "random": forest(target, trees, bootstrap=False, subset="onethird", **more),
        "ridge": LinearRegression(featuresCol="__features", labelCol=target, predictionCol="prediction", regParam=1.0, elasticNetParam=0.0, **more),
    }


def fit_stack(samples: DataFrame, features: list[str], target: str, trees: int = TREES):
    """(base models, meta model): the meta model learns from predictions for wells that the base models hadn't seen."""
    # a key made of the row itself and its place among equal rows: the same if a partition is computed again
    key = F.xxhash64(*[c for c in samples.columns])
    again = F.row_number().over(Window.partitionBy("well_id", "__key").orderBy(F.lit(0)))
    samples = complete(samples, [target, "weight"]).withColumn("__key", key).withColumn("__id", F.concat_ws("/", "well_id", F.col("__key").cast("string"), again.cast("string"))).drop("__key").persist()
    held, fitted = None, {}
    ready = vectors(samples, features)
    for name, model in base_models(target, trees).items():
        out = leave_one_out(samples, features, target, lambda t, m=model: m)
        out = out.select("__id", F.col("prediction").alias(f"p_{name}"))
        held = out if held is None else held.join(out, "__id")
        fitted[name] = model.fit(ready)
    names = [f"p_{n}" for n in fitted]
    d = VectorAssembler(inputCols=names, outputCol="__meta").transform(samples.join(held, "__id"))
    meta = LinearRegression(featuresCol="__meta", labelCol=target, predictionCol="prediction", regParam=1.0, elasticNetParam=0.0, weightCol="weight").fit(d)
    samples.unpersist()
    return fitted, meta


def predict_stack(stack, samples: DataFrame, features: list[str]) -> DataFrame:
    fitted, meta = stack
    d = vectors(samples, features)
    for name, model in fitted.items():
        d = model.transform(d).withColumnRenamed("prediction", f"p_{name}")
    return meta.transform(VectorAssembler(inputCols=[f"p_{n}" for n in fitted], outputCol="__meta").transform(d))


def blind_well(samples: DataFrame, blind: str, features: list[str], target: str, trees: int = TREES) -> dict:
    """Predict a well that no fit has seen: its rows are set apart before anything is selected or trained."""
    own = samples.where(F.col("well_id") == blind)
    rest = samples.where(F.col("well_id") != blind)
    if own.isEmpty():
        return {"status": UNUSABLE}
    counts = complete(rest, [target]).groupBy("well_id").count().where(F.col("count") >= LEAST_SAMPLES).count()
    if counts < LEAST_TRAINING_WELLS:
        return {"status": TOO_FEW, "n_training_wells": counts}
    chosen = select_features(rest, features, target)
    if not chosen:
        return {"status": NO_FEATURES}
    gate = leave_one_out(rest, chosen[:3], target, lambda t: GBTRegressor(featuresCol="__features", labelCol=t, predictionCol="prediction", maxIter=max(10, trees // 10), maxDepth=4, stepSize=0.1, seed=SEED))
    there = complete(own, [target, *chosen])
    if there.limit(2).count() < 2:
        return {"status": NO_BLIND, "features": chosen}
    scored = predict_stack(fit_stack(rest, chosen, target, trees), there, chosen)
    return {"status": VALIDATED, "features": chosen, "gate_r2": skill(gate, target).first()["r2"] if gate is not None else None, **skill(scored, target).first().asDict()}
