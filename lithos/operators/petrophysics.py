"""Petrophysical curves of wells, as one projection after another over a window of each well.

Tables: well_id, row_idx (file order), DEPT and the curves GR, RESISTIVITY, RHOB, NPHI, DT,
optionally DPTM; NULL is missing. All windows share the partitioning by well, so a whole
interpretation shuffles the logs once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.columns import at_first_max, clip, is_true, per_well
from lithos.plans.config import WELL

#: Feet in a metre, as the formula of the sonic fallback has it.
FEET = 3.28084
ZONES = {1: "Pay", 2: "Reservoir (non-pay)", 3: "Non-reservoir"}


def shale_base(config: dict, which: str):
    c = config["vsh"]
    if c.get("use_percentiles", True):
        return F.percentile("GR", F.lit(c[f"gr_{which}_percentile"] / 100.0)).over(per_well())
    return F.lit(c[f"gr_{which}_override"]).cast("double")


def vsh(df: DataFrame, config: dict = WELL) -> DataFrame:
    """Shale volume from the gamma-ray index between a well's clean and shale percentiles."""
    df = df.withColumn("__lo", shale_base(config, "clean")).withColumn("__hi", shale_base(config, "shale"))
    flat = F.col("__hi").isNull() | F.col("__lo").isNull() | (F.col("__hi") == F.col("__lo"))
    span = F.when(~flat, F.col("__hi") - F.col("__lo"))
    index = F.when(flat, F.lit(0.0)).otherwise(clip((F.col("GR") - F.col("__lo")) / span, 0.0, 1.0))
    k, e = (0.083, 3.7) if config["vsh"].get("method") == "tertiary" else (0.33, 2.0)
    return df.withColumn("VSH", clip(k * (F.pow(F.lit(2.0), e * index) - 1), 0.0, 1.0)).drop("__lo", "__hi")


def phit(df: DataFrame, config: dict = WELL) -> DataFrame:
    """Total porosity from density."""
    c = config["phit"]
    return df.withColumn("PHIT", clip((c["rhob_matrix"] - F.col("RHOB")) / (c["rhob_matrix"] - c["rhob_fluid"]), 0.0, 0.5))


def phie(df: DataFrame, config: dict = WELL) -> DataFrame:
    """Effective porosity: total less the shale's, taken at the first row of the highest shale volume."""
    shale = at_first_max("VSH", "row_idx", "PHIT", per_well())
    none = F.max("VSH").over(per_well()).isNull()
    # the product of a missing shale volume and zero is missing too
    term = F.when(none, F.when(F.col("VSH").isNotNull(), F.col("VSH") * 0.0)).otherwise(F.col("VSH") * F.col("__shale"))
    x = F.col("PHIT") - term
    return df.withColumn("__shale", shale).withColumn("PHIE", F.when(x < 0, 0.0).when(x > F.col("PHIT"), F.col("PHIT")).otherwise(x)).drop("__shale")


def phie_density_neutron(df: DataFrame, config: dict = WELL) -> DataFrame:
    """Mean of density and neutron porosity; their root mean square where gas lowers the neutron's."""
    d, n = F.col("PHIT"), F.col("NPHI")
    return df.withColumn("PHIE_DN", clip(F.when(n < d, F.sqrt((d * d + n * n) / 2)).otherwise((d + n) / 2), 0.0, 0.5))


def swe(df: DataFrame, config: dict = WELL) -> DataFrame:
    """Archie's water saturation; 1 where there is no porosity, and where an input is missing."""
    c = config["swe"]
    p, rt = F.col("PHIE"), F.col("RESISTIVITY")
    below = F.when(p > 1e-4, F.pow(p, F.lit(float(c["m"]))) * rt)
    base = F.when(below > 0, (c["a"] * c["rw"]) / F.when(below > 0, below))
    sw = F.when(base.isNotNull(), F.pow(base, F.lit(1.0 / c["n"])))
    return df.withColumn("SWE", F.when(sw.isNull() | F.isnan(sw), 1.0).otherwise(clip(sw, 0.0, 1.0)))


def dptm(df: DataFrame, config: dict = WELL, step: float | None = None) -> DataFrame:
    """The vendor's time curve where enough of it is there, else the running sum of the sonic log.

    step: metres between samples; by default the column __step.
    """
    c = config["dptm"]
    if not c.get("enabled", True):
        return df.withColumn("DPTM", F.lit(None).cast("double"))
    w = per_well()
    rise = F.coalesce("DT", F.lit(0.0)) * (F.col("__step") if step is None else F.lit(step)) / (2 * FEET * 1e6)
    total = F.sum(rise).over(w.orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0))
    if "DPTM" not in df.columns:
        return df.withColumn("DPTM", total)
    ok = F.sum(F.when(is_true(F.col("DPTM") > 0) & ~F.isnan("DPTM"), 1).otherwise(0)).over(w) >= c.get("vendor_min_valid_fraction", 0.8) * F.count("*").over(w)
    return df.withColumn("DPTM", F.when(ok, F.col("DPTM")).otherwise(total))


def md_tvd(df: DataFrame, deviation=None) -> DataFrame:
    """Measured and vertical depth of a vertical well; surveys of deviated ones aren't supported."""
    if deviation is not None:
        raise NotImplementedError("deviation surveys")
    return df.withColumn("MD", F.col("DEPT")).withColumn("TVD", F.col("DEPT"))


def perm_tixier(df: DataFrame, config: dict = WELL) -> DataFrame:
    """250 (PHIE^3 / Swirr)^2, Swirr being the saturation at the first row of the highest porosity."""
    c = config["perm_tixier"]
    found = at_first_max("PHIE", "row_idx", "SWE", per_well()) if c.get("swirr") is None else F.lit(float(c["swirr"]))
    least = F.when(found.isNull() | (found <= 0), F.lit(float(c["swirr_default"]))).otherwise(found) if c.get("swirr") is None else found
    k = 250.0 * F.pow(F.pow("PHIE", F.lit(3.0)) / F.greatest(F.col("__s"), F.lit(1e-3)), F.lit(2.0))
    return df.withColumn("__s", least).withColumn("PERM_TIXIER", F.coalesce(k, F.lit(0.0))).drop("__s")


def vvolc(df: DataFrame, config: dict = WELL) -> DataFrame:
    """Volcanics flag of dense, tight, low-gamma rock, scaled by density; 0 elsewhere."""
    c = config["vvolc"]
    like = is_true((F.col("RHOB") > c["rhob_threshold"]) & (F.col("NPHI") < c["nphi_threshold"]) & (F.col("GR") < c["gr_shale_fraction"] * F.col("__hi")))
    x = clip((F.col("RHOB") - c["rhob_scale_min"]) / (c["rhob_scale_max"] - c["rhob_scale_min"]), 0.0, 1.0)
    return df.withColumn("__hi", shale_base(config, "shale")).withColumn("VVOLC", F.when(like, x).otherwise(0.0)).drop("__hi")


def zones(df: DataFrame, config: dict = WELL) -> DataFrame:
    """1 pay, 2 reservoir without pay, 3 the rest; a missing value is the rest."""
    c = config["zones"]
    rock = is_true((F.col("VSH") < c["vsh_max"]) & (F.col("PHIE") > c["phie_min"]) & (F.col("SWE") < c["swe_reservoir_max"]))
    code = F.when(rock & is_true(F.col("SWE") < c["swe_pay_max"]), 1).when(rock, 2).otherwise(3)
    name = F.coalesce(*[F.when(F.col("ZONES") == k, F.lit(v)) for k, v in ZONES.items()])
    return df.withColumn("ZONES", code).withColumn("ZONES_LABEL", name)


def median_step(df: DataFrame) -> DataFrame:
    """df with __step: the median of a well's depth differences in file order."""
    gap = F.col("DEPT") - F.lag("DEPT").over(per_well().orderBy("row_idx"))
    return df.withColumn("__gap", gap).withColumn("__step", F.percentile("__gap", F.lit(0.5)).over(per_well())).drop("__gap")


def interpretation(df: DataFrame, config: dict = WELL) -> DataFrame:
    """All computed curves, in their fixed order."""
    df = median_step(df)
    for f in (vsh, phit, phie, swe, dptm):
        df = f(df, config)
    df = md_tvd(df)
    df = vvolc(perm_tixier(df, config), config)
    if config["phie"].get("compute_density_neutron_crosscheck", True):
        df = phie_density_neutron(df, config)
    return zones(df, config)
