"""Column helpers that carry the engine's rules for missing values.

Missing is NULL everywhere. Built-in least/greatest skip NULLs, division by zero raises under ANSI
rules, max_by breaks ties at will: these helpers state each case instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SENTINEL = -9999.25


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, low, high) -> Column:
    """x within [low, high]; NULL stays NULL."""
    x = col(x)
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def ratio(a, b, zero=None) -> Column:
    """a / b; `zero` (NULL) where b is 0, NULL where either is NULL."""
    a, b = col(a), col(b)
    return F.when(b != 0, a / b).when(b == 0, F.lit(zero).cast("double"))


def is_true(p: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(p, F.lit(False))


def no_sentinel(x, null_value: float = SENTINEL) -> Column:
    """NULL for the header's null value, within the tolerance of a relative and an absolute part, and for NaN."""
    x = col(x).cast("double")
    tolerance = 0.01 + 1e-5 * abs(null_value)
    return F.when(F.isnan(x) | (F.abs(x - null_value) <= tolerance), None).otherwise(x)


def guard(x) -> Column:
    """NULL for anything at or below -9999 or not finite."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | (x <= -9999.0), None).otherwise(x)


def at_first_max(value, order, payload, window) -> Column:
    """The payload of the first row, by order, with the largest value that isn't NULL."""
    best = F.max(F.when(col(value).isNotNull(), F.struct(col(value).alias("v"), (-col(order)).alias("o"), col(payload).alias("p"))))
    return best.over(window)["p"]


def at_first_min(value, order, payload):
    """Aggregate: the payload of the first row, by order, with the least value that isn't NULL."""
    return F.min(F.when(col(value).isNotNull(), F.struct(col(value).alias("v"), col(order).alias("o"), col(payload).alias("p"))))["p"]


def pearson(x, y, least: int = 2) -> Column:
    """Aggregate: r of the rows where both are there; NULL for fewer than `least` or a constant side."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count(x) >= least) & (sx > 0) & (sy > 0), F.covar_pop(x, y) / F.when(sx * sy > 0, sx * sy))


def lerp(x, x0, y0, x1, y1) -> Column:
    """The line through (x0, y0) and (x1, y1) at x; y0 where both are one point."""
    return F.when(col(x1) == col(x0), col(y0)).otherwise(col(y0) + (col(y1) - col(y0)) * (col(x) - col(x0)) / F.when(col(x1) != col(x0), col(x1) - col(x0)))


def ricker(t, frequency) -> Column:
    """(1 - 2a) exp(-a), a = (pi f t) ** 2; t in seconds."""
    a = F.pow(F.lit(math.pi) * col(frequency) * col(t), F.lit(2.0))
    return (1 - 2 * a) * F.exp(-a)


def rounded(df, digits: int = 6):
    """df with its doubles rounded, and no negative zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def per_well(*extra) -> Window:
    return Window.partitionBy("well_id", *extra)
