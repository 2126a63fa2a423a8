"""Small statistics as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-sided 99 percent bound of a standard normal.
Z_99 = 2.576


def per_thousand(n: Column, total: Column) -> Column:
    return 1000.0 * n / F.greatest(total, F.lit(1))


def two_proportion_z(n0: Column, all0: Column, n1: Column, all1: Column) -> Column:
    """Pooled z of share 1 minus share 0; 0 where a side is empty or nothing varies."""
    p0, p1 = F.try_divide(n0.cast("double"), all0), F.try_divide(n1.cast("double"), all1)
    pooled = F.try_divide((n0 + n1).cast("double"), all0 + all1)
    variance = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), all0) + F.try_divide(F.lit(1.0), all1))
    return F.coalesce(F.when(variance > 1e-12, (p1 - p0) / F.sqrt(variance)), F.lit(0.0))


def min_max(rows: DataFrame, value: str, by: list[str], name: str = "scaled") -> DataFrame:
    """Adds the value scaled to 0..1 within its group; a constant is 0.

    The ends are aggregated and joined back, so a group is never gathered in one task.
    """
    ends = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    return rows.join(ends, by).withColumn(name, scaled).drop("_lo", "_hi")


def log_axis(c: Column, low: float, high: float) -> Column:
    """Place in percent on a logarithmic axis that starts at ``low``."""
    import math

    return F.when(c <= low, F.lit(0.0)).otherwise(F.ln(c / low) / math.log(high / low) * 100)


def two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal, by an Arrow UDF since SQL has no erfc."""
    @F.pandas_udf("double")
    def p(v: pd.Series) -> pd.Series:
        from math import erfc, sqrt

        return v.map(lambda x: None if x is None or x != x else erfc(abs(x) / sqrt(2)))

    return p(z)
