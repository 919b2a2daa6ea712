"""Rounding with ties toward plus infinity, and clamps."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, decimals: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d as a double (ties go up, also for negatives)."""
    if decimals == 0:
        return F.floor(x + F.lit(0.5)).cast("double")
    f = float(10 ** decimals)
    return F.floor(x * F.lit(f) + F.lit(0.5)).cast("double") / F.lit(f)


def half_up_int(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    """Clamp; null and NaN become the lower bound."""
    safe = F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(float(low))).otherwise(x.cast("double"))
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), safe))


def lookup(key: Column, table: dict, default=None, dtype: str = "double") -> Column:
    """A CASE over a small fixed table (stays inside code generation)."""
    out = None
    for k, v in table.items():
        value = F.lit(v).cast(dtype)
        out = F.when(key == k, value) if out is None else out.when(key == k, value)
    return out.otherwise(F.lit(default).cast(dtype))
