"""Deterministic column expressions.

All of these are built-in Spark SQL functions composed into expressions, so
they stay inside whole-stage codegen and are independent of partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 13 hex digits = 52 bits: exact in a double, so u = h / 2^52 is a uniform on
# [0, 1) that DuckDB reproduces with ('0x' || substr(md5(s), 1, 13))::BIGINT.
HASH_HEX_DIGITS = 13
HASH_SCALE = float(2**52)

# Null is its own category in string-cast comparisons.
NULL_CATEGORY = "nan"


def hash52(text: Column) -> Column:
    """52-bit integer from the md5 of a string column."""
    return F.conv(F.substring(F.md5(text), 1, HASH_HEX_DIGITS), 16, 10).cast("bigint")


def seeded_uniform(seed: int, key: Column, tag: str = "u") -> Column:
    """u(seed, key, tag) in [0, 1): md5 of 'seed:tag:key', first 52 bits."""
    text = F.concat(F.lit(f"{seed}:{tag}:"), key.cast("string"))
    return hash52(text) / F.lit(HASH_SCALE)


def stable_value(col: Column, dtype: T.DataType) -> Column:
    """A string form of a value that Spark and DuckDB print identically.

    Doubles are scaled to integer micro-units, timestamps to epoch micros and
    booleans to 0/1, so a row key hashes the same in both engines.
    """
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        value = col.cast("double")
        scaled = F.abs(value * F.lit(1_000_000.0))
        whole = F.floor(scaled)
        rounded = whole + (scaled - whole >= 0.5).cast("bigint")  # half away from zero, as round() does by way of decimals
        micro = F.when(value < 0, -rounded).otherwise(rounded).cast("string")
        return F.when(F.abs(value) < 9e12, micro).otherwise(value.cast("string"))  # larger values, infinities and NaN as text
    if isinstance(dtype, T.TimestampType) or isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(col.cast("timestamp")).cast("string")
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("string")
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("string")
    return col.cast("string")


def row_key(df, columns: Iterable[str] | None = None) -> Column:
    """Content key of a row: every column in stable string form, null as 'nan'."""
    cols = list(columns) if columns is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.coalesce(stable_value(F.col(c), types[c]), F.lit(NULL_CATEGORY)) for c in cols]
    return F.concat_ws("\u001f", *parts)


def as_category(col: Column) -> Column:
    """String-cast category with null kept as its own level."""
    return F.coalesce(col.cast("string"), F.lit(NULL_CATEGORY))


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 or null (never raises under ANSI)."""
    return F.try_divide(num, den)


def r6(col: Column, digits: int = 6) -> Column:
    """Round for reporting; + 0.0 removes negative zero."""
    return (F.round(col.cast("double"), digits) + F.lit(0.0)).cast("double")


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """numpy.isclose(a, b): |a - b| <= atol + rtol * |b|."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def box_muller(u1: Column, u2: Column) -> Column:
    """Standard normal draw from two uniforms in [0, 1)."""
    safe_u1 = F.greatest(u1, F.lit(1e-300))
    return F.sqrt(F.lit(-2.0) * F.log(safe_u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


# Coefficients of the published rational approximation of the
# inverse normal CDF by P. J. Acklam (relative error below 1.15e-9).
_ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
             1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
             6.680131188771972e01, -1.328068155288572e01)
_ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
             3.754408661907416e00)
_P_LOW = 0.02425


def _poly(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def probit(p: Column) -> Column:
    """Inverse standard normal CDF as a column expression (Acklam)."""
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    q_lo = F.sqrt(F.lit(-2.0) * F.log(p))
    q_hi = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    q = p - F.lit(0.5)
    r = q * q
    low = _poly(_ACKLAM_C, q_lo) / (_poly(_ACKLAM_D, q_lo) * q_lo + F.lit(1.0))
    high = -_poly(_ACKLAM_C, q_hi) / (_poly(_ACKLAM_D, q_hi) * q_hi + F.lit(1.0))
    mid = _poly(_ACKLAM_A, r) * q / (_poly(_ACKLAM_B, r) * r + F.lit(1.0))
    return F.when(p < _P_LOW, low).when(p > 1 - _P_LOW, high).otherwise(mid)


# Coefficients of J. F. Hart's published rational approximation of
# the normal tail (absolute error near 1e-15).
_HART_NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
                   112.079291497871, 221.213596169931, 220.206867912376)
_HART_DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
                     296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_HART_LIMIT = 7.07106781186547


def norm_cdf(z: Column) -> Column:
    """Standard normal CDF: a rational tail (Hart), beyond 7.07 a continued fraction."""
    x = F.abs(z)
    density = F.exp(x * x * F.lit(-0.5))
    fraction = x + F.lit(0.65)
    for step in (4.0, 3.0, 2.0, 1.0):
        fraction = x + F.lit(step) / fraction
    far = density / (fraction * F.lit(math.sqrt(2.0 * math.pi)))
    near = density * _poly(_HART_NUMERATOR, x) / _poly(_HART_DENOMINATOR, x)
    tail = F.when(x < _HART_LIMIT, near).otherwise(far)
    return F.when(z > 0, F.lit(1.0) - tail).otherwise(tail)


def probit_step(z: Column, p: Column) -> Column:
    """One Halley step from ``z`` towards the inverse normal CDF of ``p``.

    ``z`` should be a materialised column (an earlier select), it is used many times.
    """
    u = (norm_cdf(z) - p) * F.lit(math.sqrt(2.0 * math.pi)) * F.exp(z * z / F.lit(2.0))
    return z - u / (F.lit(1.0) + z * u / F.lit(2.0))
