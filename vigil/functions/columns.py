"""Column expressions shared by operators (all JVM-side, inside codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun formula 7.1.26 for erf(x), x >= 0
# (|error| <= 1.5e-7).  Neither Spark SQL nor DuckDB ships erf.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Fixed value: smallest positive double, the floor for a zero contamination.
MIN_POSITIVE_DOUBLE = 4.9e-324


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def dbl(x: float) -> Column:
    """A double literal (a bare Python float would be fine, but a Decimal would not)."""
    return F.lit(float(x)).cast("double")


def erf(x) -> Column:
    """erf(x) by A&S 7.1.26, odd-extended to negative x."""
    x = col(x)
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * ax)
    a1, a2, a3, a4, a5 = (F.lit(a) for a in ERF_A)
    poly = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t
    y = F.lit(1.0) - poly * F.exp(-(ax * ax))
    return F.when(x < 0, -y).otherwise(y)


def safe_div(num, den) -> Column:
    """num / den with a zero or null denominator giving 0 (metric convention)."""
    num, den = col(num), col(den)
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def f1_from_counts(tp, fp, fn) -> Column:
    """F1 = 2tp / (2tp + fp + fn); 0 when nothing is predicted or present."""
    tp, fp, fn = col(tp), col(fp), col(fn)
    return safe_div(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn)


def strict_double(c) -> Column:
    """Strict cast: bad text raises under ANSI mode, as the reference's astype(float)."""
    return col(c).cast("double")


def lenient_double(c) -> Column:
    """Lenient cast: bad text becomes null (pandas to_numeric(errors='coerce'))."""
    return col(c).try_cast("double")


def recode(c, mapping: dict) -> Column:
    """Map listed values, keep every other value untouched (pandas replace)."""
    c = col(c)
    out = None
    for k, v in mapping.items():
        out = (F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v)))
    return c if out is None else out.otherwise(c)


def parse_timestamp(c, fmt: str = " d/M/y h:mm:ss a") -> Column:
    """Text timestamps such as ' 28/12/2015 10:00:00 AM' (leading blank, 12-hour clock)."""
    return F.try_to_timestamp(col(c), F.lit(fmt))


def in_interval(ts, start: str, end: str) -> Column:
    """1 iff start <= ts <= end (both ends inclusive)."""
    return col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")).cast("int")


def rounded(c, digits: int = 6) -> Column:
    return F.round(col(c).cast("double"), digits)


def hash_hex(*parts) -> F.Column:
    """52 bits of the MD5 of the colon-joined parts, as 13 hex digits."""
    cols = [p if isinstance(p, F.Column) else F.lit(str(p)) for p in parts]
    return F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 13)


def hex_unit(digits: F.Column) -> F.Column:
    """13 hex digits as a number in [0, 1)."""
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_unit(*parts) -> F.Column:
    """52 bits of the MD5 of the colon-joined parts, as a number in [0, 1): the same in any engine."""
    return hex_unit(hash_hex(*parts))


def hash_below(digits: F.Column, limit: float) -> F.Column:
    """``hex_unit(digits) < limit``, compared as text (no conversion of numbers that do not pass)."""
    bound = math.ceil(limit * (1 << 52))
    return F.lit(True) if bound >= 1 << 52 else digits < F.lit(f"{max(bound, 0):013x}")
