"""Numeric functions: rounding modes and nulls instead of NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(x: Column, digits: int = 0, mode: str = "HALF_EVEN") -> Column:
    """Round to digits: HALF_EVEN (default), HALF_UP, HALF_DOWN, TRUNCATE, CEILING (away from zero) or FLOOR."""
    scale = F.lit(10.0**digits)
    scaled = x * scale
    forms = {
        "HALF_EVEN": lambda: F.bround(x, digits),
        "HALF_UP": lambda: F.round(x, digits),
        "HALF_DOWN": lambda: F.signum(x) * F.ceil(F.abs(scaled) - 0.5) / scale,
        "TRUNCATE": lambda: F.signum(x) * F.floor(F.abs(scaled)) / scale,
        "CEILING": lambda: F.signum(x) * F.ceil(F.abs(scaled)) / scale,
        "FLOOR": lambda: F.floor(scaled) / scale,
    }
    if mode not in forms:
        raise ValueError(f"unknown rounding mode {mode}")
    return forms[mode]()


def sqrt(x: Column) -> Column:
    """Null for negatives."""
    return F.when(x >= 0, F.sqrt(x))


def ln(x: Column) -> Column:
    """Natural logarithm (log means the same); null for what is not positive."""
    return F.when(x > 0, F.ln(x))


def mod(a: Column, b: Column) -> Column:
    """Remainder; a zero modulus is an error."""
    return F.when(b == 0, F.raise_error(F.lit("22012: division by zero"))).otherwise(a % b)


def power(x: Column, exponent: Column | float = 1.0) -> Column:
    return F.pow(x, exponent if isinstance(exponent, Column) else F.lit(exponent))


def sign(x: Column) -> Column:
    return F.signum(x)
