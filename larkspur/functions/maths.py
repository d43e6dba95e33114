"""Mathematical functions with the dialect's NULLs instead of NaN and infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.semantics import finite


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def exp(x: Column) -> Column:
    return finite(F.exp(x))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def power(x: Column, y: Column) -> Column:
    return finite(F.pow(x, y))


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("bigint")


def floor(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def round_half_away(x: Column, digits: int = 0) -> Column:
    """ROUND of a double or decimal; an integer from a double at digits <= 0."""
    return F.round(x, digits)


def truncate(x: Column, digits: int) -> Column:
    """Cut toward zero, exact on decimals of up to 20 digits before the point and 10 after;
    other numbers are doubles, of which those beyond 2^53 have nothing to cut after it."""
    step = F.lit(10 ** abs(digits))
    wide = x.try_cast("decimal(30,10)")
    real = x.cast("double")
    if digits < 0:
        cut = F.signum(wide).cast("int") * F.floor(F.abs(wide) / step) * step
        rough = F.signum(real) * F.floor(F.abs(real) / step) * step
    else:
        cut = F.signum(wide).cast("int") * F.floor(F.abs(wide) * step) / step
        rough = F.when(F.abs(real) < 2.0**53, F.signum(real) * F.floor(F.abs(real) * step) / step).otherwise(real)
    return F.coalesce(cut.cast("double"), rough)


def pi() -> Column:
    return F.pi()
