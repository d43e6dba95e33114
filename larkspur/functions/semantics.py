"""Arithmetic, comparison and cast rules of the dialect, as Column expressions.

All stay inside whole-stage code generation; none is a UDF. Where the dialect gives NULL
Spark's ANSI mode would raise, so the guarded forms are used throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO64 = "18446744073709551616BD"
NUMBER = r"^[ \t\r\n]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
INTEGER = r"^[ \t\r\n]*([+-]?[0-9]+)"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num_prefix(text: Column) -> Column:
    """Number at the start of a text, 0 if there is none; NULL stays NULL."""
    found = F.regexp_extract(text, NUMBER, 1).try_cast("double")
    return F.when(text.isNotNull(), F.coalesce(found, F.lit(0.0)))


def finite(x: Column) -> Column:
    """NULL for NaN and the infinities, which never surface."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def divide(a: Column, b: Column, scale: int = 0) -> Column:
    """Exact ``/`` of an integer or a decimal of ``scale`` digits by an integer or decimal of
    any: 4 more digits than the dividend's, rounded half away from zero; NULL for
    division by 0."""
    dividend = a.cast(f"decimal({24 + scale},{scale + 6})")
    return F.round(F.try_divide(dividend, b), scale + 4)


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; NULL for 0."""
    return F.when(b != 0, a % b)


def int_divide(a: Column, b: Column) -> Column:
    """Quotient truncated toward zero; NULL for 0."""
    safe = F.nullif(b, F.lit(0))
    return ((a - a % safe) / safe).cast("bigint")


def unsigned(v: Column) -> Column:
    """The bits of a bigint as an unsigned number (decimal(20,0))."""
    wide = v.cast("decimal(20,0)")
    return F.when(v < 0, (wide + F.expr(TWO64)).cast("decimal(20,0)")).otherwise(wide)


def bit_and(a: Column, b: Column) -> Column:
    return unsigned(a.cast("bigint").bitwiseAND(b.cast("bigint")))


def bit_or(a: Column, b: Column) -> Column:
    return unsigned(a.cast("bigint").bitwiseOR(b.cast("bigint")))


def bit_xor(a: Column, b: Column) -> Column:
    return unsigned(a.cast("bigint").bitwiseXOR(b.cast("bigint")))


def bit_not(a: Column) -> Column:
    return unsigned(F.bitwise_not(a.cast("bigint")))


def shift_left(a: Column, n: Column) -> Column:
    """Shift by n modulo 64."""
    return unsigned(F.call_function("shiftleft", a.cast("bigint"), F.pmod(n, F.lit(64)).cast("int")))


def shift_right(a: Column, n: Column) -> Column:
    return unsigned(F.call_function("shiftrightunsigned", a.cast("bigint"), F.pmod(n, F.lit(64)).cast("int")))


def unsigned_add(a: Column, b: Column) -> Column:
    """Sum of unsigned numbers, modulo 2^64."""
    return F.pmod(a.cast("decimal(22,0)") + b.cast("decimal(22,0)"), F.expr(TWO64)).cast("decimal(20,0)")


def _null_if_any(result: Column, parts: tuple[Column, ...]) -> Column:
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, result)


def greatest(*parts: Column) -> Column:
    """NULL if any part is."""
    return _null_if_any(F.greatest(*parts), parts)


def least(*parts: Column) -> Column:
    return _null_if_any(F.least(*parts), parts)


def fold(text: Column) -> Column:
    """Key under the default collation: without case and accents."""
    return F.collate(text, "UNICODE_CI_AI")


def fold_case(text: Column) -> Column:
    """Key without case only, which also works for LIKE."""
    return F.collate(text, "UTF8_LCASE")


def to_signed(text: Column) -> Column:
    """CAST(text AS SIGNED): leading integer, else 0."""
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, INTEGER, 1).try_cast("bigint"), F.lit(0)))


def round_to_signed(x: Column) -> Column:
    """CAST(double AS SIGNED): half away from zero; NULL for what no bigint holds."""
    return F.round(x).try_cast("decimal(38,0)").try_cast("bigint")


def to_unsigned(x: Column) -> Column:
    """CAST(number AS UNSIGNED): modulo 2^64, so that negative numbers wrap."""
    return F.pmod(F.round(x).try_cast("decimal(38,0)"), F.expr(TWO64)).cast("decimal(20,0)")


def to_decimal(text: Column, precision: int, scale: int) -> Column:
    """CAST(text AS DECIMAL): rescaled half away from zero, NULL if it isn't a number."""
    return F.round(text.try_cast("decimal(38,10)"), scale).try_cast(f"decimal({precision},{scale})")


def to_date(text: Column) -> Column:
    """CAST(text AS DATE): NULL for what is no date."""
    return text.try_cast("date")


def truth(x: Column) -> Column:
    """A condition as 1, 0 or NULL."""
    return x.cast("int").cast("bigint")
