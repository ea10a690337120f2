"""Exact decimal money: scale 2, half-up rounding, no floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_money(c: Column) -> Column:
    """Scale 2, half up (Spark's decimal cast rounds half up)."""
    return c.cast("decimal(18,2)")


def currency_code(c: Column) -> Column:
    return F.upper(F.trim(c))


def to_base(amount: Column, rate: Column) -> Column:
    """Amount rounded to 2 places, times the rate, rounded again."""
    return (to_money(amount) * rate.cast("decimal(18,8)")).cast("decimal(18,2)")


def _same_currency(left: Column, right: Column, value: Column) -> Column:
    return F.when(left == right, value).otherwise(
        F.raise_error(F.concat(F.lit("currency mismatch: "), left, F.lit(" and "), right)))


def plus(a: Column, a_currency: Column, b: Column, b_currency: Column) -> Column:
    return _same_currency(a_currency, b_currency, to_money(to_money(a) + to_money(b)))


def minus(a: Column, a_currency: Column, b: Column, b_currency: Column) -> Column:
    return _same_currency(a_currency, b_currency, to_money(to_money(a) - to_money(b)))


def times(a: Column, factor: Column) -> Column:
    return to_money(to_money(a) * factor)


def divide_half_up(a: Column, b: Column, places: int, scale: int = 2) -> Column:
    """`a / b` for a >= 0, b > 0 rounded half up at `places`, in whole numbers.

    Both sides hold at most `scale` decimals. Decimal division rounds once at its
    own scale, so rounding that quotient again could be off by one last digit.
    """
    unit = 10 ** scale
    top = (a.cast(f"decimal(24,{scale})") * unit).cast("decimal(28,0)")
    bottom = (b.cast(f"decimal(24,{scale})") * unit).cast("decimal(28,0)")
    doubled = top * F.lit(2 * 10 ** places).cast("decimal(9,0)") + bottom
    quotient = F.call_function("div", doubled.cast("decimal(38,0)"), (bottom * 2).cast("decimal(29,0)"))
    return (quotient.cast("decimal(20,0)") / F.lit(10 ** places).cast(f"decimal({places + 1},0)")).cast(
        f"decimal(18,{places})")


def ratio(a: Column, b: Column) -> Column:
    """Six places, half up; a zero divisor gives 0."""
    return F.when(b == 0, F.lit(0).cast("decimal(18,6)")).otherwise(divide_half_up(a, F.nullif(b, F.lit(0)), 6))


def at_least(a: Column, threshold: Column) -> Column:
    return a >= threshold


def within(a: Column, low: Column, high: Column) -> Column:
    return a.between(low, high)


def is_multiple_of(a: Column, unit: Column) -> Column:
    """Exact multiple; a null or zero unit is never matched."""
    return F.coalesce(F.when(unit != 0, a % F.nullif(unit, F.lit(0)) == 0), F.lit(False))


def is_positive(a: Column) -> Column:
    return a > 0
