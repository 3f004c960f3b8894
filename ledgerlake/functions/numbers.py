"""Rounding and statistics as Spark columns: money is decimal, ratios and shares are double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round1(x: Column) -> Column:
    """One decimal, halves upwards (also below zero)."""
    return F.floor(x * 10 + 0.5).cast("double") / 10


def quotient(total: Column, by: Column | int, scale: int = 2) -> Column:
    """Decimal total / by, rounded half up once: the quotient is taken at a wider scale first."""
    by = F.lit(by) if isinstance(by, int) else by
    wide = total.cast("decimal(38,12)") / by.cast("decimal(10,0)")
    return F.round(wide, scale).cast(f"decimal(19,{scale})")


def money(x: Column, scale: int = 2) -> Column:
    """A double or decimal as money, rounded half up."""
    return F.round(x, scale).cast(f"decimal(19,{scale})")


def rupees(amount: Column, compact: bool = False) -> Column:
    """An amount in words: whole rupees with Indian grouping (12,34,567), or compact with one decimal and Cr, L or K
    from a crore, a lakh, a thousand on. Halves are rounded away from zero, in decimal."""
    exact, size = amount.cast("decimal(29,4)"), F.abs(amount.cast("decimal(29,4)"))
    digits = F.round(size, 0).cast("decimal(29,0)").cast("string")
    grouped = F.regexp_replace(digits, r"(\d)(?=(\d\d)+\d$)", "$1,")
    out = F.concat(F.when((exact < 0) & (digits != "0"), "-₹").otherwise("₹"), grouped)
    if not compact:
        return out
    short = lambda unit, name: F.concat(F.lit("₹"), F.round(exact / unit, 1).cast("decimal(29,1)").cast("string"), F.lit(name))
    return F.when(size >= 10_000_000, short(10_000_000, "Cr")).when(size >= 100_000, short(100_000, "L")).when(size >= 1000, short(1000, "K")).otherwise(out)


def upper_median(values: Column) -> Column:
    """The element at n / 2 of the sorted array: for an even count the upper of the two in the middle."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def tier(x: Column, *steps: tuple[float, str], other: str | None = None) -> Column:
    """The name of the first (least value, name) that x reaches."""
    out = F.lit(other).cast("string")
    for least, name in reversed(steps):
        out = F.when(x >= least, F.lit(name)).otherwise(out)
    return out
