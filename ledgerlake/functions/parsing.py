"""Parsing of statement cells; a cell that does not parse is null and tells so, never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import trimmed


def _looks_like(text: Column, pattern: str) -> Column:
    """What a text of a date format has in any case: the separator, where two or more signs come before it. Spares
    the parse, which fails by an exception."""
    sep = next(x for x in pattern if not x.isalpha())
    lead = pattern.index(sep)
    third = F.substring(text, 3, 1) == sep
    return third if lead == 2 else text.contains(sep) & ~third if lead > 2 else text.contains(sep)


def parse_date(c: Column, clamp: bool = False) -> Column:
    """The first format that fits, day before month. Days past a month's end are null, or its end if clamp."""
    text = trimmed(c)
    out = F.coalesce(*[F.when(_looks_like(text, f), F.try_to_timestamp(text, F.lit(f))) for f in V.DATE_FORMATS]).cast("date")
    if clamp:
        parts = F.regexp_extract(text, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", 0)
        day, month, year = (F.regexp_extract(parts, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", k).try_cast("int") for k in (1, 2, 3))
        last = F.last_day(F.make_date(year, month, F.lit(1)))
        out = F.coalesce(out, F.when((day <= 31) & month.between(1, 12), last))
    return out


def parse_money(c: Column) -> Column:
    """Decimal(19,4) without currency signs, grouping commas and spaces; null for blank, - and garbage."""
    return F.regexp_replace(c, r"[₹$€£,\s]", "").try_cast("decimal(19,4)")


def bad_money(c: Column) -> Column:
    """Whether a cell is neither blank, - nor a number."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[₹$€£,\s]", "")
    return ~bare.isin("", "-") & parse_money(c).isNull()


def is_debit(kind: Column, default: bool = True) -> Column:
    word = F.lower(trimmed(F.coalesce(kind, F.lit(""))))
    return F.when(word.isin(*V.DEBIT_WORDS), True).when(word.isin(*V.CREDIT_WORDS), False).otherwise(F.lit(default))


def resolve_amount(amount: Column, debit: Column, credit: Column, kind: Column) -> Column:
    """struct(amount, is_debit), or null if no column tells an amount.

    In debit and credit columns 0 counts as empty; if both are filled the larger counts, a tie is a debit.
    Else the amount column with the type column, or without one its sign.
    """
    d, c = F.when(debit != 0, F.abs(debit)), F.when(credit != 0, F.abs(credit))
    made = lambda value, flag: F.struct(value.cast("decimal(19,4)").alias("amount"), flag.alias("is_debit"))
    typed = F.length(trimmed(F.coalesce(kind, F.lit("")))) > 0
    return (
        F.when(d.isNotNull() & (c.isNull() | (d >= c)), made(d, F.lit(True)))
        .when(c.isNotNull(), made(c, F.lit(False)))
        .when(amount.isNotNull() & typed, made(F.abs(amount), is_debit(kind)))
        .when(amount.isNotNull(), made(F.abs(amount), amount < 0))
    )
