"""Behavioural signals of the last six months, from one conditional aggregate for each user."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import tier
from ..functions.periods import months_back
from .overview import between
from .recurring import category_order

MONTHS = 6
#: kind: the ratio (or percent) from which it is reported, is medium, is high; in the order of listing.
SIGNALS = {
    "WEEKEND_OVERSPEND": (1.40, 1.70, 2.00),
    "LIFESTYLE_INFLATION": (1.15, 1.25, 1.40),
    "CATEGORY_CONCENTRATION": (40.0, 50.0, 60.0),
    "INCREASING_FREQUENCY": (1.20, 1.30, 1.50),
    "LARGE_TICKETS": (1.20, 1.35, 1.50),
}


def measures(ledger: DataFrame, as_of: date) -> DataFrame:
    """user_id and the five ratios, null where there is too little to tell.

    Weekend: mean spend of days with entries, weekend against weekdays. Inflation, frequency, tickets: the
    last three months against the three before. Concentration: percent of the largest category.
    """
    rows = between(ledger, months_back(as_of, MONTHS), as_of, type="DEBIT")
    weekend, late = F.weekday("date") >= 5, F.col("date") > F.add_months(F.lit(as_of), -MONTHS // 2)
    total = lambda c: F.sum(F.when(c, F.col("amount"))).cast("double")
    days = lambda c: F.countDistinct(F.when(c, F.col("date")))
    count = lambda c: F.count(F.when(c, 1))
    one = rows.groupBy("user_id").agg(
        total(weekend).alias("we"), days(weekend).alias("wed"), total(~weekend).alias("wd"), days(~weekend).alias("wdd"),
        total(late).alias("l"), count(late).alias("ln"), total(~late).alias("e"), count(~late).alias("en"),
    )
    kinds = rows.where("category IS NOT NULL").groupBy("user_id", "category").agg(F.sum("amount").alias("t"))
    kinds = kinds.groupBy("user_id").agg(F.max(F.struct("t", (-category_order(F.col("category"))).alias("o"), "category")).alias("top"), F.sum("t").cast("double").alias("all"))
    ratio = lambda a, b: F.when((b.isNotNull()) & (b != 0), F.coalesce(a, F.lit(0.0)) / b)
    c = F.col
    return one.join(kinds, "user_id", "left").select(
        "user_id",
        F.when((c("wed") > 0) & (c("wdd") > 0), ratio(c("we") / c("wed"), c("wd") / c("wdd"))).alias("weekend"),
        ratio(c("l"), c("e")).alias("inflation"),
        F.when(c("all") != 0, c("top.t").cast("double") / c("all") * 100).alias("concentration"),
        c("top.category").alias("top_category"),
        F.when(c("en") >= 5, c("ln") / c("en")).alias("frequency"),
        F.when((c("ln") >= 5) & (c("en") >= 5), ratio(c("l") / c("ln"), c("e") / c("en"))).alias("tickets"),
    )


def signals(measured: DataFrame) -> DataFrame:
    """user_id, kind, value, severity, rank of each user's signals, most severe first."""
    columns = ("weekend", "inflation", "concentration", "frequency", "tickets")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"), F.lit(i).alias("place")) for i, (k, c) in enumerate(zip(SIGNALS, columns, strict=True))])
    rows = measured.select("user_id", F.inline(each))
    severity = F.lit(None).cast("string")
    for kind, (least, medium, high) in SIGNALS.items():
        severity = F.when(F.col("kind") == kind, tier(F.col("value"), (high, "HIGH"), (medium, "MEDIUM"), (least, "LOW"))).otherwise(severity)
    rows = rows.withColumn("severity", severity).where("severity IS NOT NULL")
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.array_position(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW"))), F.col("severity")), "place"))
    return rows.withColumn("rank", rank).drop("place")


def profile(measured: DataFrame) -> DataFrame:
    """user_id, profile: the first signal's kind, STEADY without one."""
    first = signals(measured).where("rank = 1").select("user_id", "kind")
    return measured.select("user_id").join(first, "user_id", "left").select("user_id", F.coalesce("kind", F.lit("STEADY")).alias("profile"))
