"""Recoverable spend: duplicate subscriptions, creeping prices, small frequent purchases, bank fees."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.numbers import money, quotient, tier
from ..functions.periods import months_back
from .overview import between
from .recurring import category_order, monthly_equivalent, times_a_year

MONTHS = 3
SMALL_MOST, SMALL_VISITS, SMALL_MONTHLY = 500, 8, 1500
CREEP_PAYMENTS, CREEP_RATIO = 4, 1.10
#: The order in which findings of equal impact are listed.
KINDS = ("DUPLICATE_SUBSCRIPTIONS", "SUBSCRIPTION_CREEP", "HIGH_FREQUENCY_SMALL_SPEND", "BANK_FEES")


def severity(monthly: Column) -> Column:
    return tier(monthly, (2000, "HIGH"), (500, "MEDIUM"), other="LOW")


def recent(ledger: DataFrame, as_of: date) -> DataFrame:
    """Debits of the last three months."""
    return between(ledger, months_back(as_of, MONTHS), as_of, type="DEBIT")


def creep_items(patterns: DataFrame, debits: DataFrame) -> DataFrame:
    """user_id, merchant, earlier, latest, monthly: means of the last two payments and of those before."""
    rows = debits.where("merchant IS NOT NULL").join(patterns.select("user_id", "merchant", "key", "period"), ["user_id", "merchant"])
    own = W.partitionBy("user_id", "merchant", "key", "period")
    rows = rows.withColumn("n", F.count("*").over(own)).where(F.col("n") >= CREEP_PAYMENTS)
    rows = rows.withColumn("r", F.row_number().over(own.orderBy(F.desc("date"), F.desc("id"), F.desc("amount"))))
    mean = lambda c: F.sum(F.when(c, F.col("amount"))).cast("double") / F.count(F.when(c, 1))
    rows = rows.groupBy("user_id", "merchant", "key", "period").agg(mean(F.col("r") > 2).alias("earlier"), mean(F.col("r") <= 2).alias("latest"))
    rows = rows.where((F.col("earlier") > 0) & (F.col("latest") / F.col("earlier") >= CREEP_RATIO))
    return rows.withColumn("monthly", quotient(money(F.col("latest") - F.col("earlier")) * times_a_year(F.col("period")), 12))


def drain_items(debits: DataFrame) -> DataFrame:
    """user_id, merchant, visits, monthly, mean of merchants with many small purchases."""
    rows = debits.where((F.trim("merchant") != "") & (F.col("amount") <= SMALL_MOST)).groupBy("user_id", "merchant")
    rows = rows.agg(F.count("*").alias("visits"), F.sum("amount").alias("total")).where(F.col("visits") >= SMALL_VISITS)
    rows = rows.withColumn("monthly", quotient(F.col("total"), MONTHS)).where(F.col("monthly") >= SMALL_MONTHLY)
    return rows.select("user_id", "merchant", "visits", "monthly", quotient(F.col("total"), F.col("visits")).alias("mean"))


def fee_items(debits: DataFrame, pattern: str = V.FEES) -> DataFrame:
    """user_id, merchant ("Bank fees" if blank), charges, total of entries that read like a bank fee."""
    text = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("merchant", F.lit("")))
    name = F.when(F.trim(F.coalesce("merchant", F.lit(""))) == "", "Bank fees").otherwise(F.col("merchant"))
    rows = debits.where(text.rlike(pattern)).groupBy("user_id", name.alias("merchant"))
    return rows.agg(F.count("*").alias("charges"), F.sum("amount").cast("decimal(29,4)").alias("total"))


def detect(ledger: DataFrame, patterns: DataFrame, as_of: date, fees: str = V.FEES) -> DataFrame:
    """user_id, kind, monthly, annual, items, severity, rank of each user's findings, largest impact first.

    Duplicates: the category with most patterns (at least two) of those easily cancelled, by its cheapest one. The
    others add up creep_items, drain_items and fee_items. All come from one aggregate of the recent debits by
    user and merchant, and patterns are read once.
    """
    c = F.col
    ordered = W.partitionBy("user_id", "merchant").orderBy(F.desc("date"), F.desc("id"), F.desc("amount"))
    small = (F.trim("merchant") != "") & (c("amount") <= SMALL_MOST)
    text = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("merchant", F.lit("")))
    mean = lambda x: F.sum(F.when(x, c("amount"))).cast("double") / F.count(F.when(x, 1))
    sum_ = lambda x: F.sum(F.when(x, c("amount"))).cast("decimal(29,4)")
    debits = recent(ledger, as_of).withColumn("r", F.row_number().over(ordered)).withColumn("_fee", text.rlike(fees))
    shops = debits.groupBy("user_id", "merchant").agg(
        F.count("*").alias("n"), mean(c("r") > 2).alias("earlier"), mean(c("r") <= 2).alias("latest"), F.max(F.struct("date", "id", "category"))["category"].alias("category"),
        F.count(F.when(small, 1)).alias("visits"), sum_(small).alias("small"), F.count(F.when(c("_fee"), 1)).alias("charges"), sum_(c("_fee")).alias("fees"),
    )
    none = F.lit(None).cast("string")
    item = lambda kind, sub, each: F.struct(F.lit(kind).alias("kind"), sub.alias("sub"), each.cast("decimal(29,4)").alias("each"))
    name = F.when(F.trim(F.coalesce("merchant", F.lit(""))) == "", "Bank fees").otherwise(c("merchant"))
    drained = quotient(c("small"), MONTHS)
    drain = F.when((c("visits") >= SMALL_VISITS) & (drained >= SMALL_MONTHLY), item(KINDS[2], none, drained))
    own = shops.select("user_id", F.inline(F.array_compact(F.array(drain, F.when(c("charges") > 0, item(KINDS[3], name, c("fees")))))))
    crept = (c("n") >= CREEP_PAYMENTS) & (c("earlier") > 0) & (c("latest") / c("earlier") >= CREEP_RATIO)
    creep = F.when(crept, item(KINDS[1], none, quotient(money(c("latest") - c("earlier")) * times_a_year(c("period")), 12)))
    double = F.when(c("category").isin(*V.CANCELLABLE_CATEGORIES), item(KINDS[0], c("category"), monthly_equivalent(c("amount"), c("period"))))
    bound = patterns.select("user_id", "merchant", "amount", "period").join(shops.drop("visits", "small", "charges", "fees"), ["user_id", "merchant"])
    items = own.unionByName(bound.select("user_id", F.inline(F.array_compact(F.array(double, creep)))))
    subs = items.groupBy("user_id", "kind", "sub").agg(F.count("*").alias("n"), F.sum("each").alias("total"), F.min("each").alias("least"))
    twice, fee = c("kind") == KINDS[0], c("kind") == KINDS[3]
    kinds = subs.where(~twice | (c("n") >= 2)).groupBy("user_id", "kind").agg(
        F.max(F.struct("n", (-category_order(c("sub"))).alias("o"), "least")).alias("best"), F.sum("total").alias("total"), F.sum("n").alias("n"), F.count("*").alias("subs")
    )
    monthly = money(F.when(twice, c("best.least")).when(fee, quotient(c("total"), MONTHS)).otherwise(c("total")))
    found = kinds.select("user_id", "kind", monthly.alias("monthly"), F.when(twice, c("best.n")).when(fee, c("subs")).otherwise(c("n")).alias("items"))
    found = found.select("user_id", "kind", "monthly", money(c("monthly") * 12).alias("annual"), "items", severity(c("monthly")).alias("severity"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc_nulls_last("monthly"), order)))


def summary(found: DataFrame) -> DataFrame:
    """user_id, monthly, annual (twelve times that), findings."""
    sums = found.groupBy("user_id").agg(F.sum("monthly").cast("decimal(19,2)").alias("monthly"), F.count("*").alias("findings"))
    return sums.withColumn("annual", money(F.col("monthly") * 12))
