"""Recurring payments: detection from gaps between payments, views, and the merge with stored patterns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.numbers import money, quotient, tier, upper_median
from ..functions.periods import months_back
from ..functions.text import with_merchant_key
from .overview import between

LOOK_BACK_MONTHS, LEAST_PAYMENTS, LEAST_CONFIDENCE, LEAST_KEY = 24, 2, 0.30, 3


def period_of(days: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, _, low, high, _, _ in V.PERIODS:
        out = F.when(days.between(low, high), F.lit(name)).otherwise(out)
    return out


def _of_period(period: Column, at: int) -> Column:
    out = F.lit(None).cast("string" if at == 1 else "int")
    for row in V.PERIODS:
        out = F.when(period == row[0], F.lit(row[at])).otherwise(out)
    return out


def times_a_year(period: Column) -> Column:
    return _of_period(period, 5)


def category_order(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, V.CATEGORIES)), category)


def payments(ledger: DataFrame, as_of: date, key: str = "merchant_key") -> DataFrame:
    """Debits of the last 24 months with a merchant: key and gap, the days since the key's last payment."""
    rows = between(ledger, months_back(as_of, LOOK_BACK_MONTHS), as_of, type="DEBIT")
    rows = rows.where("merchant IS NOT NULL AND trim(merchant) <> ''").withColumn("key", F.col(key)).where(F.length("key") >= LEAST_KEY)
    before = F.lag("date").over(W.partitionBy("user_id", "key").orderBy("date"))
    return rows.withColumn("gap", F.datediff("date", before))


def _gaps(days: Column) -> Column:
    """The days between one date and the next, of an array of dates in any order, repeats left out."""
    ordered = F.array(F.array_sort(F.array_distinct(days)))  # a variable of the outer loop, so it is sorted once
    return F.get(F.transform(ordered, lambda d: F.transform(F.slice(d, 2, F.size(d)), lambda x, i: F.datediff(x, F.get(d, i)))), 0)


def detect(ledger: DataFrame, as_of: date, key: str = "merchant_key", name: str = "canonical_name") -> DataFrame:
    """user_id, key, merchant, period, amount, last_seen, next_expected, payments, confidence, cancellable.

    The period is that of the upper median of the gaps (0 left out); without one there is no pattern.
    Confidence weighs how many payments there are (0.35), how many gaps fit (0.35), how stable the amount is
    (0.15) and whether the most frequent category is typically recurring (0.15). Payments are added up by user,
    merchant and category before the shuffle; a ledger without merchant_key gets the keys of these sums. No
    shuffle over a ledger that is stored by user (see sources.ledger.cluster_ledger).
    """
    one = ["user_id", "key"]
    rows = between(ledger, months_back(as_of, LOOK_BACK_MONTHS), as_of, type="DEBIT").where("merchant IS NOT NULL AND trim(merchant) <> ''")
    kept = [c for c in (key, name) if c in ledger.columns and c != "merchant"]
    value = F.col("amount").cast("double")
    sums = rows.groupBy("user_id", "merchant", "category", *kept).agg(
        F.count("*").alias("n"), F.sum("amount").alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.collect_set("date").alias("days")
    )
    if key == "merchant_key" and key not in ledger.columns:
        sums = with_merchant_key(sums)
    rows = sums.withColumn("key", F.col(key)).withColumn("_kinds", F.sum("n").over(W.partitionBy(*one, "category"))).withColumn("_names", F.sum("n").over(W.partitionBy(*one, "merchant")))
    kind = F.when(F.col("category").isNotNull(), F.struct("_kinds", (-category_order(F.col("category"))).alias("o"), "category"))
    stats = rows.groupBy(*one).agg(
        F.sum("n").alias("payments"),
        _gaps(F.flatten(F.collect_list("days"))).alias("gaps"),
        F.sum("total").cast("decimal(29,4)").alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.max(F.array_max("days")).alias("last_seen"),
        F.max(kind)["category"].alias("category"),
        F.min(F.struct((-F.col("_names")).alias("n"), "merchant"))["merchant"].alias("common_name"),
        (F.max(name) if name else F.lit(None).cast("string")).alias("known_name"),
    )
    # one condition with the payments, so that short keys are not looked for in every row before the sums
    stats = stats.where(F.when(F.length("key") >= LEAST_KEY, F.col("payments")) >= LEAST_PAYMENTS)
    stats = stats.where(F.size("gaps") > 0).withColumn("period", period_of(upper_median(F.col("gaps")))).where("period IS NOT NULL")
    stats = stats.withColumn("mean", F.col("total").cast("double") / F.col("payments"))
    low, high = _of_period(F.col("period"), 2), _of_period(F.col("period"), 3)
    stats = stats.withColumn("_low", low).withColumn("_high", high)
    # halves are summed as integers, so the order of the gaps does not matter
    fit = F.aggregate("gaps", F.lit(0), lambda s, d: s + F.when(d.between(F.col("_low"), F.col("_high")), 2).when(d <= F.col("_high") * 2, 1).otherwise(0))
    consistency = fit / 2.0 / F.size("gaps")
    stability = F.when(F.col("mean") > 0, F.greatest(F.lit(0.0), 1 - (F.col("high") - F.col("low")) / F.col("mean"))).otherwise(0.0)
    usual = F.when(F.col("category").isin(*V.RECURRING_CATEGORIES), 1.0).otherwise(0.5)
    confidence = F.least(F.col("payments"), F.lit(6)) / 6.0 * 0.35 + consistency * 0.35 + stability * 0.15 + usual * 0.15
    stats = stats.withColumn("confidence", confidence).where(F.col("confidence") >= LEAST_CONFIDENCE)
    return stats.select(
        *one,
        F.coalesce("known_name", "common_name").alias("merchant"),
        "period",
        quotient(F.col("total"), F.col("payments"), 4).alias("amount"),
        "last_seen",
        F.date_add("last_seen", _of_period(F.col("period"), 4)).alias("next_expected"),
        "payments",
        F.round("confidence", 3).cast("decimal(4,3)").alias("confidence"),
        F.coalesce(F.col("category").isin(*V.CANCELLABLE_CATEGORIES), F.lit(False)).alias("cancellable"),
    )


def monthly_equivalent(amount: Column, period: Column) -> Column:
    """Rounded once."""
    return quotient(amount * times_a_year(period), 12)


def view(patterns: DataFrame, as_of: date) -> DataFrame:
    """patterns with days_left, status, confidence_tier, label, annual and monthly (rounded from annual)."""
    days = F.datediff("next_expected", F.lit(as_of))
    nominal = _of_period(F.col("period"), 4)
    status = F.when(days < -nominal, "MISSED").when(days < 0, "OVERDUE").when(days <= 7, "DUE_SOON").otherwise("ACTIVE")
    annual = money(F.col("amount") * times_a_year(F.col("period")))
    return patterns.select(
        "*",
        days.alias("days_left"),
        status.alias("status"),
        tier(F.col("confidence"), (0.70, "HIGH"), (0.50, "MEDIUM"), other="POSSIBLE").alias("confidence_tier"),
        _of_period(F.col("period"), 1).alias("label"),
        annual.alias("annual"),
        quotient(annual, 12).alias("monthly"),
    )


def merge(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored patterns (with dismissed, confirmed) after a new detection, one row for each user, key and period.

    Dismissed ones stay as they are and hide their detection; confirmed ones take the new figures and stay
    even if not found; others are replaced by what is found.
    """
    key = ["user_id", "key", "period"]
    old, new = stored.alias("o"), found.alias("n")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]
    both = old.join(new, same[0] & same[1] & same[2], "full_outer")
    here, kept = F.col("n.user_id").isNotNull(), F.coalesce(F.col("o.dismissed"), F.lit(False))
    confirmed = F.coalesce(F.col("o.confirmed"), F.lit(False))
    pick = lambda c: F.when(here & ~kept, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    rows = both.where(here | kept | confirmed)
    values = [c for c in found.columns if c not in key]
    return rows.select(*[F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in key], *[pick(c).alias(c) for c in values], kept.alias("dismissed"), confirmed.alias("confirmed"))


def apply_actions(stored: DataFrame, actions: DataFrame) -> DataFrame:
    """stored after the last action (dismiss, restore, confirm, unconfirm) of each user, key and period, by
    column at; dismissed and confirmed exclude each other."""
    key = ["user_id", "key", "period"]
    last = actions.groupBy(*key).agg(F.max(F.struct("at", "action"))["action"].alias("action"))
    rows = stored.join(last, key, "left")
    did = F.coalesce("action", F.lit(""))
    dismissed = F.when(did == "dismiss", True).when(did.isin("restore", "confirm"), False).otherwise(F.col("dismissed"))
    confirmed = F.when(did == "confirm", True).when(did.isin("unconfirm", "dismiss"), False).otherwise(F.col("confirmed"))
    return rows.withColumn("_d", dismissed).withColumn("confirmed", confirmed).withColumn("dismissed", F.col("_d")).drop("_d", "action").select(*stored.columns)
