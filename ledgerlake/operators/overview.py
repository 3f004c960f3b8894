"""Totals, breakdowns, trends and alerts over a ledger, for all users in one pass.

Every function takes a ledger (see sources.ledger) and inclusive date bounds, and keys its rows by user_id;
filter the ledger on user_id for one user. Nothing is collected; sums are decimal, shares double.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import quotient, round1, tier
from ..functions.periods import months_back

#: Alerts: least amount, least ratio, ratio of a high one, how many a user gets, days back from as_of.
TREND_MOST = 24
ALERT_AMOUNT, ALERT_RATIO, ALERT_HIGH, ALERTS, ALERT_DAYS = 200, 1.3, 2.0, 3, 45


def between(ledger: DataFrame, start: date | None = None, end: date | None = None, **equal: str) -> DataFrame:
    """Rows within the bounds, both ends included, whose columns equal what is given; None does not filter."""
    out = ledger
    by_month = "month" in ledger.columns  # as stored: other months are not read
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start))
        out = out.where(F.col("month") >= f"{start:%Y-%m}") if by_month else out
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end))
        out = out.where(F.col("month") <= f"{end:%Y-%m}") if by_month else out
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def _sum(amount: Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(29,4)")


def of_type(kind: str) -> Column:
    return F.when(F.col("type") == kind, F.col("amount"))


def totals(ledger: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """user_id, income, spend, net, entries."""
    rows = between(ledger, start, end).groupBy("user_id").agg(_sum(of_type("CREDIT")).alias("income"), _sum(of_type("DEBIT")).alias("spend"), F.count("*").alias("entries"))
    return rows.withColumn("net", (F.col("income") - F.col("spend")).cast("decimal(29,4)"))


def summary(ledger: DataFrame, start: date | None, end: date) -> DataFrame:
    """user_id, income, spend, net, entries, categories, top_category, top_merchant, alerts: the overview of a
    period in one row a user. start: the first of end's month, if not given."""
    start = start or end.replace(day=1)
    kinds = by_category(ledger, start, end).groupBy("user_id")
    kinds = kinds.agg(F.count("*").alias("categories"), F.min(F.struct((-F.col("total")).alias("t"), "category"))["category"].alias("top_category"))
    shop = top_merchants(ledger, start, end, 1).select("user_id", F.col("merchant").alias("top_merchant"))
    warned = spend_alerts(ledger, start, end, end).groupBy("user_id").agg(F.count("*").alias("alerts"))
    out = totals(ledger, start, end).join(kinds, "user_id", "left").join(shop, "user_id", "left").join(warned, "user_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("categories", "alerts")})


def bounds(ledger: DataFrame) -> DataFrame:
    """user_id, first, last, entries, months (how many have an entry)."""
    return ledger.groupBy("user_id").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("entries"), F.countDistinct(F.trunc("date", "MM")).alias("months"))


def active_months(ledger: DataFrame) -> DataFrame:
    """user_id, month (yyyy-MM) of months with entries."""
    return ledger.select("user_id", F.date_format("date", "yyyy-MM").alias("month")).distinct()


def by_category(ledger: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """user_id, category, total, entries of debits that have a category."""
    rows = between(ledger, start, end, type="DEBIT").where("category IS NOT NULL")
    return rows.groupBy("user_id", "category").agg(_sum(F.col("amount")).alias("total"), F.count("*").alias("entries"))


def category_share(ledger: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """by_category with share: percent, one decimal, of all debits, those without category included."""
    rows = between(ledger, start, end, type="DEBIT").groupBy("user_id", "category").agg(_sum(F.col("amount")).alias("total"), F.count("*").alias("entries"))
    every = F.sum("total").over(W.partitionBy("user_id"))
    share = F.when(every > 0, round1(F.col("total").cast("double") / every.cast("double") * 100)).otherwise(0.0)
    return rows.withColumn("share", share).where("category IS NOT NULL")


def category_rollup(ledger: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """Totals by user and category, by user, and of all: null where summed over."""
    rows = between(ledger, start, end, type="DEBIT").where("category IS NOT NULL")
    return rows.rollup("user_id", "category").agg(_sum(F.col("amount")).alias("total"), F.count("*").alias("entries"))


def top_merchants(ledger: DataFrame, start: date | None, end: date | None, k: int = 8) -> DataFrame:
    """user_id, rank, merchant, total, entries of each user's k largest, ties by name."""
    rows = between(ledger, start, end, type="DEBIT").where("merchant IS NOT NULL AND merchant <> ''")
    rows = rows.groupBy("user_id", "merchant").agg(_sum(F.col("amount")).alias("total"), F.count("*").alias("entries"))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("total"), "merchant"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def monthly(ledger: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """user_id, month (date of its first day), spend, income."""
    rows = between(ledger, start, end).groupBy("user_id", F.trunc("date", "MM").alias("month"))
    return rows.agg(_sum(of_type("DEBIT")).alias("spend"), _sum(of_type("CREDIT")).alias("income"))


def trend(ledger: DataFrame, start: date, end: date) -> DataFrame:
    """monthly for every month from start to end of every user with an entry there, gaps as 0; and net."""
    found = monthly(ledger, start, end)
    months = F.explode(F.sequence(F.trunc(F.lit(start), "MM"), F.trunc(F.lit(end), "MM"), F.expr("interval 1 month"))).alias("month")
    calendar = found.select("user_id").distinct().select("user_id", months)
    rows = calendar.join(found, ["user_id", "month"], "left")
    spend, income = (F.coalesce(c, F.lit(0)).cast("decimal(29,4)") for c in ("spend", "income"))
    return rows.select("user_id", "month", spend.alias("spend"), income.alias("income"), (income - spend).cast("decimal(29,4)").alias("net"))


def trend_with_forecast(ledger: DataFrame, as_of: date, months: int = 12) -> DataFrame:
    """user_id, month, spend, income, net, forecast (false or true): the last `months` (1 to 24) months up to as_of's,
    gaps as 0, and the three after them."""
    start = months_back(as_of.replace(day=1), max(1, min(months, TREND_MOST)) - 1)
    past = trend(ledger, start, as_of)
    ahead = forecast(past, as_of).select("user_id", "month", *[F.col(c).cast("decimal(29,4)").alias(c) for c in ("spend", "income", "net")], F.lit(True).alias("forecast"))
    return past.withColumn("forecast", F.lit(False)).unionByName(ahead)


def full(ledger: DataFrame, start: date, end: date, as_of: date) -> DataFrame:
    """user_id, income, spend, net, entries and the lists of an overview, each in its order: categories (category,
    total, share; largest first), merchants (merchant, total; the top eight), alerts (category, change, severity)."""
    def listed(rows: DataFrame, name: str, order: list[Column], *columns: str) -> DataFrame:
        one = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *columns)
        lists = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(one)).alias("x"))
        return lists.select("user_id", F.transform("x", lambda r: F.struct(*[r[c].alias(c) for c in columns])).alias(name))

    kinds = listed(category_share(ledger, start, end), "categories", [-F.col("total"), F.col("category")], "category", "total", "share")
    shops = listed(top_merchants(ledger, start, end), "merchants", [F.col("rank")], "merchant", "total")
    warned = listed(spend_alerts(ledger, start, end, as_of), "alerts", [F.col("rank")], "category", "change", "severity")
    out = totals(ledger, start, end).join(kinds, "user_id", "left").join(shops, "user_id", "left").join(warned, "user_id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("categories", "merchants", "alerts")})


def forecast(history: DataFrame, as_of: date, look_back: int = 3, ahead: int = 3) -> DataFrame:
    """user_id, month, spend, income, net of the months after as_of: means of the last months of a trend."""
    last = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("month")))
    recent = history.withColumn("n", last).where(F.col("n") <= look_back).groupBy("user_id")
    means = recent.agg(quotient(F.sum("spend"), F.count("*")).alias("spend"), quotient(F.sum("income"), F.count("*")).alias("income"))
    months = F.explode(F.transform(F.sequence(F.lit(1), F.lit(ahead)), lambda i: F.add_months(F.trunc(F.lit(as_of), "MM"), i))).alias("month")
    return means.select("user_id", months, "spend", "income", (F.col("income") - F.col("spend")).cast("decimal(19,2)").alias("net"))


def spend_alerts(ledger: DataFrame, start: date, end: date, as_of: date) -> DataFrame:
    """user_id, rank, category, current, average, change, severity of categories far above their average.

    The average is over the three calendar months up to the day before start. Periods that ended over 45
    days before as_of give no alert.
    """
    before = start - timedelta(days=1)
    average = by_category(ledger, months_back(before.replace(day=1), 2), before).select("user_id", "category", quotient(F.col("total"), 3).alias("average"))
    now = by_category(ledger, start, end).where(F.lit(end) >= F.date_sub(F.lit(as_of), ALERT_DAYS))
    rows = now.join(average, ["user_id", "category"]).where((F.col("average") != 0) & (F.col("total") >= ALERT_AMOUNT))
    rows = rows.withColumn("ratio", F.col("total").cast("double") / F.col("average").cast("double")).where(F.col("ratio") >= ALERT_RATIO)
    rows = rows.withColumn("change", round1((F.col("ratio") - 1) * 100)).withColumn("severity", tier(F.col("ratio"), (ALERT_HIGH, "HIGH"), other="MEDIUM"))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("change"), "category"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= ALERTS).select("user_id", "rank", "category", F.col("total").alias("current"), "average", "change", "severity")


def prior_window(ledger: DataFrame, start: date, end: date) -> DataFrame:
    """user_id, spend, prior_spend, change (percent, one decimal): against the equally long window before."""
    first = start - (end - start) - timedelta(days=1)
    rows = between(ledger, first, end, type="DEBIT").groupBy("user_id")
    now = F.col("date") >= F.lit(start)
    sums = rows.agg(_sum(F.when(now, F.col("amount"))).alias("spend"), _sum(F.when(~now, F.col("amount"))).alias("prior_spend"))
    ratio = (F.col("spend") - F.col("prior_spend")).cast("double") / F.col("prior_spend").cast("double") * 100
    return sums.withColumn("change", F.when(F.col("prior_spend") > 0, round1(ratio)).otherwise(0.0))
