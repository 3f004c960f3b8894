"""Recommendations from leaks, and what they would save."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import money

#: What a leak leads to, and the percentage of its impact that is counted as saved.
ACTIONS = {
    "DUPLICATE_SUBSCRIPTIONS": ("CANCEL_SUBSCRIPTION", 100),
    "SUBSCRIPTION_CREEP": ("REVIEW_INFLATION", 100),
    "HIGH_FREQUENCY_SMALL_SPEND": ("SHIFT_HABIT", 50),
    "BANK_FEES": ("REDUCE_CATEGORY", 100),
}
LEAST, TOP = 100, 5


def recommendations(leaks: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """user_id, rank, action, monthly: for each leak its action, and for users with an active goal one to
    redirect all leaks to it. Under 100 a month nothing is recommended; the five largest stay."""
    action, share = F.lit(None).cast("string"), F.lit(0)
    for kind, (name, percent) in ACTIONS.items():
        action = F.when(F.col("kind") == kind, F.lit(name)).otherwise(action)
        share = F.when(F.col("kind") == kind, F.lit(percent)).otherwise(share)
    rows = leaks.select("user_id", action.alias("action"), money(F.col("monthly") * share / 100).alias("monthly"), F.col("rank").alias("place"))
    if goals is not None:
        has = goals.where("state = 'ACTIVE'").select("user_id").distinct()
        sums = leaks.join(has, "user_id", "left_semi").groupBy("user_id").agg(F.sum("monthly").cast("decimal(19,2)").alias("monthly")).where(F.col("monthly") > LEAST)
        rows = rows.unionByName(sums.select("user_id", F.lit("REDIRECT_TO_GOAL").alias("action"), "monthly", F.lit(99).alias("place")))
    rows = rows.where(F.col("monthly") >= LEAST)
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("monthly"), "place", "action"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= TOP).select("user_id", "rank", "action", "monthly")


def redirects(leaks: DataFrame, goals: DataFrame) -> DataFrame:
    """user_id, goal_id, monthly: what all leaks of a user could pay into the active goal that is due next
    (ties by goal_id; without a date last), where that is over 100 a month."""
    due = F.row_number().over(W.partitionBy("user_id").orderBy(F.asc_nulls_last("target_date"), "goal_id"))
    nearest = goals.where("state = 'ACTIVE'").withColumn("n", due).where("n = 1").select("user_id", "goal_id")
    sums = leaks.groupBy("user_id").agg(F.sum("monthly").cast("decimal(19,2)").alias("monthly")).where(F.col("monthly") > LEAST)
    return sums.join(nearest, "user_id").select("user_id", "goal_id", "monthly")


def savings(recommended: DataFrame) -> DataFrame:
    """user_id, monthly, net: the sum over recommendations, and without the redirected share counted again."""
    own = F.when(F.col("action") != "REDIRECT_TO_GOAL", F.col("monthly")).otherwise(0)
    return recommended.groupBy("user_id").agg(F.sum("monthly").cast("decimal(19,2)").alias("monthly"), F.sum(own).cast("decimal(19,2)").alias("net"))
