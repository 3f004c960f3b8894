"""Streams over ledger events: rate windows, daily spend, signals that are new. The first two give the same on tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rescan import follow, state

#: Fixed windows of a counter: seconds and how many are let through.
LIMITS = {"auth": (60, 5), "upload": (3600, 30), "reset_request": (3600, 5), "reset_confirm": (3600, 10)}


def rate_windows(events: DataFrame, key: str, kind: str, late: str = "1 day", at: str = "ts") -> DataFrame:
    """key, window_start, count, rejected: events by fixed window, and how many are over the limit.

    State is dropped once a window is `late` behind; on a table the watermark has no effect.
    """
    seconds, most = LIMITS[kind]
    if events.isStreaming:
        events = events.withWatermark(at, late)
    rows = events.groupBy(key, F.window(at, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("count"))
    return rows.select(key, F.col("w.start").alias("window_start"), "count", F.greatest(F.lit(0), F.col("count") - most).cast("long").alias("rejected"))


def daily_spend(events: DataFrame, late: str = "2 days", at: str = "ts") -> DataFrame:
    """user_id, day, category, spend, entries by day of event time."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    rows = events.groupBy("user_id", F.window(at, "1 day").alias("w"), "category")
    sums = rows.agg(F.sum("amount").cast("decimal(29,4)").alias("spend"), F.count("*").alias("entries"))
    return sums.select("user_id", F.to_date("w.start").alias("day"), "category", "spend", "entries")


def new_signals(signals: DataFrame, late: str = "30 days", at: str = "ts") -> DataFrame:
    """The first HIGH signal of each user and kind. On a stream `late` bounds the state: a repeat within it is not
    sent again, one that comes later is; on a table, which has all rows at hand, none is."""
    high = signals.where("severity = 'HIGH'")
    if high.isStreaming:
        return high.withWatermark(at, late).dropDuplicatesWithinWatermark(["user_id", "kind"])
    first = high.groupBy("user_id", "kind").agg(F.min(at).alias(at))
    return first


def each_batch(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, schema: T.StructType) -> None:
    """Renew what apply(all rows so far) gives for the users of each micro-batch, of `schema` and by user_id: for
    what needs the whole history of a user. Stored as rescan.follow does; batch_result reads it."""
    follow(stream, lambda _, rows: apply(rows), schema, path, checkpoint)


def batch_result(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return state(spark, path, schema).read()
