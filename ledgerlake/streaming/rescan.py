"""Derived state that follows a stream of ledger entries: recurring patterns that keep what users said of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import recurring
from .folders import Folders, bucket_of
from .run import foreach_batch


def history(spark: SparkSession, path: str, schema: T.StructType) -> Folders:
    return Folders(spark, f"{path}/rows", schema, newest=False)


def state(spark: SparkSession, path: str, schema: T.StructType) -> Folders:
    return Folders(spark, f"{path}/state", schema, newest=True)


def follow(stream: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType, path: str, checkpoint: str) -> None:
    """Run what is there of a stream (with user_id), and renew the stored state of the users of each batch:
    apply(their state before, all their rows so far) gives their state after (of `schema`, with user_id).

    Rows and state are stored by bucket of users, under the batch's number; a batch that comes again changes
    nothing, be it because it ended before or because it has to be done anew. Other users are not computed.
    Rows without a user are left out.
    """
    spark = stream.sparkSession
    rows, kept = history(spark, path, stream.schema), state(spark, path, schema)

    def run(batch: DataFrame, number: int) -> None:
        label = f"batch{number}"
        if kept.has(label):
            return
        rows.write(batch.where("user_id IS NOT NULL"), label)
        users = rows.part(label).select("user_id").distinct()
        buckets = sorted(r[0] for r in users.select(bucket_of()).distinct().collect())  # BUCKETS at most
        if not buckets:
            return
        before = kept.read(buckets)
        after = apply(before.join(users, "user_id", "left_semi"), rows.read(buckets).join(users, "user_id", "left_semi"))
        others = before.join(users, "user_id", "left_anti").select(*kept.schema.names)
        kept.write(others.unionByName(after.select(*kept.schema.names)), label, buckets)

    foreach_batch(stream, run, checkpoint)


def pattern_schema(detected: DataFrame) -> T.StructType:
    """What is stored of detected patterns: with dismissed and confirmed."""
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in detected.schema.fields), T.StructField("dismissed", T.BooleanType()), T.StructField("confirmed", T.BooleanType())])


def rescan(stream: DataFrame, detect: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Detect the recurring payments of each batch's users in all their entries, and merge them with the stored
    ones: dismissed patterns stay and hide their detection, confirmed ones stay with new figures."""
    schema = pattern_schema(detect(stream.sparkSession.createDataFrame([], stream.schema)))
    follow(stream, lambda before, rows: recurring.merge(before, detect(rows)), schema, path, checkpoint)


def act(spark: SparkSession, actions: DataFrame, schema: T.StructType, path: str, label: str) -> None:
    """Apply what users did (user_id, key, period, at, action) to the stored patterns, once for each label."""
    kept = state(spark, path, schema)
    buckets = sorted(r[0] for r in actions.where("user_id IS NOT NULL").select(bucket_of()).distinct().collect())
    if buckets:
        kept.write(recurring.apply_actions(kept.read(buckets), actions), label, buckets)
