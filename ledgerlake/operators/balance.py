"""Transactions from the balances of a statement that has no amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.numbers import upper_median

LEAST_JUMP, JUMP_TIMES = 1000, 100


def reconstruct(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, row_number, date, description, balance, ...) with kind, amount, is_debit, suspicious, confidence.

    kind: MISSING (no date or balance), DUPLICATE (same date, description and balance before), MARKER
    (opening or closing balance), ANCHOR (the first), NO_CHANGE, TRANSACTION. The change is against the row
    before in order of date and number. A change over 1000 and over 100 times the upper median of all
    changes is suspicious: confidence one half.
    """
    c = F.col
    good = rows.where("date IS NOT NULL AND balance IS NOT NULL")
    lower = F.lower(F.coalesce("description", F.lit("")))
    again = W.partitionBy(*key, "date", lower, "balance").orderBy("row_number")
    good = good.withColumn("_n", F.row_number().over(again))
    once = good.where("_n = 1")
    change = (c("balance") - F.lag("balance").over(W.partitionBy(*key).orderBy("date", "row_number"))).cast("decimal(19,4)")
    once = once.withColumn("_change", change)
    medians = once.groupBy(*key).agg(upper_median(F.collect_list(F.when(c("_change") != 0, F.abs("_change")))).alias("_median"))
    once = once.join(medians, key)
    marks = F.lit(False)
    for m in (*V.OPENING_MARKS, *V.CLOSING_MARKS):
        marks = marks | lower.contains(m)
    kind = F.when(marks, "MARKER").when(c("_change").isNull(), "ANCHOR").when(c("_change") == 0, "NO_CHANGE").otherwise("TRANSACTION")
    once = once.withColumn("kind", kind)
    real = c("kind") == "TRANSACTION"
    jump = real & (F.abs("_change") >= LEAST_JUMP) & (F.abs("_change") > c("_median") * JUMP_TIMES)
    once = once.withColumn("amount", F.when(real, F.round(F.abs("_change"), 2)).cast("decimal(19,4)")).withColumn("is_debit", F.when(real, c("_change") < 0))
    once = once.withColumn("suspicious", F.coalesce(jump, F.lit(False))).withColumn("confidence", F.when(real, F.when(c("suspicious"), 0.5).otherwise(1.0)).cast("decimal(5,4)"))
    rest = rows.where("date IS NULL OR balance IS NULL").withColumn("kind", F.lit("MISSING")).unionByName(good.where("_n > 1").drop("_n").withColumn("kind", F.lit("DUPLICATE")))
    empty = {"amount": "decimal(19,4)", "is_debit": "boolean", "confidence": "decimal(5,4)"}
    rest = rest.withColumns({k: F.lit(None).cast(t) for k, t in empty.items()}).withColumn("suspicious", F.lit(False))
    return once.drop("_n", "_change", "_median").unionByName(rest)
