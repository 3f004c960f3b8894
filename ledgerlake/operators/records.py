"""Changes and checks of stored rows: pages, patches, quotas, references, uploads, replies of a language model."""

from __future__ import annotations

import logging
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import clamp
from ..functions.text import trimmed
from .overview import between

log = logging.getLogger(__name__)

PAGE, PAGE_MOST = 25, 100


def page(ledger: DataFrame, number: int = 0, size: int = PAGE) -> DataFrame:
    """One page of a ledger, latest entries first; at most 100 rows."""
    size = max(1, min(size, PAGE_MOST))
    order = [F.desc("date"), F.desc("id"), F.desc("amount"), "merchant", "user_id"]
    return ledger.orderBy(*order).offset(number * size).limit(size)


def page_after(ledger: DataFrame, user_id: int, after: tuple[date, int] | None = None, size: int = PAGE) -> DataFrame:
    """One user's next entries, latest first, after the (date, id) of the last one seen (None: from the latest on).
    A stored ledger is read from that entry's month back; pages do not shift when newer entries come."""
    size = max(1, min(size, PAGE_MOST))
    rows = between(ledger, None, after[0] if after else None, user_id=user_id)
    if after:
        day = F.lit(after[0])
        rows = rows.where((F.col("date") < day) | ((F.col("date") == day) & (F.col("id") < after[1])))
    return rows.orderBy(F.desc("date"), F.desc("id")).limit(size)


def pages_after(ledger: DataFrame, keys: DataFrame | None, size: int = PAGE) -> DataFrame:
    """The next entries of many users, with place (from 1): keys (user_id, date, id) hold the last one that each has
    seen, null date for none; keys None: the first page of every user. Spark limits each user's rows before the shuffle."""
    size = max(1, min(size, PAGE_MOST))
    if keys is not None:
        last = keys.select("user_id", F.col("date").alias("_date"), F.col("id").alias("_id"))
        later = F.col("_date").isNull() | (F.col("date") < F.col("_date")) | ((F.col("date") == F.col("_date")) & (F.col("id") < F.col("_id")))
        rows = ledger.join(last, "user_id").where(later).drop("_date", "_id")
    else:
        rows = ledger.where("user_id IS NOT NULL")
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("date"), F.desc("id")))
    return rows.withColumn("place", place).where(F.col("place") <= size)


def patch(ledger: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """ledger with the cells of changes that are not null. A changed category has confidence 1 and is reviewed."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    rows = ledger.join(new, key, "left")
    changed = F.col("_category").isNotNull() if "category" in changes.columns else F.lit(False)
    made = [F.coalesce(f"_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in ledger.columns if c not in ("confidence", "reviewed")]
    confidence = F.when(changed, 1.0).otherwise(F.col("confidence") if "confidence" in ledger.columns else F.lit(None)).cast("decimal(5,4)")
    reviewed = changed | (F.coalesce("reviewed", F.lit(False)) if "reviewed" in ledger.columns else F.lit(False))
    return rows.select(*made, confidence.alias("confidence"), reviewed.alias("reviewed"))


def quota(users: DataFrame, used: DataFrame, month: date | None = None, at: str = "created_at") -> DataFrame:
    """users (user_id, quota, unlimited) with used (rows of it; with month those of that calendar month) and
    remaining (0 at least; null if unlimited), open."""
    if month is not None:
        used = used.where(F.trunc(at, "MM") == F.lit(month.replace(day=1)))
    counts = used.groupBy("user_id").agg(F.count("*").alias("used"))
    rows = users.join(counts, "user_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    left = F.greatest(F.lit(0), F.col("quota") - F.col("used"))
    return rows.withColumn("remaining", F.when(~F.col("unlimited"), left)).withColumn("open", F.col("unlimited") | (left > 0))


def counters(events: DataFrame, key: str = "user_id", at: str = "at") -> DataFrame:
    """key, count: increments since the last reset of each key, over events (kind INCREMENT or RESET)."""
    last = F.max(F.when(F.col("kind") == "RESET", F.col(at)))
    counted = events.join(events.groupBy(key).agg(last.alias("reset")), key)
    live = (F.col("kind") == "INCREMENT") & (F.col("reset").isNull() | (F.col(at) > F.col("reset")))
    return counted.groupBy(key).agg(F.count(F.when(live, 1)).alias("count"))


#: What comes first in each listing; ties by the columns after.
ORDERS = {
    "detected": (("confirmed", "desc"), ("amount", "desc_nulls_last"), ("key", "asc")),
    "stored": (("amount", "desc_nulls_first"), ("key", "asc")),
    "budgets": (("category", "asc_nulls_first"),),
    "newest": (("created_at", "desc"), ("id", "desc")),
}


def placed(rows: DataFrame, order: str) -> DataFrame:
    """rows with place, from 1 for each user, in one of ORDERS."""
    by = [getattr(F.col(c), way)() for c, way in ORDERS[order]]
    return rows.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(*by)))


def ui_signals(leaks: DataFrame, behaviours: DataFrame, most: int = 5) -> DataFrame:
    """user_id, place, origin, kind, severity: leaks and behaviours together, the most severe first, of like ones leaks."""
    rank = {"HIGH": 1, "MEDIUM": 2, "LOW": 3}
    severe = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in rank.items()], F.lit(4))
    rows = leaks.select("user_id", F.lit("LEAK").alias("origin"), "kind", "severity", "rank").unionByName(behaviours.select("user_id", F.lit("PATTERN").alias("origin"), "kind", "severity", "rank"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(severe, "origin", "rank", "kind"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("user_id", "place", "origin", "kind", "severity")


def entered(requests: DataFrame) -> DataFrame:
    """Ledger rows of entries by hand (id, user_id, amount, date, description, merchant, category, type): amounts
    without sign, texts cleaned, reviewed, source MANUAL."""
    return _made(requests, F.upper("type"), "MANUAL")


def confirmed(receipts: DataFrame) -> DataFrame:
    """Ledger rows of receipts that a user confirmed (id, user_id, amount, date, merchant, category, notes): debits
    of at least 0.01, reviewed, source OCR; the description is the notes, or the merchant."""
    rows = receipts.where(F.col("amount") >= F.lit(0.01).cast("decimal(19,4)")).withColumn("description", F.coalesce("notes", "merchant"))
    return _made(rows, F.lit("DEBIT"), "OCR")


def _made(rows: DataFrame, kind: Column, source: str) -> DataFrame:
    return rows.select(
        "id", "user_id", F.abs("amount").cast("decimal(19,4)").alias("amount"), "date", safe_text(F.col("description"), 500).alias("description"), safe_text(F.col("merchant")).alias("merchant"),
        F.coalesce("category", F.lit("OTHER")).alias("category"), kind.alias("type"), F.lit(source).alias("source"), F.lit(True).alias("reviewed"),
    )


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key is set but unknown to parent."""
    known = parent.select(F.col(parent_key).alias("_k")).distinct()
    return child.where(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("_k"), "left_anti")


def image_kind(content: Column) -> Column:
    """JPEG, PNG, WEBP, TIFF or BMP by the first bytes of a file, else null."""
    start = F.hex(F.substring(content, 1, 12))
    return (
        F.when(start.startswith("FFD8FF"), "JPEG").when(start.startswith("89504E470D0A1A0A"), "PNG").when(start.rlike("^52494646.{8}57454250"), "WEBP")
        .when(start.startswith("49492A00") | start.startswith("4D4D002A"), "TIFF").when(start.startswith("424D"), "BMP")
    )


def safe_text(c: Column, most: int = 255) -> Column:
    """Without control characters (but tabs and newlines), trimmed, at most `most` characters."""
    return F.substring(trimmed(F.regexp_replace(c, r"[\p{Cntrl}&&[^\n\t\r]]", "")), 1, most)


def safe_name(c: Column) -> Column:
    """A file name without path and odd characters."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]", "_")


def parse_reply(body: Column) -> Column:
    """struct(merchant, amount, day, confidence) of the JSON inside a chat reply; "null" texts are null."""
    inner = F.from_json(F.get_json_object(body, "$.choices[0].message.content"), "merchant string, amount string, date string, confidence double")
    real = lambda c: F.when(~F.lower(trimmed(c)).isin("null", ""), trimmed(c))
    return F.struct(
        real(inner["merchant"]).alias("merchant"), real(inner["amount"]).try_cast("decimal(19,2)").alias("amount"),
        F.try_to_timestamp(real(inner["date"]), F.lit("yyyy-MM-dd")).cast("date").alias("day"), clamp(inner["confidence"]).alias("confidence"),
    )


#: Columns of an audit log; day is its partition.
AUDIT = "event_id string, at timestamp, user_id long, action string, kind string, key string, metadata string, day date"


def audit(events: DataFrame, path: str) -> bool:
    """Append events (event_id, at, user_id, action, kind, key, metadata map) by day, metadata as JSON; whether that
    went well. An event that is there already is left out, so a repeat adds nothing; repeated ids within events
    count once; events without that column are all new. An error is logged and never reaches the caller, whose own work has to go on."""
    spark = events.sparkSession
    try:
        made = F.col("event_id").cast("string") if "event_id" in events.columns else F.expr("uuid()")
        rows = events.withColumn("event_id", made).withColumn("metadata", F.to_json("metadata")).withColumn("day", F.to_date("at"))
        rows = rows.select(*[c.split()[0] for c in AUDIT.split(", ")]).dropDuplicates(["event_id"])
        days = [r[0] for r in rows.select("day").distinct().collect()]  # the calendar bounds them
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            known = audit_log(spark, path).where(F.col("day").isin([d for d in days if d]) | (F.col("day").isNull() & F.lit(None in days))).select("event_id")
            rows = rows.join(known, "event_id", "left_anti")
        rows.select(*[c.split()[0] for c in AUDIT.split(", ")]).write.mode("append").partitionBy("day").parquet(path)
    except Exception:  # whatever it is, the caller's rows are more important
        log.exception("audit events were not written to %s", path)
        return False
    return True


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).parquet(path)
