"""Queries of streams with state, over logs that are made of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import records, recurring
from ..sources import export, large_csv, statements
from ..sources.ledger import test_ledger
from ..streaming import ingest, rescan, run, state
from .catalog import AS_OF, PATTERNS, query


def log_sql(last: str) -> str:
    """Each user's events as uses of tokens, in the SQL of either engine (`last`: the last value that is not null).
    A user comes with the newest token, or (every third time) with that of two events before."""
    before = "OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
SELECT user_id, id, ts, action, CASE WHEN action = 'ROTATE' THEN id END AS new_token,
       CASE WHEN action IN ('ISSUE', 'RESET_REQUEST') THEN id WHEN action = 'RESET_CONSUME' THEN link WHEN id % 3 = 0 THEN older WHEN action IN ('ROTATE', 'REVOKE') THEN newest END AS token
FROM (SELECT *, lag(id, 2) OVER (PARTITION BY user_id ORDER BY ts, id) AS older, {last.format("CASE WHEN action IN ('ISSUE', 'ROTATE') THEN id END")} {before} AS newest,
             {last.format("CASE WHEN action = 'RESET_REQUEST' THEN id END")} {before} AS link
      FROM (SELECT user_id, event_id AS id, ts,
                   CASE WHEN event_type = 'signup' THEN 'ISSUE' WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'REVOKE' WHEN event_type = 'purchase' THEN 'RESET_REQUEST'
                        WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'REVOKE_ALL' WHEN event_type = 'error' THEN 'RESET_CONSUME' ELSE 'ROTATE' END AS action FROM events))"""


#: Rows of a file, and so of a micro-batch, of a log that is streamed.
BATCH_ROWS = 1_000_000

#: Events of a bucket of users, all batches together, about.
BUCKET_ROWS = 1 << 16

#: Of a file that one task writes, so that more than one task reads it.
GROUP_BYTES = 2 << 20


def by_time(rows: DataFrame, name: str, least: int) -> DataFrame:
    """rows (with a time `at`) as a stream of files that come in order of time, one to a micro-batch: `least` or
    more, of about BATCH_ROWS rows at most. A file source takes files by age, so they are written in turn, each from
    its own part of the rows: all together are read twice, however many files there are."""
    spark = rows.sparkSession
    rows = run.stored(rows, name)
    schema = rows.schema
    n = max(least, -(-rows.count() // BATCH_ROWS))
    cuts = rows.select(F.percentile_approx(F.unix_micros("at"), [k / n for k in range(1, n)], 10_000)).first()[0] or []
    path = run.place(spark, f"{name}-by-time")
    number = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: F.unix_micros("at") > c))
    known = rows.where(F.col("at").isNotNull()) if cuts else rows
    dealt = run.place(spark, f"{name}-parts")
    known.withColumn("_part", number).repartition("_part").write.partitionBy("_part").parquet(dealt)
    parts = spark.read.schema(T.StructType([*schema.fields, T.StructField("_part", T.IntegerType())])).parquet(dealt)
    for k in range(len(cuts) + 1):
        parts.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


#: One step for each event of a user: what is done with the tokens so far.
TOKEN_SQL = f"""
WITH RECURSIVE log AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM ({log_sql("last_value({0} IGNORE NULLS)")})),
run AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS action, NULL::VARCHAR AS outcome, 0 AS revoked,
         []::STRUCT(t BIGINT, k VARCHAR, e TIMESTAMP, c TIMESTAMP, r TIMESTAMP)[] AS toks FROM log
  UNION ALL
  SELECT user_id, n, id, ts, action, outcome,
         CASE WHEN outcome = 'REUSED' OR action = 'REVOKE_ALL' OR outcome = 'RESET' THEN len(live) WHEN action = 'REVOKE' AND outcome = 'REVOKED' THEN 1 ELSE 0 END::INT,
         list_concat(list_transform(toks, lambda x: {{'t': x.t, 'k': x.k, 'e': x.e,
             'c': CASE WHEN x.t = token AND outcome IN ('ROTATED', 'RESET') AND x.k = CASE outcome WHEN 'RESET' THEN 'RESET' ELSE 'SESSION' END THEN ts
                       WHEN outcome = 'RESET' AND x.k = 'RESET' AND x.c IS NULL AND x.e > ts THEN ts ELSE x.c END,
             'r': CASE WHEN x.t = token AND action = 'REVOKE' AND outcome = 'REVOKED' THEN ts
                       WHEN (outcome IN ('REUSED', 'RESET') OR action = 'REVOKE_ALL') AND list_contains(live, x.t) THEN ts ELSE x.r END}}),
           CASE WHEN action = 'ISSUE' OR outcome = 'ROTATED' THEN [{{'t': id, 'k': 'SESSION', 'e': ts + INTERVAL 7 DAY, 'c': NULL::TIMESTAMP, 'r': NULL::TIMESTAMP}}]
                WHEN action = 'RESET_REQUEST' THEN [{{'t': id, 'k': 'RESET', 'e': ts + INTERVAL 30 MINUTE, 'c': NULL::TIMESTAMP, 'r': NULL::TIMESTAMP}}] ELSE [] END)
  FROM (SELECT *, CASE action WHEN 'ISSUE' THEN 'ISSUED' WHEN 'RESET_REQUEST' THEN 'ISSUED' WHEN 'REVOKE_ALL' THEN 'REVOKED'
             WHEN 'REVOKE' THEN CASE WHEN f IS NULL OR f.r IS NOT NULL THEN 'IGNORED' ELSE 'REVOKED' END
             WHEN 'RESET_CONSUME' THEN CASE WHEN f IS NULL OR f.c IS NOT NULL OR f.e <= ts THEN 'INVALID' ELSE 'RESET' END
             ELSE CASE WHEN f IS NULL THEN 'INVALID' WHEN f.c IS NOT NULL OR f.r IS NOT NULL THEN 'REUSED' WHEN f.e <= ts THEN 'EXPIRED' ELSE 'ROTATED' END END AS outcome
        FROM (SELECT log.user_id, log.n, log.id, log.ts, log.action, log.token, run.toks,
                     list_filter(run.toks, lambda x: x.t = log.token AND x.k = CASE WHEN log.action = 'RESET_CONSUME' THEN 'RESET' ELSE 'SESSION' END
                       AND NOT coalesce(least(x.e, x.c, x.r) < log.ts - INTERVAL 30 DAY, false))[1] AS f,
                     list_transform(list_filter(run.toks, lambda x: x.k = 'SESSION' AND x.c IS NULL AND x.r IS NULL AND x.e > log.ts), lambda x: x.t) AS live
              FROM run JOIN log ON run.user_id = log.user_id AND log.n = run.n + 1)))
SELECT user_id, id, ts, action, outcome, revoked FROM run WHERE n > 0"""


@query(TOKEN_SQL)
def token_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of each use of a session or reset token: the log as a stream of four files through keyed state."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    log = spark.sql(log_sql("last_value({0}, true)").replace("FROM events", "FROM {events}"), events=events)
    buckets = max(32, -(-events.count() // BUCKET_ROWS))
    out = run.drained(state.token_outcomes(by_time(log.withColumnRenamed("ts", "at"), "token-log", 4), buckets=buckets), "token-outcomes")
    return out.withColumnRenamed("at", "ts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


COUNTED = "CASE WHEN event_type = 'error' THEN 'RESET' WHEN event_id % 211 = 0 THEN 'RESET_ALL' ELSE 'INCREMENT' END"


@query(f"""
WITH e AS (SELECT user_id, ts, {COUNTED} AS kind FROM events), a AS (SELECT max(ts) AS t FROM e WHERE kind = 'RESET_ALL'), u AS (SELECT user_id, max(ts) FILTER (kind = 'RESET') AS t FROM e GROUP BY 1)
SELECT e.user_id, count(*) FILTER (kind = 'INCREMENT' AND ts > coalesce(greatest(u.t, a.t), TIMESTAMP '1900-01-01')) AS count
FROM e JOIN u ON e.user_id = u.user_id CROSS JOIN a GROUP BY 1 HAVING count(*) FILTER (kind <> 'RESET_ALL') > 0""")
def counter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's uploads since the last reset, own or of all: three files through keyed state."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.expr(f"CASE WHEN {COUNTED} <> 'RESET_ALL' THEN user_id END").alias("user_id"), F.expr(COUNTED).alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    changes = run.drained(state.counter_changes(by_time(rows, "counter-log", 3), buckets=16), "counter-changes")
    return state.latest_counts(changes)


#: Until when the entries of each batch of the re-scan go, and the patterns of the ledger up to a date.
BATCH_ENDS = ("2000-06-30", "2001-01-31", "2001-06-30")


def _patterns_until(end: str) -> str:
    return f"(WITH entries AS (SELECT * FROM ledger), ledger AS (SELECT * FROM entries WHERE date <= DATE '{end}'){PATTERNS} SELECT * EXCLUDE (label, yearly, nominal) FROM p)"


def _merged(before: str, found: str) -> str:
    """SQL of the patterns of `before` (with dismissed, confirmed) after those of `found` came."""
    values = ", ".join(f"CASE WHEN n.user_id IS NOT NULL AND NOT coalesce(o.dismissed, false) THEN n.{c} ELSE o.{c} END AS {c}" for c in ("merchant", "amount", "last_seen", "next_expected", "payments", "confidence", "cancellable"))
    return f"""SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.key, n.key) AS key, coalesce(o.period, n.period) AS period, {values}, coalesce(o.dismissed, false) AS dismissed, coalesce(o.confirmed, false) AS confirmed
  FROM {before} o FULL JOIN {found} n ON o.user_id = n.user_id AND o.key = n.key AND o.period = n.period WHERE n.user_id IS NOT NULL OR coalesce(o.dismissed, false) OR coalesce(o.confirmed, false)"""


@query(f"""
, p1 AS {_patterns_until(BATCH_ENDS[0])}, p2 AS {_patterns_until(BATCH_ENDS[1])}, p3 AS {_patterns_until(BATCH_ENDS[2])},
m1 AS (SELECT *, (user_id + ascii(right(key, 1))) % 3 = 0 AS dismissed, (user_id + ascii(right(key, 1))) % 3 = 1 AS confirmed FROM p1),
m2 AS ({_merged("m1", "p2")}), m3 AS ({_merged("m2", "p3")})
SELECT * FROM m3""")
def rescan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring patterns after three batches of entries, of which users dismissed and confirmed some after the first."""
    ledger = test_ledger(spark, sf_dir)
    source, path, checkpoint = (run.place(spark, f"rescan-{x}") for x in ("source", "state", "checkpoint"))
    detect = lambda rows: recurring.detect(rows, AS_OF, key="merchant", name="")
    schema = rescan.pattern_schema(detect(ledger))
    for number, (start, end) in enumerate(zip(("0001-01-01", *BATCH_ENDS), BATCH_ENDS, strict=False)):
        ledger.where((F.col("date") > F.lit(start).cast("date")) & (F.col("date") <= F.lit(end).cast("date"))).write.parquet(f"{source}/part{number}")
        stream = spark.readStream.schema(ledger.schema).option("recursiveFileLookup", True).parquet(source)
        rescan.rescan(stream, detect, path, checkpoint)  # each time goes on from the checkpoint
        if number == 0:
            n = F.col("user_id") + F.ascii(F.substring("key", -1, 1))
            said = rescan.state(spark, path, schema).read().select("user_id", "key", "period", F.lit(1).alias("at"), F.when(n % 3 == 0, "dismiss").when(n % 3 == 1, "confirm").alias("action"))
            rescan.act(spark, said.where("action IS NOT NULL"), schema, path, "users")
    return rescan.state(spark, path, schema).read()


#: Entries of a statement file that is made of the ledger.
FILE_ROWS = 4000


def statement_files(ledger: DataFrame, path: str) -> None:
    """The ledger as CSV statements, a folder for each user, files of about FILE_ROWS entries."""
    spark = ledger.sparkSession
    rows = ledger.select("user_id", "date", "description", "merchant", "type", "amount", F.col("id").alias("reference"))
    rows = run.stored(rows, "statement-rows")
    per_user = F.pmod(F.xxhash64("reference"), F.lit(max(1, rows.count() // (25 * FILE_ROWS))))
    shared = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.withColumn("user", F.col("user_id")).drop("user_id").withColumn("part", per_user).repartition(shared, "user", "part").write.partitionBy("user", "part").option("header", True).csv(path)


@query("""
SELECT user_id, date AS day, sum(amount) FILTER (type = 'DEBIT')::DECIMAL(29,4) AS spend, sum(amount) FILTER (type = 'CREDIT')::DECIMAL(29,4) AS income, count(*) AS entries
FROM ledger GROUP BY user_id, date""")
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of statement files that stream in, two batches and a restart; sums over categories."""
    source, path, checkpoint = (run.place(spark, f"ingest-{x}") for x in ("files", "ledger", "checkpoint"))
    ledger = run.stored(test_ledger(spark, sf_dir), "ingest-rows")
    user = F.regexp_extract("file", r"user=(\d+)", 1)
    for part, where in enumerate(("date <= DATE '2000-12-31'", "date > DATE '2000-12-31'")):
        statement_files(ledger.where(where), f"{source}/part{part}")
        ingest.ingest(ingest.arriving(spark, source), path, checkpoint, user)
    days = ingest.sums(spark, path).groupBy("user_id", "day")
    money = [F.when(F.sum(c) != 0, F.sum(c)).cast("decimal(29,4)").alias(c) for c in ("spend", "income")]
    return days.agg(*money, F.sum("entries").alias("entries"))


@query("""
SELECT user_id, count(*) AS records, count(*) AS imported, min(date) AS first, max(date) AS last, sum(amount)::DECIMAL(29,4) AS total,
       sum(amount) FILTER (type = 'DEBIT')::DECIMAL(29,4) AS debits FROM ledger GROUP BY user_id""")
def statement_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import of statement files in byte ranges finds: records, sums and dates of each user."""
    path = run.place(spark, "import-files")
    statement_files(test_ledger(spark, sf_dir), path)
    raw = large_csv.read_large_statements(spark, path, range_bytes=1 << 20)
    parsed = statements.parse_statements(raw, lambda rows: run.stored(rows, "import-cells")).withColumn("user_id", F.regexp_extract("file", r"user=(\d+)", 1).try_cast("long"))
    good = F.col("error").isNull()
    money = lambda c: F.sum(F.when(c, F.col("amount"))).cast("decimal(29,4)")
    return parsed.groupBy("user_id").agg(
        F.count("*").alias("records"), F.count(F.when(good, 1)).alias("imported"), F.min("date").alias("first"), F.max("date").alias("last"),
        money(good).alias("total"), money(good & F.col("is_debit")).alias("debits"),
    )


@query(f"""
SELECT user_id, strftime(date, '%Y-%m-%d') AS date, description, merchant, category, type, amount::VARCHAR AS amount, 'INR' AS currency, 'CSV' AS source, 'false' AS reviewed
FROM ledger WHERE date >= DATE '{BATCH_ENDS[1]}'""")
def export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of an export, read back."""
    path = run.place(spark, "export")
    export.write_export(test_ledger(spark, sf_dir).where(F.col("date") >= F.lit(BATCH_ENDS[1]).cast("date")), path)
    user = F.regexp_extract("file", r"user_id=(\d+)", 1).cast("long").alias("user_id")
    return export.read_export(spark, path).select(user, "date", "description", "merchant", "category", "type", "amount", "currency", "source", "reviewed")


@query("""
SELECT * EXCLUDE (n), (n - 25)::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, id DESC) AS n FROM ledger) WHERE n BETWEEN 26 AND 50""")
def list_after_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of every user, from the last entry of the first."""
    ledger = test_ledger(spark, sf_dir)
    first = run.stored(records.pages_after(ledger, None).where("place = 25").select("user_id", "date", "id"), "page-keys")
    return records.pages_after(ledger, first)


@query("""
SELECT event_id::VARCHAR AS event_id, user_id, event_type AS action, ts::DATE AS day, '{"value":"' || (event_id % 7)::VARCHAR || '"}' AS metadata FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0""")
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit log to which overlapping batches were appended, one of them twice."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(
        "event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", F.col("event_type").alias("action"), F.lit("Event").alias("kind"), F.col("event_id").cast("string").alias("key"),
        F.create_map(F.lit("value"), (F.col("event_id") % 7).cast("string")).alias("metadata"),
    )
    path = run.place(spark, "audit")
    for where in ("event_id % 2 = 0", "event_id % 3 = 0", "event_id % 2 = 0"):
        records.audit(rows.where(where), path)
    return records.audit_log(spark, path).select("event_id", "user_id", "action", "day", "metadata")
