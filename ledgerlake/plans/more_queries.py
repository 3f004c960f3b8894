"""Queries of overviews, listings, counters, rows made by hand, effects of scenarios."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import PRESETS, preset
from ..operators import behavior, insights, overview, records
from ..sources.ledger import test_ledger
from . import simulation as S
from .catalog import AS_OF, END, LEAKS, SIGNALS, START, query, test_leaks
from .planning_queries import GOALS_SQL, SIMULATED, TIER, test_baseline, test_goals, test_scenarios


@query("""
, r AS (SELECT * FROM ledger WHERE date BETWEEN DATE '2001-06-01' AND DATE '2001-06-30'),
s AS (SELECT user_id, coalesce(sum(amount) FILTER (type = 'CREDIT'), 0)::DECIMAL(29,4) AS income, coalesce(sum(amount) FILTER (type = 'DEBIT'), 0)::DECIMAL(29,4) AS spend, count(*) AS entries FROM r GROUP BY user_id),
k AS (SELECT user_id, category, count(*) OVER (PARTITION BY user_id) AS categories, row_number() OVER (PARTITION BY user_id ORDER BY sum(amount) DESC, category) AS n FROM r WHERE type = 'DEBIT' GROUP BY user_id, category),
m AS (SELECT user_id, merchant, row_number() OVER (PARTITION BY user_id ORDER BY sum(amount) DESC, merchant) AS n FROM r WHERE type = 'DEBIT' GROUP BY user_id, merchant)
SELECT s.user_id, income, spend, (income - spend)::DECIMAL(29,4) AS net, entries, coalesce(categories, 0) AS categories, k.category AS top_category, m.merchant AS top_merchant
FROM s LEFT JOIN k ON s.user_id = k.user_id AND k.n = 1 LEFT JOIN m ON s.user_id = m.user_id AND m.n = 1""")
def overview_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts that the overview also counts have a query of their own."""
    return overview.summary(test_ledger(spark, sf_dir), START, END).drop("alerts")


ROWS = """SELECT user_id, key, amount, confirmed, {0} AS place FROM
(SELECT event_id AS key, user_id % 15 AS user_id, CASE WHEN event_id % 7 > 0 THEN value::DECIMAL(19,4) END AS amount, event_id % 3 = 0 AS confirmed FROM events)"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 7 > 0, F.col("value").cast("decimal(19,4)"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("key"), (F.col("user_id") % 15).alias("user_id"), value.alias("amount"), (F.col("event_id") % 3 == 0).alias("confirmed"))


@query(ROWS.format("row_number() OVER (PARTITION BY user_id ORDER BY confirmed DESC, amount DESC NULLS LAST, key)"))
def order_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.placed(listed(spark, sf_dir), "detected")


@query(ROWS.format("row_number() OVER (PARTITION BY user_id ORDER BY amount DESC NULLS FIRST, key)"))
def order_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.placed(listed(spark, sf_dir), "stored")


@query("""SELECT user_id, category, row_number() OVER (PARTITION BY user_id ORDER BY category NULLS FIRST) AS place
FROM (SELECT DISTINCT user_id % 15 AS user_id, CASE WHEN event_type <> 'click' THEN event_type END AS category FROM events)""")
def order_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") != "click", F.col("event_type"))
    return records.placed(spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 15).alias("user_id"), kind.alias("category")).distinct(), "budgets")


@query("SELECT event_id AS id, user_id, ts::DATE AS created_at, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC, event_id DESC) AS place FROM events")
def order_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("date").alias("created_at"))
    return records.placed(rows, "newest")


@query(f"""{LEAKS}{SIGNALS[SIGNALS.index(", b AS"):]},
us AS (SELECT user_id, 'LEAK' AS origin, kind, severity, rank FROM lk UNION ALL SELECT user_id, 'PATTERN', kind, severity, rank FROM g),
un AS (SELECT user_id, origin, kind, severity, row_number() OVER (PARTITION BY user_id ORDER BY CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, origin, rank, kind) AS place FROM us)
SELECT * FROM un WHERE place <= 5""")
def ui_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.ui_signals(test_leaks(spark, sf_dir), behavior.signals(behavior.measures(test_ledger(spark, sf_dir), AS_OF)))


@query("""SELECT user_id, count(*) FILTER (kind = 'INCREMENT' AND (reset IS NULL OR moment > reset)) AS count
FROM (SELECT user_id, ts AS moment, CASE WHEN event_id % 50 = 0 THEN 'RESET' ELSE 'INCREMENT' END AS kind, max(ts) FILTER (event_id % 50 = 0) OVER (PARTITION BY user_id) AS reset FROM events) GROUP BY user_id""")
def keyed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 50 == 0, "RESET").otherwise("INCREMENT")
    return records.counters(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").alias("at"), kind.alias("kind")))


@query("""SELECT user_id, quota, unlimited, used, CASE WHEN NOT unlimited THEN greatest(0, quota - used) END AS remaining, unlimited OR quota > used AS open
FROM (SELECT c_custkey AS user_id, c_custkey % 3 AS quota, c_custkey % 11 = 0 AS unlimited, coalesce(n, 0) AS used
      FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE date_trunc('month', o_orderdate) = DATE '1997-03-01' GROUP BY 1) ON c_custkey = o_custkey)""")
def quota_of_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 3).alias("quota"), (F.col("c_custkey") % 11 == 0).alias("unlimited"))
    used = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"))
    return records.quota(users, used, date(1997, 3, 15))


@query("""SELECT o_orderkey AS id, o_custkey AS user_id, abs(o_totalprice)::DECIMAL(19,4) AS amount, o_orderdate::DATE AS date, o_orderpriority AS description, o_orderstatus AS merchant,
'OTHER' AS category, 'CREDIT' AS type, 'MANUAL' AS source, true AS reviewed FROM orders""")
def manual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), (-F.col("o_totalprice")).alias("amount"), F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.lit("  "), "o_orderpriority").alias("description"), F.col("o_orderstatus").alias("merchant"), F.lit(None).cast("string").alias("category"), F.lit("credit").alias("type"),
    )
    return records.entered(rows)


@query("""SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice::DECIMAL(19,4) AS amount, o_orderdate::DATE AS date, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS description,
o_orderstatus AS merchant, 'TRAVEL' AS category, 'DEBIT' AS type, 'OCR' AS source, true AS reviewed FROM orders WHERE o_totalprice::DECIMAL(19,4) >= 0.01""")
def confirmed_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").cast("decimal(19,4)").alias("amount"), F.col("o_orderdate").cast("date").alias("date"),
        notes.alias("notes"), F.col("o_orderstatus").alias("merchant"), F.lit("TRAVEL").alias("category"),
    )
    return records.confirmed(rows)


@query(f"""{LEAKS}, {GOALS_SQL},
ng AS (SELECT user_id, goal_id, row_number() OVER (PARTITION BY user_id ORDER BY target_date NULLS LAST, goal_id) AS n FROM g WHERE state = 'ACTIVE')
SELECT lk.user_id, ng.goal_id, sum(monthly)::DECIMAL(19,2) AS monthly FROM lk JOIN ng ON lk.user_id = ng.user_id AND n = 1 GROUP BY 1, 2 HAVING sum(monthly) > 100""")
def goal_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.redirects(test_leaks(spark, sf_dir), test_goals(spark, sf_dir))


def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.simulate(test_baseline(spark, sf_dir), test_scenarios(spark, sf_dir))


@query(f"""{SIMULATED} SELECT user_id, kind, CASE WHEN new_score - score >= 3 THEN 'MORE_FREE' WHEN new_score - score <= -10 THEN 'MUCH_LESS_FREE' WHEN new_score - score <= -3 AND bound > 0 THEN 'MORE_BOUND'
WHEN new_score - score <= -3 THEN 'LESS_FREE' ELSE 'MARGINAL' END AS reason FROM x""")
def flexibility_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.explanation(simulated(spark, sf_dir))


GRADE = "CASE WHEN {0} < 10 THEN 'NEUTRAL' WHEN {0} < 25 THEN 'CAUTION' ELSE 'WARNING' END"


@query(f"""{SIMULATED},
xe AS (SELECT *, CASE WHEN discretionary > 0 THEN abs(impact)::DOUBLE / discretionary::DOUBLE * 100 ELSE 100 END AS falls, CASE WHEN recurring > 0 THEN bound::DOUBLE / recurring::DOUBLE * 100 ELSE 100 END AS grows FROM x)
SELECT user_id, kind, CASE WHEN kind <> 'ONE_TIME_PURCHASE' AND impact > 0 THEN 'SAVINGS_BOOST' ELSE 'CASH_FLOW' END AS code,
       CASE WHEN kind = 'ONE_TIME_PURCHASE' THEN 'CAUTION' WHEN impact > 0 THEN 'POSITIVE' ELSE {GRADE.format("falls")} END AS severity FROM xe
UNION ALL SELECT user_id, kind, 'RECURRING_LOAD', {GRADE.format("grows")} FROM xe WHERE bound <> 0
UNION ALL SELECT user_id, kind, 'CATEGORY_SHIFT', 'CAUTION' FROM xe WHERE top_category = 'GROCERIES' OR top_category IS NOT NULL AND CASE WHEN kind = 'ONE_TIME_PURCHASE' THEN round(amount::DOUBLE / 12, 2) ELSE amount END > top_spend
UNION ALL SELECT user_id, kind, 'OPPORTUNITY_COST', CASE WHEN new_score > score THEN 'POSITIVE' ELSE 'WARNING' END FROM xe WHERE {TIER.format("score")} <> new_tier""")
def scenario_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.effects(simulated(spark, sf_dir).withColumn("category", F.lit("GROCERIES")))
