"""Queries of pages, patches, quotas, references and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records, reports
from ..sources.ledger import test_ledger
from .catalog import AS_OF, END, LEAKS, ROUND1, START, div, query, test_leaks, test_patterns

D2 = "DECIMAL(19,2)"


@query("SELECT * FROM ledger ORDER BY date DESC, id DESC, amount DESC, merchant, user_id LIMIT 25 OFFSET 25")
def list_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.page(test_ledger(spark, sf_dir), number=1)


@query("""
, e AS (SELECT event_id AS id, user_id, event_type AS merchant, NULL::VARCHAR AS category, 0.5::DECIMAL(5,4) AS confidence FROM events)
SELECT id, user_id, CASE WHEN id % 5 = 0 THEN 'renamed' ELSE merchant END AS merchant, CASE WHEN id % 10 = 0 THEN 'TRAVEL' END AS category,
       CASE WHEN id % 10 = 0 THEN 1 ELSE confidence END::DECIMAL(5,4) AS confidence, id % 10 = 0 AS reviewed FROM e -- ledger""")
def patch_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("merchant"), F.lit(None).cast("string").alias("category"), F.lit(0.5).cast("decimal(5,4)").alias("confidence"))
    changes = events.where("event_id % 5 = 0").select(F.col("event_id").alias("id"), F.lit("renamed").alias("merchant"), F.when(F.col("event_id") % 10 == 0, "TRAVEL").alias("category"))
    return records.patch(rows, changes)


@query("""
SELECT user_id, quota, unlimited, used, CASE WHEN NOT unlimited THEN greatest(0, quota - used) END AS remaining, unlimited OR quota > used AS open
FROM (SELECT c_custkey AS user_id, c_custkey % 20 AS quota, c_custkey % 11 = 0 AS unlimited, coalesce(n, 0) AS used FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey)""")
def quota_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 20).alias("quota"), (F.col("c_custkey") % 11 == 0).alias("unlimited"))
    return records.quota(users, spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("user_id")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def reference_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return records.orphans(orders, spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "o_orderkey", "l_orderkey")


@query(f"""
, r AS (SELECT * FROM ledger WHERE date BETWEEN DATE '2001-06-01' AND DATE '2001-06-30'),
s AS (SELECT user_id, coalesce(sum(amount) FILTER (type = 'CREDIT'), 0)::DECIMAL(29,4) AS income, coalesce(sum(amount) FILTER (type = 'DEBIT'), 0)::DECIMAL(29,4) AS spend, count(*) AS entries FROM r GROUP BY user_id),
k AS (SELECT user_id, category, row_number() OVER (PARTITION BY user_id ORDER BY sum(amount) DESC, category) AS n FROM r WHERE type = 'DEBIT' GROUP BY user_id, category),
m AS (SELECT user_id, merchant, row_number() OVER (PARTITION BY user_id ORDER BY sum(amount) DESC, merchant) AS n FROM r WHERE type = 'DEBIT' GROUP BY user_id, merchant)
SELECT s.user_id, 'June 2001' AS label, income, spend, (income - spend)::DECIMAL(29,4) AS net, entries, k.category AS top_category, m.merchant AS top_merchant
FROM s LEFT JOIN k ON s.user_id = k.user_id AND k.n = 1 LEFT JOIN m ON s.user_id = m.user_id AND m.n = 1""")
def monthly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.monthly(test_ledger(spark, sf_dir), AS_OF)


REPORT = f"""{LEAKS},
r1 AS (SELECT user_id, coalesce(sum(amount) FILTER (type = 'CREDIT'), 0)::DECIMAL(29,4) AS income, coalesce(sum(amount) FILTER (type = 'DEBIT'), 0)::DECIMAL(29,4) AS spend, count(*) AS entries FROM ledger WHERE date BETWEEN DATE '2001-06-01' AND DATE '2001-06-30' GROUP BY user_id),
r2 AS (SELECT user_id, coalesce(sum(amount) FILTER (date >= DATE '2001-06-01'), 0)::DECIMAL(29,4) AS s, coalesce(sum(amount) FILTER (date < DATE '2001-06-01'), 0)::DECIMAL(29,4) AS prior_spend
       FROM ledger WHERE type = 'DEBIT' AND date BETWEEN DATE '2001-05-02' AND DATE '2001-06-30' GROUP BY user_id),
r3 AS (SELECT user_id, sum(({div("amount * yearly", "12")})::{D2}) AS recurring, count(*) AS patterns FROM p GROUP BY user_id),
r4 AS (SELECT user_id, sum(monthly) AS leak_monthly, count(*) AS leaks FROM lk GROUP BY user_id)
"""


@query(f"""{REPORT}
SELECT user_id, income, spend, (income - spend)::DECIMAL(29,4) AS net, entries, coalesce(prior_spend, 0)::DECIMAL(29,4) AS prior_spend,
       CASE WHEN prior_spend > 0 THEN {ROUND1.format("(s - prior_spend)::DOUBLE / prior_spend::DOUBLE * 100")} ELSE 0 END AS change, coalesce(recurring, 0)::{D2} AS recurring, coalesce(leak_monthly, 0)::{D2} AS leak_monthly,
       coalesce(patterns, 0) AS patterns, coalesce(leaks, 0) AS leaks FROM r1 LEFT JOIN r2 USING (user_id) LEFT JOIN r3 USING (user_id) LEFT JOIN r4 USING (user_id)""")
def report_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.data(test_ledger(spark, sf_dir), test_patterns(spark, sf_dir), test_leaks(spark, sf_dir), START, END)
