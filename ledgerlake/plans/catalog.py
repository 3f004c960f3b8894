"""Every query over the test tables by name, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import CATEGORIES
from ..operators import behavior, leaks, overview, recurring
from ..sources.ledger import LEDGER_SQL, test_ledger

AS_OF, START, END = date(2001, 6, 30), date(2001, 6, 1), date(2001, 6, 30)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") or "ledger" not in sql else f"WITH {LEDGER_SQL}{sql}"
        return f

    return add


#: Order of a category in ties, in SQL.
ORDER = f"list_position({list(CATEGORIES)}, category)"
JUNE = "date BETWEEN DATE '2001-06-01' AND DATE '2001-06-30'"
ROUND1 = "floor(({0}) * 10 + 0.5) / 10"


def div(total: str, by: str, scale: int = 2) -> str:
    """Decimal total / by rounded half up once, as functions.numbers.quotient."""
    return f"CAST(sign({total}) * floor((abs(CAST({total} AS DECIMAL(38,8))) * {10**scale} * 2 / 1 + ({by})) // (2 * ({by}))) AS DECIMAL(38,8)) / {10**scale}"


@query(f"SELECT * FROM ledger WHERE {JUNE} AND type = 'DEBIT' AND category = 'GROCERIES'")
def scan_ledger_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.between(test_ledger(spark, sf_dir), START, END, type="DEBIT", category="GROCERIES")


@query(f"""
SELECT user_id, coalesce(sum(amount) FILTER (type = 'CREDIT'), 0)::DECIMAL(29,4) AS income, coalesce(sum(amount) FILTER (type = 'DEBIT'), 0)::DECIMAL(29,4) AS spend,
       count(*) AS entries, (coalesce(sum(amount) FILTER (type = 'CREDIT'), 0) - coalesce(sum(amount) FILTER (type = 'DEBIT'), 0))::DECIMAL(29,4) AS net
FROM ledger WHERE {JUNE} GROUP BY user_id""")
def sum_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.totals(test_ledger(spark, sf_dir), START, END)


@query("SELECT user_id, min(date) AS first, max(date) AS last, count(*) AS entries, count(DISTINCT date_trunc('month', date)) AS months FROM ledger GROUP BY user_id")
def date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.bounds(test_ledger(spark, sf_dir))


@query("SELECT DISTINCT user_id, strftime(date, '%Y-%m') AS month FROM ledger")
def active_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.active_months(test_ledger(spark, sf_dir))


@query(f"SELECT user_id, category, sum(amount)::DECIMAL(29,4) AS total, count(*) AS entries FROM ledger WHERE {JUNE} AND type = 'DEBIT' GROUP BY ALL")
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.by_category(test_ledger(spark, sf_dir), START, END)


@query("""
SELECT user_id, category, sum(amount)::DECIMAL(29,4) AS total, count(*) AS entries,
       floor(sum(amount)::DOUBLE / (sum(sum(amount)) OVER (PARTITION BY user_id))::DOUBLE * 100 * 10 + 0.5) / 10 AS share
FROM ledger WHERE type = 'DEBIT' GROUP BY user_id, category""")
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.category_share(test_ledger(spark, sf_dir), None, None)


@query("SELECT user_id, category, sum(amount)::DECIMAL(29,4) AS total, count(*) AS entries FROM ledger WHERE type = 'DEBIT' GROUP BY ROLLUP (user_id, category)")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.category_rollup(test_ledger(spark, sf_dir), None, None)


@query("""
SELECT user_id, rank, merchant, total, entries FROM (
  SELECT user_id, merchant, sum(amount)::DECIMAL(29,4) AS total, count(*) AS entries, row_number() OVER (PARTITION BY user_id ORDER BY sum(amount) DESC, merchant)::INT AS rank
  FROM ledger WHERE type = 'DEBIT' AND merchant <> '' GROUP BY user_id, merchant) WHERE rank <= 8""")
def top_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.top_merchants(test_ledger(spark, sf_dir), None, None)


MONTHLY = """
SELECT user_id, date_trunc('month', date)::DATE AS month, coalesce(sum(amount) FILTER (type = 'DEBIT'), 0)::DECIMAL(29,4) AS spend,
       coalesce(sum(amount) FILTER (type = 'CREDIT'), 0)::DECIMAL(29,4) AS income FROM ledger
"""


@query(f"{MONTHLY} GROUP BY 1, 2")
def monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.monthly(test_ledger(spark, sf_dir), None, None)


TREND = f"""
, m AS ({MONTHLY} WHERE date BETWEEN DATE '2000-07-01' AND DATE '2001-06-30' GROUP BY 1, 2),
c AS (SELECT user_id, month FROM (SELECT DISTINCT user_id FROM m), (SELECT unnest(generate_series(DATE '2000-07-01', DATE '2001-06-01', INTERVAL 1 MONTH))::DATE AS month)),
t AS (SELECT user_id, month, coalesce(spend, 0)::DECIMAL(29,4) AS spend, coalesce(income, 0)::DECIMAL(29,4) AS income,
             (coalesce(income, 0) - coalesce(spend, 0))::DECIMAL(29,4) AS net FROM c LEFT JOIN m USING (user_id, month))
"""


@query(f"{TREND} SELECT * FROM t")
def monthly_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.trend(test_ledger(spark, sf_dir), date(2000, 7, 1), END)


@query(f"""{TREND},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month DESC) AS n FROM t),
a AS (SELECT user_id, {div("sum(spend)", "count(*)")} AS spend, {div("sum(income)", "count(*)")} AS income FROM r WHERE n <= 3 GROUP BY user_id)
SELECT user_id, month, spend::DECIMAL(19,2) AS spend, income::DECIMAL(19,2) AS income, (income - spend)::DECIMAL(19,2) AS net
FROM a, (VALUES (DATE '2001-07-01'), (DATE '2001-08-01'), (DATE '2001-09-01')) AS v(month)""")
def trend_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.forecast(overview.trend(test_ledger(spark, sf_dir), date(2000, 7, 1), END), AS_OF)


@query(f"""
, h AS (SELECT user_id, category, {div("sum(amount)", "3")} AS average FROM ledger WHERE type = 'DEBIT' AND date BETWEEN DATE '2001-03-01' AND DATE '2001-05-31' GROUP BY 1, 2),
n AS (SELECT user_id, category, sum(amount) AS current FROM ledger WHERE type = 'DEBIT' AND {JUNE} GROUP BY 1, 2),
r AS (SELECT *, current::DOUBLE / average::DOUBLE AS ratio FROM n JOIN h USING (user_id, category) WHERE average <> 0 AND current >= 200),
s AS (SELECT *, {ROUND1.format("(ratio - 1) * 100")} AS change FROM r WHERE ratio >= 1.3),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY change DESC, category)::INT AS rank FROM s)
SELECT user_id, rank, category, current::DECIMAL(29,4) AS current, average::DECIMAL(19,2) AS average, change, CASE WHEN ratio >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM k WHERE rank <= 3""")
def spend_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.spend_alerts(test_ledger(spark, sf_dir), START, END, AS_OF)


@query(f"""
, p AS (SELECT user_id, coalesce(sum(amount) FILTER (date >= DATE '2001-06-01'), 0)::DECIMAL(29,4) AS spend,
               coalesce(sum(amount) FILTER (date < DATE '2001-06-01'), 0)::DECIMAL(29,4) AS prior_spend
        FROM ledger WHERE type = 'DEBIT' AND date BETWEEN DATE '2001-05-02' AND DATE '2001-06-30' GROUP BY user_id)
SELECT *, CASE WHEN prior_spend > 0 THEN {ROUND1.format("(spend - prior_spend)::DOUBLE / prior_spend::DOUBLE * 100")} ELSE 0 END AS change FROM p""")
def prior_window_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.prior_window(test_ledger(spark, sf_dir), START, END)


# recurring payments; the merchants of the test tables are their own keys

GAPS = """
, y AS (SELECT *, merchant AS key, date - lag(date) OVER (PARTITION BY user_id, merchant ORDER BY date) AS gap
        FROM ledger WHERE type = 'DEBIT' AND date BETWEEN DATE '1999-06-30' AND DATE '2001-06-30' AND trim(merchant) <> '')
"""


@query(f"{GAPS} SELECT user_id, key, date, gap::INT AS gap, count(*) AS entries FROM y GROUP BY ALL")
def payment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recurring.payments(test_ledger(spark, sf_dir), AS_OF, key="merchant")
    return rows.groupBy("user_id", "key", "date", "gap").agg(F.count("*").alias("entries"))


PATTERNS = f"""{GAPS},
k AS (SELECT user_id, key, category, row_number() OVER (PARTITION BY user_id, key ORDER BY count(*) DESC, {ORDER}) AS n FROM y GROUP BY user_id, key, category),
s AS (SELECT user_id, key, count(*) AS payments, list_sort(list(gap) FILTER (gap > 0)) AS gaps, sum(amount) AS total, sum(amount)::DOUBLE / count(*) AS mean,
             min(amount)::DOUBLE AS low, max(amount)::DOUBLE AS high, max(date) AS last_seen FROM y GROUP BY user_id, key),
z AS (SELECT *, gaps[len(gaps) // 2 + 1] AS mid FROM s WHERE payments >= 2 AND len(gaps) > 0),
d AS (SELECT * FROM z JOIN (VALUES ('WEEKLY', 'Weekly', 5, 10, 7, 52), ('BIWEEKLY', 'Every 2 weeks', 11, 18, 14, 26), ('MONTHLY', 'Monthly', 25, 40, 30, 12),
       ('QUARTERLY', 'Quarterly', 80, 105, 91, 4), ('ANNUAL', 'Annual', 340, 395, 365, 1)) AS v(period, label, lo, hi, nominal, yearly) ON mid BETWEEN lo AND hi),
f AS (SELECT d.*, k.category, least(payments, 6) / 6.0::DOUBLE * 0.35::DOUBLE
        + list_sum(list_transform(gaps, lambda g: CASE WHEN g BETWEEN lo AND hi THEN 2 WHEN g <= hi * 2 THEN 1 ELSE 0 END))::DOUBLE / 2.0::DOUBLE / len(gaps) * 0.35::DOUBLE
        + CASE WHEN mean > 0 THEN greatest(0.0::DOUBLE, 1 - (high - low) / mean) ELSE 0 END * 0.15::DOUBLE
        + CASE WHEN k.category IN ('SUBSCRIPTIONS', 'UTILITIES', 'FINANCE', 'ENTERTAINMENT', 'EDUCATION', 'HEALTHCARE') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 0.15::DOUBLE AS sure
      FROM d JOIN k ON d.user_id = k.user_id AND d.key = k.key AND k.n = 1),
p AS (SELECT user_id, key, key AS merchant, period, ({div("total", "payments", 4)})::DECIMAL(19,4) AS amount, last_seen, last_seen + nominal AS next_expected, payments,
             round(sure, 3)::DECIMAL(4,3) AS confidence, category IN ('SUBSCRIPTIONS', 'ENTERTAINMENT', 'EDUCATION') AS cancellable, label, yearly, nominal
      FROM f WHERE sure >= 0.30)
"""


def test_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring.detect(test_ledger(spark, sf_dir), AS_OF, key="merchant", name="")


@query(f"{PATTERNS} SELECT * EXCLUDE (label, yearly, nominal) FROM p")
def recurring_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_patterns(spark, sf_dir)


@query(f"""{PATTERNS}, a AS (SELECT *, round(amount * yearly, 2)::DECIMAL(19,2) AS annual, (next_expected - DATE '2001-06-30')::INT AS days_left FROM p)
SELECT * EXCLUDE (yearly, nominal), CASE WHEN days_left < -nominal THEN 'MISSED' WHEN days_left < 0 THEN 'OVERDUE' WHEN days_left <= 7 THEN 'DUE_SOON' ELSE 'ACTIVE' END AS status,
       CASE WHEN confidence >= 0.7 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'POSSIBLE' END AS confidence_tier,
       ({div("annual", "12")})::DECIMAL(19,2) AS monthly FROM a""")
def recurring_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring.view(test_patterns(spark, sf_dir), AS_OF)


@query(f"""{PATTERNS},
o AS (SELECT user_id, key, key AS merchant, period, 100::DECIMAL(19,4) AS amount, DATE '2001-01-01' AS last_seen, DATE '2001-02-01' AS next_expected, 3::BIGINT AS payments,
             0.5::DECIMAL(4,3) AS confidence, false AS cancellable, n % 3 = 0 AS dismissed, n % 3 = 1 AS confirmed
      FROM (SELECT user_id, key, 'QUARTERLY' AS period, user_id + ascii(right(key, 1)) AS n FROM (SELECT DISTINCT user_id, key FROM y)))
SELECT coalesce(o.user_id, p.user_id) AS user_id, coalesce(o.key, p.key) AS key, coalesce(o.period, p.period) AS period,
       CASE WHEN w THEN p.merchant ELSE o.merchant END AS merchant, CASE WHEN w THEN p.amount ELSE o.amount END AS amount,
       CASE WHEN w THEN p.last_seen ELSE o.last_seen END AS last_seen, CASE WHEN w THEN p.next_expected ELSE o.next_expected END AS next_expected,
       CASE WHEN w THEN p.payments ELSE o.payments END AS payments, CASE WHEN w THEN p.confidence ELSE o.confidence END AS confidence,
       CASE WHEN w THEN p.cancellable ELSE o.cancellable END AS cancellable, coalesce(dismissed, false) AS dismissed, coalesce(confirmed, false) AS confirmed
FROM o FULL JOIN p ON o.user_id = p.user_id AND o.key = p.key AND o.period = p.period, LATERAL (SELECT p.user_id IS NOT NULL AND NOT coalesce(dismissed, false) AS w)
WHERE p.user_id IS NOT NULL OR coalesce(dismissed, false) OR coalesce(confirmed, false)""")
def recurring_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = test_ledger(spark, sf_dir)
    seen = recurring.payments(ledger, AS_OF, key="merchant").select("user_id", "key").distinct()
    seen = seen.withColumn("n", F.col("user_id") + F.ascii(F.substring("key", -1, 1)))  # a stand-in for stored patterns
    stored = seen.select(
        "user_id", "key", F.lit("QUARTERLY").alias("period"), F.col("key").alias("merchant"), F.lit(100).cast("decimal(19,4)").alias("amount"),
        F.lit(date(2001, 1, 1)).alias("last_seen"), F.lit(date(2001, 2, 1)).alias("next_expected"), F.lit(3).cast("long").alias("payments"),
        F.lit(0.5).cast("decimal(4,3)").alias("confidence"), F.lit(False).alias("cancellable"), (F.col("n") % 3 == 0).alias("dismissed"), (F.col("n") % 3 == 1).alias("confirmed"),
    )
    return recurring.merge(stored, recurring.detect(ledger, AS_OF, key="merchant", name=""))


# leaks; a word of the test tables stands for a fee

SEVERITY = "CASE WHEN {0} >= 2000 THEN 'HIGH' WHEN {0} >= 500 THEN 'MEDIUM' ELSE 'LOW' END"
RECENT = ", e AS (SELECT * FROM ledger WHERE type = 'DEBIT' AND date BETWEEN DATE '2001-03-30' AND DATE '2001-06-30')"
TEST_FEES = r"(?i)\b(red|late\s+fee)\b"
LEAKS = f"""{PATTERNS}{RECENT},
lc AS (SELECT user_id, merchant, category, row_number() OVER (PARTITION BY user_id, merchant ORDER BY date DESC, id DESC, category DESC) AS n FROM e),
du AS (SELECT p.user_id, lc.category, count(*) AS n, min(({div("amount * yearly", "12")})::DECIMAL(19,2)) AS each FROM p JOIN lc ON p.user_id = lc.user_id AND p.merchant = lc.merchant AND lc.n = 1
       WHERE lc.category IN ('SUBSCRIPTIONS', 'ENTERTAINMENT', 'EDUCATION') GROUP BY 1, 2 HAVING count(*) >= 2),
dx AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, {ORDER}) AS r FROM du),
cr AS (SELECT e.*, p.key, p.period, p.yearly, count(*) OVER (PARTITION BY e.user_id, e.merchant, p.key, p.period) AS n,
              row_number() OVER (PARTITION BY e.user_id, e.merchant, p.key, p.period ORDER BY date DESC, id DESC, e.amount DESC) AS r
       FROM e JOIN p ON e.user_id = p.user_id AND e.merchant = p.merchant),
ci AS (SELECT user_id, merchant, key, period, yearly, sum(amount) FILTER (r > 2)::DOUBLE / count(*) FILTER (r > 2) AS earlier, sum(amount) FILTER (r <= 2)::DOUBLE / count(*) FILTER (r <= 2) AS latest
       FROM cr WHERE n >= 4 GROUP BY ALL),
cc AS (SELECT *, ({div("round(latest - earlier, 2)::DECIMAL(19,2) * yearly", "12")})::DECIMAL(19,2) AS monthly FROM ci WHERE earlier > 0 AND latest / earlier >= 1.10),
dr AS (SELECT user_id, merchant, count(*) AS visits, ({div("sum(amount)", "3")})::DECIMAL(19,2) AS monthly, ({div("sum(amount)", "count(*)")})::DECIMAL(19,2) AS mean
       FROM e WHERE amount <= 500 GROUP BY 1, 2 HAVING count(*) >= 8),
fe AS (SELECT user_id, merchant, count(*) AS charges, sum(amount)::DECIMAL(29,4) AS total FROM e WHERE regexp_matches(description || ' ' || merchant, '(?i)\\b(red|late\\s+fee)\\b') GROUP BY 1, 2),
al AS (SELECT user_id, 'DUPLICATE_SUBSCRIPTIONS' AS kind, each AS monthly, n AS items, 1 AS o FROM dx WHERE r = 1
       UNION ALL SELECT user_id, 'SUBSCRIPTION_CREEP', sum(monthly), count(*), 2 FROM cc GROUP BY user_id
       UNION ALL SELECT user_id, 'HIGH_FREQUENCY_SMALL_SPEND', sum(monthly), count(*), 3 FROM dr WHERE monthly >= 1500 GROUP BY user_id
       UNION ALL SELECT user_id, 'BANK_FEES', ({div("sum(total)", "3")})::DECIMAL(19,2), count(*), 4 FROM fe GROUP BY user_id),
lk AS (SELECT user_id, kind, monthly::DECIMAL(19,2) AS monthly, (monthly * 12)::DECIMAL(19,2) AS annual, items, {SEVERITY.format("monthly")} AS severity,
              row_number() OVER (PARTITION BY user_id ORDER BY monthly DESC NULLS LAST, o)::INT AS rank FROM al)
"""


def test_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.detect(test_ledger(spark, sf_dir), test_patterns(spark, sf_dir), AS_OF, fees=TEST_FEES)


@query(f"{LEAKS} SELECT user_id, merchant, key, period, earlier, latest, monthly FROM cc")
def leak_creep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.creep_items(test_patterns(spark, sf_dir), leaks.recent(test_ledger(spark, sf_dir), AS_OF))


@query(f"{LEAKS} SELECT * FROM fe")
def leak_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.fee_items(leaks.recent(test_ledger(spark, sf_dir), AS_OF), TEST_FEES)


EVENTS = "(SELECT event_id AS id, user_id % 15 AS user_id, (value * 60)::DECIMAL(19,4) AS amount, ts::DATE AS date, event_type AS merchant FROM events)"


@query(f"""
SELECT user_id, merchant, count(*) AS visits, ({div("sum(amount)", "3")})::DECIMAL(19,2) AS monthly, ({div("sum(amount)", "count(*)")})::DECIMAL(19,2) AS mean
FROM {EVENTS} WHERE amount <= 500 GROUP BY 1, 2 HAVING count(*) >= 8 AND {div("sum(amount)", "3")} >= 1500""")
def leak_drains(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("event_id").alias("id"), (F.col("user_id") % 15).alias("user_id"), (F.col("value") * 60).cast("decimal(19,4)").alias("amount"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("merchant"))
    return leaks.drain_items(rows)


@query(f"{LEAKS} SELECT * FROM lk")
def leak_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_leaks(spark, sf_dir)


@query(f"{LEAKS} SELECT user_id, sum(monthly)::DECIMAL(19,2) AS monthly, count(*) AS findings, (sum(monthly) * 12)::DECIMAL(19,2) AS annual FROM lk GROUP BY user_id")
def leak_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.summary(test_leaks(spark, sf_dir))


MEASURES = f"""
, b AS (SELECT *, isodow(date) >= 6 AS we, date > DATE '2001-03-30' AS late FROM ledger WHERE type = 'DEBIT' AND date BETWEEN DATE '2000-12-30' AND DATE '2001-06-30'),
o AS (SELECT user_id, sum(amount) FILTER (we)::DOUBLE AS w, count(DISTINCT date) FILTER (we) AS wn, sum(amount) FILTER (NOT we)::DOUBLE AS d, count(DISTINCT date) FILTER (NOT we) AS dn,
             sum(amount) FILTER (late)::DOUBLE AS l, count(*) FILTER (late) AS ln, sum(amount) FILTER (NOT late)::DOUBLE AS e, count(*) FILTER (NOT late) AS en FROM b GROUP BY user_id),
c AS (SELECT user_id, category, sum(amount) AS t, row_number() OVER (PARTITION BY user_id ORDER BY sum(amount) DESC, {ORDER}) AS n,
             (sum(sum(amount)) OVER (PARTITION BY user_id))::DOUBLE AS every FROM b GROUP BY user_id, category),
m AS (SELECT o.user_id, CASE WHEN wn > 0 AND dn > 0 THEN (w / wn) / (d / dn) END AS weekend, CASE WHEN e <> 0 THEN coalesce(l, 0) / e END AS inflation,
             t::DOUBLE / every * 100 AS concentration, c.category AS top_category, CASE WHEN en >= 5 THEN ln::DOUBLE / en END AS frequency,
             CASE WHEN ln >= 5 AND en >= 5 THEN (l / ln) / (e / en) END AS tickets FROM o LEFT JOIN c ON o.user_id = c.user_id AND c.n = 1)
"""


@query(f"{MEASURES} SELECT * FROM m")
def behavior_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.measures(test_ledger(spark, sf_dir), AS_OF)


SIGNALS = f"""{MEASURES},
a AS (SELECT user_id, 'WEEKEND_OVERSPEND' AS kind, weekend AS value, 1.4 AS lo, 1.7 AS mid, 2.0 AS hi, 0 AS place FROM m
      UNION ALL SELECT user_id, 'LIFESTYLE_INFLATION', inflation, 1.15, 1.25, 1.4, 1 FROM m
      UNION ALL SELECT user_id, 'CATEGORY_CONCENTRATION', concentration, 40, 50, 60, 2 FROM m
      UNION ALL SELECT user_id, 'INCREASING_FREQUENCY', frequency, 1.2, 1.3, 1.5, 3 FROM m
      UNION ALL SELECT user_id, 'LARGE_TICKETS', tickets, 1.2, 1.35, 1.5, 4 FROM m),
g AS (SELECT user_id, kind, value, CASE WHEN value >= hi THEN 'HIGH' WHEN value >= mid THEN 'MEDIUM' ELSE 'LOW' END AS severity,
             row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value >= hi THEN 1 WHEN value >= mid THEN 2 ELSE 3 END, place)::INT AS rank FROM a WHERE value >= lo)
"""


@query(f"{SIGNALS} SELECT * FROM g")
def behavior_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.signals(behavior.measures(test_ledger(spark, sf_dir), AS_OF))


@query(f"{SIGNALS} SELECT m.user_id, coalesce(kind, 'STEADY') AS profile FROM m LEFT JOIN g ON m.user_id = g.user_id AND g.rank = 1")
def behavior_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.profile(behavior.measures(test_ledger(spark, sf_dir), AS_OF))


from . import more_queries, overview_queries, planning_queries, record_queries, rule_queries, stream_queries, text_queries  # noqa: E402, F401  they register themselves
