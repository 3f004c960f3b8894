"""Queries of baselines, scenarios, budgets, goals, tax and recommendations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import insights
from ..sources.ledger import test_ledger
from . import simulation as S
from .catalog import AS_OF, LEAKS, ORDER, PATTERNS, ROUND1, div, query, test_leaks, test_patterns

D2 = "DECIMAL(19,2)"
CLAMP = "greatest({1}, least(1.0::DOUBLE, {0}))"

BASELINE = f"""{PATTERNS},
w AS (SELECT * FROM ledger WHERE date BETWEEN DATE '2001-03-01' AND DATE '2001-06-30'),
b1 AS (SELECT user_id, ({div("coalesce(sum(amount) FILTER (type = 'CREDIT'), 0)", "3")})::{D2} AS income, ({div("coalesce(sum(amount) FILTER (type = 'DEBIT'), 0)", "3")})::{D2} AS spend FROM w GROUP BY user_id),
b2 AS (SELECT user_id, category, sum(amount) AS total, row_number() OVER (PARTITION BY user_id ORDER BY sum(amount) DESC, {ORDER}) AS n FROM w WHERE type = 'DEBIT' GROUP BY user_id, category),
b3 AS (SELECT user_id, sum(({div("amount * yearly", "12")})::{D2})::{D2} AS recurring FROM p GROUP BY user_id),
b4 AS (SELECT b1.user_id, income, spend, coalesce(recurring, 0)::{D2} AS recurring, b2.category AS top_category, coalesce({div("total", "3")}, 0)::{D2} AS top_spend
       FROM b1 LEFT JOIN b3 USING (user_id) LEFT JOIN b2 ON b1.user_id = b2.user_id AND b2.n = 1),
b AS (SELECT *, greatest(0, income - spend - greatest(recurring, 0))::{D2} AS discretionary, (income - spend)::{D2} AS net,
             CASE WHEN income > 0 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (income - spend)::DOUBLE / income::DOUBLE)) ELSE 0 END AS savings_rate FROM b4)
"""


def score(recurring: str, net: str, free: str) -> str:
    part = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"
    return (
        f"(CASE WHEN income > 0 THEN floor(({part(f'1 - (greatest({recurring}, 0)::DOUBLE / income::DOUBLE) / 0.5::DOUBLE')} * 0.35::DOUBLE"
        f" + {part(f'(({net})::DOUBLE / income::DOUBLE) / 0.3::DOUBLE')} * 0.35::DOUBLE + {part(f'(({free})::DOUBLE / income::DOUBLE) / 0.2::DOUBLE')} * 0.3::DOUBLE) * 100 + 0.5) ELSE 50 END)::INT"
    )


TIER = "CASE WHEN {0} >= 80 THEN 'EXCELLENT' WHEN {0} >= 65 THEN 'GOOD' WHEN {0} >= 50 THEN 'FAIR' WHEN {0} >= 35 THEN 'TIGHT' ELSE 'CONSTRAINED' END"


def test_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.baseline(test_ledger(spark, sf_dir), test_patterns(spark, sf_dir), AS_OF)


@query(f"{BASELINE} SELECT * FROM b")
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_baseline(spark, sf_dir)


@query(f"{BASELINE}, f2 AS (SELECT user_id, {score('recurring', 'net', 'discretionary')} AS score FROM b) SELECT *, {TIER.format('score')} AS tier FROM f2")
def flexibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = test_baseline(spark, sf_dir).select("user_id", S.flexibility(c("income"), c("recurring"), c("net"), c("discretionary")).alias("score"))
    return rows.withColumn("tier", S.flexibility_tier(c("score")))


SCENARIO_ROWS = (
    ("ONE_TIME_PURCHASE", 60000, None, None, None),
    ("RECURRING_EXPENSE", 2500, None, None, 6),
    ("SAVINGS_ADJUSTMENT", 1500, None, None, None),
    ("LOAN_EMI", 500000, 9.5, 60, None),
)


def test_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame(list(SCENARIO_ROWS), "kind string, amount int, rate double, tenure int, duration int").withColumn("amount", F.col("amount").cast("decimal(19,2)"))
    users = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("user_id"))
    return users.join(F.broadcast(kinds), F.lit(True))  # four fixed scenarios for each user


VALUES = ", ".join(f"('{k}', {a}::{D2}, {r or 'NULL'}::DOUBLE, {t or 'NULL'}::INT, {d or 'NULL'}::INT)" for k, a, r, t, d in SCENARIO_ROWS)
SIMULATED = f"""{BASELINE},
x0 AS (SELECT b.*, v.*, CASE WHEN kind = 'LOAN_EMI' THEN round(amount::DOUBLE * (rate / 100 / 12) * pow(1 + rate / 100 / 12, tenure) / (pow(1 + rate / 100 / 12, tenure) - 1), 2) ELSE 0 END::{D2} AS instalment
       FROM b, (VALUES {VALUES}) AS v(kind, amount, rate, tenure, duration)),
x1 AS (SELECT *, CASE kind WHEN 'ONE_TIME_PURCHASE' THEN 0 WHEN 'RECURRING_EXPENSE' THEN -amount WHEN 'SAVINGS_ADJUSTMENT' THEN amount ELSE -instalment END::{D2} AS impact,
              CASE kind WHEN 'RECURRING_EXPENSE' THEN amount WHEN 'LOAN_EMI' THEN instalment ELSE 0 END::{D2} AS bound FROM x0),
x2 AS (SELECT *, {score('recurring', 'net', 'discretionary')} AS score,
              {score('(recurring + bound)', 'net + impact', 'greatest(0, income - (spend + greatest(bound, 0)) - greatest(recurring + bound, 0))')} AS new_score FROM x1),
x AS (SELECT *, CASE WHEN score > 0 THEN {ROUND1.format('(new_score - score)::DOUBLE / score * 100')} ELSE 0 END AS score_change, {TIER.format('new_score')} AS new_tier,
             CASE WHEN kind = 'ONE_TIME_PURCHASE' THEN -amount ELSE impact * 12 END::{D2} AS year, CASE WHEN kind = 'ONE_TIME_PURCHASE' THEN -amount ELSE impact * 60 END::{D2} AS five_years,
             CASE WHEN kind = 'ONE_TIME_PURCHASE' THEN -amount ELSE impact * 120 END::{D2} AS ten_years,
             round(CASE WHEN kind = 'ONE_TIME_PURCHASE' THEN amount::DOUBLE * pow(1.08::DOUBLE, 10) ELSE abs(impact)::DOUBLE * ((pow(1 + 0.08::DOUBLE / 12, 120) - 1) / (0.08::DOUBLE / 12)) END, 2)::{D2} AS opportunity FROM x2)
"""


@query(f"{SIMULATED} SELECT user_id, kind, instalment, impact, year, five_years, ten_years, opportunity, score, new_score, score_change, new_tier FROM x")
def simulate_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.simulate(test_baseline(spark, sf_dir), test_scenarios(spark, sf_dir))
    return rows.select("user_id", "kind", "instalment", "impact", "year", "five_years", "ten_years", "opportunity", "score", "new_score", "score_change", "new_tier")


@query(f"""{SIMULATED},
j AS (SELECT x.*, month, CASE WHEN month <= coalesce(CASE WHEN kind = 'LOAN_EMI' THEN tenure ELSE duration END, 12) THEN impact ELSE 0 END
             - CASE WHEN kind = 'ONE_TIME_PURCHASE' AND month = 1 THEN amount ELSE 0 END AS step FROM x, (SELECT unnest(range(1, 13))::INT AS month))
SELECT user_id, kind, month, (net * month)::{D2} AS before, (sum(net + step) OVER (PARTITION BY user_id, kind ORDER BY month))::{D2} AS after FROM j""")
def projection_12m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.projection(S.simulate(test_baseline(spark, sf_dir), test_scenarios(spark, sf_dir)))


@query(f"""{PATTERNS},
q AS (SELECT *, ({div("amount * yearly", "12")})::{D2} AS monthly FROM p WHERE amount > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY monthly DESC, merchant, key, period)::INT AS rank FROM q)
SELECT user_id, rank, merchant, monthly, (monthly * 12)::{D2} AS year, (monthly * 60)::{D2} AS five_years, (monthly * 120)::{D2} AS ten_years,
       round(monthly::DOUBLE * ((pow(1 + 0.08::DOUBLE / 12, 120) - 1) / (0.08::DOUBLE / 12)), 2)::{D2} AS opportunity,
       CASE WHEN monthly >= 2000 THEN 'LARGE' WHEN monthly >= 500 THEN 'NOTABLE' WHEN monthly >= 100 THEN 'SMALL' ELSE 'MINOR' END AS weight FROM r WHERE rank <= 5""")
def consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.consequences(test_patterns(spark, sf_dir))


# budgets and goals that follow from the test tables

GOALS_SQL = """
g AS (SELECT c_custkey AS goal_id, c_nationkey::BIGINT AS user_id, (1000 + abs(c_acctbal) * 2)::DECIMAL(15,2) AS target, abs(c_acctbal)::DECIMAL(15,2) AS current,
             DATE '2001-01-01' AS start, (DATE '2001-05-01' + (c_custkey % 700)::INT)::DATE AS target_date, list_extract(['ACTIVE', 'COMPLETED', 'ABANDONED', 'ACTIVE', 'ACTIVE'], (c_custkey % 5 + 1)::INT) AS state
      FROM customer)
"""


def test_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        c("c_custkey").alias("goal_id"), c("c_nationkey").cast("long").alias("user_id"), (F.abs("c_acctbal") * 2 + 1000).cast("decimal(15,2)").alias("target"), F.abs("c_acctbal").cast("decimal(15,2)").alias("current"),
        F.to_date(F.lit("2001-01-01")).alias("start"), F.date_add(F.to_date(F.lit("2001-05-01")), (c("c_custkey") % 700).cast("int")).alias("target_date"),
        F.get(F.array(*map(F.lit, ("ACTIVE", "COMPLETED", "ABANDONED", "ACTIVE", "ACTIVE"))), (c("c_custkey") % 5).cast("int")).alias("state"),
    )


BUDGETS = """
, bu AS (SELECT user_id * 100 + n AS budget_id, user_id, category, (20000 * (n + 1) * (1 + user_id % 7))::DECIMAL(15,2) AS monthly_limit
         FROM (SELECT DISTINCT user_id FROM ledger), (VALUES (0, 'FOOD_DINING'), (1, 'GROCERIES'), (2, 'TRAVEL'), (9, NULL)) AS v(n, category)),
""" + f"""
mc AS (SELECT user_id, category, sum(amount) AS total FROM ledger WHERE type = 'DEBIT' AND date BETWEEN DATE '2001-06-01' AND DATE '2001-06-20' GROUP BY 1, 2),
ma AS (SELECT user_id, sum(total) AS every FROM mc GROUP BY user_id),
bs AS (SELECT bu.*, coalesce(CASE WHEN bu.category IS NULL THEN every ELSE total END, 0) AS s FROM bu LEFT JOIN mc ON bu.user_id = mc.user_id AND bu.category = mc.category LEFT JOIN ma ON bu.user_id = ma.user_id),
bt AS (SELECT budget_id, user_id, category, monthly_limit, round(s, 2)::{D2} AS spend, round(monthly_limit - s, 2)::{D2} AS remaining,
              {ROUND1.format('s::DOUBLE / monthly_limit::DOUBLE * 100')} AS percent, ({div('s * 30', '20')})::{D2} AS projected FROM bs),
bv AS (SELECT *, CASE WHEN percent >= 100 THEN 'OVER' WHEN percent >= 80 THEN 'NEAR_LIMIT' WHEN projected > monthly_limit THEN 'PROJECTED_OVER' ELSE 'ON_TRACK' END AS status FROM bt)
"""


def test_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = test_ledger(spark, sf_dir)
    kinds = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).cast("string").alias("category")) for n, k in ((0, "FOOD_DINING"), (1, "GROCERIES"), (2, "TRAVEL"), (9, None))])
    rows = ledger.select("user_id").distinct().select("user_id", F.inline(kinds))
    limit = (20000 * (F.col("n") + 1) * (1 + F.col("user_id") % 7)).cast("decimal(15,2)")
    budgets = rows.select((F.col("user_id") * 100 + F.col("n")).alias("budget_id"), "user_id", "category", limit.alias("monthly_limit"))
    return S.budget_status(budgets, ledger, date(2001, 6, 20))


@query(f"{BUDGETS} SELECT * FROM bv")
def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_budgets(spark, sf_dir)


@query(f"""{BUDGETS} SELECT user_id, coalesce(sum(monthly_limit) FILTER (category IS NOT NULL), 0)::{D2} AS limits, coalesce(sum(spend) FILTER (category IS NOT NULL), 0)::{D2} AS spend,
count(*) FILTER (status = 'OVER') AS over FROM bv GROUP BY user_id""")
def budget_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.budget_summary(test_budgets(spark, sf_dir))


@query(f"""WITH {GOALS_SQL},
h AS (SELECT *, round(greatest(0, target - current), 2)::{D2} AS remaining, CASE WHEN target > 0 THEN least(100.0::DOUBLE, {ROUND1.format('current::DOUBLE / target::DOUBLE * 100')}) ELSE 0 END AS percent,
             target_date - DATE '2001-06-30' AS days, target_date - start AS span FROM g)
SELECT * EXCLUDE (days, span), CASE WHEN days > 0 THEN ({div('remaining', 'greatest(days, 1)')})::{D2} ELSE remaining END AS daily, greatest(0, days)::INT AS days_left,
       CASE WHEN state = 'COMPLETED' OR percent >= 100 THEN 'COMPLETED' WHEN state = 'ABANDONED' THEN 'ABANDONED' WHEN days < 0 THEN 'OVERDUE' WHEN span <= 0 THEN 'ON_PACE'
            WHEN percent > (DATE '2001-06-30' - start)::DOUBLE / span * 100 + 5 THEN 'AHEAD' WHEN percent < (DATE '2001-06-30' - start)::DOUBLE / span * 100 - 5 THEN 'BEHIND' ELSE 'ON_PACE' END AS pace FROM h""")
def goal_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.goal_status(test_goals(spark, sf_dir), AS_OF)


@query(f"""WITH {GOALS_SQL},
k AS (SELECT o_custkey AS goal_id, sum(o_totalprice::DECIMAL(15,2)) AS more FROM orders GROUP BY 1)
SELECT g.goal_id, user_id, target, (current + coalesce(more, 0))::DECIMAL(15,2) AS current, start, target_date,
       CASE WHEN state = 'ACTIVE' AND (current + coalesce(more, 0))::DECIMAL(15,2) >= target THEN 'COMPLETED' ELSE state END AS state FROM g LEFT JOIN k ON g.goal_id = k.goal_id""")
def goal_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("goal_id"), F.col("o_totalprice").cast("decimal(15,2)").alias("amount"))
    return S.contribute(test_goals(spark, sf_dir), more)


@query(f"""WITH {GOALS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY target_date, goal_id) AS r FROM g WHERE state = 'ACTIVE'),
m AS (SELECT *, (target_date - DATE '2001-04-20') / 30.0::DOUBLE AS months, target::DOUBLE - current::DOUBLE AS todo, -1000.0::DOUBLE * (user_id + 1) AS impact FROM n WHERE r = 1),
z AS (SELECT user_id, goal_id, floor(todo / greatest(1.0::DOUBLE, todo / months + impact) - months + 0.5)::BIGINT AS delay FROM m WHERE months > 0 AND todo > 0)
SELECT * FROM z WHERE delay > 0""")
def goal_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = test_goals(spark, sf_dir)
    impact = goals.select("user_id").distinct().select("user_id", ((F.col("user_id") + 1) * -1000.0).alias("impact"))
    return S.goal_delay(goals, impact, date(2001, 4, 20))


@query("""
, x AS (SELECT user_id, amount, unnest(list_filter([CASE WHEN regexp_matches(t, '(?i)\\b(lic|sip|ppf|red)\\b') THEN 'A' END, CASE WHEN regexp_matches(t, '(?i)\\b(mediclaim|ring)\\b') THEN 'B' END], lambda s: s IS NOT NULL)) AS section
        FROM (SELECT *, merchant || ' ' || description AS t FROM ledger WHERE type = 'DEBIT' AND date BETWEEN DATE '2001-04-01' AND DATE '2001-06-30'))
SELECT user_id, section, count(*) AS entries, sum(amount)::DECIMAL(29,4) AS total, CASE WHEN section = 'A' THEN greatest(0, 150000 - sum(amount)) END::DECIMAL(29,4) AS remaining FROM x GROUP BY 1, 2""")
def tax_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tax_sections(test_ledger(spark, sf_dir), AS_OF, sections=(("A", 150000, r"(?i)\b(lic|sip|ppf|red)\b"), ("B", None, r"(?i)\b(mediclaim|ring)\b")))


RECOMMENDED = f"""{LEAKS}, {GOALS_SQL},
ra AS (SELECT user_id, CASE kind WHEN 'DUPLICATE_SUBSCRIPTIONS' THEN 'CANCEL_SUBSCRIPTION' WHEN 'SUBSCRIPTION_CREEP' THEN 'REVIEW_INFLATION' WHEN 'HIGH_FREQUENCY_SMALL_SPEND' THEN 'SHIFT_HABIT' ELSE 'REDUCE_CATEGORY' END AS action,
              round(CASE WHEN kind = 'HIGH_FREQUENCY_SMALL_SPEND' THEN monthly / 2 ELSE monthly END, 2)::{D2} AS monthly, rank AS place FROM lk
       UNION ALL SELECT user_id, 'REDIRECT_TO_GOAL', sum(monthly), 99 FROM lk WHERE user_id IN (SELECT user_id FROM g WHERE state = 'ACTIVE') GROUP BY user_id HAVING sum(monthly) > 100),
rb AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY monthly DESC, place, action)::INT AS rank FROM ra WHERE monthly >= 100),
rc AS (SELECT user_id, rank, action, monthly::{D2} AS monthly FROM rb WHERE rank <= 5)
"""


@query(f"{RECOMMENDED} SELECT * FROM rc")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.recommendations(test_leaks(spark, sf_dir), test_goals(spark, sf_dir))


@query(f"{RECOMMENDED} SELECT user_id, sum(monthly)::{D2} AS monthly, coalesce(sum(monthly) FILTER (action <> 'REDIRECT_TO_GOAL'), 0)::{D2} AS net FROM rc GROUP BY user_id")
def savings_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.savings(insights.recommendations(test_leaks(spark, sf_dir), test_goals(spark, sf_dir)))
