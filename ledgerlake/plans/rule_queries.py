"""Queries of findings by rules: trade-offs of scenarios, and the narrative of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import behavior, insights, overview, recurring, reports
from ..sources.ledger import test_ledger
from . import simulation as S
from .catalog import AS_OF, END, JUNE, ORDER, ROUND1, SIGNALS, START, div, query, test_leaks, test_patterns
from .planning_queries import RECOMMENDED, SIMULATED, test_baseline, test_goals, test_scenarios

D2, M2 = "DECIMAL(19,2)", "DECIMAL(29,2)"


def rule_sql(section: str, place: int, code: str, when: str, figures: list[str], text: str, keys: str, source: str) -> str:
    """One rule over the rows of a CTE; {n} in the text are figures as whole numbers, {name} columns."""
    parts = []
    for i, piece in enumerate(text.replace("}", "{").split("{")):
        if i % 2 == 0:
            parts.append("'" + piece.replace("'", "''") + "'")
        else:
            parts.append(f"format('{{:,}}', CAST(round(({figures[int(piece)]})::DECIMAL(38,6)) AS BIGINT))" if piece.isdigit() else f"{piece}::VARCHAR")
    made = ", ".join(f"({f})::{M2}" for f in figures)
    return f"SELECT {keys}, '{section}' AS section, {place} AS place, '{code}' AS code, [{made}]::{M2}[] AS figures, {' || '.join(parts)} AS text FROM {source} WHERE {when}"


GROWN, SAVED = "{0}::DOUBLE * pow(1.08::DOUBLE, 10)", "{0}::DOUBLE * ((pow(1 + 0.08::DOUBLE / 12, 120) - 1) / (0.08::DOUBLE / 12))"
ONCE, OFTEN, SAVING, LOAN = "ONE_TIME_PURCHASE", "RECURRING_EXPENSE", "SAVINGS_ADJUSTMENT", "LOAN_EMI"
TRADEOFF_SQL = [
    (ONCE, "MONTHS_TO_SAVE", "net > 0", ["ceil(amount::DOUBLE / net::DOUBLE)", "net"], "{0} months of saving {1} each"),
    (ONCE, "DAYS_OF_SPENDING", "spend > 0", ["round(amount::DOUBLE / (spend::DOUBLE / 30))"], "as much as {0} days of usual spending"),
    (ONCE, "TEN_YEAR_COST", "true", [GROWN.format("amount")], "invested instead it would be {0} in ten years"),
    (OFTEN, "TOTAL", "true", ["amount * coalesce(duration, 120)", "coalesce(duration, 120)"], "{0} in {1} months"),
    (OFTEN, "ANNUAL", "true", ["amount * 12"], "{0} a year"),
    (OFTEN, "TEN_YEAR_COST", "true", [SAVED.format("amount")], "invested each month instead it would be {0} in ten years"),
    (SAVING, "SAVED", "amount > 0", ["amount * coalesce(duration, 120)", "coalesce(duration, 120)"], "{0} more saved in {1} months"),
    (SAVING, "SAVINGS_LOST", "amount <= 0", ["-amount * coalesce(duration, 120)", "coalesce(duration, 120)"], "{0} less saved in {1} months"),
    (SAVING, "TEN_YEAR_VALUE", "true", [SAVED.format("abs(amount)")], "kept up it comes to {0} in ten years"),
    (LOAN, "INSTALMENT", "true", ["instalment", "tenure"], "{0} every month for {1} months"),
    (LOAN, "INTEREST", "true", ["greatest(instalment * tenure - amount, 0)"], "{0} of interest over the whole time"),
    (LOAN, "REPAYMENT", "true", ["instalment * tenure"], "{0} paid back in all"),
]
EACH_TRADEOFF = " UNION ALL ".join(rule_sql("", i, code, f"kind = '{kind}' AND {when}", figures, text, "user_id, kind", "x") for i, (kind, code, when, figures, text) in enumerate(TRADEOFF_SQL, 1))


@query(f"{SIMULATED} SELECT user_id, kind, place, code, list_sum(figures)::{M2} AS figures, text FROM ({EACH_TRADEOFF})")
def scenario_tradeoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade-offs of each user's scenarios; of the figures their sum."""
    rows = S.tradeoffs(S.simulate(test_baseline(spark, sf_dir), test_scenarios(spark, sf_dir)))
    return rows.selectExpr("user_id", "kind", "place", "code", "CAST(aggregate(figures, CAST(0 AS DECIMAL(29,2)), (s, x) -> CAST(s + x AS DECIMAL(29,2))) AS DECIMAL(29,2)) AS figures", "text")


KNOWN = f"""
n1 AS (SELECT user_id, coalesce(sum(amount) FILTER (type = 'CREDIT'), 0)::DECIMAL(29,4) AS income, coalesce(sum(amount) FILTER (type = 'DEBIT'), 0)::DECIMAL(29,4) AS spend, count(*) AS entries FROM ledger WHERE {JUNE} GROUP BY user_id),
n2 AS (SELECT user_id, coalesce(sum(amount) FILTER (date >= DATE '2001-06-01'), 0)::DECIMAL(29,4) AS s, coalesce(sum(amount) FILTER (date < DATE '2001-06-01'), 0)::DECIMAL(29,4) AS prior
       FROM ledger WHERE type = 'DEBIT' AND date BETWEEN DATE '2001-05-02' AND DATE '2001-06-30' GROUP BY user_id),
n3 AS (SELECT user_id, category AS top_category, t AS top_total, {ROUND1.format("t::DOUBLE / every::DOUBLE * 100")} AS top_share FROM (
       SELECT user_id, category, sum(amount) AS t, sum(sum(amount)) OVER (PARTITION BY user_id) AS every, row_number() OVER (PARTITION BY user_id ORDER BY sum(amount) DESC, {ORDER}) AS n
       FROM ledger WHERE {JUNE} AND type = 'DEBIT' GROUP BY user_id, category) WHERE n = 1),
sg AS (WITH zz AS (SELECT 1){SIGNALS} SELECT * FROM g), ms AS (WITH zz AS (SELECT 1){SIGNALS} SELECT DISTINCT user_id FROM m),
n4 AS (SELECT ms.user_id, coalesce(max(kind) FILTER (rank = 1), 'STEADY') AS profile, count(kind) AS signals FROM ms LEFT JOIN sg ON ms.user_id = sg.user_id GROUP BY 1),
vw AS (SELECT *, round(amount * yearly, 2)::{D2} AS annual, ({div("amount * yearly", "12")})::{D2} AS own FROM p),
n5 AS (SELECT user_id, count(*) AS patterns, sum(own)::{D2} AS recurring, sum(annual)::{M2} AS recurring_annual, count(*) FILTER (cancellable) AS cancellable FROM vw GROUP BY 1),
n6 AS (SELECT user_id, merchant AS largest, amount AS largest_amount, label AS largest_period FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, key, period) AS n FROM vw) WHERE n = 1),
cq AS (SELECT user_id, merchant, own, (own * 12)::{D2} AS year, round({SAVED.format("own")}, 2)::{D2} AS opportunity, row_number() OVER (PARTITION BY user_id ORDER BY own DESC, merchant, key, period) AS n FROM vw WHERE amount > 0),
n7 AS (SELECT user_id, sum(year)::{M2} AS dearest_annual, sum(opportunity)::{M2} AS dearest_opportunity, max(merchant) FILTER (n = 1) AS dearest, max(own) FILTER (n = 1) AS dearest_monthly, max(opportunity) FILTER (n = 1) AS dearest_one FROM cq WHERE n <= 5 GROUP BY 1),
n8 AS (SELECT user_id, sum(monthly)::{D2} AS leak_monthly FROM lk GROUP BY 1),
kn AS (SELECT n1.user_id, income, spend, (income - spend)::DECIMAL(29,4) AS net, entries, coalesce(prior, 0)::DECIMAL(29,4) AS prior_spend, CASE WHEN prior > 0 THEN {ROUND1.format("(s - prior)::DOUBLE / prior::DOUBLE * 100")} ELSE 0 END AS change,
       top_category, top_total, top_share, profile, coalesce(signals, 0) AS signals, coalesce(patterns, 0) AS patterns, coalesce(recurring, 0)::{D2} AS recurring, recurring_annual, cancellable, largest, largest_amount, largest_period,
       dearest_annual, dearest_opportunity, dearest, dearest_monthly, dearest_one, coalesce(leak_monthly, 0)::{D2} AS leak_monthly, 0 AS item
       FROM n1 LEFT JOIN n2 USING (user_id) LEFT JOIN n3 USING (user_id) LEFT JOIN n4 USING (user_id) LEFT JOIN n5 USING (user_id) LEFT JOIN n6 USING (user_id) LEFT JOIN n7 USING (user_id) LEFT JOIN n8 USING (user_id)),
si AS (SELECT *, rank AS item FROM sg WHERE user_id IN (SELECT user_id FROM n1)), li AS (SELECT *, rank AS item FROM lk WHERE user_id IN (SELECT user_id FROM n1)), ri AS (SELECT *, rank AS item FROM rc WHERE user_id IN (SELECT user_id FROM n1))
"""
DIFFERS = "prior_spend > 100 AND abs(change) >= 10"
LINES = [
    ("kn", "SUMMARY", "NO_ENTRIES", "entries = 0", [], "Nothing was booked in this period."),
    ("kn", "SUMMARY", "ENTRIES", "entries > 0", ["entries", "spend", "income"], "{0} entries: {1} spent against an income of {2}."),
    ("kn", "SUMMARY", "SPEND_ROSE", "prior_spend > 0 AND change >= 0", ["abs(change)", "abs(spend - prior_spend)"], "That is {0}% or {1} more than in the period before."),
    ("kn", "SUMMARY", "SPEND_FELL", "prior_spend > 0 AND change < 0", ["abs(change)", "abs(spend - prior_spend)"], "That is {0}% or {1} less than in the period before."),
    ("kn", "SUMMARY", "NET_POSITIVE", "net > 0", ["net"], "{0} was put aside."),
    ("kn", "SUMMARY", "NET_NEGATIVE", "net < 0", ["-net"], "{0} more went out than came in."),
    ("kn", "SUMMARY", "TOP_CATEGORY", "top_category IS NOT NULL", ["top_total", "top_share"], "Most went to {top_category}: {0}, {1}% of all spend."),
    ("kn", "SUMMARY", "PROFILE", "profile <> 'STEADY'", [], "What marks the spending most: {profile}."),
    ("kn", "SUMMARY", "RECOVERABLE", "leak_monthly > 100", ["leak_monthly", "leak_monthly * 12"], "About {0} a month could be kept, {1} a year."),
    ("si", "BEHAVIOUR", "SIGNAL", "true", ["value"], "{kind} ({severity})."),
    ("kn", "BEHAVIOUR", "MUCH_CHANGED", f"{DIFFERS} AND abs(change) >= 25", ["change"], "Spending is far from that of the period before: {0}%."),
    ("kn", "BEHAVIOUR", "CHANGED", f"{DIFFERS} AND abs(change) < 25", ["change"], "Spending differs from that of the period before: {0}%."),
    ("kn", "BEHAVIOUR", "CONCENTRATED", "top_share > 40", ["top_share"], "{top_category} alone is {0}% of all spend."),
    ("kn", "BEHAVIOUR", "STEADY", f"signals = 0 AND NOT ({DIFFERS}) AND NOT coalesce(top_share > 40, false)", [], "Nothing out of the usual."),
    ("li", "LEAKS", "LEAK", "true", ["monthly", "annual"], "{kind} ({severity}): {0} a month, {1} a year."),
    ("kn", "RECURRING", "NO_PATTERNS", "patterns = 0", [], "No recurring payments are known."),
    ("kn", "RECURRING", "PATTERNS", "patterns > 0", ["recurring", "recurring_annual", "patterns"], "{2} recurring payments bind {0} a month, {1} a year."),
    ("kn", "RECURRING", "LARGEST", "largest_amount IS NOT NULL", ["largest_amount"], "The largest is {largest}: {0} ({largest_period})."),
    ("kn", "RECURRING", "CANCELLABLE", "cancellable > 0", ["cancellable"], "{0} of them are easily cancelled."),
    ("kn", "CONSEQUENCES", "OUTLAY", "dearest IS NOT NULL", ["dearest_annual", "dearest_opportunity"], "The dearest ones take {0} a year; invested, that would be {1} in ten years."),
    ("kn", "CONSEQUENCES", "EXAMPLE", "dearest IS NOT NULL", ["dearest_monthly", "dearest_one"], "{dearest} alone, {0} a month, would be {1}."),
    ("ri", "RECOMMENDATIONS", "ADVICE", "monthly > 0", ["monthly"], "{action}: up to {0} a month."),
    ("ri", "RECOMMENDATIONS", "ADVICE", "monthly <= 0", [], "{action}."),
]
EACH_LINE = " UNION ALL ".join(rule_sql(section, i, code, when, figures, text, "user_id, item::INT AS item", source) for i, (source, section, code, when, figures, text) in enumerate(LINES, 1))


@query(f"{RECOMMENDED}, {KNOWN} SELECT user_id, section, place, item, code, text FROM ({EACH_LINE})")
def report_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of June in sentences, section by section."""
    ledger, patterns, leaks = test_ledger(spark, sf_dir), test_patterns(spark, sf_dir), test_leaks(spark, sf_dir)
    measured = behavior.measures(ledger, AS_OF)
    signals = behavior.signals(measured)
    known = reports.facts(
        reports.data(ledger, patterns, leaks, START, END), overview.category_share(ledger, START, END), behavior.profile(measured), signals,
        recurring.view(patterns, AS_OF), S.consequences(patterns),
    )
    return reports.narrative(known, signals, leaks, insights.recommendations(leaks, test_goals(spark, sf_dir))).drop("figures")
