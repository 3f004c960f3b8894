"""Financial baselines, flexibility scores, what-if scenarios and goals, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import clamp, money, quotient, round1, tier
from ..functions.periods import months_back
from ..functions.rules import Rule, found
from ..functions.vocabulary import TAX_SECTIONS
from ..operators import overview
from ..operators.recurring import category_order, monthly_equivalent

MONTHS, YEARLY_RETURN, HORIZON = 3, 0.08, 12


def baseline(ledger: DataFrame, patterns: DataFrame, as_of: date) -> DataFrame:
    """user_id, income, spend, recurring, discretionary, net (all monthly), savings_rate, top_category, top_spend.

    Sums from the first of the month three months back to as_of, divided by three. patterns: those that
    are not dismissed.
    """
    rows = overview.between(ledger, months_back(as_of, MONTHS).replace(day=1), as_of)
    sums = overview.totals(rows, None, None).select("user_id", quotient(F.col("income"), MONTHS).alias("income"), quotient(F.col("spend"), MONTHS).alias("spend"))
    top = overview.by_category(rows, None, None).groupBy("user_id").agg(F.max(F.struct("total", (-category_order(F.col("category"))).alias("o"), "category")).alias("top"))
    top = top.select("user_id", F.col("top.category").alias("top_category"), quotient(F.col("top.total"), MONTHS).alias("top_spend"))
    fixed = patterns.groupBy("user_id").agg(F.sum(monthly_equivalent(F.col("amount"), F.col("period"))).cast("decimal(19,2)").alias("recurring"))
    out = sums.join(fixed, "user_id", "left").join(top, "user_id", "left")
    out = out.withColumn("recurring", F.coalesce("recurring", F.lit(0)).cast("decimal(19,2)")).withColumn("top_spend", F.coalesce("top_spend", F.lit(0)).cast("decimal(19,2)"))
    return _derived(out)


def _derived(df: DataFrame) -> DataFrame:
    c = F.col
    free = F.greatest(F.lit(0), c("income") - c("spend") - F.greatest(c("recurring"), F.lit(0))).cast("decimal(19,2)")
    net = (c("income") - c("spend")).cast("decimal(19,2)")
    rate = F.when(c("income") > 0, clamp(net.cast("double") / c("income").cast("double"), -1.0, 1.0)).otherwise(0.0)
    return df.withColumn("discretionary", free).withColumn("net", net).withColumn("savings_rate", rate)


def flexibility(income: Column, recurring: Column, net: Column, discretionary: Column) -> Column:
    """0 to 100: how little is bound, how much is saved, how much is free; 50 without income."""
    of = lambda x: x.cast("double") / income.cast("double")
    score = clamp(1 - of(F.greatest(recurring, F.lit(0))) / 0.5) * 0.35 + clamp(of(net) / 0.3) * 0.35 + clamp(of(discretionary) / 0.2) * 0.30
    return F.when(income > 0, F.floor(score * 100 + 0.5)).otherwise(50).cast("int")


def flexibility_tier(score: Column) -> Column:
    return tier(score, (80, "EXCELLENT"), (65, "GOOD"), (50, "FAIR"), (35, "TIGHT"), other="CONSTRAINED")


def emi(amount: Column, yearly_rate: Column, months: Column) -> Column:
    """Monthly instalment; amount / months without interest, 0 if an input is missing."""
    p, r, n = amount.cast("double"), yearly_rate.cast("double") / 100 / 12, months
    growth = F.pow(1 + r, n)
    return F.when(amount.isNull() | yearly_rate.isNull() | n.isNull() | (n <= 0), F.lit(0).cast("decimal(19,2)")).when(r <= 0, money(p / n)).otherwise(money(p * r * growth / (growth - 1)))


def annuity(monthly: Column, months: int = 120, yearly: float = YEARLY_RETURN) -> Column:
    """What monthly payments come to, compounded monthly."""
    r = yearly / 12
    return money(monthly.cast("double") * (((1 + r) ** months - 1) / r))


def lump_sum(amount: Column, years: int = 10, yearly: float = YEARLY_RETURN) -> Column:
    return money(amount.cast("double") * (1 + yearly) ** years)


def simulate(base: DataFrame, scenarios: DataFrame) -> DataFrame:
    """base joined with scenarios (user_id, kind, amount, rate, tenure, duration) and their effect.

    kind: ONE_TIME_PURCHASE, RECURRING_EXPENSE, SAVINGS_ADJUSTMENT, LOAN_EMI. Adds instalment, impact
    (monthly, signed), year, five_years, ten_years, opportunity, score, new_score, score_change, new_tier.
    """
    c = F.col
    out = base.join(scenarios, "user_id").withColumn("instalment", F.when(c("kind") == "LOAN_EMI", emi(c("amount"), c("rate"), c("tenure"))).otherwise(F.lit(0).cast("decimal(19,2)")))
    kinds = lambda once, often, saving, loan: F.when(c("kind") == "ONE_TIME_PURCHASE", once).when(c("kind") == "RECURRING_EXPENSE", often).when(c("kind") == "SAVINGS_ADJUSTMENT", saving).otherwise(loan).cast("decimal(19,2)")
    zero = F.lit(0).cast("decimal(19,2)")
    out = out.withColumn("impact", kinds(zero, -c("amount"), c("amount"), -c("instalment"))).withColumn("_bound", kinds(zero, c("amount"), zero, c("instalment")))
    once = c("kind") == "ONE_TIME_PURCHASE"
    for name, months in (("year", 12), ("five_years", 60), ("ten_years", 120)):
        out = out.withColumn(name, F.when(once, -c("amount")).otherwise(c("impact") * months).cast("decimal(19,2)"))
    out = out.withColumn("opportunity", F.when(once, lump_sum(c("amount"))).otherwise(annuity(F.abs(c("impact")))))
    recurring = (c("recurring") + c("_bound")).cast("decimal(19,2)")
    spend = (c("spend") + F.greatest(c("_bound"), zero)).cast("decimal(19,2)")
    free = F.greatest(F.lit(0), c("income") - spend - F.greatest(recurring, F.lit(0))).cast("decimal(19,2)")
    out = out.withColumn("score", flexibility(c("income"), c("recurring"), c("net"), c("discretionary")))
    out = out.withColumn("new_score", flexibility(c("income"), recurring, c("net") + c("impact"), free))
    change = F.when(c("score") > 0, round1((c("new_score") - c("score")).cast("double") / c("score") * 100)).otherwise(0.0)
    return out.withColumn("score_change", change).withColumn("new_tier", flexibility_tier(c("new_score"))).drop("_bound")


def _added(c: Callable[[str], Column]) -> Column:
    """What a scenario adds to recurring payments a month."""
    return F.when(c("kind") == "RECURRING_EXPENSE", c("amount")).when(c("kind") == "LOAN_EMI", c("instalment")).otherwise(0).cast("decimal(19,2)")


def explanation(simulated: DataFrame) -> DataFrame:
    """user_id, kind, reason: why the flexibility score changes, in one word."""
    change, added = F.col("new_score") - F.col("score"), _added(F.col)
    reason = F.when(change >= 3, "MORE_FREE").when(change <= -10, "MUCH_LESS_FREE").when((change <= -3) & (added > 0), "MORE_BOUND").when(change <= -3, "LESS_FREE").otherwise("MARGINAL")
    return simulated.select("user_id", "kind", reason.alias("reason"))


def effects(simulated: DataFrame) -> DataFrame:
    """user_id, kind, code, severity: what follows from a scenario (simulated, with category, null for none):
    cash flow, recurring load, a shift of the top category, a delayed goal (delay in months, if there is such
    a column), a change of tier."""
    c = F.col
    zero = F.lit(0).cast("decimal(19,2)")
    grade = lambda share: F.when(share < 10, "NEUTRAL").when(share < 25, "CAUTION").otherwise("WARNING")
    percent = lambda part, whole: F.when(whole > 0, part.cast("double") / whole.cast("double") * 100).otherwise(100.0)
    said = lambda code, severity: F.struct(F.lit(code).alias("code"), severity.alias("severity"))
    once, added = c("kind") == "ONE_TIME_PURCHASE", _added(F.col)
    cash = F.when(once, said("CASH_FLOW", F.lit("CAUTION"))).when(c("impact") > 0, said("SAVINGS_BOOST", F.lit("POSITIVE")))
    cash = cash.otherwise(said("CASH_FLOW", grade(percent(F.abs("impact"), c("discretionary")))))
    load = F.when(added != zero, said("RECURRING_LOAD", F.when(added < zero, "POSITIVE").otherwise(grade(percent(added, c("recurring"))))))
    monthly = F.when(once, money(c("amount").cast("double") / 12)).otherwise(F.abs("amount"))
    shift = (c("category") == c("top_category")) | (monthly > c("top_spend"))
    shift = F.when(c("category").isNotNull() & c("top_category").isNotNull() & shift, said("CATEGORY_SHIFT", F.lit("CAUTION")))
    moved = F.when(flexibility_tier(c("score")) != c("new_tier"), said("OPPORTUNITY_COST", F.when(c("new_score") > c("score"), "POSITIVE").otherwise("WARNING")))
    found = [cash, load, shift, moved]
    if "delay" in simulated.columns:
        found.insert(3, F.when(c("delay") > 0, said("GOAL_DELAY", F.lit("WARNING"))))
    return simulated.select("user_id", "kind", F.inline(F.array_compact(F.array(*found))))


_GROWN = f"CAST(%s AS DOUBLE) * {(1 + YEARLY_RETURN) ** 10!r}D"
_SAVED = f"CAST(%s AS DOUBLE) * {((1 + YEARLY_RETURN / 12) ** 120 - 1) / (YEARLY_RETURN / 12)!r}D"
_LASTS, _TENURE = "coalesce(duration, 120)", "coalesce(tenure, 0)"
#: What a scenario is weighed against, by its kind (the section).
TRADEOFFS = (
    Rule("ONE_TIME_PURCHASE", "MONTHS_TO_SAVE", "net > 0", ("ceil(CAST(amount AS DOUBLE) / CAST(net AS DOUBLE))", "net"), "{0} months of saving {1} each"),
    Rule("ONE_TIME_PURCHASE", "DAYS_OF_SPENDING", "spend > 0", ("round(CAST(amount AS DOUBLE) / (CAST(spend AS DOUBLE) / 30))",), "as much as {0} days of usual spending"),
    Rule("ONE_TIME_PURCHASE", "TEN_YEAR_COST", "true", (_GROWN % "amount",), "invested instead it would be {0} in ten years"),
    Rule("RECURRING_EXPENSE", "TOTAL", "true", (f"amount * {_LASTS}", _LASTS), "{0} in {1} months"),
    Rule("RECURRING_EXPENSE", "ANNUAL", "true", ("amount * 12",), "{0} a year"),
    Rule("RECURRING_EXPENSE", "TEN_YEAR_COST", "true", (_SAVED % "amount",), "invested each month instead it would be {0} in ten years"),
    Rule("SAVINGS_ADJUSTMENT", "SAVED", "amount > 0", (f"amount * {_LASTS}", _LASTS), "{0} more saved in {1} months"),
    Rule("SAVINGS_ADJUSTMENT", "SAVINGS_LOST", "amount <= 0", (f"abs(amount) * {_LASTS}", _LASTS), "{0} less saved in {1} months"),
    Rule("SAVINGS_ADJUSTMENT", "TEN_YEAR_VALUE", "true", (_SAVED % "abs(amount)",), "kept up it comes to {0} in ten years"),
    Rule("LOAN_EMI", "INSTALMENT", "true", ("instalment", _TENURE), "{0} every month for {1} months"),
    Rule("LOAN_EMI", "INTEREST", "true", (f"greatest(instalment * {_TENURE} - amount, 0)",), "{0} of interest over the whole time"),
    Rule("LOAN_EMI", "REPAYMENT", "true", (f"instalment * {_TENURE}",), "{0} paid back in all"),
)


def tradeoffs(simulated: DataFrame) -> DataFrame:
    """user_id, kind, place, code, figures, text: what each scenario (see simulate) is weighed against."""
    rules = tuple(r._replace(when=f"kind = '{r.section}' AND {r.when}") for r in TRADEOFFS)
    return found(simulated, ["user_id", "kind"], rules).drop("section")


def projection(simulated: DataFrame) -> DataFrame:
    """user_id, kind, month (1 to 12), before, after: cumulative savings without and with the scenario."""
    c = F.col
    rows = simulated.select("*", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))).alias("month"))
    lasts = F.coalesce(F.when(c("kind") == "LOAN_EMI", c("tenure")).otherwise(c("duration")), F.lit(HORIZON))
    step = F.when(c("month") <= lasts, c("impact")).otherwise(0) - F.when((c("kind") == "ONE_TIME_PURCHASE") & (c("month") == 1), c("amount")).otherwise(0)
    run = W.partitionBy("user_id", "kind").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("user_id", "kind", "month", (c("net") * c("month")).cast("decimal(19,2)").alias("before"), F.sum(c("net") + step).over(run).cast("decimal(19,2)").alias("after"))


def consequences(patterns: DataFrame, k: int = 5) -> DataFrame:
    """user_id, rank, merchant, monthly, year, five_years, ten_years, opportunity, weight of the k dearest patterns."""
    rows = patterns.where("amount > 0").withColumn("monthly", monthly_equivalent(F.col("amount"), F.col("period")))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("monthly"), "merchant", "key", "period"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    times = lambda n: money(F.col("monthly") * n)
    weight = tier(F.col("monthly"), (2000, "LARGE"), (500, "NOTABLE"), (100, "SMALL"), other="MINOR")
    return rows.select("user_id", "rank", "merchant", "monthly", times(12).alias("year"), times(60).alias("five_years"), times(120).alias("ten_years"), annuity(F.col("monthly")).alias("opportunity"), weight.alias("weight"))


def budget_status(budgets: DataFrame, ledger: DataFrame, as_of: date) -> DataFrame:
    """budgets (budget_id, user_id, category or null for all, monthly_limit) with spend, remaining, percent,
    projected, status for the month of as_of. "All" is the sum over categorised debits."""
    start = as_of.replace(day=1)
    rows = overview.by_category(ledger, start, as_of)
    every = rows.groupBy("user_id").agg(F.sum("total").alias("all"))
    out = budgets.join(rows.select("user_id", "category", "total"), ["user_id", "category"], "left").join(every, "user_id", "left")
    spend = F.coalesce(F.when(F.col("category").isNull(), F.col("all")).otherwise(F.col("total")), F.lit(0)).cast("decimal(29,4)")
    out = out.withColumn("_spend", spend)
    limit = F.col("monthly_limit")
    percent = F.when(limit > 0, round1(F.col("_spend").cast("double") / limit.cast("double") * 100)).otherwise(0.0)
    days = F.dayofmonth(F.last_day(F.lit(as_of)))
    out = out.withColumn("percent", percent).withColumn("projected", quotient(F.col("_spend") * days, as_of.day))
    status = F.when(F.col("percent") >= 100, "OVER").when(F.col("percent") >= 80, "NEAR_LIMIT").when(F.col("projected") > limit, "PROJECTED_OVER").otherwise("ON_TRACK")
    return out.select("budget_id", "user_id", "category", "monthly_limit", money(F.col("_spend")).alias("spend"), money(limit - F.col("_spend")).alias("remaining"), "percent", "projected", status.alias("status"))


def budget_summary(status: DataFrame) -> DataFrame:
    """user_id, limits, spend (without the budget of all), over (how many are spent)."""
    own = F.col("category").isNotNull()
    sum_ = lambda c: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).cast("decimal(19,2)")
    return status.groupBy("user_id").agg(sum_("monthly_limit").alias("limits"), sum_("spend").alias("spend"), F.count(F.when(F.col("status") == "OVER", 1)).alias("over"))


def goal_status(goals: DataFrame, as_of: date) -> DataFrame:
    """goals (goal_id, user_id, target, current, start, target_date, state) with remaining, percent, days_left,
    daily and pace: 5 points around the share of time that has passed are on pace."""
    c = F.col
    remaining = money(F.greatest(F.lit(0), c("target") - c("current")))
    days = F.datediff("target_date", F.lit(as_of))
    percent = F.when(c("target") > 0, F.least(F.lit(100.0), round1(c("current").cast("double") / c("target").cast("double") * 100))).otherwise(0.0)
    out = goals.withColumn("remaining", remaining).withColumn("percent", percent).withColumn("_days", days)
    out = out.withColumn("daily", F.when(c("_days") > 0, quotient(c("remaining"), F.greatest(c("_days"), F.lit(1)))).otherwise(c("remaining")))
    span = F.datediff("target_date", "start")
    passed = F.datediff(F.lit(as_of), c("start")).cast("double") / F.when(span > 0, span) * 100
    pace = (
        F.when((c("state") == "COMPLETED") | (c("percent") >= 100), "COMPLETED").when(c("state") == "ABANDONED", "ABANDONED").when(c("_days") < 0, "OVERDUE")
        .when(span <= 0, "ON_PACE").when(c("percent") > passed + 5, "AHEAD").when(c("percent") < passed - 5, "BEHIND").otherwise("ON_PACE")
    )
    return out.withColumn("pace", pace).withColumn("days_left", F.greatest(F.lit(0), c("_days"))).drop("_days")


def contribute(goals: DataFrame, contributions: DataFrame) -> DataFrame:
    """goals after a log of contributions (goal_id, amount); a target that is reached completes its goal."""
    sums = contributions.groupBy("goal_id").agg(F.sum("amount").alias("_more"))
    rows = goals.join(sums, "goal_id", "left")
    now = (F.col("current") + F.coalesce("_more", F.lit(0))).cast("decimal(15,2)")
    rows = rows.withColumn("current", now)
    return rows.withColumn("state", F.when((F.col("state") == "ACTIVE") & (F.col("current") >= F.col("target")), "COMPLETED").otherwise(F.col("state"))).drop("_more")


def goal_delay(goals: DataFrame, impact: DataFrame, as_of: date) -> DataFrame:
    """user_id, goal_id, delay (months): for each user's nearest active goal, how much later it is reached if
    monthly savings change by impact (user_id, impact); no row if it is not later."""
    c = F.col
    first = F.row_number().over(W.partitionBy("user_id").orderBy("target_date", "goal_id"))
    near = goals.where("state = 'ACTIVE'").withColumn("r", first).where("r = 1").join(impact, "user_id").where("impact < 0")
    months = F.datediff("target_date", F.lit(as_of)) / 30.0
    left = c("target").cast("double") - c("current").cast("double")
    rows = near.where(F.datediff("target_date", F.lit(as_of)) > 0).withColumn("_left", left).where("_left > 0").withColumn("_months", months)
    pace = c("_left") / c("_months")
    delay = F.floor(c("_left") / F.greatest(F.lit(1.0), pace + c("impact").cast("double")) - c("_months") + 0.5).cast("long")
    return rows.select("user_id", "goal_id", delay.alias("delay")).where("delay > 0")


def tax_sections(ledger: DataFrame, as_of: date, sections: tuple = TAX_SECTIONS) -> DataFrame:
    """user_id, section, entries, total, remaining: debits of the fiscal year (April on) up to as_of that read
    like a deductible payment; one entry can count for several sections."""
    start = date(as_of.year if as_of.month >= 4 else as_of.year - 1, 4, 1)
    rows = overview.between(ledger, start, as_of, type="DEBIT")
    text = F.concat(F.coalesce("merchant", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), F.struct(F.lit(s).alias("section"), F.lit(m).cast("decimal(19,2)").alias("most"))) for s, m, p in sections]))
    rows = rows.select("user_id", "amount", F.inline(hits)).groupBy("user_id", "section", "most").agg(F.count("*").alias("entries"), F.sum("amount").cast("decimal(29,4)").alias("total"))
    return rows.select("user_id", "section", "entries", "total", F.when(F.col("most").isNotNull(), F.greatest(F.lit(0), F.col("most") - F.col("total"))).cast("decimal(29,4)").alias("remaining"))
