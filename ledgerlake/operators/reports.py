"""Report data for a period, and its sentences."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import quotient
from ..functions.rules import Rule, found
from . import overview
from .recurring import category_order, monthly_equivalent


def monthly(ledger: DataFrame, month: date) -> DataFrame:
    """user_id, label, income, spend, net, entries, top_category, top_merchant of the month of a date."""
    start = month.replace(day=1)
    rows = overview.between(ledger, start, date(start.year + start.month // 12, start.month % 12 + 1, 1) - timedelta(days=1))
    sums = overview.totals(rows, None, None)
    kind = overview.by_category(rows, None, None).groupBy("user_id").agg(F.min(F.struct((-F.col("total")).alias("t"), "category"))["category"].alias("top_category"))
    shop = overview.top_merchants(rows, None, None, 1).select("user_id", F.col("merchant").alias("top_merchant"))
    out = sums.join(kind, "user_id", "left").join(shop, "user_id", "left")
    return out.select("user_id", F.date_format(F.lit(start), "MMMM yyyy").alias("label"), "income", "spend", "net", "entries", "top_category", "top_merchant")


def monthly_with_tax(ledger: DataFrame, month: date, sections: DataFrame) -> DataFrame:
    """monthly with tax_sections (their names in order), tax_entries and tax_total of what counts towards a deduction
    (sections: simulation.tax_sections of the month's fiscal year)."""
    sums = sections.groupBy("user_id").agg(
        F.sort_array(F.collect_list("section")).alias("tax_sections"), F.sum("entries").alias("tax_entries"), F.sum("total").cast("decimal(29,4)").alias("tax_total")
    )
    out = monthly(ledger, month).join(sums, "user_id", "left")
    zero = {"tax_entries": F.lit(0).cast("long"), "tax_total": F.lit(0).cast("decimal(29,4)"), "tax_sections": F.array().cast("array<string>")}
    return out.withColumns({c: F.coalesce(c, v) for c, v in zero.items()})


def data(ledger: DataFrame, patterns: DataFrame, leaks: DataFrame, start: date, end: date) -> DataFrame:
    """user_id, income, spend, net, entries, prior_spend, change, recurring, patterns, leak_monthly, leaks of a period."""
    now = overview.totals(ledger, start, end).select("user_id", "income", "spend", "net", "entries")
    prior = overview.prior_window(ledger, start, end).select("user_id", "prior_spend", "change")
    fixed = patterns.groupBy("user_id").agg(F.sum(monthly_equivalent(F.col("amount"), F.col("period"))).cast("decimal(19,2)").alias("recurring"), F.count("*").alias("patterns"))
    lost = leaks.groupBy("user_id").agg(F.sum("monthly").cast("decimal(19,2)").alias("leak_monthly"), F.count("*").alias("leaks"))
    out = now.join(prior, "user_id", "left").join(fixed, "user_id", "left").join(lost, "user_id", "left")
    money = [F.coalesce(c, F.lit(0)).cast("decimal(19,2)").alias(c) for c in ("recurring", "leak_monthly")]
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("patterns", "leaks")]
    return out.select("user_id", "income", "spend", "net", "entries", F.coalesce("prior_spend", F.lit(0)).cast("decimal(29,4)").alias("prior_spend"), F.coalesce("change", F.lit(0.0)).alias("change"), *money, *counts)


_DELTA = "CAST(spend - prior_spend AS DECIMAL(29,4))"
_EXECUTIVE = (
    Rule("SUMMARY", "NO_ENTRIES", "entries = 0", (), "Nothing was booked in this period."),
    Rule("SUMMARY", "ENTRIES", "entries > 0", ("entries", "spend", "income"), "{0} entries: {1} spent against an income of {2}."),
    Rule("SUMMARY", "SPEND_ROSE", "prior_spend > 0 AND change >= 0", ("abs(change)", f"abs({_DELTA})"), "That is {0}% or {1} more than in the period before."),
    Rule("SUMMARY", "SPEND_FELL", "prior_spend > 0 AND change < 0", ("abs(change)", f"abs({_DELTA})"), "That is {0}% or {1} less than in the period before."),
    Rule("SUMMARY", "NET_POSITIVE", "net > 0", ("net",), "{0} was put aside."),
    Rule("SUMMARY", "NET_NEGATIVE", "net < 0", ("abs(net)",), "{0} more went out than came in."),
    Rule("SUMMARY", "TOP_CATEGORY", "top_category IS NOT NULL", ("top_total", "top_share"), "Most went to {top_category}: {0}, {1}% of all spend."),
    Rule("SUMMARY", "PROFILE", "profile <> 'STEADY'", (), "What marks the spending most: {profile}."),
    Rule("SUMMARY", "RECOVERABLE", "leak_monthly > 100", ("leak_monthly", "leak_monthly * 12"), "About {0} a month could be kept, {1} a year."),
)
_SIGNAL = (Rule("BEHAVIOUR", "SIGNAL", "true", ("value",), "{kind} ({severity})."),)
_BEHAVIOUR = (
    Rule("BEHAVIOUR", "MUCH_CHANGED", "prior_spend > 100 AND abs(change) >= 25", ("change",), "Spending is far from that of the period before: {0}%."),
    Rule("BEHAVIOUR", "CHANGED", "prior_spend > 100 AND abs(change) >= 10 AND abs(change) < 25", ("change",), "Spending differs from that of the period before: {0}%."),
    Rule("BEHAVIOUR", "CONCENTRATED", "top_share > 40", ("top_share",), "{top_category} alone is {0}% of all spend."),
    Rule("BEHAVIOUR", "STEADY", "signals = 0 AND NOT coalesce(prior_spend > 100 AND abs(change) >= 10, false) AND NOT coalesce(top_share > 40, false)", (), "Nothing out of the usual."),
)
_LEAK = (Rule("LEAKS", "LEAK", "true", ("monthly", "annual"), "{kind} ({severity}): {0} a month, {1} a year."),)
_RECURRING = (
    Rule("RECURRING", "NO_PATTERNS", "patterns = 0", (), "No recurring payments are known."),
    Rule("RECURRING", "PATTERNS", "patterns > 0", ("recurring", "recurring_annual", "patterns"), "{2} recurring payments bind {0} a month, {1} a year."),
    Rule("RECURRING", "LARGEST", "largest_amount IS NOT NULL", ("largest_amount",), "The largest is {largest}: {0} ({largest_period})."),
    Rule("RECURRING", "CANCELLABLE", "cancellable > 0", ("cancellable",), "{0} of them are easily cancelled."),
)
_OUTLOOK = (
    Rule("CONSEQUENCES", "OUTLAY", "dearest IS NOT NULL", ("dearest_annual", "dearest_opportunity"), "The dearest ones take {0} a year; invested, that would be {1} in ten years."),
    Rule("CONSEQUENCES", "EXAMPLE", "dearest IS NOT NULL", ("dearest_monthly", "dearest_one"), "{dearest} alone, {0} a month, would be {1}."),
)
_ADVICE = (
    Rule("RECOMMENDATIONS", "ADVICE", "monthly > 0", ("monthly",), "{action}: up to {0} a month."),
    Rule("RECOMMENDATIONS", "ADVICE", "monthly <= 0", (), "{action}."),
)


def facts(report: DataFrame, kinds: DataFrame, profiles: DataFrame, signals: DataFrame, patterns: DataFrame, dearest: DataFrame) -> DataFrame:
    """report (see data, with entries) widened to one row of all that the narrative's rules ask for: the largest
    category (kinds: user_id, category, total, share), profile, number of signals, the largest and cancellable
    patterns (as recurring.view has them), and what the dearest ones (simulation.consequences) come to."""
    c = F.col
    top = kinds.groupBy("user_id").agg(F.min(F.struct((-c("total")).alias("t"), category_order(c("category")).alias("o"), "category", "share")).alias("k"))
    top = top.select("user_id", c("k.category").alias("top_category"), (-c("k.t")).alias("top_total"), c("k.share").alias("top_share"))
    some = signals.groupBy("user_id").agg(F.count("*").alias("signals"))
    most = patterns.groupBy("user_id").agg(
        F.min(F.struct((-c("amount")).alias("a"), "key", "period", "merchant", "label")).alias("m"), F.count(F.when(c("cancellable"), 1)).alias("cancellable"), F.sum("annual").cast("decimal(29,2)").alias("recurring_annual"),
    )
    most = most.select("user_id", "cancellable", "recurring_annual", c("m.merchant").alias("largest"), (-c("m.a")).alias("largest_amount"), c("m.label").alias("largest_period"))
    first = F.min(F.struct("rank", "merchant", "monthly", "opportunity"))
    far = dearest.groupBy("user_id").agg(F.sum("year").cast("decimal(29,2)").alias("dearest_annual"), F.sum("opportunity").cast("decimal(29,2)").alias("dearest_opportunity"), first.alias("f"))
    far = far.select("user_id", "dearest_annual", "dearest_opportunity", c("f.merchant").alias("dearest"), c("f.monthly").alias("dearest_monthly"), c("f.opportunity").alias("dearest_one"))
    out = report
    for more in (top, profiles.select("user_id", "profile"), some, most, far):
        out = out.join(more, "user_id", "left")
    return out.withColumn("signals", F.coalesce("signals", F.lit(0)))


def narrative(known: DataFrame, signals: DataFrame, leaks: DataFrame, recommended: DataFrame) -> DataFrame:
    """user_id, section, place, item, code, figures, text: the report of each user of known (see facts) in
    sentences, in six sections; place orders rules within a section, item the findings under one rule."""
    users = known.select("user_id")
    out, start = None, 0
    for rows, rules in ((known, _EXECUTIVE), (signals, _SIGNAL), (known, _BEHAVIOUR), (leaks, _LEAK), (known, _RECURRING), (known, _OUTLOOK), (recommended, _ADVICE)):
        own = rows is known
        items = rows.withColumn("item", F.lit(0) if own else F.col("rank"))
        said = found(items if own else items.join(users, "user_id", "left_semi"), ["user_id", "item"], rules, start)
        out, start = (said if out is None else out.unionByName(said)), start + len(rules)
    return out.select("user_id", "section", "place", "item", "code", "figures", "text")


def goal_totals(goals: DataFrame) -> DataFrame:
    """user_id, target, current, percent over active goals."""
    rows = goals.where("state = 'ACTIVE'").groupBy("user_id").agg(F.sum("target").cast("decimal(19,2)").alias("target"), F.sum("current").cast("decimal(19,2)").alias("current"))
    return rows.withColumn("percent", F.when(F.col("target") > 0, quotient(F.col("current") * 100, F.col("target").cast("decimal(10,0)"))).otherwise(0).cast("decimal(19,2)"))
