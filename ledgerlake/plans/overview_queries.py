"""Queries of whole overviews and reports, and of the real word lists over a ledger with telling texts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.numbers import rupees
from ..functions.periods import PRESETS, preset
from ..operators import leaks, overview, recurring, reports
from ..sources.ledger import test_ledger
from . import simulation as S
from .catalog import AS_OF, END, JUNE, LEDGER_SQL, PATTERNS, RECENT, ROUND1, START, TREND, div, query
from .text_queries import CLEANED, ENDINGS, brands, sub, trim

M4 = "DECIMAL(29,4)"
NAMES = ("NETFLIX.COM", "www.netflix.com", "UPI-Swiggy Instamart", "swiggy order 99887766", "AIRTEL_POSTPAID", "POS/COFFEE HOUSE/MUMBAI", "Coffee House Delhi", "12345678", "Acme Gym Pvt Ltd", "ACME GYM", "City Bank", "uber trip (IN)")
PHRASES = ("monthly plan", "ATM fee for withdrawal", "LIC premium", "Star Health mediclaim", "SIP mutual fund", "late  payment charge", "groceries", "PPF deposit", "annual charge of card", "coffee")


def telling_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test ledger with merchants and descriptions that the word lists know."""
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))
    rows = test_ledger(spark, sf_dir)
    return rows.withColumn("description", pick(PHRASES, F.col("id") % 10)).withColumn("merchant", pick(NAMES, F.floor(F.col("id") / 10) % 12))


TELLING = f"""WITH plain AS (WITH {LEDGER_SQL} SELECT * FROM ledger),
ledger AS (SELECT * REPLACE (list_extract({list(PHRASES)}, (id % 10 + 1)::INT) AS description, list_extract({list(NAMES)}, ((id // 10) % 12 + 1)::INT) AS merchant) FROM plain)"""


def telling(sql: str) -> str:
    return TELLING + sql


KEYED = rf"""
, k0 AS (SELECT *, {CLEANED.replace("raw", "merchant")} AS s0 FROM ledger), k1 AS (SELECT *, {trim(sub('s0', f'(?:(?:^| )(?:{ENDINGS}))+$'))} AS z0 FROM k0),
k2 AS (SELECT *, coalesce({brands('s0')}, {brands('z0')}) AS canonical_name, list_filter(string_split(z0, ' '), lambda w: length(w) >= 2 AND NOT list_contains({list(V.STOPWORDS)}, w)) AS w0 FROM k1),
k3 AS (SELECT *, CASE WHEN canonical_name IS NOT NULL THEN regexp_replace(lower(canonical_name), '[^a-z0-9]', '', 'g') WHEN len(w0) = 0 THEN replace(z0, ' ', '')
       WHEN length(w0[1]) >= 12 OR len(w0) = 1 THEN w0[1] ELSE w0[1] || w0[2] END AS mkey FROM k2),
nm AS (SELECT user_id, mkey, coalesce(max(known), min(merchant) FILTER (n = most)) AS merchant FROM (SELECT *, max(n) OVER (PARTITION BY user_id, mkey) AS most FROM (
       SELECT user_id, mkey, merchant, count(*) AS n, max(canonical_name) AS known FROM k3 WHERE type = 'DEBIT' AND date BETWEEN DATE '1999-06-30' AND DATE '2001-06-30' GROUP BY ALL)) GROUP BY 1, 2),
pk AS (WITH ledger AS (SELECT * FROM k3 WHERE length(mkey) >= 3){PATTERNS.replace("merchant AS key", "mkey AS key").replace("PARTITION BY user_id, merchant ORDER BY date", "PARTITION BY user_id, mkey ORDER BY date")} SELECT * FROM p)
"""


@query(telling(f"{KEYED} SELECT pk.* EXCLUDE (label, yearly, nominal, merchant), nm.merchant FROM pk JOIN nm ON pk.user_id = nm.user_id AND pk.key = nm.mkey"))
def recurring_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring payments by the key that spellings of a merchant share."""
    return recurring.detect(telling_ledger(spark, sf_dir), AS_OF)


@query(telling(rf"""{RECENT} SELECT user_id, merchant, count(*) AS charges, sum(amount)::{M4} AS total FROM e WHERE regexp_matches(description || ' ' || merchant, '{V.FEES}') GROUP BY 1, 2"""))
def bank_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank fees by the list of fee words."""
    return leaks.fee_items(leaks.recent(telling_ledger(spark, sf_dir), AS_OF))


DEDUCTIBLE = " UNION ALL ".join(
    f"SELECT user_id, '{s}' AS section, {'NULL' if most is None else most}::{M4} AS most, amount FROM d WHERE regexp_matches(merchant || ' ' || description, '{p}')" for s, most, p in V.TAX_SECTIONS
)
TAXES = rf""", d AS (SELECT * FROM ledger WHERE type = 'DEBIT' AND date BETWEEN DATE '2001-04-01' AND DATE '2001-06-30'),
tx AS (SELECT user_id, section, count(*) AS entries, sum(amount)::{M4} AS total, greatest(0, max(most) - sum(amount))::{M4} AS remaining FROM ({DEDUCTIBLE}) GROUP BY user_id, section)"""


@query(telling(f"{TAXES} SELECT user_id, section, entries, total, CASE WHEN remaining IS NOT NULL THEN remaining END AS remaining FROM tx"))
def deductible_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of the fiscal year by the word lists of tax sections."""
    return S.tax_sections(telling_ledger(spark, sf_dir), AS_OF)


@query(telling(f"""{TAXES},
s AS (SELECT user_id, coalesce(sum(amount) FILTER (type = 'CREDIT'), 0)::{M4} AS income, coalesce(sum(amount) FILTER (type = 'DEBIT'), 0)::{M4} AS spend, count(*) AS entries FROM ledger WHERE {JUNE} GROUP BY user_id),
x AS (SELECT user_id, string_agg(section, ',' ORDER BY section) AS tax_sections, sum(entries)::BIGINT AS tax_entries, sum(total)::{M4} AS tax_total FROM tx GROUP BY 1)
SELECT user_id, income, spend, entries, coalesce(tax_sections, '') AS tax_sections, coalesce(tax_entries, 0) AS tax_entries, coalesce(tax_total, 0)::{M4} AS tax_total FROM s LEFT JOIN x USING (user_id)"""))
def monthly_tax_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """June's report with what counts towards deductions."""
    ledger = telling_ledger(spark, sf_dir)
    rows = reports.monthly_with_tax(ledger, AS_OF, S.tax_sections(ledger, AS_OF))
    return rows.select("user_id", "income", "spend", "entries", F.array_join("tax_sections", ",").alias("tax_sections"), "tax_entries", "tax_total")


@query(f"""{TREND},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month DESC) AS n FROM t),
a AS (SELECT user_id, {div("sum(spend)", "count(*)")} AS spend, {div("sum(income)", "count(*)")} AS income FROM r WHERE n <= 3 GROUP BY user_id)
SELECT user_id, month, spend, income, net, false AS forecast FROM t UNION ALL
SELECT user_id, month, spend::{M4}, income::{M4}, (income - spend)::{M4}, true FROM a, (VALUES (DATE '2001-07-01'), (DATE '2001-08-01'), (DATE '2001-09-01')) AS v(month)""")
def trend_and_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve months of history and three ahead in one series."""
    return overview.trend_with_forecast(test_ledger(spark, sf_dir), AS_OF, 12)


LISTS = f"""
, h AS (SELECT user_id, category, {div("sum(amount)", "3")} AS average FROM ledger WHERE type = 'DEBIT' AND date BETWEEN DATE '2001-03-01' AND DATE '2001-05-31' GROUP BY 1, 2),
n AS (SELECT user_id, category, sum(amount) AS current FROM ledger WHERE type = 'DEBIT' AND {JUNE} GROUP BY 1, 2),
q AS (SELECT *, {ROUND1.format("(current::DOUBLE / average::DOUBLE - 1) * 100")} AS change FROM n JOIN h USING (user_id, category) WHERE average <> 0 AND current >= 200 AND current::DOUBLE / average::DOUBLE >= 1.3),
m AS (SELECT user_id, merchant, sum(amount) AS total FROM ledger WHERE type = 'DEBIT' AND {JUNE} AND merchant <> '' GROUP BY 1, 2),
l AS (SELECT user_id, 'CATEGORY' AS list, row_number() OVER (PARTITION BY user_id ORDER BY current DESC, category) AS place, category AS name, current::{M4} AS figure, 99 AS most FROM n
      UNION ALL SELECT user_id, 'MERCHANT', row_number() OVER (PARTITION BY user_id ORDER BY total DESC, merchant), merchant, total::{M4}, 8 FROM m
      UNION ALL SELECT user_id, 'ALERT', row_number() OVER (PARTITION BY user_id ORDER BY change DESC, category), category, change::{M4}, 3 FROM q)
SELECT user_id, list, place::INT AS place, name, figure FROM l WHERE place <= most"""


@query(LISTS)
def overview_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of each user's overview of June, entry by entry."""
    rows = overview.full(test_ledger(spark, sf_dir), START, END, END)
    of = lambda name, column, what, figure: F.transform(column, lambda x, i: F.struct(F.lit(name).alias("list"), (i + 1).alias("place"), x[what].alias("name"), x[figure].cast("decimal(29,4)").alias("figure")))
    return rows.select("user_id", F.inline(F.concat(of("CATEGORY", "categories", "category", "total"), of("MERCHANT", "merchants", "merchant", "total"), of("ALERT", "alerts", "category", "change"))))


@query(f"""
, v AS (SELECT * FROM (VALUES ('LAST_7_DAYS', DATE '2001-06-30' - 6, DATE '2001-06-30'), ('LAST_30_DAYS', DATE '2001-06-30' - 29, DATE '2001-06-30'),
  ('LAST_90_DAYS', DATE '2001-06-30' - 89, DATE '2001-06-30'), ('THIS_MONTH', DATE '2001-06-01', DATE '2001-06-30'), ('LAST_MONTH', DATE '2001-05-01', DATE '2001-05-31'),
  ('THIS_YEAR', DATE '2001-01-01', DATE '2001-06-30'), ('CUSTOM', DATE '2001-02-03', DATE '2001-03-04')) AS t(name, first, last))
SELECT name, user_id, count(*) AS entries, coalesce(sum(amount) FILTER (type = 'DEBIT'), 0)::{M4} AS spend FROM v JOIN ledger ON date BETWEEN first AND last GROUP BY 1, 2""")
def date_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and spend of each user in each named range: one pass, an entry counts in every range it is in."""
    ranges = {p: preset(p, AS_OF, date(2001, 2, 3), date(2001, 3, 4)) for p in PRESETS}
    rows = overview.between(test_ledger(spark, sf_dir), min(a for a, _ in ranges.values()), max(b for _, b in ranges.values()))
    inside = F.array_compact(F.array(*[F.when(F.col("date").between(F.lit(a), F.lit(b)), F.lit(p)) for p, (a, b) in ranges.items()]))
    spend = F.coalesce(F.sum(overview.of_type("DEBIT")), F.lit(0)).cast("decimal(29,4)")
    return rows.select("user_id", "type", "amount", F.explode(inside).alias("name")).groupBy("name", "user_id").agg(F.count("*").alias("entries"), spend.alias("spend"))


SHOWN = "CASE id % 4 WHEN 0 THEN amount * 300 WHEN 1 THEN -amount ELSE amount / (id % 4 * 50) END"
DIGITS = "round(abs(x), 0)::DECIMAL(29,0)::VARCHAR"


@query(rf"""
, a AS (SELECT id, ({SHOWN})::{M4} AS x FROM ledger WHERE {JUNE}), g AS (SELECT *, {DIGITS} AS d FROM a),
w AS (SELECT *, CASE WHEN x < 0 AND d <> '0' THEN '-₹' ELSE '₹' END || CASE WHEN length(d) <= 3 THEN d ELSE ltrim(reverse(regexp_replace(reverse(d[:-4]), '(..)', '\1,', 'g')), ',') || ',' || d[-3:] END AS plain FROM g)
SELECT id, plain, CASE WHEN abs(x) >= 10000000 THEN '₹' || round(x / 10000000, 1)::DECIMAL(29,1)::VARCHAR || 'Cr' WHEN abs(x) >= 100000 THEN '₹' || ({div("x", "100000", 1)})::DECIMAL(29,1)::VARCHAR || 'L'
       WHEN abs(x) >= 1000 THEN '₹' || ({div("x", "1000", 1)})::DECIMAL(29,1)::VARCHAR || 'K' ELSE plain END AS compact FROM w""")
def rupee_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as they are shown, whole and compact."""
    rows = overview.between(test_ledger(spark, sf_dir), START, END).select("id", F.expr(SHOWN).cast("decimal(29,4)").alias("x"))
    return rows.select("id", rupees(F.col("x")).alias("plain"), rupees(F.col("x"), compact=True).alias("compact"))
