"""Queries of cleaning, parsing, balances, receipts, export and streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, text
from ..functions import vocabulary as V
from ..operators import balance, receipts
from ..sources import statements
from ..sources.ledger import test_ledger
from ..streaming import run, windows
from .catalog import query

#: Statement texts made of the customers, in words that both engines read alike.
RAW = """
CASE c_custkey % 12 WHEN 0 THEN 'UPI-Swiggy Instamart/' || c_name WHEN 1 THEN ' NEFT-HDFC0000123-AIRTEL ' WHEN 2 THEN 'www.netflix.com monthly plan'
  WHEN 3 THEN 'POS-4411223344/COFFEE HOUSE/' || c_mktsegment WHEN 4 THEN 'The Acme Pvt Ltd ' || c_mktsegment WHEN 5 THEN 'FOOBAR BAKERY 12345' WHEN 6 THEN 'Salary credited ' || c_mktsegment || '--'
  WHEN 7 THEN 'uber trip (US)  ' || c_name WHEN 8 THEN '123456789' WHEN 9 THEN '///---' WHEN 10 THEN NULL ELSE c_mktsegment || ' electricity bill payment' END
"""
CELL = "CASE c_custkey % 9 WHEN 0 THEN '₹1,50,000.50' WHEN 1 THEN ' $ 12.5 ' WHEN 2 THEN '-' WHEN 3 THEN 'abc' WHEN 4 THEN NULL WHEN 5 THEN '' WHEN 6 THEN CAST(-c_custkey AS VARCHAR(20)) || '.25' WHEN 7 THEN '0' ELSE CAST(c_custkey AS VARCHAR(20)) END"
DAY = "CASE c_custkey % 6 WHEN 0 THEN '25/12/2024' WHEN 1 THEN '2024-03-15' WHEN 2 THEN '1/6/2024' WHEN 3 THEN '31/02/2024' WHEN 4 THEN 'soon' ELSE NULL END"


def customers(spark: SparkSession, sf_dir: str, **made: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_custkey", *[F.expr(e.strip()).alias(k) for k, e in made.items()])


TRIM = r"regexp_replace({0}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def trim(x: str) -> str:
    return TRIM.format(x)


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


CLEAN = trim(sub(sub(sub(sub(trim("coalesce(raw, '')"), "(?i)[0-9]{9,20}|UPI/[A-Z0-9]+|REF[A-Z0-9]+|NEFT/[A-Z0-9]+|IMPS/[A-Z0-9]+", " "), "/[A-Z0-9]{6,}/", " "), r"\s{2,}", " "), r"[/@\-_]+$"))


@query(f"SELECT c_custkey, {CLEAN} AS description FROM (SELECT *, {RAW} AS raw FROM customer)")
def normalize_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir, raw=RAW).select("c_custkey", text.clean_description(F.col("raw")).alias("description"))


@query(rf"""
WITH t AS (SELECT c_custkey, regexp_split_to_array({sub(trim('raw'), '(?i)^(UPI-|NEFT-|IMPS-|VPA-|POS-|ATM-|ACH-|SI-|ECS-|DD-|NACH-)')}, '[/|\-]') AS parts FROM (SELECT *, {RAW} AS raw FROM customer)),
p AS (SELECT c_custkey, {trim('parts[1]')} AS a, {trim('parts[2]')} AS b FROM t)
SELECT c_custkey, CASE WHEN regexp_matches(a, '^[0-9\s]+$') THEN b WHEN length(a) >= 3 THEN a END AS merchant FROM p""")
def extract_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir, raw=RAW).select("c_custkey", text.merchant_of(F.col("raw")).alias("merchant"))


def brands(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{w}') THEN '{n.replace(chr(39), chr(39) * 2)}'" for w, n in V.BRANDS) + " END"


STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(lower(" + trim("coalesce(raw, '')") + r"), '^www\.', ''), '\.(com|in|co\.in|net|org|io|app|co|tv|me|edu|ai)\b', '', 'g'), '\b\d{5,}\b', '', 'g')"
CLEANED = trim(sub(sub(sub(sub(sub(STRIPPED, r"\b(upi|imps|neft|rtgs|ach|paytm|gpay|phonepe|bhim)[/\-:]?"), r"\(.*?\)", " "), r"[/_\-]+", " "), "[^a-z0-9 ]", " "), r"\s+", " "))
ENDINGS = "|".join(sorted(V.NOISE_ENDINGS, key=len, reverse=True))


@query(f"""
WITH t AS (SELECT c_custkey, {CLEANED} AS s FROM (SELECT *, {RAW} AS raw FROM customer)),
u AS (SELECT *, {trim(sub('s', f'(?:(?:^| )(?:{ENDINGS}))+$'))} AS z FROM t),
n AS (SELECT *, coalesce({brands('s')}, {brands('z')}) AS canonical_name, list_filter(string_split(z, ' '), lambda w: length(w) >= 2 AND NOT list_contains({list(V.STOPWORDS)}, w)) AS w FROM u)
SELECT c_custkey, canonical_name, CASE WHEN canonical_name IS NOT NULL THEN regexp_replace(lower(canonical_name), '[^a-z0-9]', '', 'g')
       WHEN len(w) = 0 THEN replace(z, ' ', '') WHEN length(w[1]) >= 12 OR len(w) = 1 THEN w[1] ELSE w[1] || w[2] END AS merchant_key FROM n""")
def merchant_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.with_merchant_key(customers(spark, sf_dir, raw=RAW), "raw").drop("raw")


def points(words: tuple[str, ...]) -> str:
    return " + ".join(f"CASE WHEN contains(h, '{w}') THEN {12 + 8 * (len(w) > 6)} ELSE 0 END" for w in words)


POINTS = ", ".join(f"{{'s': least(95, 45 + {points(w)}), 'o': {-at}, 'n': '{name}', 'p': {points(w)}}}" for at, (name, w) in enumerate(V.LEXICON.items()))


@query(f"""
WITH t AS (SELECT c_custkey, lower(coalesce(raw, '')) || ' ' || lower(c_mktsegment) AS h FROM (SELECT *, {RAW} AS raw FROM customer)),
b AS (SELECT c_custkey, list_sort(list_filter([{POINTS}], lambda x: x.p > 0), 'DESC')[1] AS best FROM t)
SELECT c_custkey, coalesce(best.n, 'UNCATEGORIZED') AS category, (coalesce(best.s, 25) / 100)::DECIMAL(5,4) AS confidence FROM b""")
def categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.with_category(customers(spark, sf_dir, description=RAW, merchant="c_mktsegment")).drop("description", "merchant")


BARE = r"regexp_replace(cell, '[₹$€£,\s]', '', 'g')"


@query(f"SELECT c_custkey, TRY_CAST({BARE} AS DECIMAL(19,4)) AS amount, coalesce({BARE} NOT IN ('', '-') AND TRY_CAST({BARE} AS DECIMAL(19,4)) IS NULL, false) AS bad FROM (SELECT *, {CELL} AS cell FROM customer)")
def parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cell")
    return customers(spark, sf_dir, cell=CELL).select("c_custkey", parsing.parse_money(c).alias("amount"), parsing.bad_money(c).alias("bad"))


@query(f"SELECT c_custkey, coalesce(try_strptime(cell, '%d/%m/%Y'), try_strptime(cell, '%Y-%m-%d'))::DATE AS day FROM (SELECT *, {DAY} AS cell FROM customer)")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir, cell=DAY).select("c_custkey", parsing.parse_date(F.col("cell")).alias("day"))


@query("""
WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal::DECIMAL(19,4) END AS a, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 50)::DECIMAL(19,4) END AS d,
                  CASE WHEN c_custkey % 5 = 0 THEN (c_custkey % 40)::DECIMAL(19,4) END AS c, CASE c_custkey % 7 WHEN 0 THEN ' CR' WHEN 1 THEN 'dr' WHEN 2 THEN 'what' ELSE '' END AS k FROM customer),
u AS (SELECT *, CASE WHEN d <> 0 THEN abs(d) END AS dd, CASE WHEN c <> 0 THEN abs(c) END AS cc FROM t)
SELECT c_custkey, CASE WHEN dd IS NOT NULL AND (cc IS NULL OR dd >= cc) THEN dd WHEN cc IS NOT NULL THEN cc ELSE abs(a) END::DECIMAL(19,4) AS amount,
       CASE WHEN dd IS NOT NULL AND (cc IS NULL OR dd >= cc) THEN true WHEN cc IS NOT NULL THEN false WHEN a IS NOT NULL AND trim(k) <> '' THEN lower(trim(k)) <> 'cr' WHEN a IS NOT NULL THEN a < 0 END AS is_debit FROM u""")
def resolve_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    money = lambda c: c.cast("decimal(19,4)")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    made = parsing.resolve_amount(
        F.when(k % 2 == 0, money(F.col("c_acctbal"))), F.when(k % 3 == 0, money(k % 50)), F.when(k % 5 == 0, money(k % 40)),
        F.when(k % 7 == 0, " CR").when(k % 7 == 1, "dr").when(k % 7 == 2, "what").otherwise(""),
    )
    return rows.select("c_custkey", made.alias("r")).select("c_custkey", "r.amount", "r.is_debit")


BALANCES = """
WITH s AS (SELECT o_custkey AS account, o_orderkey AS row_number, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS date, o_orderpriority AS description,
                  (CASE WHEN o_orderkey % 97 = 0 THEN 90000000 ELSE 0 END + (o_orderkey % 13) * 250)::DECIMAL(19,4) AS balance FROM orders),
d AS (SELECT *, row_number() OVER (PARTITION BY account, date, lower(description), balance ORDER BY row_number) AS n FROM s WHERE date IS NOT NULL),
c AS (SELECT *, balance - lag(balance) OVER (PARTITION BY account ORDER BY date, row_number) AS change FROM d WHERE n = 1),
m AS (SELECT account, list_sort(list(abs(change)) FILTER (change <> 0)) AS g FROM c GROUP BY account),
k AS (SELECT c.*, g[len(g) // 2 + 1] AS mid, CASE WHEN lower(description) LIKE '%ob%' THEN 'MARKER' WHEN change IS NULL THEN 'ANCHOR' WHEN change = 0 THEN 'NO_CHANGE' ELSE 'TRANSACTION' END AS kind FROM c JOIN m ON c.account = m.account)
SELECT account, row_number, kind, CASE WHEN kind = 'TRANSACTION' THEN round(abs(change), 2) END::DECIMAL(19,4) AS amount, CASE WHEN kind = 'TRANSACTION' THEN change < 0 END AS is_debit,
       coalesce(kind = 'TRANSACTION' AND abs(change) >= 1000 AND abs(change) > mid * 100, false) AS suspicious FROM k
UNION ALL SELECT account, row_number, CASE WHEN date IS NULL THEN 'MISSING' ELSE 'DUPLICATE' END, NULL, NULL, false FROM (SELECT account, row_number, date FROM s WHERE date IS NULL UNION ALL SELECT account, row_number, date FROM d WHERE n > 1)
"""


@query(BALANCES)
def balance_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("account"), k.alias("row_number"), F.when(k % 50 != 0, F.col("o_orderdate").cast("date")).alias("date"), F.col("o_orderpriority").alias("description"),
        (F.when(k % 97 == 0, 90000000).otherwise(0) + (k % 13) * 250).cast("decimal(19,4)").alias("balance"),
    )
    return balance.reconstruct(rows, ["account"]).select("account", "row_number", "kind", "amount", "is_debit", "suspicious")


EXPORT = '''
SELECT user_id, date, id, strftime(date, '%Y-%m-%d') || ',' || description || ',' || merchant || ',' || category || ',' || type || ',' || amount::VARCHAR || ',INR,CSV,false,' AS line
FROM (SELECT user_id, date, id, CASE WHEN id % 3 = 0 THEN chr(39) || '=' || description WHEN id % 3 = 1 THEN '"' || description || ', ""new""' || '"' ELSE description END AS description, merchant, category, type, amount
      FROM ledger WHERE date >= DATE '2001-06-01')
'''


@query(EXPORT)
def csv_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = test_ledger(spark, sf_dir).where(F.col("date") >= F.lit(date(2001, 6, 1)))
    third = F.col("id") % 3
    made = F.when(third == 0, F.concat(F.lit("="), "description")).when(third == 1, F.concat("description", F.lit(', "new"'))).otherwise(F.col("description"))
    return statements.export_lines(rows.withColumn("description", made))


LINES = r"""
WITH t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '(\r?\n)+$', ''), '\r\n', chr(10), 'g'), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, (len(l) * 25)::INT AS height, ((generate_subscripts(l, 1) - 1) * 25)::INT AS top, regexp_replace(unnest(l), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS line FROM t)
"""


@query(f"{LINES} SELECT doc_id, top, height, 0.8::DOUBLE AS confidence, line FROM x WHERE line <> ''")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.text_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


NOISE = " OR ".join("contains(lower(line), '%s')" % w for w in receipts.NOT_MERCHANT)
CASED = r"regexp_replace(line, '[^\p{L}]', '', 'g')"


SCORE = rf"""CASE WHEN n < 4 OR {NOISE} OR regexp_matches(line, '{receipts.ADDRESS}') OR regexp_matches(line, '{receipts.CONTACT}') OR regexp_matches(line, '^[0-9]') OR digits > n * 0.5 THEN 0
  ELSE CASE WHEN pos <= 0.25 THEN (1 - pos / 0.25::DOUBLE) * 0.35::DOUBLE ELSE 0 END + 0.8::DOUBLE * 0.3::DOUBLE
     + CASE WHEN letters >= 2 AND capitals / letters >= 0.85 THEN 0.2::DOUBLE WHEN len(list_filter(w, lambda z: regexp_matches(z, '^\p{{Lu}}'))) / len(w) >= 0.6 THEN 0.1::DOUBLE ELSE 0 END
     + CASE WHEN n <= 30 THEN 0.1::DOUBLE WHEN n <= 60 THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN letters / n >= 0.75 THEN 0.05::DOUBLE ELSE 0 END END"""


@query(rf"""{LINES.replace("coalesce(text, '')", "regexp_replace(coalesce(text, ''), '[^{0}]', 'x', 'g')".format(r"{0}x00-{0}x7F".format(chr(92))))},
y AS (SELECT doc_id, top, line, length(line) AS n, length({CASED}) AS letters, length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS capitals, top::DOUBLE / height AS pos, regexp_split_to_array(line, '\s+') AS w,
             length(regexp_replace(line, '[^0-9]', '', 'g')) AS digits FROM x WHERE line <> '')
SELECT doc_id, top, {SCORE} AS score FROM y""")
def merchant_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    # letters beyond ASCII become x: the engines differ in where a word with them ends
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    lines = receipts.text_lines(docs, "doc_id")
    return receipts.merchant_score(lines).select("doc_id", "top", "score")


RECEIPT = "CASE o_orderkey % 6 WHEN 0 THEN 'GRAND TOTAL ' || CAST(o_orderkey AS VARCHAR(20)) || '.75 on 25/12/2024' WHEN 1 THEN 'Net Payable: 1,250.00 dated 2024-03-15' WHEN 2 THEN 'Total: 50.00 then total 60.5 5 Jan 2024' WHEN 3 THEN 'milk 12.50 bread 95.50' WHEN 4 THEN 'nothing 01/01/2099' ELSE NULL END"


@query(rf"""
WITH t AS (SELECT o_orderkey, {RECEIPT} AS text FROM orders)
SELECT o_orderkey, coalesce(TRY_CAST(replace(regexp_extract_all(text, '{receipts.TOTALS[0]}', 1)[-1], ',', '') AS DECIMAL(19,2)), TRY_CAST(replace(regexp_extract_all(text, '{receipts.TOTALS[1]}', 1)[-1], ',', '') AS DECIMAL(19,2)),
       list_max(list_transform(regexp_extract_all(text, '{receipts.ANY_AMOUNT}', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DECIMAL(19,2))))) AS total,
       CASE o_orderkey % 6 WHEN 0 THEN DATE '2024-12-25' WHEN 1 THEN DATE '2024-03-15' WHEN 2 THEN DATE '2024-01-05' END AS day FROM t""")
def receipt_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(RECEIPT).alias("text"))
    return rows.select("o_orderkey", receipts.receipt_total(F.col("text")).alias("total"), receipts.receipt_date(F.col("text"), date(2025, 1, 1)).alias("day"))


#: Receipts of all kinds, made of the orders: sure, ambiguous, corrupted and low merchants, blank and missing texts.
SLIP = f"""CASE o_orderkey % 8 WHEN 0 THEN 'STARBUCKS COFFEE' || chr(10) || '12 Main St' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || {RECEIPT}
  WHEN 1 THEN 'Corner Bakery' || chr(10) || 'Little Stall' || repeat(chr(10) || 'x', 20) || chr(10) || {RECEIPT} WHEN 2 THEN 'zzzzzzz market' || chr(10) || {RECEIPT} WHEN 3 THEN chr(10) || chr(10) || chr(10) || 'some old small place where nobody ever goes at night or by day, really' || chr(10) || {RECEIPT}
  WHEN 4 THEN 'FRESH MART ' || o_orderpriority || chr(10) || 'q' || chr(10) || 'r' || chr(10) || 's' || chr(10) || {RECEIPT} WHEN 5 THEN '   ' WHEN 6 THEN 'a b c d e f g h' ELSE {RECEIPT} END"""


def named_sql(c: str) -> str:
    """receipts.merchant_name in SQL."""
    trim = lambda x: rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
    for pattern, name in receipts.SPELLINGS:
        c = trim("regexp_replace({}, '(?i){}', '{}', 'g')".format(c, pattern.replace("'", "''"), name))
    return rf"regexp_replace({trim(rf"regexp_replace({c}, '^[^\w]+|[^\w)]+$', '', 'g')")}, '\s{{2,}}', ' ', 'g')"


@query(rf"""
WITH d AS (SELECT o_orderkey AS doc_id, {SLIP} AS text FROM orders),
t AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(\r?\n)+$', ''), chr(10)) AS l FROM d),
x AS (SELECT doc_id, (len(l) * 25)::INT AS height, ((generate_subscripts(l, 1) - 1) * 25)::INT AS top, regexp_replace(unnest(l), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS line FROM t),
y AS (SELECT doc_id, top, line, length(line) AS n, length({CASED}) AS letters, length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS capitals, top::DOUBLE / height AS pos, regexp_split_to_array(line, '\s+') AS w,
             length(regexp_replace(line, '[^0-9]', '', 'g')) AS digits FROM x WHERE line <> ''),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, top, line) AS r, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, top, line) AS rival FROM (SELECT doc_id, top, line, {SCORE} AS score FROM y) WHERE score > 0),
f AS (SELECT doc_id, CASE WHEN trim(text) <> '' THEN text END AS text FROM d),
g AS (SELECT f.doc_id, text, {named_sql("line")} AS merchant, score, coalesce(score - rival < 0.08::DOUBLE, false) AS ambiguous,
      coalesce(regexp_matches(text, '{"|".join(f"{ch}{{5}}" for ch in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")}')
        OR list_sum(list_transform(regexp_split_to_array(trim(text), '\s+'), lambda v: length(v)))::DOUBLE / len(regexp_split_to_array(trim(text), '\s+')) < 2, false) AS corrupted
      FROM f LEFT JOIN z ON f.doc_id = z.doc_id AND r = 1)
SELECT doc_id AS o_orderkey, coalesce(TRY_CAST(replace(regexp_extract_all(text, '{receipts.TOTALS[0]}', 1)[-1], ',', '') AS DECIMAL(19,2)), TRY_CAST(replace(regexp_extract_all(text, '{receipts.TOTALS[1]}', 1)[-1], ',', '') AS DECIMAL(19,2)),
       list_max(list_transform(regexp_extract_all(text, '{receipts.ANY_AMOUNT}', 1), lambda v: TRY_CAST(replace(v, ',', '') AS DECIMAL(19,2))))) AS amount,
       CASE WHEN text IS NULL THEN NULL WHEN text LIKE '%25/12/2024%' THEN DATE '2024-12-25' WHEN text LIKE '%2024-03-15%' THEN DATE '2024-03-15' WHEN text LIKE '%5 Jan 2024%' THEN DATE '2024-01-05' ELSE DATE '2025-01-01' END AS date,
       merchant, round(score, 6) AS score, ambiguous, corrupted, text IS NOT NULL AND (corrupted OR coalesce(score < 0.4::DOUBLE OR ambiguous, false)) AS escalated
FROM g""")
def receipt_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts from text to amount, date and merchant, and which ones an interpreter would be asked about."""
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(SLIP).alias("text"))
    rows = receipts.parse(docs, "o_orderkey", date(2025, 1, 1))
    return rows.select("o_orderkey", "amount", "date", "merchant", F.round("score", 6).alias("score"), "ambiguous", "corrupted", "escalated")


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.when(F.col("l_linenumber") == 1, "Grand Total").when(F.col("l_linenumber") == 2, "VAT").otherwise("thing")
    items = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(name.alias("name"), F.col("l_extendedprice").cast("decimal(19,2)").alias("price")))).alias("items"))
    total = F.when(F.col("l_orderkey") % 10 != 0, (F.col("l_orderkey") * 11 % 200000 + 1).cast("decimal(19,2)"))
    return items.select("l_orderkey", total.alias("total"), "items")


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber AS n, l_extendedprice::DECIMAL(19,2) AS price FROM lineitem WHERE l_extendedprice > 0),
g AS (SELECT l_orderkey, CASE WHEN l_orderkey % 10 <> 0 THEN (l_orderkey * 11 % 200000 + 1)::DECIMAL(19,2) END AS total FROM lineitem GROUP BY l_orderkey),
r AS (SELECT g.*, s::DOUBLE AS goods, most FROM g LEFT JOIN (SELECT l_orderkey, sum(price) AS s, max(price) AS most FROM i WHERE n > 2 GROUP BY 1) z ON g.l_orderkey = z.l_orderkey),
o AS (SELECT l_orderkey, total, goods, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN goods IS NULL THEN 0 WHEN total / goods < 0.3 THEN -0.35::DOUBLE WHEN total / goods < 0.85 THEN -0.1::DOUBLE
        WHEN total / goods <= 1.05 THEN 0.15::DOUBLE WHEN total / goods <= 1.35 THEN 0.25::DOUBLE ELSE -0.05::DOUBLE END + CASE WHEN total < most THEN -0.3::DOUBLE ELSE 0 END)) AS score FROM r WHERE total IS NOT NULL),
a AS (SELECT l_orderkey, total AS price, score, 0 AS k FROM o
      UNION ALL SELECT i.l_orderkey, price, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE + CASE WHEN n = 1 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN n = 2 THEN -0.4::DOUBLE ELSE 0 END + CASE WHEN price >= total THEN 0.05::DOUBLE ELSE 0 END
        + CASE WHEN price / goods BETWEEN 0.85 AND 1.35 THEN 0.15::DOUBLE ELSE 0 END)), 1 FROM i JOIN o ON i.l_orderkey = o.l_orderkey WHERE n <= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(score, 9) DESC, k, price) AS r FROM a)
SELECT g.l_orderkey, b.price AS amount, round(coalesce(b.score, 0), 6) AS score, CASE WHEN round(coalesce(b.score, 0), 9) >= 0.65 THEN 'HIGH' WHEN round(b.score, 9) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM g LEFT JOIN b ON g.l_orderkey = b.l_orderkey AND r = 1""")
def amount_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.validate_total(items_of(spark, sf_dir)).select("l_orderkey", "amount", F.round("score", 6).alias("score"), "confidence")


#: A letter or digit five times in a row, without a back reference.
REPEATED = "|".join(f"{ch}{{5}}" for ch in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


@query(rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {trim("coalesce(text, '')")} AS bare FROM documents)
SELECT doc_id, length(bare) > 0 AND (length(regexp_replace(text, '[\x09\x0A\x0D\x20-\x7F]', '', 'g'))::DOUBLE / length(text) > 0.15 OR regexp_matches(text, '{REPEATED}')
       OR length(regexp_replace(bare, '[ \t\n\x0B\f\r]+', '', 'g'))::DOUBLE / len(regexp_split_to_array(bare, '[ \t\n\x0B\f\r]+')) < 2) AS corrupted FROM t""")
def ocr_corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a recogniser garbled."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", receipts.corrupted(F.coalesce("text", F.lit(""))).alias("corrupted"))


# streams over the events table; each runs to its end and gives what its state holds


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, whether it is one file or a folder of part files."""
    place = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(place).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    folder = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory()
    rows = reader.parquet(place) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS count, greatest(0, count(*) - 30) AS rejected FROM events GROUP BY 1, 2")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = run.drained(windows.rate_windows(events_stream(spark, sf_dir), "user_id", "upload"), "rate-windows", "complete")
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT user_id, ts::DATE AS day, event_type AS category, sum(value::DECIMAL(19,4))::DECIMAL(29,4) AS spend, count(*) AS entries FROM events GROUP BY 1, 2, 3")
def daily_stream_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_stream(spark, sf_dir).select("user_id", "ts", F.col("event_type").alias("category"), F.col("value").cast("decimal(19,4)").alias("amount"))
    return run.drained(windows.daily_spend(events), "daily-spend", "complete")


@query("SELECT DISTINCT user_id, event_type AS kind FROM events WHERE value > 50")
def new_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_stream(spark, sf_dir).select("user_id", "ts", F.col("event_type").alias("kind"), F.when(F.col("value") > 50, "HIGH").otherwise("LOW").alias("severity"))
    return run.drained(windows.new_signals(rows, late="60 days"), "new-signals").select("user_id", "kind")
