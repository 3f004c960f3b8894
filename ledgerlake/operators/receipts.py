"""Receipts: lines of recognised text, merchant, total, date, and a check of the total against the items."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import clamp, tier
from ..functions.text import trimmed

# Words whose line names no merchant.
NOT_MERCHANT = (
    "welcome to", "welcome", "thank you for shopping", "total", "subtotal", "grand total", "net total", "balance due", "balance", "tax", "vat",
    "gst", "hst", "pst", "sgst", "cgst", "igst", "service charge", "receipt", "invoice", "bill", "order #", "order no", "order number", "store #",
    "store no", "store number", "register", "terminal", "thank you", "thanks for", "come again", "have a nice", "please come back", "visa",
    "mastercard", "american express", "amex", "discover", "debit", "credit card", "credit", "cash", "change", "payment", "paid", "tender",
    "contactless", "chip & pin", "approved", "date", "time", "cashier", "transaction", "approval", "auth code", "reference", "ref no", "ticket",
    "sequence", "item", "qty", "quantity", "price", "amount", "discount", "savings", "description", "unit", "each", "phone", "tel:", "fax:",
    "email:", "www.", "http", "contact us", "calories", "carbs", "protein",
)
# Patterns of address and contact lines.
ADDRESS = r"(?i)\b(st|ave|rd|blvd|dr|ln|ct|pl|way|hwy|pkwy|suite|ste|fl|floor|unit|apt|po\s+box)\b"
CONTACT = (
    r"(?i)GSTIN|GTIN|\bGST\b|\bCIN\b|\bPAN\b|\bTIN\b|\bEIN\b|VAT\s+REG|Tel\s*:|Ph\s*:|Fax\s*:|@|www\.|http|[0-9]{10,}|"
    r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]\b"
)
# The same words and patterns for a quick check: words that hold no other one (gst, vat, unit, www. and http say what ADDRESS
# and CONTACT say by them), whole words, labels before a colon, and what has six digits or more.
_WORDS = (*NOT_MERCHANT, "gtin", "@")
PLAIN_WORDS = tuple(w for w in _WORDS if not any(v != w and v in w for v in _WORDS))
WHOLE_WORDS = r"(?i)\b(?:st|ave|rd|blvd|dr|ln|ct|pl|way|hwy|pkwy|suite|ste|fl|floor|apt|po\s+box|cin|pan|tin|ein)\b"
LABELS = r"(?i)(?:tel|ph|fax)\s*:"
NUMBERS = r"[0-9]{10,}|(?i:\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]\b)"
# Spellings of a merchant on receipts, tried one after another.
SPELLINGS = (
    (r"STARBUCKS\s+COFFEE", "STARBUCKS"), (r"WAL[\-\s]+MART\s*SUPERCENTER", "WALMART"), (r"WAL[\-\s]+MART", "WALMART"), (r"MC\s*DONALD['S]*", "MCDONALDS"),
    (r"KFC\s+RESTAURANT", "KFC"), (r"SUBWAY\s+RESTAURANT", "SUBWAY"), (r"DOMINO['S]*\s+PIZZA", "DOMINOS"), (r"PIZZA\s+HUT\s+\w+", "PIZZA HUT"),
    (r"AMAZON\.COM", "AMAZON"), (r"TARGET\s+STORE", "TARGET"), (r"WHOLE\s+FOODS\s+MARKET", "WHOLE FOODS"), (r"COSTCO\s+WHOLESALE", "COSTCO"),
    (r"RELIANCE\s+FRESH", "RELIANCE FRESH"), (r"BIGBASKET\.COM", "BIGBASKET"), (r"SWIGGY\s+[A-Z]+", "SWIGGY"), (r"TATA\s+CLIQ", "TATACLIQ"),
    (r"^WELCOME\s+TO\s+", ""), (r"^THANK\s+YOU\s+FOR\s+VISITING\s+", ""), (r"^SHOP\s+AT\s+", ""),
)
# Labels of a total, and labels of other sums.
TOTAL_LABELS = (
    "grand total", "total due", "amount paid", "net total", "final total", "total payable", "amount payable", "net payable", "balance due",
    "amount due", "total amount", "net amount", "payable amount", "total",
)
OTHER_LABELS = (
    "vat", "tax", "cgst", "sgst", "igst", "service tax", "gst", "subtotal", "sub total", "sub-total", "subtot", "discount", "savings", "round off",
    "rounding", "coupon", "cashback", "cash back",
)
# Patterns of a total, in the order of trust, and of dates.
TOTALS = (
    r"(?i)(?:grand\s*total|net\s*payable|amount\s*payable|total\s*payable|bill\s*total|final\s*total)[^\d₹$]*[₹$]?\s*([0-9,]+(?:\.[0-9]{1,2})?)",
    r"(?i)total\s*[:\-]?\s*[₹$]?\s*([0-9,]+(?:\.[0-9]{1,2})?)",
    r"(?m)[₹$]\s*([0-9,]+\.[0-9]{2})\s*$",
)
ANY_AMOUNT = r"[₹$]?\s*([0-9,]+\.[0-9]{2})"
DATES = (
    r"\b(\d{1,2}[/\-]\d{1,2}[/\-]\d{4})\b",
    r"\b(\d{4}[/\-]\d{1,2}[/\-]\d{1,2})\b",
    r"(?i)\b(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{4})\b",
)
DATE_FORMATS = ("d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy")

# Dates of a recogniser's reply, in the order of trial.
REPLY_DATES = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "d/M/yyyy", "d MMM yyyy", "d MMMM yyyy")

LINE_HEIGHT, PLAIN_CONFIDENCE = 25, 0.80
#: A best merchant under the first score, or with the second best nearer than the other, is unsure.
LEAST_SCORE, NEAR = 0.40, 0.08


def text_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, top, height, confidence, line of plain text: 25 pixels to a line, blank ones counted but left out."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(\r?\n)+$", ""), r"\r?\n")
    # the height is made before the lines part, else each line would split its whole text again; an outer explode
    # loses nothing, as there is always a line, and spares a filter that splits once more
    rows = docs.select(key, lines.alias("_lines")).withColumn("height", F.size("_lines") * LINE_HEIGHT).select(key, "height", F.posexplode_outer("_lines").alias("at", "line"))
    return rows.select(key, (F.col("at") * LINE_HEIGHT).alias("top"), "height", F.lit(PLAIN_CONFIDENCE).alias("confidence"), trimmed(F.col("line")).alias("line")).where("line <> ''")


def tsv_lines(words: DataFrame, key: str) -> DataFrame:
    """key, top, height, confidence, line of recognised words (key, block, par, line, word, top, height of the
    document, conf, text): words in order joined, least top, mean confidence."""
    rows = words.where("conf >= 0 AND trim(text) <> ''").groupBy(key, "block", "par", "line")
    made = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ")
    return rows.agg(F.min("top").alias("top"), F.max("height").alias("height"), (F.avg("conf") / 100).alias("confidence"), made.alias("text_line")).select(key, "top", "height", "confidence", F.col("text_line").alias("line"))


def _count(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def names_no_merchant(c: Column) -> Column:
    """Whether a line holds a word of NOT_MERCHANT, ADDRESS or CONTACT, starts with a digit, or is mostly digits."""
    # the small text is a variable, so it is made once and not for each word
    words = F.exists(F.array(F.lower(c)), lambda t: reduce(lambda a, b: a | b, [t.contains(w) for w in PLAIN_WORDS]))
    digits = F.length(F.regexp_replace(c, "[^0-9]+", ""))
    return words | c.rlike("^[0-9]") | c.rlike(WHOLE_WORDS) | (c.contains(":") & c.rlike(LABELS)) | F.exists(F.array(digits), lambda n: (n > F.length(c) * 0.5) | ((n >= 6) & c.rlike(NUMBERS)))


def merchant_score(lines: DataFrame) -> DataFrame:
    """lines with score, 0 to 1: place near the top, confidence, capitals, length and letters."""
    c, size = F.col("line"), F.length("line")
    rows = lines.withColumn("_at", F.when(F.col("height") > 0, F.col("top") / F.col("height")).otherwise(0.0))
    letters, capitals = F.length(F.regexp_replace(c, r"\P{L}+", "")), F.length(F.regexp_replace(c, r"\P{Lu}+", ""))
    titled = _count(c, r"(?<!\S)\p{Lu}") / F.size(F.split(c, r"\s+")) >= 0.6
    score = (
        F.when(F.col("_at") <= 0.25, (1 - F.col("_at") / 0.25) * 0.35).otherwise(0.0)
        + F.least(F.lit(1.0), F.col("confidence")) * 0.30
        + F.when((letters >= 2) & (capitals / F.greatest(letters, F.lit(1)) >= 0.85), 0.20).when(titled, 0.10).otherwise(0.0)
        + F.when(size <= 30, 0.10).when(size <= 60, 0.04).otherwise(0.0)
        + F.when(letters / size >= 0.75, 0.05).otherwise(0.0)
    )
    return rows.withColumn("score", F.when((size < 4) | names_no_merchant(c), 0.0).otherwise(score)).drop("_at")


def merchant_name(c: Column) -> Column:
    for pattern, name in SPELLINGS:
        c = trimmed(F.regexp_replace(c, "(?i)" + pattern, name))
    return F.regexp_replace(trimmed(F.regexp_replace(c, r"^[^\w]+|[^\w)]+$", "")), r"\s{2,}", " ")


def best_merchant(scored: DataFrame, key: str, least: float = LEAST_SCORE, near: float = NEAR) -> DataFrame:
    """key, merchant, score, ambiguous (the second is near), escalate (too low or ambiguous)."""
    order = W.partitionBy(key).orderBy(F.desc("score"), "top", "line")
    rows = scored.where("score > 0").withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("r = 1")
    ambiguous = F.coalesce(F.col("score") - F.col("next") < near, F.lit(False))
    return rows.select(key, merchant_name(F.col("line")).alias("merchant"), "score", ambiguous.alias("ambiguous"), ((F.col("score") < least) | ambiguous).alias("escalate"))


def _amount(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(19,2)")


def receipt_total(text: Column) -> Column:
    """The last match of the most trusted pattern that matches, else the largest amount."""
    tried = [_amount(F.try_element_at(F.regexp_extract_all(text, F.lit(p), 1), F.lit(-1))) for p in TOTALS]
    return F.coalesce(*tried, F.array_max(F.transform(F.regexp_extract_all(text, F.lit(ANY_AMOUNT), 1), _amount)))


def receipt_date(text: Column, as_of: date) -> Column:
    """The first date that parses and is not after as_of."""
    out = []
    for p in DATES:
        found = F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
        parsed = F.coalesce(*[F.try_to_timestamp(found, F.lit(f)) for f in DATE_FORMATS]).cast("date")
        out.append(F.when(parsed <= F.lit(as_of), parsed))
    return F.coalesce(*out)


def corrupted(text: Column) -> Column:
    """Over 15 percent other than ASCII, a character five times in a row, or words shorter than 2 on average."""
    odd = _count(text, r"[^\x09\x0A\x0D\x20-\x7F]") / F.length(text) > 0.15
    words = F.split(trimmed(text), r"\s+")
    short = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) / F.size(words) < 2.0
    return F.coalesce((F.length(trimmed(text)) > 0) & (odd | text.rlike(r"([A-Za-z0-9])\1{4,}") | short), F.lit(False))


def _has(label: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [label.contains(w) for w in words])


def validate_total(receipts: DataFrame) -> DataFrame:
    """receipts (total, items array<struct<name,price>>) with amount, score, confidence.

    The given total and every item that is labelled as a sum are scored against the other items; the best
    score wins, the given total on a tie.
    """
    label = lambda i: F.lower(trimmed(i["name"]))
    is_sum = lambda i: _has(label(i), TOTAL_LABELS) | _has(label(i), OTHER_LABELS)
    valid = F.filter(F.coalesce("items", F.array().cast("array<struct<name:string,price:decimal(19,2)>>")), lambda i: i["name"].isNotNull() & (i["price"] > 0))
    rows = receipts.withColumn("_v", valid)
    rows = rows.withColumn("_goods", F.transform(F.filter("_v", lambda i: ~is_sum(i)), lambda i: i["price"])).withColumn("_sums", F.filter("_v", is_sum))
    rows = rows.withColumn("_goods_sum", F.when(F.size("_goods") > 0, F.aggregate("_goods", F.lit(0).cast("decimal(29,2)"), lambda s, p: (s + p).cast("decimal(29,2)")).cast("double")))
    total, goods = F.col("total").cast("double"), F.col("_goods_sum")
    ratio = total / goods
    own = 0.50 + F.when(goods.isNull(), 0.0).when(ratio < 0.30, -0.35).when(ratio < 0.85, -0.10).when(ratio <= 1.05, 0.15).when(ratio <= 1.35, 0.25).otherwise(-0.05)
    own = clamp(own + F.when(F.col("total") < F.array_max("_goods"), -0.30).otherwise(0.0))

    def line(i: Column) -> Column:
        near = F.coalesce((i["price"].cast("double") / goods).between(0.85, 1.35), F.lit(False))
        points = 0.40 + F.when(_has(label(i), TOTAL_LABELS), 0.40).otherwise(0.0) + F.when(_has(label(i), OTHER_LABELS), -0.40).otherwise(0.0)
        return F.struct(clamp(points + F.when(i["price"] >= F.col("total"), 0.05).otherwise(0.0) + F.when(near, 0.15).otherwise(0.0)).alias("score"), i["price"].alias("price"))

    scored = F.concat(F.array(F.struct(own.alias("score"), F.col("total").cast("decimal(19,2)").alias("price"))), F.transform("_sums", line))
    best = F.aggregate(scored, F.get(scored, 0), lambda b, x: F.when(x["score"] > b["score"], x).otherwise(b))
    rows = rows.withColumn("_best", F.when(F.col("total").isNotNull(), best))
    rows = rows.withColumn("amount", F.col("_best.price")).withColumn("score", F.coalesce(F.col("_best.score"), F.lit(0.0)))
    return rows.withColumn("confidence", tier(F.round("score", 9), (0.65, "HIGH"), (0.40, "MEDIUM"), other="LOW")).drop("_v", "_goods", "_sums", "_goods_sum", "_best")


#: Lines of a receipt that an interpreter gets, and names that are proposed to it.
MOST_LINES, HINTS = 25, 3
INTERPRETED = "merchant string, category string, confidence double"


def parse(docs: DataFrame, key: str, as_of: date, text: str = "text", interpret: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """key, amount, date, merchant, score, ambiguous, corrupted, escalated, category, currency, successful of plain
    receipts, by rules; key is one row's.

    A receipt is escalated if its text is corrupted, or its best merchant has a low score or a near rival.
    interpret: takes frames (text, hints) of escalated receipts only and gives frames (merchant, category,
    confidence) of the same length; a merchant that it tells replaces the rules' one, null keeps it. Texts that
    are blank or null have nothing, and no amount makes a receipt unsuccessful; without a date it is as_of's.
    """
    scored = merchant_score(text_lines(docs, key, text))
    order = W.partitionBy(key).orderBy(F.desc("score"), "top", "line")
    first = scored.where("score > 0").withColumn("r", F.row_number().over(order)).where(F.col("r") <= HINTS).groupBy(key)
    ranked = F.sort_array(F.collect_list(F.struct("r", "score", merchant_name(F.col("line")).alias("name"))))
    best = first.agg(ranked.alias("_n")).select(F.col(key).alias("_k"), "_n")
    content = F.coalesce(F.col(text), F.lit(""))
    filled = trimmed(content) != ""
    rows = docs.select(key, F.when(filled, content).alias("_text")).join(best, F.col(key) == F.col("_k"), "left")
    score, rival = F.get("_n", 0)["score"], F.get("_n", 1)["score"]
    rows = rows.select(
        key, "_text", receipt_total(F.col("_text")).alias("amount"), F.when(F.col("_text").isNotNull(), F.coalesce(receipt_date(F.col("_text"), as_of), F.lit(as_of))).alias("date"),
        F.get("_n", 0)["name"].alias("merchant"), score.alias("score"), F.coalesce(score - rival < NEAR, F.lit(False)).alias("ambiguous"), corrupted(F.col("_text")).alias("corrupted"),
        F.array_distinct(F.filter(F.transform("_n", lambda n: n["name"]), lambda n: n != "")).alias("_hints"),
    )
    low = F.coalesce((F.col("score") < LEAST_SCORE) | F.col("ambiguous"), F.lit(False))
    rows = rows.withColumn("escalated", F.col("_text").isNotNull() & (F.col("corrupted") | low)).withColumn("category", F.lit(None).cast("string"))
    if interpret is not None:
        rows = _interpreted(rows, interpret)
    done = [F.when(F.col("_text").isNotNull(), F.lit("INR")).alias("currency"), F.col("amount").isNotNull().alias("successful")]
    return rows.select(key, "amount", "date", "merchant", "score", "ambiguous", "corrupted", "escalated", "category", *done)


def _interpreted(rows: DataFrame, interpret: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """rows with the interpreter's merchant and category for escalated ones, in one pass over batches; it is
    started once for each partition, with an iterator, so it can hold what is dear to set up."""
    lines = F.filter(F.split("_text", r"\r?\n"), lambda x: trimmed(x) != "")
    rows = rows.withColumn("_asked", F.when(F.col("escalated"), F.array_join(F.slice(lines, 1, MOST_LINES), "\n")))
    names = rows.columns

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def questions() -> Iterator[pd.DataFrame]:
            for batch in batches:
                waiting.append(batch)
                asked = batch.filter(pa.compute.is_valid(batch.column("_asked")))
                if asked.num_rows:
                    yield pd.DataFrame({"text": asked.column("_asked").to_pylist(), "hints": [h or [] for h in asked.column("_hints").to_pylist()]})

        answers = interpret(questions())
        while True:
            answer = next(answers, None)  # pulls batches until there is a question
            for batch in waiting:
                at = np.flatnonzero(pa.compute.is_valid(batch.column("_asked")).to_numpy(zero_copy_only=False))
                columns = {n: batch.column(n).to_pylist() if n in ("merchant", "category") else batch.column(n) for n in names}
                if len(at):
                    if answer is None or len(answer) != len(at):
                        raise ValueError("an interpreter answers each frame of questions with a frame of the same length")
                    for i, merchant, category in zip(at.tolist(), answer["merchant"], answer["category"], strict=True):
                        if isinstance(merchant, str) and merchant.strip():
                            columns["merchant"][i] = merchant.strip()
                            columns["category"][i] = category if isinstance(category, str) else None
                yield pa.RecordBatch.from_arrays([pa.array(columns[n], batch.schema.field(n).type) if isinstance(columns[n], list) else columns[n] for n in names], names=names)
            waiting.clear()
            if answer is None:
                return

    return rows.mapInArrow(ask, rows.schema)


def from_reply(rows: DataFrame, as_of: date, column: str = "json") -> DataFrame:
    """rows with amount, date, merchant, address, confidence, confirm, successful of a recogniser's reply in JSON:
    the total checked against the items (see validate_total), a future or unreadable date null, texts cleaned
    and cut to 200 and 500 characters. Broken JSON gives nulls, unsuccessful."""
    kind = "merchant_name string, merchant_address string, transaction_date string, total_amount decimal(19,4), line_items array<struct<item_name:string,item_price:decimal(19,4)>>"
    clean = lambda c, most: F.nullif(F.substring(trimmed(F.regexp_replace(trimmed(c), r"[\p{Cntrl}&&[^\n\t\r]]", "")), 1, most), F.lit(""))
    made = rows.withColumn("_j", F.from_json(column, kind))
    made = made.withColumn("total", F.when(F.col("_j.total_amount") > 0, F.col("_j.total_amount").cast("decimal(19,2)")))
    made = made.withColumn("items", F.transform("_j.line_items", lambda i: F.struct(i["item_name"].alias("name"), i["item_price"].cast("decimal(19,2)").alias("price"))))
    day = F.coalesce(*[F.try_to_timestamp(trimmed(F.col("_j.transaction_date")), F.lit(f)) for f in REPLY_DATES]).cast("date")
    out = validate_total(made).withColumn("date", F.when(day <= F.lit(as_of), day))
    out = out.withColumn("merchant", clean(F.col("_j.merchant_name"), 200)).withColumn("address", clean(F.col("_j.merchant_address"), 500))
    low = F.col("confidence") == "LOW"
    return out.withColumn("confirm", low).withColumn("successful", F.coalesce(F.col("amount") > 0, F.lit(False))).select(*rows.columns, "amount", "date", "merchant", "address", "confidence", "confirm", "successful")


def parse_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with merchant, total and items of a recognised receipt in JSON; those with neither a merchant nor
    a positive total go. Unknown fields and broken text are left out."""
    kind = "merchant_name string, total_amount decimal(19,2), date string, line_items array<struct<item_name:string,item_quantity:string,item_price:decimal(15,2)>>"
    made = rows.withColumn("_j", F.from_json(column, kind, {"mode": "PERMISSIVE"}))
    named = F.nullif(trimmed(F.col("_j.merchant_name")), F.lit(""))
    items = F.transform("_j.line_items", lambda i: F.struct(i["item_name"].alias("name"), i["item_price"].cast("decimal(19,2)").alias("price")))
    out = made.withColumn("merchant", named).withColumn("total", F.when(F.col("_j.total_amount") > 0, F.col("_j.total_amount"))).withColumn("items", items).drop("_j")
    return out.where("merchant IS NOT NULL OR total IS NOT NULL")


def new_entries(receipts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Confirmed receipts that no ledger entry (with receipt_id) has taken yet, so a second confirm adds nothing."""
    return receipts.join(ledger.select("receipt_id").where("receipt_id IS NOT NULL").distinct(), "receipt_id", "left_anti")
