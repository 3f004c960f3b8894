"""Recurring patterns, leaks and receipts on small ledgers."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.text import with_merchant_key
from ledgerlake.operators import leaks, receipts, recurring

AS_OF = date(2026, 6, 30)
LEDGER = "id long, user_id long, amount decimal(19,4), date date, description string, merchant string, category string, type string"


def ledger(spark, rows):
    return spark.createDataFrame([(i, 1, Decimal(a), d, "", m, c, "DEBIT") for i, (a, d, m, c) in enumerate(rows)], LEDGER)


@pytest.mark.parametrize("days,period", [(7, "WEEKLY"), (14, "BIWEEKLY"), (28, "MONTHLY"), (31, "MONTHLY"), (91, "QUARTERLY"), (365, "ANNUAL"), (50, None), (1, None)])
def test_periods(spark, days, period):
    rows = [(100, AS_OF - timedelta(days * k), "Netflix", "SUBSCRIPTIONS") for k in range(2)]
    got = recurring.detect(with_merchant_key(ledger(spark, rows)), AS_OF).collect()
    assert [r.period for r in got] == ([period] if period else [])


def test_confidence_and_view(spark):
    rows = [(500, AS_OF - timedelta(30 * k), "NETFLIX.COM", "SUBSCRIPTIONS") for k in range(6)]
    row = recurring.view(recurring.detect(with_merchant_key(ledger(spark, rows)), AS_OF), AS_OF).first()
    assert (row.merchant, row.payments, float(row.confidence), row.cancellable) == ("Netflix", 6, 1.0, True)
    assert (row.status, row.monthly, row.annual) == ("ACTIVE", Decimal("500.00"), Decimal("6000.00"))


def test_merge_keeps_what_users_said(spark):
    found = recurring.detect(with_merchant_key(ledger(spark, [(100, AS_OF - timedelta(30 * k), m, "SUBSCRIPTIONS") for k in range(4) for m in ("Netflix", "Spotify")])), AS_OF)
    stored = found.where("key = 'netflix'").withColumn("amount", F.lit(5).cast("decimal(19,4)")).withColumn("dismissed", F.lit(True)).withColumn("confirmed", F.lit(False))
    rows = {r.key: r for r in recurring.merge(stored, found).collect()}
    assert rows["netflix"].dismissed and rows["netflix"].amount == 5 and not rows["spotify"].dismissed
    actions = spark.createDataFrame([(1, "netflix", "MONTHLY", 1, "restore"), (1, "netflix", "MONTHLY", 2, "confirm")], "user_id long, key string, period string, at int, action string")
    one = recurring.apply_actions(stored, actions).first()
    assert (one.dismissed, one.confirmed) == (False, True)


def test_keys_are_made_of_sums_and_not_of_rows(spark):
    names = ("NETFLIX.COM", "www.netflix.com", "Acme Gym Pvt Ltd", "ACME GYM", "12345678", "ab", " ")
    made = [(100 + k % 3, AS_OF - timedelta(30 * (k // 7) + (k % 7 == 1)), names[k % 7], ("OTHER", "SUBSCRIPTIONS", None)[k % 3]) for k in range(70)]
    rows = ledger(spark, made).unionByName(ledger(spark, made[:20]))
    found = recurring.detect(rows, AS_OF)
    got = sorted(map(str, found.collect()))
    assert got == sorted(map(str, recurring.detect(with_merchant_key(rows), AS_OF).collect())) and len(got) == 1
    acme = found.where("key = 'acmegym'").first()
    assert (acme.payments, acme.period, acme.merchant) == (26, "MONTHLY", "ACME GYM")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "regexp_replace" not in plan[plan.rindex("Aggregate") :].split("\n", 1)[1]


@pytest.mark.parametrize("visits,amount,found", [(8, "500", True), (7, "500", False), (8, "500.01", False), (9, "499.99", False), (10, "450", True)])
def test_small_drains(spark, visits, amount, found):
    rows = ledger(spark, [(amount, AS_OF - timedelta(k), "Cafe", "FOOD_DINING") for k in range(visits)])
    got = leaks.drain_items(leaks.recent(rows, AS_OF)).collect()
    assert bool(got) == (found and visits * float(amount) / 3 >= 1500 or (visits * float(amount) / 3 >= 1500 and visits >= 8 and float(amount) <= 500))


def test_fees_without_merchant(spark):
    rows = spark.createDataFrame([(1, 1, Decimal(50), AS_OF, "late fee", None, None, "DEBIT"), (2, 1, Decimal(9), AS_OF, "coffee", "x", None, "DEBIT")], LEDGER)
    assert [(r.merchant, r.charges) for r in leaks.fee_items(leaks.recent(rows, AS_OF)).collect()] == [("Bank fees", 1)]


def test_empty_ledger(spark):
    none = ledger(spark, [(1, AS_OF, "a", "OTHER")]).where("id < 0")
    patterns = recurring.detect(with_merchant_key(none), AS_OF)
    assert patterns.count() == 0 and leaks.detect(none, patterns, AS_OF).count() == 0


def test_receipt_amounts(spark):
    kind = "total decimal(19,2), items array<struct<name:string,price:decimal(19,2)>>"
    rows = [
        (Decimal(18), [("a", Decimal(85)), ("b", Decimal(45)), ("VAT", Decimal(18)), ("Grand Total", Decimal(118))]),
        (Decimal(14), [("a", Decimal(80)), ("b", Decimal(40))]),
        (None, []), (Decimal(9), None),
    ]
    got = receipts.validate_total(spark.createDataFrame(rows, kind)).collect()
    assert [(r.amount, r.confidence) for r in got] == [(Decimal(118), "HIGH"), (Decimal(14), "LOW"), (None, "LOW"), (Decimal(9), "MEDIUM")]


def test_receipt_merchant(spark):
    doc = spark.createDataFrame([(1, "STARBUCKS COFFEE\n12 Main St\nTotal 5.00\n\n")], "id long, text string")
    best = receipts.best_merchant(receipts.merchant_score(receipts.text_lines(doc, "id")), "id").first()
    assert best.merchant == "STARBUCKS" and best.score > 0.8
    words = spark.createDataFrame([(1, 1, 1, 1, 2, 12, 100, 90.0, "Mart"), (1, 1, 1, 1, 1, 10, 100, 100.0, "Big")], "id long, block int, par int, line int, word int, top int, height int, conf double, text string")
    line = receipts.tsv_lines(words, "id").first()
    assert (line.line, line.top, line.confidence) == ("Big Mart", 10, 0.95)


def test_lines_split_each_text_once(spark):
    doc = spark.createDataFrame([(1, "a\r\n\n \tb \nc\n\n"), (2, None), (3, "x")], "id long, text string")
    lines = receipts.text_lines(doc, "id")
    assert sorted((r.id, r.top, r.height, r.line) for r in lines.collect()) == [(1, 0, 100, "a"), (1, 50, 100, "b"), (1, 75, 100, "c"), (3, 0, 25, "x")]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.index("Generate") < plan.index("split(")  # below the lines, not once for each


def test_lines_without_merchant_by_all_words_in_one_pass(spark):
    import random
    import re

    rnd = random.Random(1)
    bits = [*receipts.NOT_MERCHANT, "st", "Ave", "PO  Box", "waye", "fl", "GSTIN", "gtin", "GST", "cin", "Pan", "tina", "EIN", "VAT  REG", "Tel :", "ph:", "PH", "fax\t:", ":", "@", "http", "0123456789", "012345",
            "27ABCDE1234F1Z5", "x27abcde1234f1z5", "Acme", "café", "ÉTÉ", "\u212a", "GT\u0130N", "7", "12 12", "-", "_", "名", "𝐀b", " "]
    made = [rnd.choice(["", " ", "x", "."]).join(rnd.choices(bits, k=rnd.randint(1, 3))) for _ in range(1500)] + [*bits, *[b.upper() for b in bits]]
    c = F.col("line")
    small = F.lower(c)
    words = F.array_contains(F.array(*[small.contains(w) for w in receipts.NOT_MERCHANT]), True)
    plain = words | c.rlike(receipts.ADDRESS) | c.rlike(receipts.CONTACT) | c.rlike("^[0-9]") | (F.length(F.regexp_replace(c, "[^0-9]", "")) > F.length(c) * 0.5)
    rows = spark.createDataFrame([(x,) for x in made], "line string").select(c, receipts.names_no_merchant(c).alias("got"), plain.alias("want")).collect()
    assert [r.line for r in rows if r.got != r.want] == [] and {r.got for r in rows} == {True, False}
    plan = spark.createDataFrame([("a",)], "line string").select(receipts.names_no_merchant(c))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"lower\(", plan.split("AS ")[0] if "AS " in plan else plan)) <= 1


def test_scores_of_letters_and_capitals(spark):
    lines = ["Big Mart Plaza", "BIG MART", "big mart plaza", "ÉTÉ 12-34", "Big  mart\tPlaza Of", " Big Mart", "a-B c-D e-F", "名名名名", "---- ----"]
    rows = spark.createDataFrame([(k, 1000, 100, 0.8, x) for k, x in enumerate(lines)], "id int, top int, height int, confidence double, line string")
    got = {r.line: round(r.score, 6) for r in receipts.merchant_score(rows).collect()}
    assert [got[x] for x in lines] == [0.49, 0.59, 0.39, 0.54, 0.49, 0.49, 0.34, 0.39, 0.34]


def test_receipt_json(spark):
    rows = spark.createDataFrame([('{"merchant_name": "A", "total_amount": 12.5, "more": 1}',), ('{"total_amount": -1}',), ("broken",), (None,)], "json string")
    assert [(r.merchant, r.total) for r in receipts.parse_json(rows).collect()] == [("A", Decimal("12.50"))]


def test_interpreter_is_asked_about_escalated_receipts_only(spark):
    import pandas as pd

    def interpret(frames):
        for frame in frames:
            assert len(frame) and all("sure" not in t.lower() for t in frame["text"])
            yield pd.DataFrame({"merchant": [f"asked:{h[0]}" if h else None for h in frame["hints"]], "category": ["DINING"] * len(frame), "confidence": [0.9] * len(frame)})

    docs = [(k, "SURE SHOP\nx\ny\nz\nTotal 5.00") if k % 3 == 0 else (k, "Corner Bakery\nLittle Stall\n" + "x\n" * 20 + "Total: 7.50") if k % 3 == 1 else (k, "zzzzzz q w\nTotal 2.00") for k in range(300)] + [(900, None), (901, " "), (902, "12 12\nTotal 3")]
    rows = receipts.parse(spark.createDataFrame(docs, "id long, text string").repartition(3), "id", AS_OF, interpret=interpret)
    got = {r.id: (r.merchant, r.category, r.escalated, r.successful) for r in rows.collect()}
    assert got[0] == ("SURE SHOP", None, False, True) and got[1] == ("asked:Corner Bakery", "DINING", True, True) and got[900] == got[901] == (None, None, False, False)
    assert all(v == got[k % 3] for k, v in got.items() if k < 300) and got[902][0] is None and got[902][2] is False
    plain = {r.id: r.merchant for r in receipts.parse(spark.createDataFrame(docs, "id long, text string"), "id", AS_OF).collect()}
    assert plain[1] == "Corner Bakery" and set(plain) == set(got)
    broken = receipts.parse(spark.createDataFrame(docs, "id long, text string"), "id", AS_OF, interpret=lambda frames: (f.iloc[:0] for f in frames))
    with pytest.raises(Exception, match="same length"):
        broken.collect()


def test_reply_of_a_recogniser(spark):
    from datetime import date

    rows = [
        ('{"merchant_name": " A\\u0007 Shop ", "merchant_address": "1 St", "transaction_date": "12/31/2000", "total_amount": 18, "line_items": [{"item_name": "a", "item_price": 85}, {"item_name": "b", "item_price": 45}, {"item_name": "Grand Total", "item_price": 118}]}',),
        ('{"merchant_name": "  ", "transaction_date": "2999-01-01", "total_amount": -1}',), ("broken",), (None,),
    ]
    got = receipts.from_reply(spark.createDataFrame(rows, "json string"), AS_OF).collect()
    assert [(r.merchant, r.address, r.date, r.amount, r.confirm, r.successful) for r in got] == [("A Shop", "1 St", date(2000, 12, 31), Decimal(118), False, True), *[(None, None, None, None, True, False)] * 3]
