"""Statement layouts and cells with the results that are expected of them."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import parsing, text
from ledgerlake.sources import statements


def parse(spark, tmp_path, content, name="s.csv"):
    (tmp_path / name).write_text(content, encoding="utf-8")
    return statements.parse_statements(statements.read_statements(spark, f"file://{tmp_path}"))


LAYOUTS = [
    ("date,description,amount,type\n2026-01-01,A,100,debit\n2026-01-02,B,50,credit\n", [("100", True), ("50", False)]),
    ("date,description,amount\n2026-01-01,A,-100\n2026-01-02,B,50\n", [("100", True), ("50", False)]),
    ("Date,Narration,Debit Amount,Credit Amount,Closing Balance\n01/01/2026,A,100,,900\n02/01/2026,B,,50,950\n", [("100", True), ("50", False)]),
    ("Date,Narration,Credit Amount,Debit Amount,Closing Balance\n01/01/2026,A,,-1500.0,900\n", [("1500", True)]),
    ("Date,Description,Withdrawal,Deposit,Balance\n01/01/2026,A,100,0,900\n", [("100", True)]),
    ("Date,Description,Money Out,Money In,Balance\n01/01/2026,A,,75,900\n", [("75", False)]),
    ("Date,Description,Amount,Cr/Dr\n01/01/2026,A,10,CR\n02/01/2026,A,20,DR\n", [("10", False), ("20", True)]),
    ("Transaction Date,Description,Transaction Amount,Type\n01/01/2026,A,10,deposit\n", [("10", False)]),
    ("date,description,balance\n2026-01-01,Opening Balance,10000\n2026-01-02,Walmart,9500\n2026-01-03,Salary,14500\n", [("500", True), ("5000", False)]),
]


@pytest.mark.parametrize("content,expected", LAYOUTS)
def test_layouts(spark, tmp_path, content, expected):
    rows = parse(spark, tmp_path, content).where("error IS NULL").orderBy("row_number").collect()
    assert [(r.amount, r.is_debit) for r in rows] == [(Decimal(a), d) for a, d in expected]


def test_errors_are_rows(spark, tmp_path):
    content = "Date,Description,Debit,Credit\n01/01/2026,A,100,\n02/01/2026,B,,\n03/01/2026,C,N/A,\nsoon,D,1,\n"
    rows = parse(spark, tmp_path, content).orderBy("row_number").collect()
    assert [r.error for r in rows] == [None, "Row 3: No amount", "Row 4: invalid debit", "Row 5: invalid date"]
    one = statements.summary(parse(spark, tmp_path, content)).first()
    assert (one.records, one.imported, one.skipped, one.total) == (4, 1, 3, Decimal(100))


def test_unknown_layout_and_mixed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,description,amount\n2026-01-01,"x, y","1,50,000.50"\n')
    (tmp_path / "ignored.txt").write_text("date,description,amount\n2026-01-01,x,1\n")
    rows = parse(spark, tmp_path, "FooDate,BarDescription,BazNumber\n1,2,3\n4,5,6\n", "b.csv").orderBy("file").collect()
    assert [(r.layout, r.amount) for r in rows] == [("EXPLICIT_AMOUNT", Decimal("150000.50")), ("UNKNOWN", None), ("UNKNOWN", None)]
    assert rows[2].file.endswith("ignored.txt") and "not a CSV file" in rows[2].error  # refused with a word, not in silence
    assert rows[0].description == "x, y"


def test_balance_series(spark, tmp_path):
    steps = [100000, 99950, 99900, 99850, 99800, 0]
    lines = "\n".join(f"2026-01-{i + 1:02d},step {i},{b}" for i, b in enumerate(steps))
    rows = parse(spark, tmp_path, "date,description,balance\n" + lines + "\n,missing,5\n").orderBy("row_number").collect()
    assert [float(r.confidence) for r in rows if r.amount is not None] == [1, 1, 1, 1, 0.5]
    assert [r.error for r in rows if r.error] == ["Row 8: missing date or balance"]


def test_to_ledger_cleans_and_categorises(spark, tmp_path):
    parsed = parse(spark, tmp_path, "date,description,amount\n2026-01-01,UPI-Zomato/BLR/REF123,-250\n")
    row = statements.to_ledger(parsed, F.lit(7)).first()
    assert (row.user_id, row.merchant, row.category, row.type, row.currency) == (7, "Zomato", "FOOD_DINING", "DEBIT", "INR")


MERCHANTS = [
    ("Netflix", "netflix", "Netflix"), ("www.netflix.com", "netflix", "Netflix"), ("NETFLIX SUBSCRIPTION 123456", "netflix", "Netflix"), ("UPI/NETFLIX/MONTHLY", "netflix", "Netflix"),
    ("Swiggy Instamart", "swiggyinstamart", "Swiggy Instamart"), ("SWIGGY", "swiggy", "Swiggy"), ("ICICI BANK EMI", "emi", "EMI"), ("INTERNET BILL JIO FIBER", "jio", "Jio"),
    ("NEFT-HDFC0000123-AIRTEL", "airtel", "Airtel"), ("FOOBAR BAKERY 12345", "foobarbakery", None), ("foobar bakery", "foobarbakery", None), (None, "", None), ("  ", "", None), ("123456789", "", None), ("///---", "", None),
]


def test_merchant_keys(spark):
    rows = text.with_merchant_key(spark.createDataFrame([(m[0],) for m in MERCHANTS], "merchant string")).collect()
    assert [(r.merchant_key, r.canonical_name) for r in rows] == [m[1:] for m in MERCHANTS]


def test_dates_clamp(spark):
    df = spark.createDataFrame([("31/02/2024",), ("5 Jan 2024",), ("x",), (None,)], "t string")
    assert [str(r[0]) for r in df.select(parsing.parse_date(F.col("t"), clamp=True)).collect()] == ["2024-02-29", "2024-01-05", "None", "None"]


def test_export_quotes_formulas(spark):
    df = spark.createDataFrame([(1, 1, None, "=1+1", 'a"b', None, "DEBIT", Decimal("-42.50"))], "user_id long, id long, date date, description string, merchant string, category string, type string, amount decimal(19,4)")
    assert "'=1+1" in statements.export_lines(df).first().line and ",-42.5000," in statements.export_lines(df).first().line


def test_records_are_split_once_for_all_layouts(spark, tmp_path):
    """The three branches read what is kept of the records, and their header need not be scanned for each role."""
    kept = []
    (tmp_path / "a.csv").write_text("date,description,amount,date\n2026-01-01,A,5,2026-01-02\n2026-01-03,B\n\n")
    (tmp_path / "b.csv").write_text("date,description,balance\n2026-01-01,A,5\n2026-01-02,B,7\n")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")

    def keep(rows):
        kept.append(rows.persist())
        return kept[-1]

    parsed = statements.parse_statements(statements.read_statements(spark, f"file://{tmp_path}"), keep)
    rows = {(r.file[-5], r.row_number): (str(r.date), r.layout, r.error) for r in parsed.collect()}
    assert len(kept) == 1 and kept[0].is_cached
    # of two headers that are alike the last one's cell counts
    assert rows[("a", 2)] == ("2026-01-02", "EXPLICIT_AMOUNT", None) and rows[("a", 3)][2] == "Row 3: No amount"
    assert rows[("b", 3)][1:] == ("BALANCE_ONLY", None) and rows[("c", 2)][1] == "UNKNOWN"
    kept[0].unpersist()


def test_words_are_found_by_one_pattern(spark):
    """Words that overlap, begin with one another or hold signs, against a plain loop over the words."""
    lexicon = {"A": ("ab", "abc", "bcd", "long word"), "B": ("abc", "c.d", "(x", "longest"), "C": ("b",)}
    texts = [("zabcd", None), ("c+d", "c.d (X"), ("LONG WORD", "ab"), ("long", "word"), ("longest", "long word"), ("\n", ""), (None, None), ("bc", "abab ab"), ("né 😀 ab", "b")]

    def best(words):
        points = [sum(12 + 8 * (len(w) > 6) for w in ws if w in words) for ws in lexicon.values()]
        score, order = max((min(95, p + 45) if p else 0, -at) for at, p in enumerate(points))
        return (list(lexicon)[-order], Decimal(score) / 100) if score else ("UNCATEGORIZED", Decimal("0.25"))

    rows = text.with_category(spark.createDataFrame(texts, "description string, merchant string"), lexicon=lexicon).collect()
    assert [(r.category, r.confidence) for r in rows] == [best(f"{d or ''} {m or ''}".lower()) for d, m in texts]
    assert re.findall(text.words_pattern(lexicon["A"]), "abcd ab") == ["abc", "bcd", "ab"]
