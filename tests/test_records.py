"""Uploads, replies, sentences and streams."""

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlake.operators import records, receipts, reports
from ledgerlake.sources import ledger as L
from ledgerlake.streaming import windows


def test_image_kinds(spark):
    starts = ["FFD8FFE0", "89504E470D0A1A0A00", "524946460000000057454250", "49492A0000", "4D4D002A", "424D00", "00", ""]
    rows = spark.createDataFrame([(bytearray.fromhex(s),) for s in starts], "c binary").select(records.image_kind(F.col("c"))).collect()
    assert [r[0] for r in rows] == ["JPEG", "PNG", "WEBP", "TIFF", "TIFF", "BMP", None, None]


def test_replies(spark):
    body = '{"choices":[{"message":{"content":"{\\"merchant\\": \\"A\\", \\"amount\\": \\"12.5\\", \\"date\\": \\"null\\", \\"confidence\\": 7}"}}]}'
    rows = spark.createDataFrame([(body,), ("broken",), (None,)], "b string").select(records.parse_reply(F.col("b")).alias("r")).collect()
    assert (rows[0].r.merchant, rows[0].r.amount, rows[0].r.day, rows[0].r.confidence) == ("A", Decimal("12.50"), None, 1.0)
    assert rows[1].r.merchant is None and rows[2].r.merchant is None


def test_safe_names(spark):
    rows = spark.createDataFrame([("../a/b c?.csv", "x\u0000y\u0007 \n")], "n string, t string")
    assert rows.select(records.safe_name(F.col("n")), records.safe_text(F.col("t"))).first()[:] == ("b_c_.csv", "xy")


def test_narrative(spark):
    D = Decimal
    kind = (
        "user_id long, income decimal(29,4), spend decimal(29,4), net decimal(29,4), entries long, prior_spend decimal(29,4), change double, recurring decimal(19,2), patterns long, leak_monthly decimal(19,2), "
        "top_category string, top_total decimal(29,4), top_share double, profile string, signals long, cancellable long, recurring_annual decimal(29,2), largest string, largest_amount decimal(19,4), largest_period string, "
        "dearest_annual decimal(29,2), dearest_opportunity decimal(29,2), dearest string, dearest_monthly decimal(19,2), dearest_one decimal(19,2)"
    )
    full = (1, D(1000), D(1500), D(-500), 12, D(1000), 50.0, D(50), 2, D(110), "DINING", D("1234.5"), 82.3, "LARGE_TICKETS", 1, 1, D(600), "Gym", D(40), "Monthly", D(600), D(9147), "Gym", D(40), D(7318))
    bare = (2, D(0), D(0), D(0), 0, D(0), 0.0, D(0), 0, D(0), None, None, None, "STEADY", 0, None, None, None, None, None, None, None, None, None, None)
    known = spark.createDataFrame([full, bare], kind)
    signals = spark.createDataFrame([(1, "LARGE_TICKETS", 1.5, "HIGH", 1), (3, "LARGE_TICKETS", 1.5, "HIGH", 1)], "user_id long, kind string, value double, severity string, rank int")
    leaks = spark.createDataFrame([(1, "BANK_FEES", D(110), D(1320), "LOW", 1)], "user_id long, kind string, monthly decimal(19,2), annual decimal(19,2), severity string, rank int")
    advice = spark.createDataFrame([(1, 1, "REDUCE_CATEGORY", D(110)), (1, 2, "WATCH", D(0))], "user_id long, rank int, action string, monthly decimal(19,2)")
    rows = sorted(reports.narrative(known, signals, leaks, advice).collect(), key=lambda r: (r.user_id, r.place, r.item))
    assert [(r.section, r.code) for r in rows if r.user_id == 2] == [("SUMMARY", "NO_ENTRIES"), ("BEHAVIOUR", "STEADY"), ("RECURRING", "NO_PATTERNS")] and {r.user_id for r in rows} == {1, 2}
    assert [r.text for r in rows if r.user_id == 1] == [
        "12 entries: 1,500 spent against an income of 1,000.", "That is 50% or 500 more than in the period before.", "500 more went out than came in.", "Most went to DINING: 1,235, 82% of all spend.",
        "What marks the spending most: LARGE_TICKETS.", "About 110 a month could be kept, 1,320 a year.", "LARGE_TICKETS (HIGH).", "Spending is far from that of the period before: 50%.", "DINING alone is 82% of all spend.",
        "BANK_FEES (LOW): 110 a month, 1,320 a year.", "2 recurring payments bind 50 a month, 600 a year.", "The largest is Gym: 40 (Monthly).", "1 of them are easily cancelled.",
        "The dearest ones take 600 a year; invested, that would be 9,147 in ten years.", "Gym alone, 40 a month, would be 7,318.", "REDUCE_CATEGORY: up to 110 a month.", "WATCH.",
    ]


def test_ledger_round_trip_and_audit(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, Decimal(5), date(2026, 1, 2), "d", "m", None, "DEBIT"), (2, 1, Decimal(6), date(2026, 2, 2), "d", "m", None, "DEBIT")], L.SCHEMA)
    L.write_ledger(rows, f"{tmp_path}/ledger")
    assert L.read_ledger(spark, f"{tmp_path}/ledger").where("month = '2026-02'" if "month" in L.read_ledger(spark, f"{tmp_path}/ledger").columns else "date >= '2026-02-01'").count() == 1
    events = spark.createDataFrame([(datetime(2026, 1, 1), 1, "LOGIN", "User", "1", {"ip": "x"})], "at timestamp, user_id long, action string, kind string, key string, metadata map<string,string>")
    records.audit(events, f"{tmp_path}/audit")
    records.audit(events, f"{tmp_path}/audit")
    assert [r.metadata for r in spark.read.parquet(f"{tmp_path}/audit").collect()] == ['{"ip":"x"}'] * 2


def test_confirmed_receipts_once(spark):
    ledger = spark.createDataFrame([(1, "r1"), (2, None)], "id long, receipt_id string")
    assert [r.receipt_id for r in receipts.new_entries(spark.createDataFrame([("r1",), ("r2",)], "receipt_id string"), ledger).collect()] == ["r2"]


def test_rate_windows_on_a_table_and_stream_batches(spark, tmp_path):
    rows = [(1, datetime(2026, 1, 1, 0, 0, s)) for s in range(7)] + [(1, datetime(2026, 1, 1, 0, 1, 0))]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp")
    got = sorted((r["count"], r.rejected) for r in windows.rate_windows(events, "user_id", "auth").collect())
    assert got == [(1, 0), (7, 2)]
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    count = lambda every: every.groupBy("user_id").count()
    for _ in range(2):  # a restart adds nothing
        windows.each_batch(stream, count, f"{tmp_path}/out", f"{tmp_path}/check", count(events).schema)
        assert windows.batch_result(spark, f"{tmp_path}/out", count(events).schema).first()["count"] == 8


def test_a_date_range_reads_its_months_only(spark, tmp_path):
    from datetime import date

    from ledgerlake.operators import overview
    from ledgerlake.sources import ledger

    rows = [(k, 1, 10, date(2024, 1 + k % 6, 5), "d", "m", "OTHER", "DEBIT") for k in range(12)]
    ledger.write_ledger(spark.createDataFrame(rows, "id long, user_id long, amount int, date date, description string, merchant string, category string, type string").withColumn("amount", F.col("amount").cast("decimal(19,4)")), str(tmp_path / "l"))
    some = overview.between(ledger.read_ledger(spark, str(tmp_path / "l")), date(2024, 2, 1), date(2024, 3, 31))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-02" in plan and some.count() == 4
    assert len(some.inputFiles()) and overview.totals(some, None, None).first().entries == 4


def test_each_batch_renews_the_users_of_a_batch(spark, tmp_path):
    from ledgerlake.streaming.windows import batch_result, each_batch

    rows = spark.createDataFrame([(k % 5, k) for k in range(20)], "user_id long, amount long")
    count = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"))
    for part, where in enumerate(("amount < 10", "amount >= 10 AND user_id < 2")):
        rows.where(where).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
        stream = spark.readStream.schema("user_id long, amount long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        each_batch(stream, count, str(tmp_path / "out"), str(tmp_path / "check"), count(rows).schema)
    got = {r.user_id: r.n for r in batch_result(spark, str(tmp_path / "out"), count(rows).schema).collect()}
    assert got == {0: 4, 1: 4, 2: 2, 3: 2, 4: 2}
