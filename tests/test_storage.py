"""What stored ledgers save: months that are not read, shuffles that are not needed; audit logs, pages by key."""

import uuid
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import behavior, leaks, overview, records, recurring, reports
from ledgerlake.plans import simulation
from ledgerlake.sources import ledger as L

AS_OF = date(2024, 6, 30)


def rows(spark):
    made = [(k, k % 7, Decimal(100 + k % 13), date(2022 + k % 30 // 12, k % 12 + 1, 5 + k % 3), "d", f"shop{k % 5}", "SUBSCRIPTIONS" if k % 2 else "OTHER", "DEBIT" if k % 9 else "CREDIT") for k in range(900)]
    return spark.createDataFrame(made, L.SCHEMA)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ledger"))
    L.write_ledger(rows(spark), path)
    return L.read_ledger(spark, path)


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    name = f"ledger_{uuid.uuid4().hex}"
    yield L.cluster_ledger(rows(spark), name, str(tmp_path_factory.mktemp("clustered")), buckets=4)
    spark.sql(f"DROP TABLE {name}")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def patterns(df):
    return recurring.detect(df, AS_OF, key="merchant", name="")


WINDOWED = {
    "totals": lambda df: overview.totals(df, date(2024, 1, 1), AS_OF), "prior_window": lambda df: overview.prior_window(df, date(2024, 6, 1), AS_OF),
    "spend_alerts": lambda df: overview.spend_alerts(df, date(2024, 6, 1), AS_OF, AS_OF), "detect": patterns, "measures": lambda df: behavior.measures(df, AS_OF),
    "recent": lambda df: leaks.recent(df, AS_OF), "leaks": lambda df: leaks.detect(df, patterns(df), AS_OF), "baseline": lambda df: simulation.baseline(df, patterns(df), AS_OF),
    "monthly": lambda df: reports.monthly(df, AS_OF), "tax": lambda df: simulation.tax_sections(df, AS_OF),
}


@pytest.mark.parametrize("name", sorted(WINDOWED))
def test_every_scan_reads_its_months_only(spark, stored, name):
    found = WINDOWED[name](stored).drop("month")
    scans = [line for line in plan_of(found).splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [isnotnull(month" in s for s in scans)
    assert sorted(map(str, found.collect())) == sorted(map(str, WINDOWED[name](rows(spark)).select(*found.columns).collect()))


@pytest.mark.parametrize("name", ["detect", "category_share", "balance_windows"])
def test_a_ledger_stored_by_user_needs_no_shuffle(spark, clustered, name):
    from pyspark.sql import Window as W

    run = {
        "detect": patterns, "category_share": lambda df: overview.category_share(df, date(2023, 1, 1), AS_OF),
        "balance_windows": lambda df: df.select("user_id", "id", F.sum("amount").over(W.partitionBy("user_id").orderBy("date", "id")).alias("run")),
    }[name]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = run(clustered)
        plan = plan_of(found)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange" not in plan and "Bucketed: true" in plan and (name == "balance_windows" or "PartitionFilters: [isnotnull(month" in plan)
    assert sorted(map(str, found.collect())) == sorted(map(str, run(rows(spark)).select(*found.columns).collect()))


def test_pages_by_key_add_up_to_the_listing(spark, stored):
    want = [(r.date, r.id) for r in rows(spark).where("user_id = 3").orderBy(F.desc("date"), F.desc("id")).collect()]
    got, last = [], None
    while True:
        part = [(r.date, r.id) for r in records.page_after(stored, 3, last, size=40).collect()]
        got += part
        if len(part) < 40:
            break
        last = part[-1]
    assert got == want
    plan = plan_of(records.page_after(stored, 3, (date(2022, 3, 5), 10)))
    assert "(month" in plan and "<= 2022-03" in plan and "PartitionFilters: [isnotnull(month" in plan
    keys = spark.createDataFrame([(3, *want[9]), (4, None, None)], "user_id long, date date, id long")
    many = records.pages_after(rows(spark), keys, 20).collect()
    assert sorted((r.place, r.date, r.id) for r in many if r.user_id == 3) == [(k + 1, *want[10 + k]) for k in range(20)] and {r.user_id for r in many} == {3, 4}


def test_audit_appends_once_and_never_fails_the_caller(spark, tmp_path):
    path = str(tmp_path / "audit")
    kind = "event_id long, at timestamp, user_id long, action string, kind string, key string, metadata map<string,string>"
    made = [(k, datetime(2024, 1, 1 + k % 3), 1, "A", "User", "1", {"a": "b"}) for k in range(9)] + [(20, None, None, None, None, None, None), (1, datetime(2024, 1, 2), 1, "A", "User", "1", None)]
    events = spark.createDataFrame(made, kind)
    for _ in range(2):
        assert records.audit(events, path)
    assert sorted(r.event_id for r in records.audit_log(spark, path).collect()) == sorted(map(str, [*range(9), 20]))
    assert records.audit_log(spark, path).where("day = DATE '2024-01-02'").count() == 3
    blocked = tmp_path / "file"
    blocked.write_text("not a folder")
    assert records.audit(events, f"{blocked}/audit") is False and records.audit(events.withColumn("action", F.raise_error(F.lit("no")).cast("string")), f"{path}-other") is False
    assert events.count() == 11 and records.audit_log(spark, path).count() == 10
