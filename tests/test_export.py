"""The export writer: what is read back, files of users, and failures."""

import csv
import glob
import os
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.sources import export
from ledgerlake.sources.statements import HEADER

TEXTS = ["plain", "with, comma", 'says "hi"', "two\nlines", "two\r\nlines", "=1+1", "-x", "", None, "ü日"]


def ledger(spark):
    rows = [(k, k % 4, Decimal(k) / 2, date(2024, 1, 1 + k % 9), TEXTS[k % 10], TEXTS[(k + 3) % 10], "OTHER", "DEBIT") for k in range(60)]
    return spark.createDataFrame([*rows, (99, None, Decimal(1), date(2024, 1, 1), "x", "y", "OTHER", "DEBIT")], "id long, user_id long, amount decimal(19,4), date date, description string, merchant string, category string, type string")


def files_of(path):
    return {os.path.basename(f): f for f in glob.glob(f"{path}/part-*/*.csv")}


def test_files_of_users_come_back(spark, tmp_path):
    path = str(tmp_path / "out")
    for _ in range(2):  # the second replaces the first
        export.write_export(ledger(spark), path)
    found = files_of(path)
    assert sorted(found) == [f"user_id={u}.csv" for u in range(4)] and sorted(os.listdir(path))[0] == "_SUCCESS" and not glob.glob(f"{path}/_staging*")
    safe = lambda t: "" if t is None else f"'{t}" if t[:1] in ("=", "-") else t
    for u in range(4):
        with open(found[f"user_id={u}.csv"], newline="", encoding="utf-8") as f:
            raw = f.read()
        head, *rows = csv.reader(raw.splitlines(keepends=True))
        assert raw.startswith(HEADER + "\r\n") and raw.endswith("\r\n") and head == HEADER.split(",")
        mine = sorted((r for r in ledger(spark).collect() if r.user_id == u), key=lambda r: (-r.date.toordinal(), r.id))
        assert [r[:6] for r in rows] == [[str(r.date), safe(r.description), safe(r.merchant), "OTHER", "DEBIT", str(r.amount)] for r in mine]
    back = export.read_export(spark, path)
    assert back.count() == 60 and back.where("description = 'two\r\nlines'").count() == 6 and back.agg(F.sum(F.col("amount").cast("double"))).first()[0] == 885.0
    export.write_export(ledger(spark).where("user_id = 3"), path, "append")
    assert len(glob.glob(f"{path}/part-*/*.csv")) == 5


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    export.write_export(ledger(spark).where("user_id = 1"), path)
    before = files_of(path)
    broken = ledger(spark).withColumn("category", F.when((F.col("user_id") == 2) & (F.col("id") == 2), F.raise_error(F.lit("broken row"))).otherwise(F.col("category")))
    with pytest.raises(Exception, match="broken row|abort"):
        export.write_export(broken, path)
    assert files_of(path) == before and not glob.glob(f"{path}/_staging*")


def test_an_empty_ledger_has_no_files(spark, tmp_path):
    export.write_export(ledger(spark).where("false"), str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["_SUCCESS"]
