"""Every query of the ledger against its SQL on the smallest test tables."""

import os

import pytest

from ledgerlake.plans import catalog

from .oracle import frame_rows, sql_rows, tables_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert frame_rows(catalog.QUERIES[name](spark, SF)) == sql_rows(catalog.ORACLE_SQL[name], tables_of(SF))


@pytest.mark.parametrize("by", [[], ["event_type"]])
def test_streams_over_a_folder_of_part_files(spark, tmp_path, by):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(3).write.partitionBy(*by).parquet(f"{tmp_path}/events.parquet")
    for name in ("rate_window", "daily_stream_spend", "new_signals"):
        got = frame_rows(catalog.QUERIES[name](spark, str(tmp_path)))
        assert got[1] and got == sql_rows(catalog.ORACLE_SQL[name], tables_of(SF))


def test_entry_module_names_every_query(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["user_id", "category", "total", "entries", "share"]


def test_corrupted_text(spark):
    from pyspark.sql import functions as F

    from ledgerlake.operators import receipts

    rows = [("plain words of a receipt",), ("aaaaaa bill",), ("a b c d e",), ("éüöß" * 9,), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(receipts.corrupted(F.col("t"))).collect()]
    assert got == [False, True, True, True, False, False]
