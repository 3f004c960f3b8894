"""The ledger: its schema, and the view of the test tables as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import CATEGORIES

#: Columns that the operators read; amount is never negative, type tells the direction.
SCHEMA = "id long, user_id long, amount decimal(19,4), date date, description string, merchant string, category string, type string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """With month (yyyy-MM), the partition column: overview.between reads the months of its range only."""
    return spark.read.schema(f"{SCHEMA}, month string").parquet(path)


def write_ledger(ledger: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by month, so that a date range reads its months only."""
    ledger.withColumn("month", F.date_format("date", "yyyy-MM")).write.mode(mode).partitionBy("month").parquet(path)


def cluster_ledger(ledger: DataFrame, table: str, path: str, buckets: int = 200, mode: str = "overwrite") -> DataFrame:
    """The ledger as a catalog table by month and, within it, by bucket of user_id: a date range reads its months
    only, and aggregates and windows by user (and more) need no shuffle. Buckets: about a task's share of the
    users; each month has at most so many files if one task writes a bucket."""
    rows = ledger.withColumn("month", F.date_format("date", "yyyy-MM")).repartition(buckets, "user_id")
    rows.write.mode(mode).partitionBy("month").bucketBy(buckets, "user_id").sortBy("user_id", "date").option("path", path).saveAsTable(table)
    return ledger.sparkSession.table(table)


def test_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a ledger with nations for users: many entries for each user and merchant."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = (
        t("lineitem")
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("c_nationkey").cast("long").alias("user_id"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(19,4)").alias("amount"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"),
        F.col("s_name").alias("merchant"),
        F.get(F.array(*map(F.lit, CATEGORIES)), F.col("p_partkey") % 15).alias("category"),
        F.when(F.col("l_returnflag") == "R", "CREDIT").otherwise("DEBIT").alias("type"),
    )


#: The same rows in SQL, as the common table expression `ledger`.
LEDGER_SQL = f"""
ledger AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, c_nationkey::BIGINT AS user_id, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(19,4)) AS amount,
         CAST(l_shipdate AS DATE) AS date, p_name || ' ' || p_type AS description, s_name AS merchant,
         list_extract({list(CATEGORIES)}, (p_partkey % 15 + 1)::INT) AS category, CASE WHEN l_returnflag = 'R' THEN 'CREDIT' ELSE 'DEBIT' END AS type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
"""
