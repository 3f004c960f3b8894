"""Statements that arrive as files become ledger entries and daily sums, each file once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import statements
from .run import foreach_batch

ENTRY = (
    "id long, user_id long, amount decimal(19,4), date date, description string, merchant string, category string, type string, currency string, "
    "confidence decimal(5,4), raw_text string, source string"
)
SUMS = "user_id long, day date, category string, spend decimal(29,4), income decimal(29,4), entries long"
#: Files of a month and batch at most: without a bound each task would write one for each of its months.
MONTH_FILES = 4
BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The files under path as a stream, in order of age; at most so many to a micro-batch."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(path)


def daily_sums(entries: DataFrame) -> DataFrame:
    """user_id, day, category, spend, income, entries."""
    money = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("amount"))), F.lit(0)).cast("decimal(29,4)")
    return entries.groupBy("user_id", F.col("date").alias("day"), "category").agg(money("DEBIT").alias("spend"), money("CREDIT").alias("income"), F.count("*").alias("entries"))


def ingest(files: DataFrame, path: str, checkpoint: str, user_id: Column) -> None:
    """Parse what is there of a stream of files (see arriving) into path: entries by month, their daily sums, and
    what became of each file. user_id: an expression over `file`, the file's path.

    Each batch has partitions of its own, by its number, and replaces them if it comes again, so a restart adds
    nothing twice. Files and rows that do not parse are in the imports with their errors, as are those without
    a user; entries with neither date nor amount do not exist.
    """
    user = user_id.try_cast("long")

    def run(batch: DataFrame, number: int) -> None:
        kept: list[DataFrame] = []
        # the parse makes a method of 37 kB; beyond 8,000 bytes the JVM interprets it, so it is left in parts (the stream's own session)
        batch.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)

        def keep(rows: DataFrame) -> DataFrame:
            kept.append(rows.persist())
            return kept[-1]

        parsed = statements.parse_statements(statements.records_of(batch), keep)
        parsed = parsed.withColumn("error", F.coalesce("error", F.when(user.isNull(), F.lit("no user"))))
        # kept before rows with errors are told from others: each row is parsed once for both, and for the test itself
        done = keep(statements.ledger_rows(parsed, user, also=("file", "row_number", "error")))
        entries = done.where("error IS NULL").drop("file", "row_number", "error").withColumn("month", F.date_format("date", "yyyy-MM"))
        daily = daily_sums(entries).withColumn("month", F.date_format("day", "yyyy-MM"))
        try:
            for rows, name in ((entries.repartition("month", F.pmod("id", F.lit(MONTH_FILES))), "entries"), (daily.repartition("month"), "daily")):
                write = rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                write.partitionBy("month", "batch").parquet(f"{path}/{name}")
            statements.summary(done).write.mode("overwrite").parquet(f"{path}/imports/batch={number}")
        finally:
            for rows in kept:
                rows.unpersist()

    foreach_batch(files, run, checkpoint)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The ledger so far, with month: date ranges read their months only."""
    return spark.read.schema(f"{ENTRY}, month string, batch int").parquet(f"{path}/entries").drop("batch")


def sums(spark: SparkSession, path: str) -> DataFrame:
    """Daily sums over all batches, with month; each batch has added its own."""
    rows = spark.read.schema(f"{SUMS}, month string, batch int").parquet(f"{path}/daily").groupBy("user_id", "day", "category", "month")
    return rows.agg(*[F.sum(c).cast("decimal(29,4)").alias(c) for c in ("spend", "income")], F.sum("entries").alias("entries"))


def imports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/imports")
