"""A corpus from raw documents to training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import drop, materialize, sized
from ledgerlake.llm.line_dedup import drop_repeated_lines
from ledgerlake.llm.mixing import mix
from ledgerlake.llm.ngram_join import keep_first, near_duplicates
from ledgerlake.llm.packing import pack
from ledgerlake.llm.toxicity import fit_toxicity, score_toxicity


def small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts, so fewer of them at a time go between Spark and its Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a conditional random field, trained on the labels, holds for toxic go."""
    small_batches(spark)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where("toxicity < 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of three lines and more that stand elsewhere before go, and documents that hold nothing else."""
    cut = drop_repeated_lines(docs).where("n_lines = 0 OR n_removed < n_lines")
    if "n_chars" not in docs.columns:
        return cut.select(*docs.columns)
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose word 5-grams agree to four fifths the first stays."""
    small_batches(spark)
    return keep_first(docs, near_duplicates(docs.select("doc_id", "text"), n=5, num=80, den=100))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stays as often as the mix takes more than half of it
    (so nearly all of what it draws stands), and those it does not reach go."""
    taken = mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "taken")
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    times = materialize(taken.groupBy("doc_id").agg(F.max(times).alias("times")).where("times > 0"), "mixing-times")
    times = sized(times.withColumnRenamed("doc_id", "_id"), times.count())
    mixed = docs.join(times, F.col("doc_id").eqNullSafe(F.col("_id")))
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "times"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents in sequences of at most 1024 tokens."""
    small_batches(spark)
    return pack(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", near_dedup), ("source_mix", mixing), ("packing", packing)]

#: Training and tokenisation have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
