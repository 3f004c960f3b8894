"""The corpus operators' queries over whole tables, in the columns that their contracts name, and their SQL."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_search, line_dedup, mixing, url_filter
from .common import held_out, table


def op1_toxicity_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text by a conditional random field trained without the held out labels."""
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 1.5 times the corpus takes of each document."""
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents", "doc_id", "source", "text")).drop("first_finish")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the passages of three lines and more that stand elsewhere before."""
    from .line_dedup import drop_repeated_lines

    return drop_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text from its prefix table."""
    from .token_counts import prefix_token_counts

    counted = prefix_token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100."""
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose word 3-grams agree to nine tenths."""
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), n=3, num=90, den=100)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    from .packing import pack

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_quality_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text by an additive model trained without the held out labels."""
    from .quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages", "page_id", "url"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every vector whose id is divisible by 50."""
    from .exact_search import top_inner_products

    return top_inner_products(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers that share bytes, and how common their pairs are over all documents."""
    from .alignment import link_statistics, pair_counts

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return link_statistics(docs, pair_counts(docs))


def op12_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by replay of the merges, and the bytes that the ids stand for, as digests."""
    from .merge_replay import round_trip

    return round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all texts with the far more frequent near word that each may be a variant of."""
    from .spelling import variants, word_counts

    return variants(word_counts(table(spark, sf_dir, "documents", "doc_id", "text")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity_field,
        op2_source_mix,
        op3_line_dedup,
        op4_token_counts,
        op5_hilbert_neighbours,
        op6_ngram_join,
        op7_packing,
        op8_quality_additive,
        op9_url_filter,
        op10_exact_top_k,
        op11_tokenizer_alignment,
        op12_merge_replay,
        op13_spelling_variants,
        pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_source_mix": mixing.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op9_url_filter": url_filter.ORACLE, "op10_exact_top_k": exact_search.ORACLE}
