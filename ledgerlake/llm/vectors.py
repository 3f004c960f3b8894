"""What both vector searches share: which vectors take part, and the merge of partial results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(vectors: DataFrame, zero: bool = True) -> DataFrame:
    """vec_id, embedding, dims of the rows whose id and vector are there and whose components are all finite
    (and, unless zero, not all 0)."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite
    if not zero:
        good = good & F.exists(x, lambda v: v != 0)
    return vectors.select("vec_id", "embedding", F.size("embedding").alias("dims")).where(F.coalesce(good, F.lit(False)))


def matrix(table: pa.Table, column: str = "embedding") -> np.ndarray:
    """Rows of equally long vectors as doubles."""
    col = table.column(column).combine_chunks()
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), float)
    return flat.reshape(table.num_rows, -1)


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query; a vec_id that was found again counts once."""
    once = found.groupBy("query_id", "vec_id").agg((F.max if descending else F.min)("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc() if descending else F.col("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
