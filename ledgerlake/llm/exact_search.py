"""Exact top-k search by inner product over integer vectors, pruned by segment statistics.

A vector is cut into 1, 2, 4, ... segments. For a segment of n components the inner product of two vectors
is at most n * mean * mean + deviation * deviation, where the deviation is the norm of what is left without
the mean; summed over segments that bounds the score from above (as a bound on the distance from below).
Finer segments bound tighter. Pairs whose coarse bound is under the query's floor (the k-th best score among
the longest rows) go first; exact scores are computed for those that every bound leaves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .vectors import best, matrix, usable


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row sqrt(n) * mean and deviation of each segment: the bound is the inner product of these."""
    parts = [p for p in np.array_split(x, segments, axis=1) if p.shape[1]]
    means = np.stack([p.mean(1) for p in parts], 1)
    norms = np.stack([np.sqrt(np.square(p - m[:, None]).sum(1)) for p, m in zip(parts, means.T, strict=True)], 1)
    return np.hstack([means * np.sqrt([p.shape[1] for p in parts]), norms])


def search_block(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of query and row, and the exact score, of the pairs that may reach the query's floor."""
    counts = [s for s in (1, 4, 16, 32) if s <= max(1, rows.shape[1] // 2)]
    of_rows = [segment_statistics(rows, s) for s in counts]
    of_queries = [segment_statistics(queries, s) for s in counts]
    exact_in_doubles = rows.shape[1] * np.abs(rows).max(initial=1) * np.abs(queries).max(initial=1) < 2**53
    wide = None if exact_in_doubles else [np.vectorize(int, otypes=[object])(x) for x in (queries, rows)]
    out = []
    for lo in range(0, len(queries), 128):
        at = slice(lo, lo + 128)
        alive, pairs = ids[None] != own[at, None], None
        for left, right in zip(of_queries, of_rows, strict=True):
            # all pairs at once while many are left, then those that are left
            bound = left[at] @ right.T if pairs is None else np.einsum("ij,ij->i", left[pairs[0]], right[pairs[1]])
            near = bound + 1e-9 * np.abs(bound) + 1e-3 >= (floors[at, None] if pairs is None else floors[pairs[0]])
            if pairs is not None:
                pairs = [x[near] for x in pairs]
            else:
                alive &= near
                if np.count_nonzero(alive) * 8 < alive.size:
                    i, j = np.nonzero(alive)
                    pairs = [i + lo, j]
        if wide is None and pairs is None:
            every = queries[at] @ rows.T  # whole numbers, so exact
            i, j = np.nonzero(alive & (every >= floors[at, None]))
            out.append((i + lo, j, every[i, j].astype(np.int64)))
            continue
        if pairs is None:
            i, j = np.nonzero(alive)
            pairs = [i + lo, j]
        if wide is None:
            scores = np.einsum("ij,ij->i", queries[pairs[0]], rows[pairs[1]]).astype(np.int64)
        else:
            scores = [max(1 - 2**63, min(2**63 - 1, int((wide[0][i] * wide[1][j]).sum()))) for i, j in zip(*pairs, strict=True)]
        out.append((*pairs, np.array(scores, np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, block: int = 8192, query_block: int = 8192, heads: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` the k highest inner products of
    floor(scale * component), ties to the smaller vec_id; scores beyond a long saturate.

    Vectors that are null, empty or hold null or non-finite components, and rows without an id, take no
    part; vectors of another length than the query's are no candidates. vec_id names a vector: the query's
    own id is no candidate and a repeated id appears once, with its best score. An empty table gives no
    rows. First the queries meet the `heads` longest rows, whose k-th best score is a floor that prunes from
    the start. Then they meet all rows block by block: each block of rows meets each block of queries in a
    task of bounded size, and each sends on no more than what may be among the k best.
    """
    data = usable(vectors)
    counted = data.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    blocks, query_blocks = max(1, -(-counted[0] // block)), max(1, -(-counted[1] // query_block))
    turn = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = data.where(F.col("vec_id") % every == 0).withColumn("q", turn(query_blocks, 2))

    def whole(table: pa.Table) -> np.ndarray:
        return np.floor(scale * matrix(table))

    def start(left: pa.Table, right: pa.Table) -> pa.Table:
        """The queries with their floors."""
        floors = np.full(right.num_rows, -np.inf)
        if left.num_rows and right.num_rows:
            ids, own = (t.column("vec_id").to_numpy() for t in (left, right))
            i, j, scores = search_block(whole(right), whole(left), own, ids, floors)
            order = np.lexsort((-scores, ids[j], i))
            i, j, scores = i[order], ids[j[order]], scores[order]
            best_of_id = np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])))[: len(i)]
            i, scores = i[best_of_id], scores[best_of_id]
            order = np.lexsort((-scores, i))
            i, scores = i[order], scores[order]
            first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))[: len(i)]
            last = first + k - 1
            enough = last < np.append(first[1:], len(i))
            floors[i[first[enough]]] = scores[last[enough]]
        return right.append_column("floor", pa.array(floors, pa.float64()))

    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = data.orderBy(norm.desc(), "vec_id").limit(heads).withColumn("q", spread(query_blocks))
    fields = T.StructType([*asked.schema.fields, T.StructField("floor", T.DoubleType())])
    floored = longest.groupBy("dims", "q").cogroup(asked.groupBy("dims", "q")).applyInArrow(start, fields)
    floored = materialize(floored, "top-floors")

    rows = data.withColumn("b", turn(blocks, 1)).withColumn("q", spread(query_blocks))
    queries = floored.withColumn("b", spread(blocks))
    made = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return made.empty_table()
        ids, own = (t.column("vec_id").to_numpy() for t in (left, right))
        i, j, scores = search_block(whole(right), whole(left), own, ids, right.column("floor").to_numpy())
        order = np.lexsort((ids[j], -scores, i))
        i, j, scores = i[order], ids[j[order]], scores[order]
        starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))[: len(i)]
        place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
        kept = place < k * int(np.unique(ids, return_counts=True)[1].max())  # so many hold k ids
        return pa.table([pa.array(c, pa.int64()) for c in (own[i[kept]], j[kept], scores[kept])], schema=made)

    keys = ["dims", "b", "q"]
    found = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    return best(found, k, descending=True).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
