"""Approximate nearest neighbours by shifted Hilbert orderings of projected vectors.

Several orderings, each of its own projection and shift, give every vector a key. Equal shares of each
ordering are blocks, cut by as many bits of the key as their sizes need; a query meets the vectors of the
blocks around its own in each ordering, and the exactly measured distances of all orderings are merged.
How wide the windows are is fitted, with the projection, on a bounded sample: the narrowest that finds
`aim` of the sample's true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, sized
from .vectors import best, matrix, usable

DIMS, BITS = 8, 7
#: Queries that meet a block in one task.
QUERIES = 8192
#: Bits of a key that are counted at a time to cut an ordering into blocks.
CELL_BITS = 14
#: Where a row is in an ordering: its first block of `parts`, and the window of a query there.
PLACE = ["curve", "first", "parts", "low", "high"]
#: Window widths, as shares of an ordering, that the fit tries.
SHARES = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows), `bits` to a coordinate."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            x[high, 0] ^= p
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in reversed(range(bits)):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b) & 1
    return key


class Orderings:
    """Projections, ranges and shifts of the orderings, fitted on a sample (rows of vectors)."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.mean = sample.mean(0)
        _, axes = np.linalg.eigh(np.cov((sample - self.mean).T).reshape(d, d) if len(sample) > 1 else np.eye(d))
        axes = axes[:, ::-1]  # most varied first
        self.maps, self.low, self.step, self.shift = [], [], [], []
        for c in range(curves):
            # each ordering mixes its own share of the axes, strong and weak ones
            own = axes[:, c::curves] if d >= curves * DIMS else axes
            mix = rng.normal(size=(own.shape[1], DIMS))
            self.maps.append(own @ (mix / np.linalg.norm(mix, axis=0)))
            y = (sample - self.mean) @ self.maps[-1]
            low, high = np.quantile(y, [0.005, 0.995], axis=0)
            self.low.append(low)
            self.step.append(np.maximum(high - low, 1e-12))
            self.shift.append(rng.uniform(0, 0.5, DIMS))

    def first(self, curves: int) -> "Orderings":
        for x in (self.maps, self.low, self.step, self.shift):
            del x[curves:]
        return self

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for m, low, step, shift in zip(self.maps, self.low, self.step, self.shift, strict=True):
            u = np.clip(((x - self.mean) @ m - low) / step, 0, 1) / 2 + shift
            out.append(hilbert_keys(np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS))
        return out


def centre(x: np.ndarray) -> np.ndarray:
    """The mean of the rows: without it products of vectors far from the origin would round their distances away."""
    with np.errstate(over="ignore", invalid="ignore"):
        mean = x.mean(0)
    return np.where(np.isfinite(mean), mean, 0.0)


def fit(sample: np.ndarray, curves: int, k: int, aim: float) -> tuple[Orderings, float, float]:
    """The orderings, the window's share of an ordering, and the recall it has in the sample. Of one to
    `curves` orderings as many as reach the recall with the fewest vectors met: a few wide windows would
    cost more than one that is wider."""
    made = Orderings(sample, curves)
    queries = np.arange(0, len(sample), max(1, len(sample) // 200))
    near_zero = sample - centre(sample)
    norms = np.square(near_zero).sum(1)
    d = norms[queries][:, None] + norms[None] - 2 * near_zero[queries] @ near_zero.T
    d[np.arange(len(queries)), queries] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return Orderings(sample, 1), 1.0, 1.0
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    gaps = []
    for key in made.keys(sample):
        rank = np.empty(len(sample), int)
        rank[np.argsort(key, kind="stable")] = np.arange(len(sample))
        gaps.append(np.abs(rank[near] - rank[queries][:, None]))
    found = [(1.0, 1, 1.0, 1.0)]  # cost, orderings, share, recall
    for c in range(1, curves + 1):
        gap = np.min(gaps[:c], axis=0) / len(sample)
        reached = [(c * share, c, share, recall) for share in SHARES[:-1] if (recall := float((gap <= share / 2).mean())) >= aim]
        found += reached[:1]
    _, used, share, recall = min(found)
    return made.first(used), share, recall


class Blocks:
    """The blocks of one ordering: the first key of each, and the keys whose rows are dealt over several.

    leaves: (low, first, parts) in the order of low; keys from low on, up to the next leaf's, are in block
    first or, if parts > 1, all equal low and are dealt over blocks first to first + parts - 1.
    """

    def __init__(self, leaves: list[tuple[int, int, int]], blocks: int, reach: int):
        self.low, self.first, self.parts = (np.array(c, np.int64) for c in zip(*sorted(leaves), strict=True))
        self.blocks, self.reach = blocks, reach
        # the blocks that go with each: a window that meets a dealt key takes all of its blocks
        self.begin, self.end = np.arange(blocks), np.arange(blocks)
        for first, parts in zip(self.first[self.parts > 1], self.parts[self.parts > 1], strict=True):
            self.begin[first : first + parts] = np.minimum(self.begin[first : first + parts], first)
            self.end[first : first + parts] = np.maximum(self.end[first : first + parts], first + parts - 1)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each key its first block, its number of blocks, and the window of a query there."""
        at = np.searchsorted(self.low, keys, side="right") - 1
        first, parts = self.first[at], self.parts[at]
        low = np.maximum(0, first - self.reach)
        high = np.minimum(self.blocks - 1, first + parts - 1 + self.reach)
        return first, parts, self.begin[low], self.end[high]


def cut(per_curve: DataFrame, block: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each curve the leaves (see Blocks) of its rows (curve, key), in blocks of about `block` rows.

    Cells of the top bits are counted; those with more rows than a block are counted by the next bits, to
    the whole key. What comes to the driver is one row for each block or cell larger than a block.
    """
    spark, total = per_curve.sparkSession, DIMS * BITS
    leaves: dict[int, list[tuple[int, int, int]]] = {}
    rows = per_curve.withColumn("parent", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long"))
    for shift in range(total - CELL_BITS, -1, -CELL_BITS):
        cells = rows.groupBy("curve", "parent", "base", F.shiftright("key", shift).alias("cell")).agg(F.count("*").alias("n"))
        before = W.partitionBy("curve", "parent").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # at most 1 << CELL_BITS cells
        cells = cells.withColumn("at", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        big = F.when(F.col("n") > block, F.col("cell"))
        groups = cells.groupBy("curve", "parent", F.floor(F.col("at") / block).cast("long").alias("first"), big.alias("big"))
        found = groups.agg(F.min("cell").alias("cell"), F.min("at").alias("at"), F.sum("n").alias("n")).collect()
        deeper = []
        for r in found:
            if r.big is None or shift == 0:
                parts = 1 if r.big is None else -(-r.n // block)
                leaves.setdefault(r.curve, []).append((r.cell << shift, r.first, parts))
            else:
                deeper.append((r.curve, r.cell, r["at"]))
        if not deeper:
            break
        inner = F.broadcast(spark.createDataFrame(deeper, "curve int, parent long, base long"))
        rows = per_curve.withColumn("parent", F.shiftright("key", shift)).join(inner, ["curve", "parent"])
    return leaves


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, curves: int = 4, aim: float = 0.95, sample_rows: int = 4000, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` the k nearest found, by Euclidean
    distance in doubles, ties to the smaller vec_id.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take
    no part; vectors of each length are searched among themselves, by an index of their own. vec_id names a
    vector: the query's own is no candidate, a repeated one appears once, with its least distance. An empty
    table gives no rows. The fit sees a sample of about sample_rows; every row is indexed, in the order of
    whole keys that the fit measured. Rows of one key that are more than a block are dealt over blocks, all
    of which a query whose window touches one of them meets, so nothing is cut off.
    """
    data = usable(vectors, zero=False)
    sizes = data.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect()  # a row for each length
    found = [_nearest(data.where(F.col("dims") == dims), rows, k, every, curves, aim, sample_rows, block) for dims, rows in sizes]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best(reduce(DataFrame.union, found), k, descending=False).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(data: DataFrame, rows: int, k: int, every: int, curves: int, aim: float, sample_rows: int, block: int) -> DataFrame:
    """query_id, vec_id, score: what the orderings of vectors of one length find, k for each query and block."""
    chance = min(1.0, sample_rows / rows)
    sample = data.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 20)) < int(chance * (1 << 20)) + 1)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        rows = np.array(pdf.embedding.tolist(), float)
        x = rows[np.lexsort((*rows.T[::-1], pdf.vec_id.to_numpy()))]  # the same fit whatever the order of rows
        made, share, recall = fit(x, curves, k, aim)
        return pd.DataFrame({"model": [pickle.dumps(made)], "share": [share], "recall": [recall]})

    model, share, _ = sample.groupBy("dims").applyInPandas(learn, "model binary, share double, recall double").first()

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        made = pickle.loads(model)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(np.stack(made.keys(matrix(t)), 1)), pa.list_(pa.int64()))], names=["vec_id", "embedding", "keys"])

    keyed = data.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(key, "vec_id long, embedding array<double>, keys array<long>")
    keyed = materialize(keyed.withColumn("embedding", F.col("embedding").cast("array<float>")) if dict(data.dtypes)["embedding"] == "array<float>" else keyed, "ann")
    leaves = cut(keyed.select(F.posexplode("keys").alias("curve", "key")), block)
    blocks = -(-rows // block)
    # a block holds rows whose cells begin in it, so ranks and blocks may differ by one block more
    reach = 0 if blocks == 1 else int(np.ceil(share * rows / 2 / block)) + 1
    orders = {c: Blocks(one, blocks, reach) for c, one in leaves.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in PLACE]))
        for batch in batches:
            keys = np.array(batch.column(2).to_pylist(), np.int64).reshape(batch.num_rows, -1)
            found = [(np.full(len(keys), c), *orders[c].places(keys[:, c])) for c in range(keys.shape[1])]
            # rows outside, curves inside
            columns = [pa.array(np.stack(x, 1).ravel().astype(np.int32)) for x in zip(*found, strict=True)]
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, PLACE)).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "embedding", "places"])

    def placed(some: DataFrame) -> DataFrame:
        fields = [keyed.schema["vec_id"], keyed.schema["embedding"], T.StructField("places", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in PLACE])))]
        return some.mapInArrow(place, T.StructType(fields)).select("vec_id", "embedding", F.inline("places"))

    indexed = placed(keyed).withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).select("curve", "block", "vec_id", "embedding")
    asked = placed(keyed.where(F.col("vec_id") % every == 0))
    asked = asked.select("curve", F.explode(F.sequence("low", "high")).alias("block"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    # a block that more queries meet than a task holds meets them in turns
    crowded = asked.groupBy("curve", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns")).where("turns > 1")
    crowded = materialize(crowded, "ann-crowded")
    turns = sized(crowded, crowded.count())
    last = F.coalesce(F.col("turns"), F.lit(1)) - 1
    indexed = indexed.join(turns, ["curve", "block"], "left").withColumn("turn", F.explode(F.sequence(F.lit(0), last))).drop("turns")
    asked = asked.join(turns, ["curve", "block"], "left").withColumn("turn", F.pmod(F.xxhash64("query_id"), last + 1).cast("int")).drop("turns")
    made = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return made.empty_table()
        ids, own = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        x, q = matrix(left), matrix(right, "query")
        middle, out = centre(x), []
        moved = x - middle
        norms = np.square(moved).sum(1)
        # so many of the nearest rows hold k ids at least, and more than rounding mixes up
        keep = min(len(x), 4 * k * int(np.unique(ids, return_counts=True)[1].max()))
        for lo in range(0, len(q), 256):
            some = q[lo : lo + 256]
            rough = norms[None] - 2 * (some - middle) @ moved.T
            for j, row in enumerate(rough):
                row = np.where(ids == own[lo + j], np.inf, row)
                at = np.flatnonzero((row <= np.partition(row, keep - 1)[keep - 1]) & (row < np.inf))
                score = np.sqrt(np.square(x[at] - some[j]).sum(1))
                order = np.lexsort((ids[at], score))
                at, score = at[order], score[order]
                first = np.sort(np.unique(ids[at], return_index=True)[1])[:k]
                out.append((np.full(len(first), own[lo + j]), ids[at][first], score[first]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], schema=made)

    keys = ["curve", "block", "turn"]
    return indexed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
