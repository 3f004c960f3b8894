"""Packing of tokenised documents into fixed sequences by cutting-stock column generation.

A document's ids are cut into runs of `size`; each full run is a sequence. What is left over loses a run of
half a sequence if it has one, so that every rest is at most half as long as a sequence (rests longer than
that could not share one, and would be padded). Rests are counted by length. A linear program over patterns (how many rests of each length share a
sequence) covers that histogram; its columns come from a knapsack dynamic program on the dual prices. The
rounded patterns are dealt to the rests by their rank among the rests of their length. The few rests that
rounding leaves over (a bounded number, whatever the corpus) are packed best fit decreasing.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import materialize, releasing, text_of
from .token_counts import default_vocabulary


def knapsack(prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value at each exact fill and the last length taken there; prices by length, -inf if absent."""
    value, taken = np.full(size + 1, -np.inf), np.zeros(size + 1, int)
    value[0] = 0.0
    for fill in range(1, size + 1):
        sums = prices[1 : fill + 1] + value[fill - 1 :: -1][:fill]
        best = int(np.argmax(sums))
        value[fill], taken[fill] = sums[best], best + 1
    return value, taken


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """In numpy's own loops: threads of a linear algebra library may block beside a JVM's."""
    return np.einsum("ij,j->i", matrix, vector)


def first_patterns(demand: dict[int, int], size: int) -> tuple[list[Counter], list[int], list[float]]:
    """A first basis: first fit decreasing, where each pattern repeats until one of its lengths is spent.
    Patterns, the length that each spends, and how often each is used."""
    left: dict[int, float] = dict(sorted(demand.items(), reverse=True))
    patterns, spends, uses = [], [], []
    while left:
        pattern, space = Counter(), size
        for x, n in left.items():
            take = min(space // x, max(math.ceil(n - 1e-9), 1)) if space >= x else 0
            if take:
                pattern[x] = take
                space -= take * x
        spent = min(pattern, key=lambda x: (left[x] / pattern[x], -x))
        share = left.pop(spent) / pattern[spent]
        for x, n in pattern.items():
            if x != spent:
                left[x] = max(0.0, left[x] - n * share)
        patterns.append(pattern)
        spends.append(spent)
        uses.append(share)
    return patterns, spends, uses


def generate_patterns(demand: dict[int, int], size: int, gap: float = 1e-3, rounds: int = 60) -> list[tuple[Counter, float]]:
    """Patterns and how often the linear program uses them; stops within `gap` of its bound or after `rounds`.

    Each round prices patterns by one knapsack: for every length the best pattern that holds it. Those that
    still gain at the duals of their turn enter the basis one after another. Should rounding errors add up,
    the first basis, which is exact, is the answer, and a warning says so.
    """
    if not demand:
        return []
    patterns, spends, uses = first_patterns(demand, size)
    first = list(zip(patterns, uses, strict=True))
    lengths = np.array(sorted(demand))
    row = {int(x): i for i, x in enumerate(lengths)}
    need = np.array([demand[int(x)] for x in lengths], float)
    # no pattern holds a length that an earlier one spent: in that order the basis is triangular
    order = {x: i for i, x in enumerate(spends)}
    lower = np.zeros((len(lengths), len(lengths)))
    for j, pattern in enumerate(patterns):
        for x, n in pattern.items():
            lower[order[x], j] = n
    solved = np.zeros_like(lower)
    for i in range(len(lengths)):
        unit = np.zeros(len(lengths))
        unit[i] = 1.0
        solved[i] = (unit - np.einsum("j,jk->k", lower[i, :i], solved[:i])) / lower[i, i]
    inverse = solved[:, [order[int(x)] for x in lengths]]
    use, duals = np.array(uses), inverse.sum(0)
    prices = np.full(size + 1, -np.inf)
    for _ in range(rounds):
        prices[lengths] = duals
        value, taken = knapsack(prices, size)
        if value.max() <= 1 + gap:  # the bound is the present cost over the best price
            break
        reach = np.maximum.accumulate(value)
        fills = np.array([int(np.argmax(value[: size - x + 1])) for x in lengths])
        worth = duals + reach[size - lengths]
        for i in np.argsort(-worth, kind="stable")[:64]:
            pattern, fill = Counter({int(lengths[i]): 1}), int(fills[i])
            while fill:
                pattern[int(taken[fill])] += 1
                fill -= int(taken[fill])
            column = np.zeros(len(lengths))
            for x, n in pattern.items():
                column[row[x]] = n
            gain = float((duals * column).sum()) - 1
            if gain <= gap / 2:
                continue
            change = times(inverse, column)
            ratios = np.where(change > 1e-7, use / np.where(change > 1e-7, change, 1), np.inf)
            near = ratios <= ratios.min() + 1e-9 * (1 + ratios.min())
            out = int(np.argmax(np.where(near, change, 0)))  # of tied rows the most stable pivot
            if not np.isfinite(ratios[out]):
                continue
            theta, pivot = ratios[out], inverse[out] / change[out]
            inverse -= np.outer(change, pivot)
            inverse[out] = pivot
            use = use - theta * change
            use[out] = theta
            np.maximum(use, 0, out=use)
            duals = duals - gain * pivot
            patterns[out] = pattern
    covered = np.zeros(len(lengths))
    for pattern, n in zip(patterns, use, strict=True):
        for x, k in pattern.items():
            covered[row[x]] += n * k
    if not (np.abs(covered - need) <= 0.5 + 1e-9 * need).all():
        logging.getLogger(__name__).warning("the linear program lost %g rests to rounding; first fit decreasing stands in", np.abs(covered - need).max())
        return first
    return list(zip(patterns, use.tolist(), strict=True)) if use.sum() < sum(uses) else first


def best_fit(items: Counter, size: int) -> list[Counter]:
    """Best fit decreasing of a few items."""
    bins: list[Counter] = []
    by_space: dict[int, list[int]] = defaultdict(list)
    for x in sorted(items.elements(), reverse=True):
        space = next((s for s in range(x, size + 1) if by_space.get(s)), None)
        if space is None:
            bins.append(Counter())
            at, space = len(bins) - 1, size
        else:
            at = by_space[space].pop()
        bins[at][x] += 1
        by_space[space - x].append(at)
    return bins


def plan(demand: dict[int, int], size: int) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], int]:
    """For each length the runs of ranks (from, to, each, first sequence, offset), and the number of sequences.

    Ranks from..to-1 of a length go to sequences first, first+1, ..., `each` to a sequence from offset on.
    """
    rest = Counter({k: v for k, v in demand.items() if v > 0})
    dealt: list[tuple[Counter, int]] = []
    for pattern, use in generate_patterns(rest, size):
        turns = int(min([use + 1e-6, *(rest[x] // n for x, n in pattern.items())]))
        if turns > 0:
            dealt.append((pattern, turns))
            rest.subtract({x: n * turns for x, n in pattern.items()})
    dealt += [(b, 1) for b in best_fit(+rest, size)]
    runs: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
    at: Counter = Counter()
    first = 0
    for pattern, turns in dealt:
        offset = 0
        for x, n in sorted(pattern.items(), reverse=True):
            runs[x].append((at[x], at[x] + n * turns, n, first, offset))
            at[x] += n * turns
            offset += n * x
        first += turns
    return runs, first


#: One row for each piece; full ones have rest 0, and before: how many full pieces, or rests of this length,
#: stand before it in its partition.
PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("rest", T.IntegerType()),
        T.StructField("before", T.LongType()),
    ]
)


def encode(docs: DataFrame, size: int, path: str, end_id: int = 0) -> DataFrame:
    """The pieces of each document's ids (with end_id after them)."""
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ledgerlake.llm.bpe import packed_ids
        from pyspark import TaskContext

        packed, part = packed_ids(path), TaskContext.get().partitionId()
        end, before = int(end_id).to_bytes(4, "little"), Counter()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        for batch in releasing(batches):
            rows: list[tuple] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = packed.ids(value.as_py()) + end
                n, view, at = len(ids) // 4, memoryview(ids), 0
                while at < n:
                    length = size if n - at >= size else half if n - at > half else n - at
                    rest = 0 if length == size else length
                    rows.append((key, n, at, zlib.crc32(view[4 * at : 4 * (at + length)]), part, rest, before[rest]))
                    before[rest] += 1
                    at += length
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=PIECES.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, size: int = 1024, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone, so a piece of length 1. Repeated rows and repeated or null
    ids are packed row by row; an empty table gives no rows. Other columns of docs are left out. Texts are
    read and encoded once; what shuffles is a few numbers a piece. To the driver go the histogram of rests
    (at most size / 2 rows) and back the runs of its patterns (bounded by size alone).
    """
    spark = docs.sparkSession
    made = materialize(encode(docs, size, path or default_vocabulary()), "packing")
    # one row for each partition and length, whatever the number of documents
    cells = materialize(made.groupBy("part", "rest").agg(F.count("*").alias("n")), "packing-cells")
    demand = {r[0]: r[1] for r in cells.groupBy("rest").agg(F.sum("n")).collect()}
    full = demand.pop(0, 0)
    runs, sequences = plan(demand, size)
    runs[0] = [(0, full, 1, sequences, 0)]
    kind = "rest int, runs array<struct<lo:bigint,hi:bigint,each:bigint,first:bigint,at:bigint>>"
    patterns = spark.createDataFrame(list(runs.items()), kind)
    cells = cells.select("part", "rest", (F.sum("n").over(W.partitionBy("rest").orderBy("part")) - F.col("n")).alias("skip"))
    ranked = made.join(cells, ["part", "rest"]).withColumn("rank", F.col("before") + F.col("skip"))
    placed = ranked.join(F.broadcast(patterns), "rest").withColumn("run", F.filter("runs", lambda x: (x.lo <= F.col("rank")) & (F.col("rank") < x.hi))[0])
    within = F.col("rank") - F.col("run.lo")
    return placed.select(
        "doc_id",
        "start",
        F.when(F.col("rest") == 0, F.lit(size)).otherwise(F.col("rest")).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("run.first") + F.floor(within / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + within % F.col("run.each") * F.col("rest")).cast("long").alias("offset"),
    )
