"""Mixing of sources to target weights by weighted fair queueing, with DataFrame operations only.

Every document of a source's shuffled stream gets a virtual finish time: the words of its source up to its
end, divided by the source's target. The streams are merged in the order of finish time, range by range,
and cut where the total budget is spent. A source whose target is above its size streams twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, sized, text_of

#: Rows that one bucket of a stream, or one range of finish times, is planned to hold.
BUCKET_ROWS = 4_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of a table (source, source_size) with a row for each source.

    Weights repeat over the sources in code point order, null last. The budget (share of all sizes) is split
    by weight; a source takes at most `most` times its size, and what that leaves is split again by weight
    until none is above. Closed form: in the order of size / weight the capped sources come first, and the
    level below which sources are capped is (budget - caps so far) / (weights from here on).
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())  # one row for each source, not for each document
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    at = sizes.withColumn("n", F.row_number().over(ordered)).withColumn("weight", F.get(kinds, (F.col("n") - 1) % len(weights)))
    at = at.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "n").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    at = at.withColumn("level", left / weight)
    free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "n", "level"))).over(every)
    return at.select("source", "source_size", F.coalesce(F.least(free["level"] * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def shuffle_key(seed: int) -> Column:
    """Where a document stands in its source's stream: a hash of its id, the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, first_finish.

    taken: the words the mix takes of it, repeats counted; first_finish: its virtual finish time in the
    first pass (null for no words). Each source's taken words are its target rounded down: the document at
    the target's end is cut there. Null text has size 0 and takes nothing; null is a source of its own, the
    last; rows that repeat an id are documents of their own; an empty table gives no rows. Other columns of
    docs are left out. Streams and the merged order are cut into buckets of hash or time ranges, whose
    sums are added up first, so a source with most rows is no single group.
    """
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    made = docs.select("doc_id", "source", named.alias("stream"), F.regexp_count(text_of(), F.lit(WORD_PATTERN)).cast("long").alias("size"), shuffle_key(seed).alias("key"))
    made = materialize(made.withColumn("row", F.monotonically_increasing_id()), "mixing")
    sizes = made.groupBy("stream", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sizes = materialize(sizes, "mixing-sources")
    aims = targets(sizes.select("source", "source_size"), weights, share, most).select(F.col("source").alias("_s"), "target")
    aims = materialize(sizes.join(aims, F.col("source").eqNullSafe(F.col("_s"))).select("stream", "source_size", "docs", "target"), "mixing-targets")
    totals = aims.agg(F.sum("source_size"), F.sum("docs"), F.count("*")).first()
    budget, ranges = int((totals[0] or 0) * share), max(1, -(-2 * (totals[1] or 0) // BUCKET_ROWS))

    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    known = made.join(sized(aims, totals[2]), "stream")
    known = known.withColumn("bucket", F.floor(place * F.ceil(F.col("docs") / BUCKET_ROWS)))
    worded = known.where("size > 0")
    # words of a source before each of its buckets; a row for each source and bucket
    sums = worded.groupBy("stream", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("stream", "bucket", (F.sum("words").over(W.partitionBy("stream").orderBy("bucket")) - F.col("words")).alias("skip"))
    in_bucket = W.partitionBy("stream", "bucket").orderBy("key", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    queued = worded.withColumn("run", F.sum("size").over(in_bucket)).join(sums, ["stream", "bucket"])
    queued = queued.withColumn("goal", F.floor("target")).withColumn("end", F.col("run") + F.col("skip"))
    # each pass over the source that begins before its target; the last document ends at the target
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("goal") / F.col("source_size")) - 1).cast("int"))
    items = queued.select("row", "size", "goal", "key", "source_size", "end", F.explode(passes).alias("pass"))
    items = items.withColumn("end", F.col("pass") * F.col("source_size") + F.col("end")).drop("pass", "source_size")
    items = items.withColumn("part", F.col("size") - F.greatest(F.lit(0), F.least(F.col("size"), F.col("end") - F.col("goal"))))
    items = items.where("part > 0").withColumn("finish", F.least(F.col("end"), F.col("goal")) / F.col("goal"))
    # the merged order: ranges of finish time, each sorted, cut at the budget
    items = items.withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(ranges - 1)))
    spent = items.groupBy("range").agg(F.sum("part").alias("words"))
    spent = spent.select("range", (F.sum("words").over(W.orderBy("range")) - F.col("words")).alias("before"))
    merged = items.withColumn("sum", F.sum("part").over(W.partitionBy("range").orderBy("finish", "key", "row", "end").rowsBetween(W.unboundedPreceding, 0))).join(spent, "range")
    over = F.greatest(F.lit(0), F.least(F.col("part"), F.col("sum") + F.col("before") - F.lit(budget)))
    taken = merged.groupBy("row").agg(F.sum(F.col("part") - over).alias("taken"), F.min("finish").alias("first_finish"))
    out = known.join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_finish")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('42:' || coalesce(doc_id::VARCHAR, 'null')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS n, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
f AS (SELECT level AS free FROM l WHERE ratio > level ORDER BY ratio, n LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(f.free * weight, cap), cap) AS target FROM l LEFT JOIN f ON true),
q AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS goal,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS stop
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (least(size, greatest(0, goal - (stop - size))) + least(size, greatest(0, goal - source_size - (stop - size))))::BIGINT AS taken
FROM q
"""
