"""Removal of repeated passages by overlapping windows of lines, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, drop, join_unique, materialize

#: Blank characters: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    """The lines that are not blank."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def line_windows(keyed: DataFrame, lines: int = 3) -> DataFrame:
    """A row for each window of consecutive lines that are not blank: its row (doc, hash), the number of its
    first line and the hash of its lines. A line counts without the blanks around it."""
    hashes = F.transform(_lines(F.col("text")), lambda x: F.xxhash64(F.btrim(x, F.lit(BLANKS))))
    made = keyed.select("doc", "hash", hashes.alias("h")).where(F.size("h") >= lines)
    window = F.transform(
        F.sequence(F.lit(0), F.size("h") - lines),
        lambda i: F.struct(i.alias("at"), F.unhex(F.substring(F.md5(F.array_join(F.slice("h", i + 1, lines).cast("array<string>"), ",")), 1, 24)).alias("window")),
    )
    return made.select("doc", "hash", F.inline(window))


def drop_repeated_lines(docs: DataFrame, lines: int = 3) -> DataFrame:
    """docs with text cut, and n_lines, n_removed: how many of its lines are not blank, and were removed.

    Wherever `lines` consecutive lines stand a second time (in doc_id order, then by place; null ids last)
    they are removed; overlapping windows remove the union of what they cover, and each removed line has a
    kept one before it. A text that loses lines is put together from the kept ones, without blank lines;
    any other stays as it is. Null text stays null and a text with fewer lines is left alone. Identical rows
    count as one place and lose the same lines; an empty table gives no rows. Columns n_lines and n_removed
    of docs give way, any other column stays, whatever its name. What shuffles is a hash for each line; the
    numbers of removed lines are broadcast to the texts if their counted bytes are few, else texts shuffle once.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # the row in one column, so that no name of its columns meets those made here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    text = F.coalesce(F.col("row").getField("text").cast("string"), F.lit(""))
    # doc and hash tell rows apart by what they hold; identical rows are one place
    keyed = rows.select("row", F.coalesce(F.col("row").getField("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))
    windows = materialize(line_windows(keyed, lines), "lines")
    place = F.struct("doc", "hash", "at")
    counted = windows.groupBy("window").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1")
    repeated = materialize(counted, "lines-repeated")
    marked = join_unique(windows, repeated, "window", "times", windows.count(), repeated.count(), window=12, first=24)
    gone = marked.where(F.col("first").isNotNull() & (F.col("first") != place)).groupBy("doc", "hash").agg(F.collect_set("at").alias("gone"))
    gone = materialize(gone, "lines-gone")
    drop(windows, repeated)
    total = gone.agg(F.count("*"), F.sum(F.size("gone"))).first()
    fits = 24 * total[0] + 4 * (total[1] or 0) <= BROADCAST_BYTES
    cut = keyed.join(F.broadcast(gone) if fits else gone.hint("shuffle_hash"), ["doc", "hash"], "left").withColumn("lines", _lines(F.col("text")))
    covered = F.array_distinct(F.flatten(F.transform("gone", lambda i: F.sequence(i, i + (lines - 1)))))
    cut = cut.withColumn("kept", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)))
    text = F.when(F.col("gone").isNotNull(), F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")).otherwise(F.col("row").getField("text"))
    removed = F.when(F.col("gone").isNotNull(), F.size("lines") - F.size("kept")).otherwise(0)
    columns = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in kept]
    return cut.select(*columns, F.size("lines").cast("int").alias("n_lines"), removed.cast("int").alias("n_removed"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, pos, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
f AS (SELECT doc_id, line, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p FROM l WHERE t <> ''),
w AS (SELECT doc_id, p, t AS a, lead(t, 1) OVER o AS b, lead(t, 2) OVER o AS c FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS n FROM w WHERE c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, p + k AS p FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1),
k AS (SELECT f.doc_id, count(*) AS n_lines, count(g.p) AS n_removed,
             coalesce(string_agg(f.line, chr(10) ORDER BY f.p) FILTER (g.p IS NULL), '') AS cut
      FROM f LEFT JOIN g ON f.doc_id = g.doc_id AND f.p = g.p GROUP BY f.doc_id)
SELECT d.doc_id, CASE WHEN n_removed > 0 THEN cut ELSE d.text END AS text,
       coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
