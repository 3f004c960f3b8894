"""Groups of spelling variants: words one code point apart, found by hashes of all single deletions.

Prefix and suffix polynomial hashes give the hash of every word without one of its code points, for a batch
of words at once. Keys are partitioned by their high bits and sorted; only keys that several words share go
on, are joined with the strings again and compared. Two words that differ by a replaced code point are
equal without it, and no two words share more than one place in that way; an inserted code point is a word
that equals another one without it. So numbers of near words and the best of them come from sums over
groups, and no pairs are made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BOOL, INT, LONG, STRING, drop, materialize, releasing, schema, text_of
from .ngram_join import mix64

#: Words of the corpus: letters of the Latin-1 range. Only A-Z is lower-cased.
RUN, UPPER = "A-Za-zÀ-ÿ", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A word has at least so many code points and occurrences; a form is so many times as frequent as its word.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Of the run's occurrences in documents one in so many loses a code point.
LOSS = 199
#: Words that a task counts before it passes them on, code points whose keys are made at once.
COUNTED, EXPANDED = 400_000, 1 << 20
_BASE = 0x5851F42D4C957F2D | 1


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of whole texts that are long and frequent enough, in tasks summed before the shuffle.

    Of a run whose crc32 of `<doc_id>:<run>` is divisible by 199 the code point at crc32 % length is left out,
    in each of its occurrences in the document. Null texts have no words; a null id reads as the empty text.
    """
    long_runs = re.compile(f"[{RUN}]{{{least_length},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def passed_on() -> Iterator[pa.RecordBatch]:
            words, n = list(counts), list(counts.values())
            counts.clear()
            for at in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + (1 << 16)], pa.string()), pa.array(n[at : at + (1 << 16)], pa.int64())], names=["word", "n"])

        crc = zlib.crc32
        for batch in releasing(batches):
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                start = crc(key.as_py().encode() + b":")
                for run, times in Counter(long_runs(value.as_py())).items():
                    word = run.lower() if run.isascii() else run.translate(UPPER)
                    h = crc(word.encode(), start)
                    if h % LOSS:
                        counts[word] += times
                    elif len(word) > least_length:
                        at = h % len(word)
                        counts[word[:at] + word[at + 1 :]] += times
                if len(counts) > COUNTED:
                    yield from passed_on()
        yield from passed_on()

    texts = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), text_of(text).alias("text"))
    partial = texts.mapInArrow(count, schema(word=STRING, n=LONG))
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def deletion_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in a row: the hash without each code point, whether the code point differs from the one
    before it in the word, and the hash of each whole word. Equal strings have equal hashes."""
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n, first = len(points), np.cumsum(size) - size
    longest = int(size.max(initial=0))
    power = np.ones(longest + 1, np.uint64)
    np.multiply.accumulate(np.full(longest, _BASE, np.uint64), out=power[1:])
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(n) - first[word]
    terms = np.append(np.uint64(0), np.cumsum(points * power[place], dtype=np.uint64))  # modulo 2^64
    prefix = terms[:-1] - terms[first][word]
    suffix = terms[first + size][word] - terms[1:]
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))  # what follows moves one place to the left
    changes = np.append(True, points[1:] != points[:-1]) if n else np.zeros(0, bool)
    changes[first[size > 0]] = True
    return mix64(prefix + suffix * inverse), changes, mix64(terms[first + size] - terms[first])


def deletion_keys(words: DataFrame) -> DataFrame:
    """key, id, place, first of every word (id, word): one row for each deletion (first: not within a run of
    equal code points) and one, at place -1, for the whole word."""
    names = ["key", "id", "place", "first"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: list[int], run: list[str]) -> Iterator[pa.RecordBatch]:
            deleted, changes, whole = deletion_hashes(run)
            size = np.array([len(w) for w in run])
            id_ = np.array(ids, np.int64)
            place = np.arange(len(deleted)) - np.repeat(np.cumsum(size) - size, size)
            columns = [np.concatenate(x) for x in ((whole, deleted), (id_, np.repeat(id_, size)), (np.full(len(run), -1), place), (np.zeros(len(run), bool), changes))]
            columns[0], columns[2] = columns[0].view(np.int64), columns[2].astype(np.int32)
            for at in range(0, len(columns[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 17)]) for c in columns], names=names)

        for batch in releasing(batches):
            ids, run, total = [], [], 0
            for i, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                word = w.as_py()
                if run and total + len(word) > EXPANDED:
                    yield from rows(ids, run)
                    ids, run, total = [], [], 0
                ids.append(i)
                run.append(word)
                total += len(word)
            if run:
                yield from rows(ids, run)

    return words.select("id", "word").mapInArrow(keys, schema(key=LONG, id=LONG, place=INT, first=BOOL))


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows whose key stands for near words: a whole word and another word's deletion, or deletions of two
    words at one place. Radix partitions by the key's high bits, each sorted and swept; a group lies within
    one, and has at most the code points' number of words at each place."""
    names = ["key", "id", "place", "first"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(c: list[np.ndarray]) -> pa.RecordBatch:
            key, _, place, first = c
            start = np.append(True, key[1:] != key[:-1])
            group = np.cumsum(start) - 1
            whole = np.zeros(group[-1] + 1, bool)
            whole[group[place < 0]] = True
            alike = ~start & (place == np.append(-2, place[:-1])) & (place >= 0)  # in order of place within a key
            alike[:-1] |= alike[1:]
            cut = np.zeros(group[-1] + 1, bool)
            cut[group[first]] = True
            keep = alike | (whole & cut)[group] & (first | (place < 0))
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in c], names=names)

        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            c = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int(np.searchsorted(c[0], c[0][-1]))  # the last key may go on
            if cut:
                yield found([x[:cut] for x in c])
            rest = [x[cut:] for x in c]
        if rest is not None:
            yield found(rest)

    return keys.repartition(F.shiftright("key", 40)).sortWithinPartitions("key", "place").mapInArrow(sweep, schema(key=LONG, id=LONG, place=INT, first=BOOL))


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, best of the words (id, word, n) that have near words: how many, and of those with the
    largest n the first in code-point order (best.word, best.minus_n, best.id)."""
    shared = shared_keys(deletion_keys(words)).join(words, "id")
    place = F.col("place")
    rest = F.when(place < 0, F.col("word")).otherwise(F.concat(F.expr("substr(word, 1, place)"), F.expr("substr(word, place + 2)")))
    shared = shared.select("key", "place", "first", "id", rest.alias("rest"), F.struct((-F.col("n")).alias("minus_n"), "word", "id").alias("own"))
    stored = materialize(shared, "spelling-shared")
    shared = stored.repartition("key")
    # equal without the code point at one place: all others of the group are near; the best but oneself
    at_place = W.partitionBy("key", "rest", "place")
    ranked = at_place.orderBy("own").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, second = F.first("own").over(ranked), F.nth_value("own", 2).over(ranked)
    replaced = shared.where("place >= 0").select("id", (F.count("*").over(at_place) - 1).alias("n_near"), F.when(first["id"] == F.col("id"), second).otherwise(first).alias("best"))
    # a whole word that is another one without a code point
    by_rest = W.partitionBy("key", "rest")
    whole, longer = place < 0, F.col("first")
    moved = shared.where(whole | longer).select(
        "id",
        F.when(whole, F.sum(F.when(longer, 1).otherwise(0)).over(by_rest)).otherwise(F.sum(F.when(whole, 1).otherwise(0)).over(by_rest)).alias("n_near"),
        F.when(whole, F.min(F.when(longer, F.col("own"))).over(by_rest)).otherwise(F.min(F.when(whole, F.col("own"))).over(by_rest)).alias("best"),
    )
    near = replaced.unionByName(moved).where("n_near > 0")
    out = materialize(near.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")), "spelling-near")
    drop(stored)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """id, root_id of the words (id, form_id): the last one when forms are followed. Each step multiplies the
    count, so chains are short; their length halves with every round."""
    now = forms.select("id", F.col("form_id").alias("root_id"))
    while True:
        step = now.select(F.col("id").alias("_at"), F.col("root_id").alias("_next"))
        moved = now.join(step, F.col("root_id") == F.col("_at"), "left").select("id", F.coalesce("_next", "root_id").alias("root_id"), F.col("_next").isNotNull().alias("_moved"))
        moved = materialize(moved, "spelling-roots")
        if hasattr(now, "stored_at"):
            drop(now)
        now = moved
        if not now.where("_moved").head(1):
            return now.select("id", "root_id")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of the distinct words (word, n; neither null).

    form: of the near words (one code point inserted, deleted or replaced) the one with the largest n, ties to
    the first in code-point order, if its n is at least `times` (at least 2) the word's; root: the last form
    reached. No words give no rows.
    """
    if times < 2:
        raise ValueError("times must be at least 2: forms have to lead upwards")
    words = materialize(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = near_words(words)
    best = near.select("id", "n_near", F.col("best.id").alias("form_id"), F.col("best.word").alias("form"), (-F.col("best.minus_n")).alias("form_n"))
    joined = words.join(best, "id", "left")
    good = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    joined = joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(good, F.col(c)).alias(c) for c in ("form_id", "form", "form_n")])
    formed = materialize(joined, "spelling-forms")
    drop(near)
    followed = roots(formed.where("form_id IS NOT NULL").select("id", "form_id"))
    ends = followed.join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    return formed.join(ends, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
