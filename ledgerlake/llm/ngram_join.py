"""Jaccard join of documents over word n-grams, by count vectors in R-trees.

Exact copies (equal sets) are one class each, and classes are joined:

1. Shingles are hashed into groups, the groups into blocks. Two sets that differ in at most d shingles
   have equal group counts in all but d of the blocks; with more than d blocks some block's count vector
   is equal. So equal vectors of a block, within sizes that can link, give neighbourhoods.
2. Each neighbourhood is bulk-loaded into an R-tree over the points of its group counts. The overlap of
   two boxes is at most the sum of the smaller upper corners; boxes, level by level, then points, that
   cannot reach the threshold are dropped. What survives, connected, gives clusters: no link crosses them.
3. Within each cluster the same tree prunes again, and surviving pairs are verified on the sets, unless
   they are connected already.

Neighbourhoods and clusters beyond PART_ROWS are split. Each part takes the hub along; after that, only
what is still apart from the largest component visits the other parts, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, held, join_unique, materialize, releasing, sized, text_of
from .components import components

#: Members that one part of a neighbourhood holds, that one unit of work is planned to, and shingles of either.
PART_ROWS, UNIT_ROWS, PART_SHINGLES = 1024, 256, 500_000
#: Points of an R-tree's leaf, and children of a node.
FAN = 16
#: One document in so many is asked for hot keys.
SAMPLE = 64
#: Words whose hashes a worker keeps.
CACHE = 100_000
#: Sizes of a stratum are within this ratio.
RATIO = 1.3

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = x.astype(_U)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


class Words(dict):
    """64-bit hashes of words; the first seen stay."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE and len(word) < 64:
            self[word] = out
        return out


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams, A-Z lower-cased; the whole of shorter texts."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters, space and 9 to 13
    if not words:
        return np.empty(0, _U)
    cache = held("ngram-words", Words)
    w = np.fromiter([cache[x] for x in words], _U, len(words))
    with np.errstate(over="ignore"):
        if len(w) < n:
            out = np.array([len(w)], _U)
            for x in w:
                out = mix64(out * _U(0x9E3779B97F4A7C15) + x)
            return out
        out = w[: len(w) - n + 1].copy()
        for k in range(1, n):
            out = out * _U(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
    out = mix64(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


class Strata:
    """Size classes, and how many blocks each needs for a threshold of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.blocks, self.spare = [1], [], []
        while self.low[-1] < 1 << 31:
            low = self.low[-1]
            high = max(low + 1, int(low * RATIO))
            differ = (high - 1) * (den - num) // num
            mean = (differ + 1) * math.exp(-low / (differ + 1)) if differ else 0.0
            spare = math.ceil(mean + 3.5 * math.sqrt(mean)) if differ else 0
            self.blocks.append(differ + 1 + spare)
            self.spare.append(spare)
            self.low.append(high)

    def of(self, size: int) -> list[int]:
        """The strata in which a set of this size may be the larger or smaller one of a pair."""
        at = int(np.searchsorted(self.low, size, "right")) - 1
        out = [at]
        while at > 0 and (self.low[at] - 1) * self.den // self.num >= size:
            at -= 1
            out.append(at)
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Hashes of (stratum, block, the block's group counts). A block without shingles gives no key
        unless more blocks than the spare ones are so: else a filled block agrees as well."""
        out = []
        worth = mix64((hashes & _U(0xFFFF)) + _U(1))  # summed: a code of the counts of 65536 groups
        for k in self.of(len(hashes)):
            m = self.blocks[k]
            block = (hashes >> _U(32)) * _U(m) >> _U(32)
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(worth, starts)
                out.append(mix64(sums + mix64(block[starts] + _U(k << 32))))
                if m - len(starts) > self.spare[k]:
                    empty = np.setdiff1d(np.arange(m, dtype=_U), block[starts])
                    out.append(mix64(mix64(empty + _U(k << 32))))
        return np.concatenate(out)


def _links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def count_vector(hashes: np.ndarray) -> bytes:
    """Size and group counts of a set: at least half as many groups as shingles, a power of two."""
    groups = 1 << max(4, min(12, (len(hashes) // 2).bit_length()))
    while True:
        counts = np.bincount((hashes >> _U(20)).astype(np.int64) & (groups - 1), minlength=groups)
        if counts.max(initial=0) <= 255:
            return np.int32(len(hashes)).tobytes() + counts.astype(np.uint8).tobytes()
        groups *= 2


def fold(points: list[np.ndarray]) -> np.ndarray:
    """Count vectors as rows of as many groups as the shortest has."""
    groups = min(len(p) for p in points)
    return np.stack([p.reshape(-1, groups).sum(0, np.int64) for p in points])


def narrow(points: np.ndarray, groups: int) -> np.ndarray:
    return points.reshape(len(points), -1, groups).sum(1) if points.shape[1] > groups else points


def near_leaves(least: np.ndarray, most: np.ndarray, corners: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a <= b) of an R-tree's leaves that may hold a link, from the root down. A box has the least and
    largest size in it and the upper corner of its group counts; sizes ascend from leaf to leaf."""
    levels = [(least, most, corners)]
    while len(levels[-1][0]) > FAN:
        starts = np.arange(0, len(levels[-1][0]), FAN)
        low, high, corner = levels[-1]
        levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(corner, starts)))
    a, b = np.triu_indices(len(levels[-1][0]))
    while True:
        low, high, corner = levels.pop()
        near = low[b] * num <= high[a] * den
        a, b = a[near], b[near]
        near = np.minimum(corner[a], corner[b]).sum(1) * (num + den) >= num * (low[a] + low[b])
        a, b = a[near], b[near]
        if not levels:
            return a, b
        # the children of both, each pair once
        count, step = len(levels[-1][0]), np.arange(FAN)
        x = (a[:, None, None] * FAN + step[:, None] + 0 * step).ravel()
        y = (b[:, None, None] * FAN + step[None, :] + 0 * step[:, None]).ravel()
        inside = (x < count) & (y < count) & (x <= y)
        a, b = x[inside], y[inside]


def tree_join(ids: np.ndarray, bodies: list[bytes], exact: bool, label: np.ndarray, visits: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Stars (document, the smallest of its component) that connect what is linked and not yet labelled alike:
    pairs of a visitor and a resident, or of residents if nobody visits. Boxes of count vectors in a packed
    R-tree prune. bodies: sets, and links are verified; or, if not exact, count vectors, and what may overlap
    enough is linked."""
    if exact:
        sets = [np.frombuffer(b, _U) for b in bodies]
        bodies = [count_vector(s) for s in sets]
    size = np.array([int(np.frombuffer(b, "<i4", 1)[0]) for b in bodies])
    order = np.lexsort((label, size))  # tiles of like size
    size, first, visit = size[order], label[order], visits[order]
    label = first.copy()
    calls = bool(visit.any())
    starts = np.arange(0, len(order), FAN)
    points = [fold([np.frombuffer(bodies[i], np.uint8, -1, 4) for i in order[s : s + FAN]]) for s in starts]
    narrowest = min(p.shape[1] for p in points)
    corners = np.stack([narrow(p, narrowest).max(0) for p in points])
    for a, b in zip(*near_leaves(np.minimum.reduceat(size, starts), np.maximum.reduceat(size, starts), corners, num, den), strict=True):
        left, right = (slice(starts[k], starts[k] + FAN) for k in (a, b))
        if (label[left] == label[left.start]).all() and (label[right] == label[left.start]).all():
            continue
        groups = min(points[a].shape[1], points[b].shape[1])
        overlap = np.minimum(narrow(points[a], groups)[:, None], narrow(points[b], groups)[None]).sum(2)
        may = overlap * (num + den) >= num * (size[left][:, None] + size[right][None])
        may &= label[left][:, None] != label[right][None]
        if calls:
            may &= visit[left][:, None] != visit[right][None]
        for i, j in np.argwhere(may):
            x, y = left.start + i, right.start + j
            if (a != b or i < j) and label[x] != label[y] and (not exact or _links(sets[order[x]], sets[order[y]], num, den)):
                label[label == label[y]] = label[x]
    out = []
    for one in np.unique(label[label != first]):
        mine = label == one
        heads = ids[order[mine][np.unique(first[mine], return_index=True)[1]]]  # a document of each former label
        out += [(int(x), int(heads.min())) for x in heads if x != heads.min()]
    return out


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, sig (128 bits of the set; null if it is empty)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ledgerlake.llm.ngram_join import mix64, shingle_set

        for batch in releasing(batches):
            counts, sigs = [], []
            for value in batch.column(1):
                s = shingle_set(value.as_py(), n)
                counts.append(len(s))
                sigs.append(np.array([mix64(s).sum(dtype=_U), mix64(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)], _U).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "sig"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, sig binary")


def _keys(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, key: a row for each block's count vector."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ledgerlake.llm.ngram_join import Strata, shingle_set

        strata = Strata(num, den)
        for whole in releasing(batches):
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                got = []
                for value in batch.column(1):
                    s = shingle_set(value.as_py(), n)
                    got.append(strata.keys(s) if len(s) else np.empty(0, _U))
                ids = batch.column(0).to_numpy().repeat([len(g) for g in got])
                keys = np.concatenate(got).view(np.int64) if got else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], names=["doc_id", "key"])

    return docs.mapInArrow(key, "doc_id long, key long")


def _members(docs: DataFrame, rows: int, n: int, num: int, den: int) -> DataFrame:
    """key, doc_id of the keys that several documents have. Keys meet in one shuffle; one that is hot in a
    sample of the documents is shared for certain and is dealt out, so that no task gets all of its rows."""
    keys = _keys(docs, n, num, den)
    some = _keys(docs.where(F.pmod(F.xxhash64(F.lit(21), "doc_id"), F.lit(SAMPLE)) == 0), n, num, den)
    hot = materialize(some.groupBy("key").count().where(F.col("count") > max(256, rows // SAMPLE // 1000)).select("key", F.lit(True).alias("hot")), "ngram-hot")
    count = hot.count()
    if count:
        keys = keys.join(sized(hot, count), "key", "left")
    else:
        keys = keys.withColumn("hot", F.lit(None).cast("boolean"))
    keys = keys.withColumn("turn", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(1024))).otherwise(0))
    alone = W.partitionBy("key", "turn") if count else W.partitionBy("key")
    met = keys.withColumn("lo", F.min("doc_id").over(alone)).withColumn("hi", F.max("doc_id").over(alone))
    return met.where("hot OR lo < hi").select("key", "doc_id")


def _bodies(docs: DataFrame, n: int, exact: bool) -> DataFrame:
    """docs with shingles, body in place of text: the size of the set, and its sorted hashes or its count vector."""
    kept = [c for c in docs.columns if c != "text"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ledgerlake.llm.ngram_join import count_vector, shingle_set

        for whole in releasing(batches):
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sizes, made = [], []
                for value in batch.column(len(kept)):
                    s = shingle_set(value.as_py(), n)
                    sizes.append(len(s))
                    made.append(s.tobytes() if exact else count_vector(s))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], names=[*kept, "shingles", "body"])

    out = T.StructType([*[docs.schema[c] for c in kept], T.StructField("shingles", T.LongType()), T.StructField("body", T.BinaryType())])
    return docs.select(*kept, "text").mapInArrow(build, out)


def _joined(units: DataFrame, exact: bool, num: int, den: int) -> DataFrame:
    """a, b: stars within each (cluster, part, block) of units (unit, cluster, part, block, doc_id, label, visits, body)."""
    made = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(table: pa.Table) -> pa.Table:
        from ledgerlake.llm.ngram_join import tree_join

        columns = [table.column(c).to_numpy() for c in ("cluster", "part", "block", "doc_id", "label", "visits")]
        order = np.lexsort(columns[3::-1])
        cluster, part, block, ids, label, visits = (c[order] for c in columns)
        new = (cluster[1:] != cluster[:-1]) | (part[1:] != part[:-1]) | (block[1:] != block[:-1])
        cut = np.flatnonzero(np.concatenate(([True], new, [True])))
        bodies, out = table.column("body"), set()
        for lo, hi in zip(cut, cut[1:], strict=False):
            if hi - lo > 1:
                own = [bodies[int(i)].as_py() for i in order[lo:hi]]
                out.update(tree_join(ids[lo:hi], own, exact, label[lo:hi], visits[lo:hi].astype(bool), num, den))
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=made)

    return units.groupBy("unit").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: the smallest doc_id reachable by links.

    Documents link when den * |intersection| >= num * |union| of their sets of word n-grams. Null and empty
    texts have no shingles and link with nothing. doc_id names a document: rows that repeat one are one
    node (of all their texts); rows with a null id link with nothing and have a null component. An empty
    table gives no rows; other columns are left out. No pair is lost: see the module's text. What shuffles
    is a key for each block, the numbers of documents, and the sets of those with a neighbour.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    signed = materialize(_signed(texts, n), "ngram-signed")
    rows = signed.count()
    named = signed.where("doc_id IS NOT NULL AND sig IS NOT NULL")
    again = bool(named.groupBy("doc_id").count().where("count > 1").take(1))
    classes = materialize(named.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "ngram-classes")
    several = classes.count()
    # an id that names several sets stays in: it may be what connects them
    copies = join_unique(named.select("doc_id", "sig"), classes, "sig", "copies", rows, several, sig=16).select("doc_id", F.xxhash64("sig").alias("set"), "rep")
    copies = copies.groupBy("doc_id").agg(F.min("set").alias("lo"), F.max("set").alias("hi"), F.min("rep").alias("rep")).where("lo = hi AND doc_id <> rep")
    copies = materialize(copies.select("doc_id"), "ngram-copies")
    single = texts.where("doc_id IS NOT NULL").join(sized(copies, copies.count()), "doc_id", "left_anti")

    members = materialize(_members(single, rows, n, num, den), "ngram-members")
    met = members.count()
    # neighbourhoods with the same members are one
    alike = members.groupBy("key").agg(F.count("*").alias("k"), F.sum(F.xxhash64("doc_id") % (1 << 40)).alias("who"), F.sum(F.xxhash64(F.lit(5), "doc_id") % (1 << 40)).alias("too"))
    alike = materialize(alike.groupBy("k", "who", "too").agg(F.min("key").alias("key")).select("key", "k"), "ngram-alike")
    several_keys = alike.count()
    near = join_unique(members, alike.select("key", F.lit(True).alias("own"), "k"), "key", "k", met, several_keys).where("own")
    near = materialize(near.select(F.col("key").alias("cluster"), "doc_id"), "ngram-near")
    drop(copies, members)
    # first each document in its largest neighbourhood; then the neighbourhoods that this left in pieces
    largest = near.join(sized(alike.select(F.col("key").alias("cluster"), "k"), several_keys), "cluster")
    largest = largest.groupBy("doc_id").agg(F.max(F.struct("k", "cluster"))["cluster"].alias("cluster"))
    largest = materialize(largest.select("cluster", "doc_id", F.col("doc_id").alias("label")), "ngram-largest")
    ids = largest.select("doc_id")
    points = _bodies(texts.join(sized(ids, largest.count()), "doc_id", "left_semi"), n, False)
    points = materialize(points.distinct() if again else points, "ngram-points")
    sizes = points.groupBy("doc_id").agg(F.max("shingles").alias("n"))
    sizes = sized(sizes, points.count())

    def with_point(placed: DataFrame, rows: int) -> DataFrame:
        return sized(placed, rows).join(points, "doc_id")

    def with_set(placed: DataFrame, rows: int) -> DataFrame:
        made = _bodies(texts.join(sized(placed, rows), "doc_id"), n, True)
        return made.distinct() if again else made

    stars = _linked(with_point, sizes, largest, False, num, den)
    label = components(stars).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    labelled = near.join(sized(label, label.count()), "doc_id", "left").select("cluster", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    pieces = labelled.groupBy("cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k")).where("lo < hi")
    pieces = materialize(pieces.select("cluster", F.lit(True).alias("own"), "k"), "ngram-pieces")
    rest = join_unique(labelled, pieces, "cluster", "k", met, pieces.count()).where("own").select("cluster", "doc_id", "label")
    rest = materialize(rest, "ngram-rest")
    close = components(label.select(F.col("doc_id").alias("a"), F.col("label").alias("b")).union(_linked(with_point, sizes, rest, False, num, den)))
    close = close.select(F.col("component").alias("cluster"), F.col("node").alias("doc_id"), F.col("node").alias("label"))
    close = materialize(close, "ngram-clusters")
    drop(alike, near, largest, pieces, rest)
    found = components(_linked(with_set, sizes, close, True, num, den))
    drop(close, points)

    # every class or document whose component is not itself
    label = found.select(F.col("node").alias("rep"), "component")
    reps = classes.join(label, "rep", "left").select("sig", F.coalesce("component", "rep").alias("by_class"), "copies")
    out = join_unique(signed, reps, "sig", "copies", rows, several, sig=16)
    by_id = label.select(F.col("rep").alias("doc_id"), F.col("component").alias("by_id"))
    out = out.join(sized(by_id, found.count()), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce(F.least("by_class", "by_id"), F.col("doc_id")).alias("component_id"))


def _linked(with_body: Callable[[DataFrame, int], DataFrame], sizes: DataFrame, members: DataFrame, exact: bool, num: int, den: int) -> DataFrame:
    """a, b: stars that connect what is linked within each cluster of members (cluster, doc_id, label) and not
    labelled alike. with_body: adds body to counted rows with a doc_id; sizes: doc_id, n of all members."""
    rows = members.count()
    weight = members.select("cluster", "doc_id").join(sizes, "doc_id").groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"), F.min("doc_id").alias("hub"))
    parts = F.greatest(F.ceil(F.col("k") / PART_ROWS), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int")
    weight = materialize(weight.withColumns({"parts": parts, "alone": F.col("k") > UNIT_ROWS}), "ngram-weights")
    total = weight.agg(F.sum("shingles"), F.count("*"), F.max("parts"), F.sum("parts")).first()
    units = 1 + max((total[0] or 0) // PART_SHINGLES, rows // UNIT_ROWS)
    known = join_unique(members, weight.select("cluster", "parts", "hub", "alone", "k"), "cluster", "k", rows, total[1])
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    # the hub of a split cluster is in each of its parts
    part = F.explode(F.when((F.col("parts") > 1) & (F.col("doc_id") == F.col("hub")), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))
    # small clusters share a unit, a large one or a part has its own
    unit = F.when((F.col("parts") == 1) & ~F.col("alone"), F.pmod(F.xxhash64("cluster"), F.lit(units))).otherwise(F.xxhash64("cluster", "part")).alias("unit")
    placed = known.select("cluster", "parts", "alone", "doc_id", "label", part.alias("part")).select(unit, "cluster", "part", "doc_id", "label")
    within = with_body(placed, rows + (total[3] or 0)).withColumns({"block": F.lit(0), "visits": F.lit(0)})
    links = materialize(_joined(within, exact, num, den), "ngram-links")
    if (total[2] or 1) == 1:
        drop(weight)
        return links
    split = known.where("parts > 1")
    labels = components(links.union(known.where("doc_id <> label").select("doc_id", "label")))
    labels = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("now"))
    split = split.join(labels, "doc_id", "left").withColumn("label", F.coalesce("now", "label")).drop("now")
    split = materialize(split, "ngram-split")
    count = split.groupBy("cluster", "label").agg(F.count("*").alias("m"))
    main = count.groupBy("cluster").agg(F.max(F.struct("m", "label")).alias("most"), F.count("*").alias("labels"), F.sum("m").alias("k")).where("labels > 1")
    # visitors come in blocks, each of which meets the residents of every part
    blocks = F.ceil((F.col("k") - F.col("most.m")) / PART_ROWS).cast("int").alias("blocks")
    main = materialize(main.select("cluster", F.col("most.label").alias("main"), blocks, "k"), "ngram-main")
    open_ = join_unique(split, main, "cluster", "k", split.count(), main.count()).where("main IS NOT NULL")
    stay = open_.select("cluster", own.alias("part"), every("blocks").alias("block"), "doc_id", "label", F.lit(0).alias("visits"))
    turn = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.col("blocks")).cast("int").alias("block")
    visit = open_.where(F.col("label") != F.col("main")).select("cluster", every("parts").alias("part"), turn, "doc_id", "label", F.lit(1).alias("visits"))
    both = stay.union(visit).withColumn("unit", F.xxhash64("cluster", "part", "block"))
    both = materialize(both, "ngram-visits")
    visited = materialize(_joined(with_body(both, both.count()), exact, num, den), "ngram-links")
    drop(weight, split, main, both)
    return links.union(visited)


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows of documents that follow another of their component; null ids stay."""
    later = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "ngram-later")
    return docs.join(sized(later, later.count()), "doc_id", "left_anti").select(*docs.columns)
