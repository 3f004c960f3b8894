"""Document quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted on one feature after another, round and round, at a low rate; each feature's
trees add up to a lookup table over its bins. Then the pairs of features that explain most of what is left
get tables over two features' bins, boosted in the same turns. A score is the sum of one table entry for
each feature and pair, added for all documents of a batch at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, held_out, text_of

FEATURES = (
    "log_words", "log_lines", "mean_word", "long_words", "one_letter", "distinct_words", "top_word", "same_as_before",
    "longest_run", "upper", "digits", "symbols", "ending_marks", "pipes", "spaces", "distinct_lines", "distinct_triples", "words_per_line", "top_letters", "odd_ends",
)

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1  # upper case
_KIND[48:58] = 2  # digits
_KIND[list(b"!?#$%&*+/<=>@\\^_`{|}~;")] = 3  # symbols
_KIND[[9, 10, 11, 12, 13, 32]] = 4  # spaces
_MARKS = frozenset("!#$%&*|~^=+<>@\\_")


def features(text: str) -> list[float]:
    """What is measured of a text; all of it, in one go."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    letters = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, letters, 5)
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    times = np.bincount(ids)
    same = ids[1:] == ids[:-1]
    turns = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    sizes = np.array([len(w) for w in known])
    odd = np.array([w[-1] in _MARKS for w in known])
    lines = [x for x in text.split("\n") if x.strip()]
    triple = ids[:1]
    if n > 2:
        pair = ids[:-1] * len(known) + ids[1:]
        if len(known) > 2_000_000:  # the code of a triple would not fit
            pair = np.unique(pair, return_inverse=True)[1]
        triple = pair[:-1] * len(known) + ids[2:]
    size = len(raw)
    per = times / n
    return [
        float(np.log1p(n)), float(np.log1p(len(lines))), float((sizes * per).sum()), float(per[sizes > 12].sum()), float(per[sizes == 1].sum()),
        len(known) / n, float(per.max()), float(same.sum() / n), float(np.log1p(np.diff(turns).max())), kinds[1] / size, kinds[2] / size, kinds[3] / size,
        letters[33] / size, letters[124] / size, kinds[4] / size, len(set(lines)) / max(1, len(lines)), len(np.unique(triple)) / len(triple),
        float(np.log1p(n / max(1, len(lines)))), float(np.sort(letters)[-5:].sum() / size), float(per[odd].sum()),
    ]


class Additive:
    """Bin edges and tables."""

    def __init__(self, prior: float):
        self.prior = prior
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.coarse = 8

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def coarse_bins(self, bins: np.ndarray) -> np.ndarray:
        return np.stack([b * self.coarse // (len(e) + 1) for b, e in zip(bins.T, self.edges, strict=True)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, bins = np.full(len(x), self.prior), self.bins(x)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        if self.pairs:
            wide = self.coarse_bins(bins)
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                out += t[wide[:, a], wide[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def tree_on_bins(g: np.ndarray, h: np.ndarray, leaves: int = 3, smooth: float = 1.0, least: float = 2.0) -> np.ndarray:
    """A shallow tree over ordered bins: the best cuts one after another; gradients and weights by bin."""
    cuts = [0, len(g)]
    sums_g, sums_h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (a * a) / (b + smooth)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo > 1:
                at = np.arange(lo + 1, hi)
                gl, hl = sums_g[at] - sums_g[lo], sums_h[at] - sums_h[lo]
                gr, hr = sums_g[hi] - sums_g[at], sums_h[hi] - sums_h[at]
                gain = worth(gl, hl) + worth(gr, hr) - worth(gl + gr, hl + hr)
                gain[(hl < least) | (hr < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(at[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = (sums_g[hi] - sums_g[lo]) / (sums_h[hi] - sums_h[lo] + smooth)
    return out


def tree_on_pair(g: np.ndarray, h: np.ndarray, smooth: float = 1.0) -> tuple[np.ndarray, float]:
    """A tree of depth two over a grid: one cut of either axis, then one of the other on each side; its gain."""
    best, table = 0.0, np.zeros(g.shape)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, a.shape[0]):
            made, gain = np.zeros(a.shape), 0.0
            for side in (slice(0, cut), slice(cut, None)):
                sg, sh = a[side].sum(0), b[side].sum(0)
                cg, ch = np.cumsum(sg)[:-1], np.cumsum(sh)[:-1]
                tg, th = sg.sum(), sh.sum()
                worth = cg**2 / (ch + smooth) + (tg - cg) ** 2 / (th - ch + smooth)
                k = int(np.argmax(worth)) + 1
                gain += float(worth[k - 1])
                made[side, :k] = sg[:k].sum() / (sh[:k].sum() + smooth)
                made[side, k:] = sg[k:].sum() / (sh[k:].sum() + smooth)
            if gain > best:
                best, table = gain, made if axis == 0 else made.T
    return table, best


def train(x: np.ndarray, y: np.ndarray, rounds: int = 250, pair_rounds: int = 80, pairs: int = 6, rate: float = 0.08, bins: int = 32) -> Additive:
    base = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
    model = Additive(float(np.log(base / (1 - base))))
    if len(y) < 2 or y.min() == y.max():
        return model
    for j in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])))
        model.tables.append(np.zeros(len(model.edges[-1]) + 1))
    at = model.bins(x)
    margin = np.full(len(y), model.prior)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):  # in turn, so that no feature takes another's part
            p = 1 / (1 + np.exp(-margin))
            g, h = np.bincount(at[:, j], y - p, len(table)), np.bincount(at[:, j], p * (1 - p), len(table))
            step = rate * tree_on_bins(g, h)
            table += step
            margin += step[at[:, j]]
    wide, n = model.coarse_bins(at), model.coarse
    p = 1 / (1 + np.exp(-margin))

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(wide[:, a] * n + wide[:, b], values, n * n).reshape(n, n)

    gains = [(tree_on_pair(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1], a, b) for a in range(x.shape[1]) for b in range(a)]
    for _, a, b in sorted(gains, reverse=True)[:pairs]:
        model.pairs.append((a, b))
        model.pair_tables.append(np.zeros((n, n)))
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-margin))
            step = rate * tree_on_pair(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0]
            table += step
            margin += step[wide[:, a], wide[:, b]]
    return model


def loaded(model: bytes) -> Additive:
    return held(model, lambda: pickle.loads(model))


def measure(docs: DataFrame) -> DataFrame:
    """docs with features (array of double) in the place of text. One pass, no shuffle."""
    kept = [c for c in docs.columns if c not in ("text", "features")]
    out = T.StructType([*[docs.schema[c] for c in kept], T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ledgerlake.llm.quality import features

        for batch in batches:
            made = pa.array([features(v.as_py()) for v in batch.column(len(kept))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], made], names=[*kept, "features"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], text_of().alias("text")).mapInArrow(run, out)


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> bytes:
    """A trained model from labels (doc_id, quality) of docs (doc_id, text), without the held out ids.

    It sees about sample_rows labelled documents, picked by a hash of their id, and of those only their
    features. Labels that are null or of unknown documents are left out.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id")))
    share = min(1.0, sample_rows / max(1, known.count()))
    part = known.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("doc_id", "quality")
    sample = measure(docs.select("doc_id", "text").join(F.broadcast(part), "doc_id"))  # about sample_rows ids

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(pdf.features.tolist(), float), (pdf.quality.to_numpy() > 0).astype(float)
        order = np.lexsort((y, *x.T[::-1], pdf.doc_id.to_numpy()))
        return pd.DataFrame({"model": [pickle.dumps(train(x[order], y[order]))]})

    got = sample.groupBy(F.col("quality").isNull().alias("all")).applyInPandas(learn, "model binary").first()
    return got[0] if got else pickle.dumps(train(np.empty((0, len(FEATURES))), np.empty(0)))


def score_quality(docs: DataFrame, model: bytes) -> DataFrame:
    """docs without text, with features and quality_score (0 to 1, higher is better).

    Null and empty texts have all features 0 and the score of that. Whole texts are read; repeated rows are
    scored each by itself; columns of docs named like the results give way. One pass, no shuffle.
    """
    kept = [c for c in docs.columns if c not in ("text", "features", "quality_score")]
    fields = [*[docs.schema[c] for c in kept], T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("quality_score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ledgerlake.llm.quality import features, loaded

        tables = loaded(model)
        for batch in batches:
            x = np.array([features(v.as_py()) for v in batch.column(len(kept))], float).reshape(batch.num_rows, len(FEATURES))
            made = [pa.array(list(x), pa.list_(pa.float64())), pa.array(tables.score(x), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[*kept, "features", "quality_score"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], text_of().alias("text")).mapInArrow(run, T.StructType(fields))
