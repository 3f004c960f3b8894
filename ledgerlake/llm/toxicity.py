"""Toxic spans and document scores by a linear-chain conditional random field.

Labels mark documents, so tokens are labelled first: in a bounded sample of labelled documents, tokens and
their letter patterns that stand far oftener in toxic documents than elsewhere mark toxic tokens; then the
field is trained on those labels, relabels the toxic documents' tokens (the others have none), and is
trained again. Tokens are words; a very long one is read as its parts, down to the last character. Scoring
runs forward and backward over every token of a text as one chain; marginals make spans, and their strongest and summed evidence, through a small logistic model, the document's score.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from xxhash import xxh3_64_intdigest as slot
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held, held_out, releasing, text_of

#: Tokens of a row; longer texts take several rows, between which messages are carried, shorter ones are padded.
LENGTH = 64
#: Longer runs without spaces are read in parts: words with what follows them, long ones in steps of WIDTH
#: characters that see LAP characters of their neighbours, so that no letter run of a feature is cut.
LONGEST, WIDTH, LAP = 40, 20, 4
#: Distinct tokens whose scores a worker keeps.
CACHE = 100_000
#: Slots of the hashed feature weights.
SLOTS = 1 << 18
_EDGE = re.compile(r"^\W+|\W+$")
_MARKS = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M")
_PART = re.compile(rf"((?:[^\W_]|[{_MARKS}])+)[\W_]*|[\W_]+")


def parts(run: str) -> list[tuple[str, int, int]]:
    """Token, begin and end of the parts of a long run without spaces; each character is in one of them."""
    out = []
    for m in _PART.finditer(run):
        if m.end() - m.start() <= LONGEST:
            out.append((m[1] or m[0], m.start(), m.end()))
        else:
            for at in range(m.start(), m.end(), WIDTH):
                end = min(at + WIDTH, m.end())
                out.append((run[max(m.start(), at - LAP) : min(end + LAP, m.end())], at, end))
    return out


def words(text: str) -> list[str]:
    """The tokens of a text."""
    found = text.split()
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [x for w in found for x in ([w] if len(w) <= LONGEST else [p[0] for p in parts(w)])]


def places(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of each token in the text."""
    for m in re.finditer(r"\S+", text):
        if m.end() - m.start() <= LONGEST:
            yield m.start(), m.end()
        else:
            yield from ((m.start() + a, m.start() + b) for _, a, b in parts(m[0]))


def names(token: str) -> list[str]:
    """A token's features: the bare word, its starts and ends, and inner letter runs."""
    word = _EDGE.sub("", token.lower()) or token
    out = [f"w={word}", f"l={min(len(word), 15)},{word[:4]}"]
    out += [f"p{k}={word[:k]}" for k in (3, 4, 5, 6) if len(word) > k]
    out += [f"s{k}={word[-k:]}" for k in (2, 3, 4) if len(word) > k]
    return out + [f"g={word[i : i + 5]}" for i in range(1, len(word) - 4)]


def features(token: str) -> list[int]:
    """Slots of a token's features."""
    return [slot(x) & (SLOTS - 1) for x in names(token)]


class Lexicon:
    """Features of many distinct tokens as one flat table."""

    def __init__(self, tokens: list[str]):
        parts = [features(t) for t in tokens]
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.flat = np.array([x for p in parts for x in p], np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.flat], self.at[:-1]) if len(self.flat) else np.empty(0)

    def gradient(self, per_token: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, np.repeat(per_token, np.diff(self.at)), SLOTS)


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of these token counts: for each slot (rows of LENGTH) the token's place in the flat token
    list, or -1; and the rows of each text."""
    per = -(-lengths // LENGTH)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    first = np.repeat(starts, per) + LENGTH * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    end = np.repeat(starts + lengths, per)
    grid = first[:, None] + np.arange(LENGTH)
    return np.where(grid < end[:, None], grid, -1), per


def carried(odds: np.ndarray, m: np.ndarray, start: float, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages at the edges of rows, `per` of which make a chain: for each row the forward one at its first
    slot (without that slot's odds) and the backward one at its last slot."""
    n, length = odds.shape
    ahead, after = np.ones((2, n)), np.ones((2, n))
    ahead[1] = np.exp(start)
    first = (np.cumsum(per) - per)[np.argsort(-per, kind="stable")]  # of the longest chains first
    active = [int((per > w).sum()) for w in range(1, per.max(initial=0))]
    if not active:
        return ahead, after
    long = np.repeat(per > 1, per)
    at = np.cumsum(long) - 1  # places of the rows of long chains among themselves
    some = odds[long]
    # what a row does to a message: through[i, j] leads from state i in its first slot to j in its last
    through = np.zeros((2, 2, len(some)))
    through[0, 0], through[1, 1] = 1.0, some[:, 0]
    for t in range(1, length):
        clean = through[:, 0] * m[0, 0] + through[:, 1] * m[1, 0]
        toxic = (through[:, 0] * m[0, 1] + through[:, 1] * m[1, 1]) * some[:, t]
        through = np.stack([clean, toxic], 1)
        through /= through.sum((0, 1))
    for w, k in enumerate(active, 1):
        row = first[:k] + w
        now = np.einsum("in,ijn->jn", ahead[:, row - 1], through[:, :, at[row - 1]])
        now = np.einsum("in,ij->jn", now, m)
        ahead[:, row] = now / now.sum(0)
    for w, k in reversed(list(enumerate(active, 1))):
        row = first[:k] + w
        back = np.einsum("ijn,jn->in", through[:, :, at[row]], after[:, row])
        back = np.einsum("ij,jn->in", m, back)
        after[:, row - 1] = back / back.sum(0)
    return ahead, after


def marginals(scores: np.ndarray, real: np.ndarray, start: float, moves: np.ndarray, per: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each slot, expected moves (2 by 2) and P(toxic) at chain starts. scores: of toxic against
    clean; moves: log potentials from (clean, toxic) to (clean, toxic); per: rows of each chain, one if not given."""
    n, length = scores.shape
    per = np.ones(n, np.int64) if per is None else per
    odds = np.exp(np.clip(np.where(real, scores, -40.0), -40, 40))
    m = np.exp(moves)
    prior, after = carried(odds, m, start, per)
    ahead = np.empty((length, 2, n))
    now = prior * np.stack([np.ones(n), odds[:, 0]])
    now /= now.sum(0)
    ahead[0] = now
    for t in range(1, length):
        clean = now[0] * m[0, 0] + now[1] * m[1, 0]
        toxic = (now[0] * m[0, 1] + now[1] * m[1, 1]) * odds[:, t]
        total = clean + toxic
        now = np.stack([clean / total, toxic / total])
        ahead[t] = now
    p = np.empty((n, length))
    both = ahead[-1] * after
    p[:, -1] = both[1] / both.sum(0)
    moved = np.zeros((2, 2))
    back = after
    for t in range(length - 2, -1, -1):
        clean, toxic = back[0], back[1] * odds[:, t + 1]
        pair = np.stack([[ahead[t, 0] * m[0, 0] * clean, ahead[t, 0] * m[0, 1] * toxic], [ahead[t, 1] * m[1, 0] * clean, ahead[t, 1] * m[1, 1] * toxic]])
        moved += (pair / pair.sum((0, 1)) * real[:, t + 1]).sum(2)
        back = np.stack([m[0, 0] * clean + m[0, 1] * toxic, m[1, 0] * clean + m[1, 1] * toxic])
        back /= back.sum(0)
        both = ahead[t] * back
        p[:, t] = both[1] / both.sum(0)
    first = (np.cumsum(per) - per)[per > 0]
    inner = np.setdiff1d(np.arange(n), first)  # rows that go on with a chain
    pair = ahead[-1][:, None, inner - 1] * m[:, :, None] * np.stack([back[0], back[1] * odds[:, 0]])[None, :, inner]
    moved += (pair / pair.sum((0, 1))).sum(2)
    return p, moved, p[first, 0]


class Field:
    """Weights of the field and of the document model."""

    def __init__(self) -> None:
        self.weights = np.zeros(SLOTS)
        self.start, self.moves = -3.0, np.array([[0.0, -3.0], [0.0, 0.0]])
        self.document = np.array([-4.0, 1.0, 0.0])

    def train(self, lexicon: Lexicon, token: np.ndarray, labels: np.ndarray, grid: np.ndarray, per: np.ndarray, steps: int, decay: float = 0.02) -> None:
        """Adagrad ascent of the log likelihood of labels (0 or 1 for each token) over the chains of grid (`per` rows each)."""
        real = grid >= 0
        at = np.where(real, grid, 0)
        gold = np.where(real, labels[at], 0)
        types = token[at]
        size = len(lexicon.at) - 1
        want = np.bincount(types[real], gold[real], size)
        moved_gold = np.zeros((2, 2))
        np.add.at(moved_gold, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
        first = (np.cumsum(per) - per)[per > 0]
        inner = np.setdiff1d(np.arange(len(grid)), first)
        np.add.at(moved_gold, (gold[inner - 1, -1], gold[inner, 0]), 1)
        start_gold = gold[first, 0].sum()
        g2, h2, s2 = np.full(SLOTS, 1e-8), np.full((2, 2), 1e-8), 1e-8
        for _ in range(steps):
            p, moved, begun = marginals(lexicon.scores(self.weights)[types], real, self.start, self.moves, per)
            g = lexicon.gradient(want - np.bincount(types[real], p[real], size)) - decay * self.weights
            h, s = moved_gold - moved, start_gold - begun.sum()
            h[0, 0] = h[1, 0] = 0.0  # scores are against clean, whose potentials stay
            g2 += g * g
            h2 += h * h
            s2 += s * s
            self.weights += 0.5 * g / np.sqrt(g2)
            self.moves += 0.2 * h / np.sqrt(h2)
            self.start += 0.2 * s / np.sqrt(s2)


def evidence(p: np.ndarray, per: np.ndarray, real: np.ndarray) -> np.ndarray:
    """For each document: 1, the log odds of its likeliest token, and the log of its expected toxic tokens."""
    p = np.where(real, np.clip(p, 1e-9, 1 - 1e-9), 1e-9)
    top, total = np.zeros(len(per)), np.zeros(len(per))
    owner = np.repeat(np.arange(len(per)), per)
    np.maximum.at(top, owner, p.max(1) if len(p) else np.empty(0))
    np.add.at(total, owner, np.where(p > 0.05, p, 0).sum(1))
    top = np.clip(top, 1e-9, 1 - 1e-9)
    return np.stack([np.ones(len(per)), np.log(top / (1 - top)), np.log1p(total)], 1)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    w, scale = np.zeros(x.shape[1]), np.maximum(np.abs(x).max(0), 1e-9)
    z, g2 = x / scale, np.full(x.shape[1], 1e-8)
    for _ in range(steps):
        g = ((y - 1 / (1 + np.exp(-np.clip((z * w).sum(1), -30, 30))))[:, None] * z).mean(0) - 1e-4 * w
        g2 += g * g
        w += 0.5 * g / np.sqrt(g2)
    return w / scale


def tokens_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens, each token's number, and token counts."""
    lists = [words(t) for t in texts]
    known: dict[str, int] = {}
    flat = np.array([known.setdefault(x, len(known)) for ts in lists for x in ts], np.int64)
    return list(known), flat, np.array([len(ts) for ts in lists], np.int64)


def label_tokens(lexicon: Lexicon, token: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for the distinct tokens with a feature that stands far oftener in toxic documents."""
    doc = np.repeat(np.arange(len(counts)), counts)
    pairs = np.unique(np.stack([doc, token]), axis=1)
    size = len(lexicon.at) - 1
    width = np.diff(lexicon.at)
    # in how many documents of either kind each feature stands (once for each distinct token there)
    by_kind = [np.bincount(pairs[1][toxic[pairs[0]] == k], minlength=size).astype(float) for k in (0, 1)]
    clean, bad = (np.bincount(lexicon.flat, np.repeat(c, width), SLOTS) for c in by_kind)
    base = toxic.mean()
    seen = clean + bad
    # a feature speaks if nearly all that has it is toxic, far beyond chance
    strong = (seen >= 3) & ((bad + base) / (seen + 1) >= np.maximum(0.8, 4 * base))
    return np.maximum.reduceat(strong[lexicon.flat], lexicon.at[:-1]).astype(np.int64) if size else np.empty(0, np.int64)


def train(texts: list[str], toxic: np.ndarray, rounds: int = 3, steps: int = 25) -> Field:
    """The field from texts and their documents' labels (0 or 1)."""
    field = Field()
    if not len(texts) or toxic.min() == toxic.max():
        field.document = np.array([2.0 if len(texts) and toxic.max() else -4.0, 0.0, 0.0])
        return field
    names, token, counts = tokens_of(texts)
    if not len(token):
        return field
    lexicon = Lexicon(names)
    grid, per = chains(counts)
    real = grid >= 0
    doc = np.repeat(np.arange(len(counts)), counts)
    labels = label_tokens(lexicon, token, counts, toxic)[token] & toxic[doc]
    for r in range(rounds):
        field.train(lexicon, token, labels, grid, per, steps)
        p, _, _ = marginals(np.where(real, lexicon.scores(field.weights)[token[np.where(real, grid, 0)]], 0), real, field.start, field.moves, per)
        if r < rounds - 1:
            likely = np.zeros(len(token))
            likely[grid[real]] = p[real]
            top = np.zeros(len(counts))
            np.maximum.at(top, doc, likely)
            # a toxic document has a toxic token: if none is likely, then the likeliest
            labels = (toxic[doc] * ((likely >= 0.5) | ((top[doc] < 0.5) & (likely >= top[doc]) & (likely > 0.02)))).astype(np.int64)
    field.document = logistic(evidence(p, per, real), toxic.astype(float))
    return field


class Scorer(dict):
    """Token scores of a trained field, kept for frequent tokens."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.weights = field, field.weights.tolist()

    def __missing__(self, token: str) -> float:
        out = sum(map(self.weights.__getitem__, features(token)))
        if len(self) < CACHE and len(token) <= LONGEST:
            self[token] = out
        return out

    def run(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Document scores, and the (start, end) of the spans whose tokens are likelier toxic than not."""
        lists = [words(t) for t in texts]
        counts = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter([self[x] for ts in lists for x in ts], float, int(counts.sum()))
        grid, per = chains(counts)
        real = grid >= 0
        if len(grid):
            p, _, _ = marginals(np.where(real, flat[np.where(real, grid, 0)], 0), real, self.field.start, self.field.moves, per)
        else:
            p = np.empty((0, LENGTH))
        score = 1 / (1 + np.exp(-np.clip((evidence(p, per, real) * self.field.document).sum(1), -30, 30)))
        hit = np.zeros(len(flat), bool)
        hit[grid[real]] = p[real] >= 0.5
        starts, spans = np.concatenate([[0], np.cumsum(counts)]), []
        for k, text in enumerate(texts):
            mine, found = hit[starts[k] : starts[k + 1]], []
            if mine.any():
                for i, (begin, end) in enumerate(places(text)):
                    if mine[i]:
                        if found and i and mine[i - 1]:
                            found[-1] = (found[-1][0], end)
                        else:
                            found.append((begin, end))
            spans.append(found)
        return score, spans


def scorer(model: bytes) -> Scorer:
    return held(model, lambda: Scorer(pickle.loads(model)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_tokens: int = 1_000_000, longest: int = 200_000) -> bytes:
    """A trained field from labels (doc_id, toxic) of docs (doc_id, text), without the held out ids.

    It sees a bounded sample of labelled documents, taken in the order of a hash of their id: about
    sample_rows of them, none with a text over `longest` bytes, and of those in turn each that keeps all
    within sample_tokens. Which ones does not depend on the order of rows. Labels that are null or of
    unknown documents are left out. All texts are scored, whatever their length.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id")))
    rows = known.count()
    share = min(1.0, sample_rows / max(1, rows))
    part = known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("doc_id", "toxic")
    sample = docs.select("doc_id", text_of().alias("text")).where(F.octet_length("text") <= longest).join(F.broadcast(part), "doc_id")  # about sample_rows ids
    sample = sample.withColumn("turn", F.xxhash64(F.lit(12), "doc_id")).orderBy("turn", "doc_id", "text", "toxic").limit(2 * sample_rows)  # ids may repeat

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "doc_id", "text", "toxic"])
        left, kept = sample_tokens, []
        for text in pdf.text:
            n = len(words(text))
            kept.append(n <= left)
            left -= n * kept[-1]
        pdf = pdf[kept]
        field = train(pdf.text.tolist(), (pdf.toxic.to_numpy() > 0).astype(np.int64))
        del pdf, kept
        give_back()
        return pd.DataFrame({"model": [pickle.dumps(field)]})

    got = sample.groupBy(F.col("toxic").isNull().alias("all")).applyInPandas(learn, "model binary").first()
    return got[0] if got else pickle.dumps(train([], np.empty(0, np.int64)))


def score_toxicity(docs: DataFrame, model: bytes) -> DataFrame:
    """docs with toxicity (0 to 1) and toxic_spans (array of begin and end, in characters); text stays.

    Null and empty texts have no spans and the score of no evidence. Whole texts are read; repeated rows
    are scored each by itself; columns of docs named like the results give way. One pass, no shuffle.
    """
    kept = [c for c in docs.columns if c not in ("toxicity", "toxic_spans")]
    fields = [docs.schema[c] for c in kept]
    from pyspark.sql import types as T

    span = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = T.StructType([*fields, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_spans", span)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ledgerlake.llm.toxicity import scorer

        field = scorer(shared.value)
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for whole in releasing(batches):
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                score, spans = field.run([x or "" for x in batch.column(place).to_pylist()])
                made = pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), made], names=[*kept, "toxicity", "toxic_spans"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, out)
