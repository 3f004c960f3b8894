"""Byte-level BPE by replay of all merges over many words at once, and the way back from ids to bytes.

The distinct pre-tokens of a block of texts are laid out as one array of symbols. An inverted index leads
from the rank of a token pair to the positions where such a pair stands; ranks are taken in order, each
merge is applied at all its positions together, and only pairs with a merged neighbour are looked up anew.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _ODD, _SPLIT
from .common import blocks, held, releasing, text_of

#: Bytes of texts in a block, of words in one replay, and words that a worker keeps from block to block.
BLOCK_BYTES, REPLAY_BYTES, KEPT_WORDS = 16 << 20, 3 << 20, 250_000
_NONE, _NO_SYMBOL = np.int32(2**31 - 1), np.int32((1 << 20) - 1)
#: Slots of the tables that tell what a pair makes, and multipliers that spread the pairs over them.
SLOT_BITS, SPREAD = 20, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def splitter() -> Callable[[str], list[str]]:
    """The pre-tokens of a text. The quick pattern holds for texts without rare signs; the other one is the
    public pattern with white space as Unicode has it (\\s also takes four control signs there)."""
    import public_tokenizers
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    quick, odd = _SPLIT.findall, _ODD.search
    return lambda text: pattern.findall(text) if odd(text) else quick(text)


class Ranks:
    """A vocabulary of byte strings with ranks, and all pairs of entries that make another entry."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}
        self.bytes = {i: b for b, i in self.rank.items()}
        if any(bytes([x]) not in self.rank for x in range(256)) or len(self.bytes) < len(self.rank) or max(self.bytes) >= _NO_SYMBOL:
            raise ValueError(f"{path}: each byte needs a rank, each rank one entry, below {_NO_SYMBOL}")
        get, keys, made = self.rank.get, array("q"), array("i")
        for word, rank in self.rank.items():
            for cut in range(1, len(word)):
                a = get(word[:cut])
                if a is not None and (b := get(word[cut:])) is not None:
                    keys.append(a << 20 | b)
                    made.append(rank)
        rest, made = np.frombuffer(keys, np.int64), np.frombuffer(made, np.int32)
        self.tables = []
        for spread in SPREAD:  # the first pair of a slot is in the first table, the others in the next
            slot = self._slot(rest, spread)
            own, at = np.unique(slot, return_index=True)
            key, what = np.full(1 << SLOT_BITS, -1, np.int64), np.full(1 << SLOT_BITS, _NONE, np.int32)
            key[own], what[own] = rest[at], made[at]
            self.tables.append((spread, key, what))
            left = np.ones(len(rest), bool)
            left[at] = False
            rest, made = rest[left], made[left]
        order = np.argsort(rest)
        self.rest, self.rest_made = np.append(rest[order], 1 << 62), np.append(made[order], _NONE)
        self.of_byte = np.array([self.rank[bytes([x])] for x in range(256)], np.int32)

    @staticmethod
    def _slot(key: np.ndarray, spread: int) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(spread) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the entry that each pair makes, _NONE without one."""
        key = a.astype(np.int64) << 20 | b
        out = np.full(len(key), _NONE, np.int32)
        for spread, keys, made in self.tables:
            slot = self._slot(key, spread)
            np.copyto(out, made[slot], where=keys[slot] == key)
        if len(self.rest) > 1:
            at = np.searchsorted(self.rest, key)
            np.copyto(out, self.rest_made[at], where=self.rest[at] == key)
        return out

    def one_by_one(self, word: bytes) -> list[int]:
        """The plain method for one word: the leftmost pair of the least rank, again and again."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
            if rank == _NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has. Words must not be empty."""
        size = np.fromiter(map(len, words), np.intp, len(words))
        first = np.cumsum(size) - size
        n = int(size.sum())
        # position n stands for "none": its symbol is in no pair
        sym = np.append(self.of_byte[np.frombuffer(b"".join(words), np.uint8)], _NO_SYMBOL)
        after, before = np.arange(1, n + 2, dtype=np.intp), np.arange(-1, n, dtype=np.intp)
        after[first + size - 1] = after[n] = before[first] = n
        makes = self.pair(sym, sym[after])  # what a symbol and the next one make
        index: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def enter(at: np.ndarray, found: np.ndarray) -> None:
            good = np.flatnonzero(found != _NONE)
            if not len(good):
                return
            good = good[np.argsort(found[good])]
            at, found = at[good], found[good]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            begin = 0
            for rank, end in zip(found[np.append(0, cuts)].tolist(), [*cuts.tolist(), len(at)], strict=True):
                if rank in index:
                    index[rank].append(at[begin:end])
                else:
                    index[rank] = [at[begin:end]]
                    heapq.heappush(ranks, rank)
                begin = end

        enter(np.arange(n + 1), makes)
        again: set[int] = set()  # words in which a merge opened one of a lower rank: done one by one
        while ranks:
            rank = heapq.heappop(ranks)
            parts = index.pop(rank)
            at = np.concatenate(parts) if len(parts) > 1 else parts[0]
            at = at[makes[at] == rank]
            at.sort()
            gone = after[at]
            if len(at) > 1:
                if not (once := at[1:] != at[:-1]).all():
                    at = at[np.append(True, once)]
                    gone = after[at]
                if (touch := gone[:-1] == at[1:]).any():  # of overlapping pairs every other one merges
                    k = np.arange(len(at))
                    at = at[(k - np.maximum.accumulate(np.where(np.append(True, ~touch), k, 0))) % 2 == 0]
                    gone = after[at]
            sym[at] = rank
            sym[gone] = -1
            makes[gone] = _NONE
            beyond = after[gone]
            after[at] = beyond
            before[beyond] = at
            prior = before[at]
            touched = np.concatenate([prior, at])
            made = self.pair(sym[touched], np.concatenate([np.full(len(at), rank, np.int32), sym[beyond]]))
            makes[touched] = made
            if (low := made < rank).any():
                odd = np.unique(np.searchsorted(first, touched[low], "right") - 1)
                again.update(odd.tolist())
                for w in odd.tolist():
                    makes[first[w] : first[w] + size[w]] = _NONE
            enter(touched, made)
        sym = sym[:n]
        counts = np.add.reduceat(sym >= 0, first) if n else np.zeros(0, np.intp)
        ids = sym[sym >= 0]
        get = self.rank.get
        special = {w: [whole] for w in np.flatnonzero(counts > 1).tolist() if (whole := get(words[w])) is not None}
        special |= {w: self.one_by_one(words[w]) for w in again if w not in special}
        if special:
            runs = np.split(ids, np.cumsum(counts)[:-1])
            for w, own in special.items():
                runs[w], counts[w] = np.array(own, np.int32), len(own)
            ids = np.concatenate(runs)
        return ids, counts


class Lexicon(dict):
    """Numbers of words in the order they were first met, and the ids of those replayed so far."""

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.split = splitter()
        entries = self.ranks.bytes
        self.entry = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.decimal = [b"%d" % i for i in range(len(self.entry))]
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def learn(self) -> None:
        """Replay the merges over the words met since the last time."""
        words = [w.encode() for w in self.fresh]
        self.fresh = []
        at = 0
        found, counts = [self.ids], [self.size]
        while at < len(words):
            to, total = at, 0
            while to < len(words) and (to == at or total + len(words[to]) <= REPLAY_BYTES):
                total += len(words[to])
                to += 1
            ids, n = self.ranks.replay(words[at:to])
            found.append(ids)
            counts.append(n)
            at = to
        self.ids, self.size = np.concatenate(found), np.concatenate(counts)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self) > KEPT_WORDS:
            self.reset()
        split, number = self.split, self.__getitem__
        numbered = [array("i", map(number, split(t))) for t in texts]
        if self.fresh:
            self.learn()
        out = []
        for words in numbered:
            w = np.frombuffer(words, np.int32)
            n = self.size[w]
            end = np.cumsum(n)
            at = np.repeat(self.start[w] - end + n, n)
            at += np.arange(len(at))
            out.append(self.ids[at])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        entry = self.entry
        return b"".join([entry[i] for i in ids.tolist()])

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        decimal = self.decimal
        return hashlib.sha256(b",".join([decimal[i] for i in ids.tolist()])).hexdigest()


def lexicon(path: str) -> Lexicon:
    return held(("replay", path), lambda: Lexicon(path))


def _mapped(df: DataFrame, source: str, made: dict[str, T.DataType], path: str, each: Callable[[Lexicon, list], list[list]]) -> DataFrame:
    """df without the columns `source` and made's; each: the values of the made columns for a run of source's."""
    kept = [c for c in df.columns if c.lower() not in {x.lower() for x in (source, *made)}]
    name = "_source"
    while name in map(str.lower, kept):
        name = "_" + name
    out = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(k, v) for k, v in made.items())])
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in releasing(batches):
            for at, values in blocks(batch.column(len(kept)), BLOCK_BYTES):
                columns = [pa.array(x, types[t.typeName()]) for x, t in zip(each(lexicon(path), values), made.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(values)).columns[: len(kept)], *columns], names=[*kept, *made])

    value = text_of(source) if df.schema[source].dataType.typeName() != "binary" else F.coalesce(F.col(source), F.lit(b""))
    return df.select(*[F.col(f"`{c}`") for c in kept], value.alias(name)).mapInArrow(run, out)


def encode(df: DataFrame, text: str = "text", path: str | None = None, out: str = "token_ids") -> DataFrame:
    """df with the packed ids (little-endian, 32 bits each) of every whole text in `out` instead of the text.

    Null and empty texts have no ids. No special tokens: their strings are ordinary text. A column of df with
    the name of the result gives way; repeated rows are encoded each by itself. One pass, no shuffle; a worker
    holds a block of texts and the words of the last blocks.
    """
    return _mapped(df, text, {out: T.BinaryType()}, path or default_ranks(), lambda lex, texts: [[x.astype("<u4").tobytes() for x in lex.encode(texts)]])


def decode(df: DataFrame, ids: str = "token_ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """df with the bytes that packed ids stand for in `out` instead of the ids; null and empty: no bytes."""
    return _mapped(df, ids, {out: T.BinaryType()}, path or default_ranks(), lambda lex, packed: [[lex.decode(np.frombuffer(x, "<u4")) for x in packed]])


def round_trip(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every text, beside df's other columns: encode, then decode
    from the ids alone, without the ids leaving the worker. Nulls, ties and clashing names as in encode."""

    def each(lex: Lexicon, texts: list[str]) -> list[list]:
        ids = lex.encode(texts)
        return [[len(x) for x in ids], [lex.digest(x) for x in ids], [hashlib.sha256(lex.decode(x)).hexdigest() for x in ids]]

    made = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return _mapped(df, text, made, path or default_ranks(), each)
