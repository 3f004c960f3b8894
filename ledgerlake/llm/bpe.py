"""Byte-level BPE pieces: pre-token split, exact prefix counts by dynamic programming, packed ids."""

from __future__ import annotations

import array
import re

import numpy as np

from .common import held

#: Where the fast split holds: no letter, digit or space outside these classes below U+0250, no odd controls.
_ODD = re.compile("[\x1c-\x1fɐ-\U0010ffff]")
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_SPACES = re.compile(f"[{_S}][{_S}]")
#: Signs that spaces may stand in a row; quicker to look for than the pattern.
_DOUBLE = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
#: Entries of a worker's caches; the first seen stay, as frequent pieces come early.
CACHE = 100_000
#: Pieces of at most so many bytes are counted many at once, and so many are kept from block to block.
SHORT, KEPT_PIECES = 48, 200_000
_BASE = 0x9E3779B97F4A7C15


def byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable bytes stand for
    themselves, the others are numbered from U+0100 in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}


def fast_encoder(vocab: dict[bytes, int]):
    """BPE of one pre-token. The merges of the vocabulary rank as the ids of their results do."""
    import tiktoken

    return tiktoken.Encoding("pieces", pat_str=r"\S+|\s+", mergeable_ranks=vocab, special_tokens={})._core_bpe.encode_single_piece


class Pieces:
    """Split of a text into pre-tokens, exactly as the library does for this vocabulary."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or model["type"] != "BPE" or not plain:
            raise ValueError(f"{path}: only byte-level BPE with the usual split, without a normalizer, is counted here")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x["content"] for x in spec["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        chars = byte_chars()
        self.vocab = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in chars for c in t)}
        self.longest = max(map(len, self.vocab))

    def simple(self, text: str) -> bool:
        return not _ODD.search(text) if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f") else True

    def split(self, text: str) -> list[str]:
        if self.simple(text):
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def segments(self, text: str) -> list[tuple[str, str | None]]:
        """Runs of ordinary text, each with the added token after it (None at the end)."""
        out, at = [], 0
        for m in self._special.finditer(text):
            out.append((text[at : m.start()], m[0]))
            at = m.end()
        return [*out, (text[at:], None)]


class PrefixCounts(Pieces, dict):
    """Token counts of every prefix.

    A sequence of tokens is the BPE encoding of its bytes exactly if each token alone and each adjacent
    pair encode to themselves. So the encoding of a prefix ends with the one vocabulary token that pairs
    with the last token of a shorter prefix: count[i] = count[i - len(token)] + 1.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self._pairs: dict[int, bool] = {}
        self._known: dict[bytes, int] = {}  # the last tokens of prefixes that many pieces share
        self._encode = fast_encoder(self.vocab)
        self._bytes = {i: b for b, i in self.vocab.items()}
        self._pair_keys, self._pair_fits = np.full(1, 1 << 62), np.zeros(1, bool)
        power, inverse = [1], [1]
        for _ in range(SHORT):
            power.append(power[-1] * _BASE % (1 << 64))
            inverse.append(inverse[-1] * pow(_BASE, -1, 1 << 64) % (1 << 64))
        self._power, self._inverse = np.array(power, np.uint64), np.array(inverse, np.uint64)
        short = [(sum((c + 1) * x for c, x in zip(b, power, strict=False)) % (1 << 64), i) for b, i in self.vocab.items() if len(b) <= SHORT]
        self._hashes, self._ids = (np.array(x, t) for x, t in zip(zip(*sorted(short), strict=True), (np.uint64, np.int64), strict=True))
        self._seen = np.zeros(1 << 20, bool)  # upper bits of hashes that entries have
        self._seen[self._hashes >> np.uint64(44)] = True

    def learn(self, pieces: set[str]) -> None:
        """Store what is missing of the pieces, the short ones together: the last token and the count of all
        their prefixes of one length follow from those of the shorter ones."""
        if len(self) > KEPT_PIECES:
            self.clear()
        fresh = [p for p in pieces if p not in self and p[0] != "'"]
        data = [p.encode() for p in fresh]
        keep = [i for i, d in enumerate(data) if len(d) <= SHORT]
        keep.sort(key=lambda i: -len(data[i]))  # those that a prefix length concerns stand in front
        fresh, data = [fresh[i] for i in keep], [data[i] for i in keep]
        if not fresh:
            return
        size = np.array([len(d) for d in data])
        longest = int(size[0])
        points = np.zeros((longest, len(data)), np.uint64)
        flat = np.frombuffer(b"".join(data), np.uint8)
        row = np.repeat(np.arange(len(data)), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        points[place, row] = (flat.astype(np.uint64) + np.uint64(1)) * self._power[place]
        sums = np.concatenate([np.zeros((1, len(data)), np.uint64), np.cumsum(points, axis=0, dtype=np.uint64)])
        last, count = np.full((longest + 1, len(data)), -1, np.int64), np.zeros((longest + 1, len(data)), np.int16)
        for k in range(1, longest + 1):
            rest = np.arange(np.searchsorted(-size, -k, "right"))
            for at in range(max(0, k - self.longest), k):
                key = (sums[k, rest] - sums[at, rest]) * self._inverse[at]
                good = np.flatnonzero(self._seen[key >> np.uint64(44)])
                found = np.minimum(np.searchsorted(self._hashes, key[good]), len(self._hashes) - 1)
                same = self._hashes[found] == key[good]
                good = good[same]
                token, before = self._ids[found[same]], last[at, rest[good]]
                fits = self._all_fit((before + 1) << 20 | token)
                hit = rest[good[fits]]
                last[k, hit], count[k, hit] = token[fits], count[at, hit] + 1
                rest = np.delete(rest, good[fits])
                if not len(rest):
                    break
        # a prefix counts at the end of each of its characters
        ends = np.append((flat[1:] & 0xC0) != 0x80, True)
        ends[np.cumsum(size) - 1] = True
        row, place = row[ends], place[ends] + 1
        counts = count[place, row]
        table = np.diff(counts, prepend=np.int16(0))
        first = np.append(True, row[1:] != row[:-1])
        table[first] = counts[first]
        stored = table.astype(np.int8).tobytes()
        cuts = np.append(np.flatnonzero(first), len(row)).tolist()
        encode = self._encode
        for i, d in enumerate(data):
            if len(encode(d)) == count[size[i], i]:  # else (equal hashes of other strings) the piece is counted by itself
                self[fresh[i]] = stored[cuts[i] : cuts[i + 1]]

    def _all_fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the two tokens of each pair (before + 1 above 20 bits for the token) encode to themselves."""
        if len(self._pair_keys) > 4 * CACHE:
            self._pair_keys, self._pair_fits = np.full(1, 1 << 62), np.zeros(1, bool)
        at = np.searchsorted(self._pair_keys, pairs)
        new = np.unique(pairs[self._pair_keys[at] != pairs])
        if len(new):
            fits = [self._encode((self._bytes[(x >> 20) - 1] if x >> 20 else b"") + self._bytes[x & 0xFFFFF]) == ([(x >> 20) - 1, x & 0xFFFFF] if x >> 20 else [x]) for x in new.tolist()]
            place = np.searchsorted(self._pair_keys, new)
            self._pair_keys, self._pair_fits = np.insert(self._pair_keys, place, new), np.insert(self._pair_fits, place, fits)
            at = np.searchsorted(self._pair_keys, pairs)
        return self._pair_fits[at]

    def _fits(self, before: int, token: int) -> bool:
        """Whether the two tokens (or the token alone, before < 0) encode to themselves."""
        key = before << 20 | token if before >= 0 else ~token
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) > CACHE:
                self._pairs.clear()
            data = self._bytes[token] if before < 0 else self._bytes[before] + self._bytes[token]
            ok = self._pairs[key] = self._encode(data) == ([token] if before < 0 else [before, token])
        return ok

    def _last(self, data: bytes, last: list[int]) -> int:
        """The last token of data's encoding; last: those of its prefixes, by length."""
        get = self.vocab.get
        for at in range(max(0, len(data) - self.longest), len(data)):
            token = get(data[at:])
            if token is not None and self._fits(last[at], token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def piece_counts(self, piece: str) -> list[int]:
        """Tokens of piece[:k] for k from 1, taken as one pre-token."""
        data = piece.encode()
        last, count, known = [-1], [0], self._known
        for i in range(1, len(data) + 1):
            prefix = data[max(0, i - 2 * self.longest) : i] if i > 200 else data[:i]
            token = known.get(prefix) if i <= 60 else None
            if token is None:
                token = self._last(prefix, last[i - len(prefix) :])
                if len(known) < CACHE and i <= 60:
                    known[prefix] = token
            last.append(token)
            count.append(count[i - len(self._bytes[token])] + 1)
        if len(data) == len(piece):
            return count[1:]
        at, out = 0, []
        for c in piece:
            at += len(c.encode())
            out.append(count[at])
        return out

    def deltas(self, piece: str) -> list[int]:
        counts = self.piece_counts(piece)
        if piece[0] == "'" and len(piece) > 1:
            if piece in ("'re", "'ve", "'ll"):
                counts[1] = 2  # cut after its second character, apostrophe and letter are pieces by themselves
        return [b - a for a, b in zip([0, *counts], counts)]  # noqa: B905

    def __missing__(self, piece: str) -> bytes:
        d = self.deltas(piece)
        if min(d) < -127 or max(d) > 127:
            raise OverflowError
        out = bytes([x & 255 for x in d])
        if len(self) < CACHE and len(piece) < 200:
            self[piece] = out
        return out

    def _ordinary(self, text: str, pieces: list[str] | None = None) -> np.ndarray | bytes:
        simple = pieces is not None or self.simple(text)
        pieces = pieces or (_SPLIT.findall(text) if simple else self.split(text))
        try:
            stored = b"".join([self[p] for p in pieces])
        except OverflowError:  # a change beyond a byte
            table = np.array([x for p in pieces for x in self.deltas(p)], np.int64)
        else:
            if simple and not any(x in text for x in _DOUBLE) and (text.isascii() or not _SPACES.search(text)):
                return stored
            table = np.frombuffer(stored, np.int8).astype(np.int64)
        return self._spaces(table, pieces)

    def _spaces(self, table: np.ndarray, pieces: list[str]) -> np.ndarray:
        """A prefix that ends with a run of spaces has the whole run as one piece, though in the full text the
        run's last space may start the next piece."""
        at, before = 0, ""
        for p in pieces:
            if before and before.isspace() and p[0].isspace():
                start = at - len(before)
                whole = self.piece_counts(before + p[0])[-1]
                change = whole - int(table[start : at + 1].sum())
                table[at] += change
                if at + 1 < len(table):
                    table[at + 1] -= change
            at, before = at + len(p), p
        return table

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """The table of each text; pieces that are new in them are counted together."""
        pieces = [_SPLIT.findall(t) if self.simple(t) and not self._special.search(t) else None for t in texts]
        self.learn({p for own in pieces if own for p in own})
        return [self.table(t, own) for t, own in zip(texts, pieces, strict=True)]

    def table(self, text: str, pieces: list[str] | None = None) -> np.ndarray:
        """Differences of the token counts of text[:0], text[:1], ... as the library encodes each prefix."""
        runs = [(text, None)] if pieces else self.segments(text)
        if len(runs) == 1:
            got = self._ordinary(text, pieces)
            return np.frombuffer(got, np.int8) if isinstance(got, bytes) else got
        out: list[np.ndarray] = []
        total = 0
        for run, special in runs:
            got = self._ordinary(run)
            d = (np.frombuffer(got, np.int8) if isinstance(got, bytes) else got).astype(np.int64)
            out.append(d)
            if special is not None:
                inside = [int(np.sum(self.table(run + special[:j]))) for j in range(1, len(special))]
                counts = np.array([int(d.sum()), *inside, int(d.sum()) + 1])
                out.append(np.diff(counts))
            total += int(d.sum())
        return np.concatenate(out)


class PackedIds(Pieces, dict):
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        self._encode = fast_encoder(self.vocab)

    def __missing__(self, piece: str) -> bytes:
        out = array.array("I", self._encode(piece.encode())).tobytes()
        if len(self) < CACHE and len(piece) < 200:
            self[piece] = out
        return out

    def ids(self, text: str) -> bytes:
        if not self.simple(text) or self._special.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self[p] for p in _SPLIT.findall(text)])


def prefix_counts(path: str) -> PrefixCounts:
    return held(("prefixes", path), lambda: PrefixCounts(path))


def packed_ids(path: str) -> PackedIds:
    return held(("ids", path), lambda: PackedIds(path))
