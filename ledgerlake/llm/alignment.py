"""Alignment of two tokenizers over the same texts, and corpus-wide counts of linked token ids.

Both token sequences of a text are cut where they end at the same byte; tokens of one group are linked.
Texts are taken in chunks between which neither tokenizer ever joins anything, so each distinct chunk is
encoded and aligned once a block. Linked ids are packed into an int64 key: every task reduces its documents'
distinct keys by np.unique, the partial counts are range-partitioned and sorted, runs of equal keys are
summed, and the sums stay as sorted shards in the shared folder, which workers map into memory to search.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _L, _ODD, _SPLIT, Pieces, fast_encoder
from .common import LONG, STRING, blocks, drop, held, materialize, releasing, schema, shared_dir, text_of

#: A key is the id of A above 20 bits for the id of B.
B_BITS = 20
#: Chunks that a worker keeps from block to block, keys that it gathers before they are reduced, counts of a shard.
KEPT_CHUNKS, GATHERED, SHARD_ROWS = 150_000, 1_000_000, 4_000_000
#: Bytes of texts whose chunks are learnt together.
BLOCK_BYTES = 4 << 20
#: A group of more links is taken by its distinct ids and their numbers.
MANY_LINKS = 10_000
#: Signs before which a run of letters may end a chunk, if no piece of B goes on over them.
_STOPS = " \n.,;:!?\""


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then those of the next."""
    end = np.cumsum(size)
    at = np.repeat(start - end + size, size)
    return at + np.arange(len(at))


class First(Pieces):
    """Tokenizer A: byte-level BPE; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.single = fast_encoder(self.vocab)
        self.size = np.zeros(max(self.vocab.values()) + 1, np.int64)
        self.bytes: list[bytes] = [b""] * len(self.size)
        for data, i in self.vocab.items():
            self.size[i], self.bytes[i] = len(data), data

    def ids(self, chunk: str) -> list[int]:
        if not self.simple(chunk):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        out: list[int] = []
        for piece in _SPLIT.findall(chunk):
            out += self.single(piece.encode())
        return out


class Second:
    """Tokenizer B: pieces with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        real = [p for i, p in enumerate(pieces) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        inside = {pair for p in real for pair in zip(p, p[1:], strict=False)}
        letters = re.findall(f"[{_L}]", "".join(map(chr, range(0x250))))
        #: Whether a piece neither goes on over a space nor over a line's end, so that texts can be cut there.
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in real) and m.encode("\nx")[:2] == [m.piece_to_id("▁"), m.piece_to_id("<0x0A>")]
        self.stops = [c for c in _STOPS if not any((x, c) in inside for x in letters)]

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk: the model puts a space before a text that is not empty, so a chunk goes without
        its first space, and where that does not do after a line's end, which is a token by itself."""
        bare = [c[0] == " " and len(c) > 1 for c in chunks]
        found = self.model.encode([c[1:] if x else "\n" + c for c, x in zip(chunks, bare, strict=True)], num_threads=1)
        return [ids if x else ids[2:] for ids, x in zip(found, bare, strict=True)]


class Aligner(dict):
    """Numbers of the chunks met, and of each chunk its tokens, groups, links and what is summed over links."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = First(a_path), Second(b_path)
        if not self.b.cuts:
            self.chunks: Callable[[str], list[str]] = lambda s: [s]
        else:
            stops = "".join(map(re.escape, self.b.stops))
            quick = re.compile(rf' ?[{_L}]+(?=[{stops}]|\Z)|[.,;:!?"()]+(?=[ \n]|\Z)|(?<=\S)\n(?=\S)| ?.+?(?=(?<=\S) \S|\Z)', re.DOTALL).findall
            odd, slow = _ODD.search, re.compile(r".+?(?=(?<=\w) \w|\Z)", re.DOTALL).findall
            self.chunks = lambda s: slow(s) if odd(s) else quick(s)
        self.decimal = [[b"%d" % i + end for i in range(max(len(self.a.size), len(self.b.size)))] for end in (b",", b"|", b";")]
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.groups: list[bytes] = []
        self.sums = np.zeros((0, 7), np.int64)  # n_a, n_b, n_groups, n_links, n_best, count_sum, links not counted; n_a of -1: bytes differ
        self.keys, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.fresh.append(chunk)
        return number

    def learn(self, counts: Counts | None) -> None:
        """Encode and align the chunks met since the last time; with counts, sum them over each chunk's links."""
        chunks, self.fresh = self.fresh, []
        a, b = [self.a.ids(c) for c in chunks], self.b.ids(chunks)
        data = [c.encode() for c in chunks]
        ends = np.cumsum([len(d) for d in data])
        na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        flat_a, flat_b = (np.array([i for x in ids for i in x], np.int64) for ids in (a, b))
        to_a, to_b = np.cumsum(self.a.size[flat_a]), np.cumsum(self.b.size[flat_b])
        whole = b"".join(data)
        bad = np.zeros(len(chunks), bool)
        if any(b"".join([t.bytes[i] for i in x.tolist()]) != whole for t, x in ((self.a, flat_a), (self.b, flat_b))) or not all(np.array_equal(ends, to[np.cumsum(n) - 1]) for to, n in ((to_a, na), (to_b, nb))):
            for i, d in enumerate(data):  # some chunk does not come back byte by byte
                bad[i] = any(b"".join([t.bytes[k] for k in x]) != d for t, x in ((self.a, a[i]), (self.b, b[i])))
            good = [i for i in range(len(chunks)) if not bad[i]]
            a, b, na, nb = [a[i] for i in good], [b[i] for i in good], na[good], nb[good]
            ends = np.cumsum([len(data[i]) for i in good], dtype=np.int64)
            flat_a, flat_b = (np.array([i for x in ids for i in x], np.int64) for ids in (a, b))
            to_a, to_b = np.cumsum(self.a.size[flat_a]), np.cumsum(self.b.size[flat_b])
        n = len(ends)
        both = np.zeros((2, int(ends[-1]) if n else 0), bool)
        both[0, to_a - 1] = both[1, to_b - 1] = True
        cut = both[0] & both[1]
        number = np.cumsum(cut)  # groups up to and with a byte
        in_a, in_b = (number[to - 1] - cut[to - 1] for to in (to_a, to_b))
        total = int(number[-1]) if n else 0
        size_a, size_b = np.bincount(in_a, minlength=total), np.bincount(in_b, minlength=total)
        upto = number[ends - 1]
        n_groups = np.diff(upto, prepend=0)
        of_group = np.repeat(np.arange(n), n_groups)
        n_links = np.bincount(of_group, size_a * size_b, minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
        keys, weights, owner = self._links(flat_a, flat_b, size_a, size_b, of_group)
        sums = np.full((len(chunks), 7), -1, np.int64)
        summed = counts.sums(keys, weights, owner, n) if counts else (np.zeros(n, np.int64),) * 3
        sums[~bad] = np.column_stack([na, nb, n_groups, n_links, *summed])
        self.sums = np.concatenate([self.sums, sums])
        if counts is None:
            per = np.zeros(len(chunks), np.int64)
            per[~bad] = np.bincount(owner, minlength=n)
            self.keys = np.concatenate([self.keys, keys])
            self.size = np.concatenate([self.size, per])
            self.start = np.cumsum(self.size) - self.size
        else:
            self._texts(flat_a, flat_b, in_a, in_b, of_group, n, bad)

    def _links(self, flat_a, flat_b, size_a, size_b, of_group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed keys of the links with how often each stands there and the chunk's number, chunk by chunk."""
        start_a, start_b, links = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b, size_a * size_b
        large = np.flatnonzero(links > MANY_LINKS)
        links[large] = 0
        k = ragged(np.zeros(len(links), np.int64), links)
        width = np.repeat(size_b, links)
        keys = flat_a[np.repeat(start_a, links) + k // width] << B_BITS | flat_b[np.repeat(start_b, links) + k % width]
        weights, owner = np.ones(len(keys), np.int64), np.repeat(of_group, links)
        if len(large):
            more = [[], [], []]
            for g in large.tolist():
                x, nx = np.unique(flat_a[start_a[g] : start_a[g] + size_a[g]], return_counts=True)
                y, ny = np.unique(flat_b[start_b[g] : start_b[g] + size_b[g]], return_counts=True)
                for at, part in zip(more, ((x[:, None] << B_BITS | y).ravel(), (nx[:, None] * ny).ravel(), np.full(len(x) * len(y), of_group[g])), strict=True):
                    at.append(part)
            keys, weights, owner = (np.concatenate([p, *q]) for p, q in zip((keys, weights, owner), more, strict=True))
            order = np.argsort(owner, kind="stable")
            keys, weights, owner = keys[order], weights[order], owner[order]
        return keys, weights, owner

    def _texts(self, flat_a, flat_b, in_a, in_b, of_group, n, bad) -> None:
        """The groups of each chunk in decimal: ids joined by commas, A's, a bar, B's, a semicolon."""
        group = np.concatenate([in_a * 2, in_b * 2 + 1])
        order = np.argsort(group, kind="stable")
        side = group[order]
        last = np.append(side[1:] != side[:-1], True) if len(side) else np.zeros(0, bool)
        end = np.where(last, 1 + side % 2, 0)
        ids = np.concatenate([flat_a, flat_b])[order]
        decimal = self.decimal
        parts = [decimal[e][i] for e, i in zip(end.tolist(), ids.tolist(), strict=True)]
        upto = np.cumsum(np.bincount(of_group[side // 2], minlength=n)).tolist() if n else []
        at, good = 0, iter(upto)
        for wrong in bad.tolist():
            if wrong:
                self.groups.append(b"")
            else:
                to = next(good)
                self.groups.append(b"".join(parts[at:to]))
                at = to

    def numbered(self, texts: list[str], counts: Counts | None) -> list[np.ndarray]:
        """The chunk numbers of each text (none for an empty one), all of them learnt."""
        if len(self) > KEPT_CHUNKS:
            self.reset()
        number, chunks = self.__getitem__, self.chunks
        out = [np.frombuffer(array("i", map(number, chunks(" " + t))) if t else array("i"), np.int32) for t in texts]
        if self.fresh:
            self.learn(counts)
        return out


class Counts:
    """Sorted shards of keys and counts in the shared folder, mapped into memory, and the highest count of each A id."""

    def __init__(self, shards: list[tuple[str, int, int]], best: np.ndarray):
        self.shards, self.best = shards, best
        self.first = np.array([s[1] for s in shards], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            place, _, rows = self.shards[i]
            files, path = FileSystem.from_uri(place)
            if isinstance(files, LocalFileSystem):
                both = np.memmap(path, "<i8", "r", shape=(2, rows))
            else:  # a store without files: a copy that is gone from the folder as soon as it is mapped
                own, path = tempfile.mkstemp()
                with os.fdopen(own, "wb") as f, files.open_input_stream(FileSystem.from_uri(place)[1]) as source:
                    while part := source.read(8 << 20):
                        f.write(part)
                both = np.memmap(path, "<i8", "r", shape=(2, rows))
                os.unlink(path)
            self.open[i] = both[0], both[1]
        return self.open[i]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each of the sorted keys; 0 for one that no document holds."""
        out = np.zeros(len(keys), np.int64)
        of_shard = np.searchsorted(self.first, keys, "right") - 1
        for i in np.unique(of_shard[of_shard >= 0]).tolist():
            lo, hi = np.searchsorted(of_shard, [i, i + 1])
            have, counts = self.shard(i)
            at = np.minimum(np.searchsorted(have, keys[lo:hi]), len(have) - 1)
            out[lo:hi] = np.where(have[at] == keys[lo:hi], counts[at], 0)
        return out

    def sums(self, keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """For each chunk: its links whose count is the highest of their A id, the sum of its links' counts, and
        how many of its links no document holds (as may be in a text that does not come back byte by byte)."""
        if not len(keys):
            return (np.zeros(n, np.int64),) * 3
        own, at = np.unique(keys, return_inverse=True)
        count = self.of(own)
        ids = own >> B_BITS
        high = (count == self.best[np.minimum(ids, len(self.best) - 1)]) & (count > 0)
        edge = np.searchsorted(owner, np.arange(n + 1))
        running = [np.append(0, np.cumsum(weights * x[at])) for x in (high, count, count == 0)]
        return tuple(r[edge[1:]] - r[edge[:-1]] for r in running)


def aligner(a_path: str, b_path: str) -> Aligner:
    return held(("align", a_path, b_path), lambda: Aligner(a_path, b_path))


def _partial(texts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """key, n: of every task how many of its documents hold a pair of ids linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gathered, total = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def reduce():
            keys, n = np.unique(np.concatenate([*gathered, np.zeros(0, np.int64)]), return_counts=True)
            own, at = np.unique(np.concatenate([known[0], keys]), return_inverse=True)
            return own, np.bincount(at, np.concatenate([known[1], n]), minlength=len(own)).astype(np.int64)

        for batch in releasing(batches):
            for _, values in blocks(batch.column(0), BLOCK_BYTES):
                lex = aligner(*paths)
                for chunks in lex.numbered(values, None):
                    chunks = np.unique(chunks)
                    if len(chunks) and lex.sums[chunks, 0].min() >= 0:
                        keys = np.unique(lex.keys[ragged(lex.start[chunks], lex.size[chunks])])
                        gathered.append(keys)
                        total += len(keys)
                        if total >= GATHERED:
                            known, gathered, total = reduce(), [], 0
                            if len(known[0]) >= GATHERED:
                                yield pa.RecordBatch.from_arrays(list(map(pa.array, known)), names=["key", "n"])
                                known = np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = reduce()
        for at in range(0, len(known[0]), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 18)]) for x in known], names=["key", "n"])

    return texts.mapInArrow(count, schema(key=LONG, n=LONG))


def _write_shards(sorted_counts: DataFrame, folder: str, most: int) -> DataFrame:
    """Sum runs of equal keys; place, first, rows of the shards written, and each A id's highest count there.
    A repeated task writes files of its own names, and only those of the one that ended are listed."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)

        def shard(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            name = f"shard-{uuid.uuid4().hex}"
            with files.open_output_stream(f"{path}/{name}") as out:
                out.write(keys.astype("<i8").tobytes())
                out.write(counts.astype("<i8").tobytes())
            ids = keys >> B_BITS
            at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            best = np.maximum.reduceat(counts, at)
            columns = [pa.array([f"{folder}/{name}"] * len(at)), pa.array([int(keys[0])] * len(at), pa.int64()), pa.array([len(keys)] * len(at), pa.int64()), pa.array(ids[at]), pa.array(best)]
            return pa.RecordBatch.from_arrays(columns, names=["place", "first", "rows", "a_id", "best"])

        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            counts = np.concatenate([counts, batch.column(1).to_numpy(zero_copy_only=False)])
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[at], np.add.reduceat(counts, at)
            while len(keys) > most:  # the last run may go on in the next batch
                yield shard(keys[:most], counts[:most])
                keys, counts = keys[most:], counts[most:]
        if len(keys):
            yield shard(keys, counts)

    return sorted_counts.mapInArrow(write, schema(place=STRING, first=LONG, rows=LONG, a_id=LONG, best=LONG))


def pair_counts(df: DataFrame, text: str = "text", paths: tuple[str, str] | None = None, shard_rows: int = SHARD_ROWS) -> Counts:
    """How many documents of df hold each pair of an A and a B id linked, as sorted shards in the shared folder.

    A row is a document. Null and empty texts, and those that do not come back byte by byte, hold nothing. To
    the driver come the shards' places and at most one number for each entry of A's vocabulary. The shared
    folder must be one that pyarrow.fs opens.
    """
    paths = paths or default_paths()
    texts = df.select(text_of(text).alias("text")).where("text <> ''")
    partial = materialize(_partial(texts, paths), "pair-partial")  # sampled for the ranges, so not computed again
    folder = f"{shared_dir(df.sparkSession)}/ledgerlake/pair-counts-{uuid.uuid4().hex}"
    written = materialize(_write_shards(partial.repartitionByRange("key").sortWithinPartitions("key"), folder, shard_rows), "pair-shards")
    shards = sorted(((r.place, r.first, r.rows) for r in written.select("place", "first", "rows").distinct().collect()), key=lambda s: s[1])
    highest = written.groupBy("a_id").agg(F.max("best").alias("best")).collect()
    best = np.zeros(max((r.a_id for r in highest), default=0) + 1, np.int64)
    for r in highest:
        best[r.a_id] = r.best
    drop(partial, written)
    return Counts(shards, best)


def _stats(df: DataFrame, text: str, paths: tuple[str, str], counts: Counts, made: T.StructType, each: Callable[[Aligner, list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    names = {f.name.lower() for f in made.fields}
    kept = [c for c in df.columns if c.lower() not in {text.lower(), *names}]
    name = "_source"
    while name in map(str.lower, kept):
        name = "_" + name
    out = T.StructType([*(df.schema[c] for c in kept), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in releasing(batches):
            for at, values in blocks(batch.column(len(kept)), BLOCK_BYTES):
                lex = aligner(*paths)
                columns = each(lex, lex.numbered(values, counts))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(values)).columns[: len(kept)], *columns], names=out.names)

    return df.select(*[F.col(f"`{c}`") for c in kept], text_of(text).alias(name)).mapInArrow(run, out)


def _good(lex: Aligner, chunks: np.ndarray) -> bool:
    return len(chunks) > 0 and lex.sums[chunks, 0].min() >= 0


def _joined(lex: Aligner, chunks: np.ndarray) -> bytes:
    groups = lex.groups
    return b"".join([groups[i] for i in chunks.tolist()])[:-1]


def groups(df: DataFrame, text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """df with `groups` (a1,a2|b1;a3|b2,b3: ids of both tokenizers between common ends) instead of the text;
    '' for null and empty texts and for those that do not come back byte by byte."""
    nothing = _Uncounted([], np.zeros(1, np.int64))
    return _stats(df, text, paths or default_paths(), nothing, schema(groups=STRING), lambda lex, docs: [pa.array([_joined(lex, d).decode() if _good(lex, d) else "" for d in docs], pa.string())])


class _Uncounted(Counts):
    def sums(self, keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        return (np.zeros(n, np.int64),) * 3


MADE = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def link_statistics(df: DataFrame, counts: Counts, text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """df with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 instead of the text.

    counts: what pair_counts gave for a corpus that holds all these texts. Null and empty texts, and those
    whose tokens of either side do not give the text's bytes after a space, have zeros and ''. Columns of df
    with the names of the results give way; each of repeated rows is a document. No shuffle.
    """

    def each(lex: Aligner, docs: list[np.ndarray]) -> list[pa.Array]:
        good = [_good(lex, d) for d in docs]
        sums = np.array([lex.sums[d].sum(axis=0) if ok else np.zeros(7, np.int64) for d, ok in zip(docs, good, strict=True)], np.int64).reshape(-1, 7)
        if sums[:, 6].any():
            raise ValueError("links that were not counted: the texts have changed since")
        digests = [hashlib.sha256(_joined(lex, d)).hexdigest() if ok else "" for d, ok in zip(docs, good, strict=True)]
        return [*(pa.array(np.ascontiguousarray(sums[:, i])) for i in range(6)), pa.array(digests, pa.string())]

    return _stats(df, text, paths or default_paths(), counts, schema(**dict.fromkeys(MADE, LONG), groups_sha256=STRING), each)
