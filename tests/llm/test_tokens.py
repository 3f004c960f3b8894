"""Token counts and packing against the library."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import packing, token_counts
from ledgerlake.llm.bpe import packed_ids, prefix_counts

PATH = token_counts.default_vocabulary()
ALPHABET = [*"ab c'\n\t rslltd1é.,!\x85\x1c", "  ", "<|endoftext|>", "'re", "'ll", "日本", "aaaa", " \n", " ", "२", "the", " tion"]


def encode(text):
    return packed_ids(PATH).tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join))
def test_every_prefix_counts_as_the_library_does(text):
    got = np.cumsum(prefix_counts(PATH).table(text), dtype=np.int64).tolist()
    assert got == [len(encode(text[:i])) for i in range(1, len(text) + 1)]
    assert packed_ids(PATH).ids(text) == np.asarray(encode(text), "<u4").tobytes()


def test_long_piece():
    text = "ab" * 3000 + " " * 500 + "é" * 700
    assert int(prefix_counts(PATH).table(text).sum(dtype=np.int64)) == len(encode(text))


def test_counts_of_messy_rows(messy, nothing):
    rows = token_counts.prefix_token_counts(messy.withColumnRenamed("lang", "n_tokens").select("doc_id", "text", "n_tokens")).collect()
    texts = [r.text or "" for r in messy.collect()]
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted((len(t.encode()), len(encode(t))) for t in texts)
    assert token_counts.prefix_token_counts(nothing).count() == 0


def test_longest_prefix(spark):
    texts = ["the thing is that one", "", "a" * 50]
    counted = token_counts.prefix_token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    for row in token_counts.longest_prefix(counted, 3).collect():
        t = texts[row.doc_id]
        assert row.fits == max([0, *(k for k in range(1, len(t) + 1) if len(encode(t[:k])) <= 3)])


@pytest.mark.parametrize("n", [0, 1, 40, 3000])
def test_plan_places_every_rest(n):
    rng = random.Random(n)
    demand = dict(Counter(rng.randint(1, 512) for _ in range(n)))
    runs, sequences = packing.plan(demand, 1024)
    slots = Counter()
    for x, parts in runs.items():
        assert [p[0] for p in sorted(parts)] == [0, *[p[1] for p in sorted(parts)][:-1]] and max(p[1] for p in parts) == demand[x]
        for lo, hi, each, first, at in parts:
            for r in range(hi - lo):
                for token in range(x):
                    slots[first + r // each, at + r % each * x + token] += 1
    assert set(slots.values()) <= {1} and all(at < 1024 for _, at in slots)
    assert len({s for s, _ in slots}) == sequences
    if n >= 3000:
        assert sum(slots.values()) >= 0.99 * 1024 * sequences


def test_packing_round_trip(messy, nothing):
    rows = packing.pack(messy).collect()
    texts = {(r.doc_id, r.text) for r in messy.collect()}
    assert sum(r.length for r in rows) == sum(len(encode(r.text or "")) + 1 for r in messy.collect())
    pieces = {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows}
    for doc_id, text in texts:
        ids = np.array([*encode(text or ""), 0], "<u4")
        mine = [p for p in pieces if p[0] == doc_id and p[4] == len(ids)]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c, _ in mine) and sum(p[2] for p in mine) == len(ids)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert packing.pack(nothing).count() == 0
