"""Encoding by merge replay against the library, and the way back."""

import base64
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import merge_replay, queries
from ledgerlake.llm.merge_replay import Lexicon, Ranks, default_ranks

ALPHABET = [*"ab c'\n\t rslltd1é.,!\x85\x1c\x1e 　​½Ωß", "  ", "<|endoftext|>", "'re", "'ll", "日本", "aaaa", " \n", "२", "the", " tion", "\U0001f600", "0" * 9]


@pytest.fixture(scope="module")
def lexicon():
    return Lexicon(default_ranks())


@pytest.fixture(scope="module")
def library():
    return library_of(default_ranks())


def library_of(path):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(ids, encoding):
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), max_size=6))
def test_ids_are_the_librarys(lexicon, library, texts):
    got = lexicon.encode(texts)
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert [lexicon.decode(x).decode() for x in got] == texts


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_unicode(lexicon, library, text):
    assert lexicon.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_long_runs(lexicon, library):
    for text in ("a" * 5001, "ab" * 3000 + " " * 500 + "é" * 700, "\n" * 999 + "x"):
        assert lexicon.encode([text])[0].tolist() == library.encode_ordinary(text)


def odd_ranks(folder):
    """Ranks in which a merge opens one of a lower rank, entries no merge reaches, and pairs of equal letters."""
    path = f"{folder}/odd.tiktoken"
    extra = [b"bc", b"abc", b"abcd", b"ab", b"aa", b"aaa", b"cd", b"xyz", b"aaaa", b"da", b"dada", b"ad"]
    with open(path, "wb") as f:
        for rank, word in enumerate([*(bytes([x]) for x in range(256)), b"abcb", *extra]):
            f.write(base64.b64encode(word) + b" %d\n" % rank)
    return path


def test_replay_of_odd_ranks(tmp_path):
    path = odd_ranks(tmp_path)
    ranks, library, rng = Ranks(path), library_of(path), random.Random(5)
    words = ["".join(rng.choices("abcdxyz", k=rng.randint(1, 14))) for _ in range(3000)]
    ids, counts = ranks.replay([w.encode() for w in words])
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [library.encode_ordinary(w) for w in words]
    assert [i if (i := ranks.rank.get(w.encode())) is not None else None for w in ("xyz", "abcb")] == [got_whole(ranks, w) for w in ("xyz", "abcb")]


def got_whole(ranks, word):
    ids, counts = ranks.replay([word.encode()])
    return ids.tolist()[0] if counts.tolist() == [1] else None


def test_ranks_are_checked(tmp_path):
    with open(f"{tmp_path}/short", "wb") as f:
        f.write(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="each byte needs a rank"):
        Ranks(f"{tmp_path}/short")


def test_blocks_and_forgetting(lexicon, library, monkeypatch):
    """Small blocks, small replays and a full lexicon give the same ids."""
    monkeypatch.setattr(merge_replay, "REPLAY_BYTES", 20)
    monkeypatch.setattr(merge_replay, "KEPT_WORDS", 5)
    rng = random.Random(2)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 30))) for _ in range(12)) for _ in range(3)]
        assert [x.tolist() for x in lexicon.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_messy_rows(messy, nothing, library, monkeypatch):
    """Nulls, empty and long texts, repeated rows and columns with the names of the results."""
    rows = merge_replay.round_trip(messy.withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "_source").drop("n_chars")).collect()
    want = sorted(digests(library.encode_ordinary(t or ""), library) for (t,) in messy.select("text").collect())
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert sum(r.doc_id is None for r in rows) == 2 and set(rows[0].asDict()) == {"doc_id", "_source", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert merge_replay.round_trip(nothing).count() == 0
    packed = merge_replay.encode(messy.select("doc_id", "text").withColumn("token_ids", messy.text))
    back = merge_replay.decode(packed.withColumn("decoded", packed.doc_id)).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for (t,) in messy.select("text").collect())
    empty = merge_replay.decode(packed.selectExpr("cast(null as binary) as token_ids")).collect()
    assert {bytes(r.decoded) for r in empty} == {b""}


def test_query_against_the_library(spark, library):
    path = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op12_merge_replay"](spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    assert got == {r.doc_id: digests(library.encode_ordinary(r.text or ""), library) for r in docs}
