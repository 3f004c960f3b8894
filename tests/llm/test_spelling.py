"""Spelling variants against plain loops over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlake.llm import queries, spelling


def plain_counts(docs, least_length=6, least_count=5):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) if vs else None for w, vs in near.items()}
    form = {w: b if b is not None and counts[b] >= 5 * counts[w] else None for w, b in best.items()}
    rows = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), None if form[w] is None else counts[form[w]]))
    return sorted(rows)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_hashes_are_those_of_the_strings():
    words = ["aab", "", "é", "abab", "ba", "b\U0001f600a", "aaaa"]
    deleted, changes, whole = spelling.deletion_hashes(words)
    strings = [w[:i] + w[i + 1 :] for w in words for i in range(len(w))]
    known = {w: h for w, h in zip(words, whole.tolist(), strict=True)}
    assert changes.tolist() == [i == 0 or w[i] != w[i - 1] for w in words for i in range(len(w))]
    for s, h in zip(strings, deleted.tolist(), strict=True):
        assert known.setdefault(s, h) == h
    assert len(set(known.values())) == len(known)
    assert [len(x) for x in spelling.deletion_hashes([])] == [0, 0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_variants_of_random_words(spark, seed):
    """Few letters, so that runs of equal ones, chains, ties and several near words abound."""
    rng = random.Random(seed)
    words = {"".join(rng.choices("abÿ" if seed else "ab", k=rng.randint(1, 8))) for _ in range(400)}
    counts = {w: 5 ** rng.randint(0, 6) + rng.randint(0, 1) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    got = rows_of(spelling.variants(df))
    assert got == plain_variants(counts)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(spelling, "mix64", lambda x: np.zeros_like(x))
    keys = np.concatenate([spelling.deletion_hashes(["abc", "xyz"])[0], spelling.deletion_hashes(["ab"])[2]])
    assert len(set(keys.tolist())) == 1
    words = spark.createDataFrame([(0, "abcdef", 9), (1, "abxdef", 90), (2, "qqqqqq", 9), (3, "abcde", 9)], "id long, word string, n long")
    places = [(i, w, p) for i, w in ((0, "abcdef"), (1, "abxdef"), (2, "qqqqqq"), (3, "abcde")) for p in range(-1, len(w))]
    same = spark.createDataFrame([(7, i, p, p >= 0 and (p == 0 or w[p] != w[p - 1])) for i, w, p in places], "key long, id long, place int, first boolean")
    monkeypatch.setattr(spelling, "deletion_keys", lambda _: same)
    got = {r.id: (r.n_near, r.best.word) for r in spelling.near_words(words).collect()}
    assert got == {0: (2, "abxdef"), 1: (1, "abcdef"), 3: (1, "abcdef")}


def test_counts_and_messy_rows(spark, messy, nothing):
    """Nulls in either column, empty and very long texts, repeated rows, one very long run, clashing columns."""
    rng = random.Random(4)
    pool = ["".join(rng.choices("abABé×", k=rng.randint(4, 9))) for _ in range(300)] + ["aÉbaba-ba"]
    texts = [" ".join(rng.choices(pool, k=400)) for _ in range(40)]
    docs = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (None, None), (3, "Zz" * 3000), (4, "Zz" * 3000 + "z")] * 5
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n long, word string").repartition(6)
    counted = spelling.word_counts(df)
    want = plain_counts(docs)
    assert {r.word: r.n for r in counted.collect()} == want and len(want) > 50
    assert rows_of(spelling.variants(counted)) == plain_variants(want)
    assert {r.word: r.n for r in spelling.word_counts(messy).collect()} == plain_counts([tuple(r) for r in messy.select("doc_id", "text").collect()])
    assert spelling.variants(spelling.word_counts(nothing)).count() == 0
    with pytest.raises(ValueError, match="times"):
        spelling.variants(counted, times=1)


def test_tasks_that_pass_counts_on(spark, monkeypatch):
    df = spark.createDataFrame([(i, "several words of letters") for i in range(30)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(spelling, "COUNTED", 1)
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == plain_counts([(i, "several words of letters") for i in range(30)])


def test_query_against_plain_loops(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = rows_of(queries.QUERIES["op13_spelling_variants"](spark, path))
    assert got == plain_variants(plain_counts(docs)) and got
