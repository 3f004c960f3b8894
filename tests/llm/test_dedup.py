"""Line dedup, the n-gram join and components against plain versions."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

import ledgerlake.llm.ngram_join as nj
from ledgerlake.llm.components import components
from ledgerlake.llm.line_dedup import drop_repeated_lines


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_components(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


def corpus(seed, groups=12, each=6):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 12, 60, 300]))]
        for _ in range(rng.randint(1, each)):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            rows.append((len(rows) * 3 + 1, " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    rng.shuffle(rows)
    return [*rows, (0, ""), (2, None)]


@pytest.mark.parametrize("seed,n,num,den,part_rows", [(1, 3, 90, 100, 1024), (2, 5, 80, 100, 1024), (3, 3, 80, 100, 4), (4, 2, 50, 100, 3)])
def test_join_loses_no_link(spark, monkeypatch, seed, n, num, den, part_rows):
    monkeypatch.setattr(nj, "PART_ROWS", part_rows)
    rows = corpus(seed)
    found = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, num, den).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(rows, n, num, den)
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingles(t, n)) for i, t in rows}


def test_rows_of_one_id_connect_what_their_texts_link(spark):
    rows = [(1, "a b c d"), (2, "e f g h"), (3, "a b c d"), (3, "e f g h"), (4, "e f g h"), (5, "x y z"), (6, "a b c d"), (6, "x y z w")]
    found = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 1)}


def test_blocks_agree_where_sets_link():
    rng = np.random.default_rng(5)
    for num, den in ((80, 100), (90, 100)):
        strata = nj.Strata(num, den)
        for size in (1, 2, 5, 9, 10, 30, 200, 2000):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                keep = a[rng.permutation(len(a))[: -(-len(a) * (num + den) // (2 * den))]]
                b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 1 + size // 10)).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if den * both >= num * (len(a) + len(b) - both):
                    assert len(np.intersect1d(strata.keys(a), strata.keys(b)))


def test_join_of_messy_rows(messy, nothing):
    found = nj.near_duplicates(messy.withColumnRenamed("lang", "n_shingles"), 3, 90, 100).collect()
    assert len(found) == messy.count()
    by_id = {r.doc_id: r.component_id for r in found}
    assert by_id[1] == by_id[2] == 1 and by_id[None] is None and by_id[3] == 3 and by_id[4] == 4
    assert nj.near_duplicates(nothing).count() == 0
    kept = nj.keep_first(messy, nj.near_duplicates(messy, 3, 90, 100))
    assert 2 not in [r.doc_id for r in kept.collect()] and kept.columns == messy.columns and kept.where("doc_id IS NULL").count() == 2


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (5, 5), *[(100, 100 + k) for k in range(1, 300)], *[(k, k + 1) for k in range(1000, 1040)]]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8} | {100 + k: 100 for k in range(300)} | {k: 1000 for k in range(1000, 1041)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, n=3):
    seen, gone, kept = {}, defaultdict(set), {}
    for i, t in sorted(rows):
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        kept[i] = lines
        for k in range(len(lines) - n + 1):
            window = tuple(x.strip(" \t\n\x0b\x0c\r") for x in lines[k : k + n])
            if seen.setdefault(window, (i, k)) != (i, k):
                gone[i] |= set(range(k, k + n))
    return {i: ("\n".join(x for k, x in enumerate(kept[i]) if k not in gone[i]) if gone[i] else t) for i, t in rows}


def test_line_dedup_against_plain_loop(spark):
    rng = random.Random(3)
    passage = [f"passage line {k}" for k in range(6)]
    rows = []
    for i in range(60):
        lines = [f"own {rng.randint(0, 9)} {rng.randint(0, 9)}" if rng.random() < 0.7 else rng.choice(["", "  ", "x "]) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(lines))
            lines[at:at] = passage[rng.randint(0, 2) : rng.randint(3, 6)]
        rows.append((i, "\n".join(lines)))
    rows.append((60, "\n".join(["same"] * 5)))
    got = {r.doc_id: r.text for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ("gone", "_lines", "_doc", "_hash", "_kept", "row", "doc", "hash", "at", "lines", "kept", "window", "first")
    rows = [(1, "a\nb\nc"), (2, "x\na\nb\nc"), (None, "a\nb\nc\nd")]
    docs = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in rows], f"doc_id long, text string, {', '.join(n + ' string' for n in names)}")
    out = drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    for r in out.collect():
        assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
        assert (r.text, r.n_removed) == {1: ("a\nb\nc", 0), 2: ("x", 3), None: ("d", 3)}[r.doc_id]


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    """With every key hot, no link is lost."""
    monkeypatch.setattr(nj, "SAMPLE", 1)
    monkeypatch.setattr(nj, "max", lambda *a: 1, raising=False)
    rows = corpus(6)
    found = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(rows, 3, 80, 100)


def test_line_dedup_of_messy_rows(messy, nothing):
    out = drop_repeated_lines(messy.withColumnRenamed("lang", "n_lines"))
    rows = out.collect()
    assert len(rows) == messy.count() and out.columns == ["doc_id", "text", "source", "n_chars", "n_lines", "n_removed"]
    assert [r.n_removed for r in rows if r.doc_id == 1] == [0, 0] and [r.text for r in rows if r.doc_id == 2] == ["A B c d e f g"]
    assert [r.text for r in rows if r.doc_id == 3] == [None]
    assert drop_repeated_lines(nothing).count() == 0
