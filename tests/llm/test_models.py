"""Toxicity and quality on held out labels, and on messy rows."""

import zlib

import numpy as np
import pytest

from ledgerlake.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def scores(spark, tables, scored, label):
    rows = scored.join(tables[1].select("doc_id", label), "doc_id").collect()
    return [(r[1], r[label]) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_toxicity_on_held_out_documents(spark, tables):
    model = toxicity.fit_toxicity(*tables)
    scored = toxicity.score_toxicity(tables[0], model)
    assert auc(scores(spark, tables, scored.select("doc_id", "toxicity"), "toxic")) > 0.9
    row = toxicity.score_toxicity(spark.createDataFrame([(1, "You idiot and pathetic loser, go.")], "doc_id long, text string"), model).first()
    assert row.toxicity > 0.5 and "idiot" in [row.text[s.begin : s.end] for s in row.toxic_spans][0]


def test_toxicity_of_messy_rows(messy, nothing, spark):
    labels = spark.createDataFrame([(1, 0), (2, None), (7, 1), (99, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(messy, labels)
    rows = toxicity.score_toxicity(messy.withColumnRenamed("lang", "toxicity"), model).collect()
    assert len(rows) == messy.count() and all(0 <= r.toxicity <= 1 for r in rows)
    empty = toxicity.fit_toxicity(nothing, labels)
    assert toxicity.score_toxicity(nothing, empty).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    n = 5
    s, moves, start = rng.normal(size=(1, n)), rng.normal(size=(2, 2)), 0.3
    moves[:, 0] = [0.0, 0.0]
    total, on = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [(code >> k) & 1 for k in range(n)]
        w = np.exp(start * y[0] + sum(s[0, k] * y[k] for k in range(n)) + sum(moves[y[k], y[k + 1]] for k in range(n - 1)))
        total += w
        on += w * np.array(y)
    p, moved, _ = toxicity.marginals(s, np.ones((1, n), bool), start, moves)
    assert np.allclose(p[0], on / total) and np.isclose(moved.sum(), n - 1)


def test_chains_of_several_rows():
    """Marginals of a chain in rows of four slots are those of the same chain in one row."""
    rng = np.random.default_rng(3)
    lengths, wide = np.array([11, 3, 8, 1, 14]), 4
    moves = np.array([[0.0, -1.0], [0.0, 2.0]])
    alone, rows, real, per = [], [], [], -(-lengths // wide)
    moved, begun = np.zeros((2, 2)), []
    for n in lengths:
        s = rng.normal(size=(1, n))
        p, m, first = toxicity.marginals(s, np.ones((1, n), bool), -2.0, moves)
        alone.append(p[0])
        moved, begun = moved + m, [*begun, *first]
        padded = np.pad(s[0], (0, -n % wide))
        rows.append(padded.reshape(-1, wide))
        real.append((np.arange(len(padded)) < n).reshape(-1, wide))
    real = np.concatenate(real)
    p, m, first = toxicity.marginals(np.concatenate(rows), real, -2.0, moves, per)
    assert np.allclose(p[real], np.concatenate(alone)) and np.allclose(m, moved) and np.allclose(first, begun)


def test_every_character_of_long_runs_is_read():
    run = "日本語の文" * 30 + ",idiot,_loser_" + "x" * 95 + "=" * 50
    found = toxicity.parts(run)
    assert "".join(run[a:b] for _, a, b in found) == run and {"idiot", "loser"} <= {t for t, _, _ in found}
    text = f" one {run} two"
    assert [text[a:b] for a, b in toxicity.places(text)] == ["one", *[run[a:b] for _, a, b in found], "two"]
    assert len(toxicity.words(text)) == len(found) + 2
    for i in range(20, len(run) - 5):  # a run of five letters is in a token
        if run[i : i + 5].isalnum():
            assert any(run[i : i + 5] in t for t, _, _ in found)
    clean = ["fine.words,of:a/text-glued.together,with;points,and.no.space" + f",n{i}" for i in range(200)]
    bad = [t.replace("together", "together,idiot") for t in clean[:40]]
    field = toxicity.train(clean + bad, np.repeat([0, 1], [200, 40]))
    score, spans = toxicity.Scorer(field).run([clean[0], bad[0]])
    assert score[0] < 0.5 < score[1] and "idiot" in bad[0][spans[1][0][0] : spans[1][0][1]]


def test_quality_on_held_out_documents(spark, tables):
    model = quality.fit_quality(*tables)
    pairs = scores(spark, tables, quality.score_quality(tables[0], model).select("doc_id", "quality_score"), "quality")
    assert auc(pairs) > 0.9
    assert np.mean([s >= 0.3 for s, y in pairs if y]) > 0.97


def test_quality_of_messy_rows(messy, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, None), (99, 1)], "doc_id long, quality int")
    rows = quality.score_quality(messy.withColumnRenamed("lang", "features"), quality.fit_quality(messy, labels)).collect()
    assert len(rows) == messy.count() and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.score_quality(nothing, quality.fit_quality(nothing, labels)).count() == 0


def test_tables_add_up():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair tells
    model = quality.train(x, y, rounds=20, pair_rounds=60, pairs=2)
    assert (0, 1) in [tuple(sorted(p)) for p in model.pairs] and ((model.score(x) > 0.5) == y).mean() > 0.9
