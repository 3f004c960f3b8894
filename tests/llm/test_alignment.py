"""Alignment of two tokenizers and counts of linked ids, against the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerlake.llm import alignment, queries

ALPHABET = [*"ab c'\n\t rslltd1é.,!\x85\x1c\x1e 　▁\r\0", "  ", "<|endoftext|>", "'re", "'ll", "日本", "aaaa", " \n", "२", "the", " tion", "ß", "Ω", "\U0001f600", "½", "<s>", "<0x41>", "; ", "word. Next", '(see) "x"', " 123"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = alignment.default_paths()
    first = Tokenizer.from_file(a)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=b)


@pytest.fixture(scope="module")
def lexicon():
    return alignment.Aligner(*alignment.default_paths())


def plain_groups(text, libraries):
    """[([A ids], [B ids])] of a text by the libraries; [] where the bytes differ."""
    first, second = libraries
    if not text:
        return []
    chars = {**{chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}}
    chars |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in chars.values())}
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    data_a = [bytes(chars[c] for c in first.id_to_token(i)) for i in a]
    data_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(data_a) != whole or b"".join(data_b) != whole:
        return []
    out, x, y, at, to = [], [], [], 0, 0
    ids_a, ids_b = iter(zip(a, data_a, strict=True)), iter(zip(b, data_b, strict=True))
    while at < len(whole) or to < len(whole):
        if at <= to:
            i, d = next(ids_a)
            x.append(i)
            at += len(d)
        else:
            i, d = next(ids_b)
            y.append(i)
            to += len(d)
        if at == to:
            out.append((x, y))
            x, y = [], []
    return out


def plain_rows(texts, libraries):
    all_groups = [plain_groups(t, libraries) for t in texts]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in all_groups]
    count = Counter(pair for own in links for pair in own)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    rows = []
    for g, own in zip(all_groups, links, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        n_best = sum(n for (a, b), n in own.items() if count[a, b] == best[a])
        rows.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()), n_best, sum(n * count[p] for p, n in own.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return rows


def row(r):
    return tuple(r[c] for c in (*alignment.MADE, "groups_sha256"))


def test_groups_are_the_libraries(lexicon, libraries):
    rng = random.Random(3)
    nothing = alignment._Uncounted([], np.zeros(1, np.int64))
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(3000)]
    for text, chunks in zip(texts, lexicon.numbered(texts, nothing), strict=True):
        want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain_groups(text, libraries))
        assert (alignment._joined(lexicon, chunks).decode() if alignment._good(lexicon, chunks) else "") == want


def test_whole_operator_by_blocks_and_shards(spark, libraries, monkeypatch):
    """Random and given texts, with small blocks, shards and partial counts; groups with many links."""
    rng = random.Random(8)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(120)] + ["a" * 300 + " b", "=" * 700, "x = 1;\r\n" * 40]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(25).collect()]
    for name, value in (("KEPT_CHUNKS", 50), ("GATHERED", 100), ("MANY_LINKS", 30)):
        monkeypatch.setattr(alignment, name, value)
    lex = alignment.Aligner(*alignment.default_paths())
    nothing = alignment._Uncounted([], np.zeros(1, np.int64))
    got = []
    for t in texts:  # in this process, where the small limits hold
        (chunks,) = lex.numbered([t], nothing)
        good = alignment._good(lex, chunks)
        got.append((*(lex.sums[chunks, :4].sum(axis=0).tolist() if good else [0] * 4), hashlib.sha256(alignment._joined(lex, chunks)).hexdigest() if good else ""))
    want = plain_rows(texts, libraries)
    assert got == [(*w[:4], w[6]) for w in want]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    rows = {r.id: row(r) for r in alignment.link_statistics(df, alignment.pair_counts(df, shard_rows=40)).collect()}
    assert [rows[i] for i in range(len(texts))] == want


def test_shards_are_written_and_searched(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "shared_dir", lambda _: str(tmp_path))
    df = spark.createDataFrame([(i, f"the word{i} and the end {i % 7}") for i in range(400)], "id long, text string").repartition(6)
    counts = alignment.pair_counts(df, shard_rows=100)
    keys = np.concatenate([np.array(counts.shard(i)[0]) for i in range(len(counts.shards))])
    assert len(counts.shards) > 1 and (np.diff(keys) > 0).all()
    assert counts.of(keys).max() == 400 and counts.best.max() == 400
    assert counts.of(keys[::3]).tolist() == np.concatenate([np.array(counts.shard(i)[1]) for i in range(len(counts.shards))])[::3].tolist()
    assert counts.of(np.array([0, 1 << 50])).tolist() == [0, 0]
    with pytest.raises(Exception, match="not counted"):
        alignment.link_statistics(df.selectExpr("id", "'another text' AS text"), counts).collect()


def test_messy_rows(messy, nothing, libraries):
    """Nulls, empty and long texts, repeated rows (each a document), columns with the names of the results."""
    docs = messy.withColumnRenamed("lang", "N_A").withColumnRenamed("source", "_source").drop("n_chars")
    rows = alignment.link_statistics(docs, alignment.pair_counts(docs)).collect()
    assert set(rows[0].asDict()) == {"doc_id", "_source", *alignment.MADE, "groups_sha256"}
    assert sorted(map(row, rows)) == sorted(plain_rows([t for (t,) in messy.select("text").collect()], libraries))
    assert alignment.link_statistics(nothing, alignment.pair_counts(nothing)).count() == 0
    said = {r.groups for r in alignment.groups(docs.where("text = 'one' OR text IS NULL")).collect()}
    assert said == {"", *(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain_groups("one", libraries))}


def test_query_against_plain_loops(spark, libraries):
    path = "/root/testdata/sf0.001"
    got = {r.doc_id: row(r) for r in queries.QUERIES["op11_tokenizer_alignment"](spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    assert got == dict(zip([r.doc_id for r in docs], plain_rows([r.text for r in docs], libraries), strict=True))
