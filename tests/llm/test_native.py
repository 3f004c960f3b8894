"""Mixing, url rules, the corpus queries' SQL, and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import mixing, queries, url_filter

from ..oracle import frame_rows, sql_rows, tables_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert frame_rows(queries.QUERIES[name](spark, SF)) == sql_rows(queries.ORACLE_SQL[name], tables_of(SF))


def test_targets_cap_at_twice_the_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 40), ("d", 0)], "source string, source_size long")
    rows = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert rows["a"] == 20 and rows["d"] == 0 and abs(sum(rows.values()) - 1.5 * 1550) < 1e-6
    assert all(rows[s] <= 2 * n + 1e-9 for s, n in (("a", 10), ("b", 1000), ("c", 500), (None, 40)))


def test_mix_of_messy_rows(messy, nothing, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)  # many buckets and ranges
    rows = mixing.mix(messy.withColumnRenamed("lang", "taken")).collect()
    assert len(rows) == messy.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    monkeypatch.undo()
    same = mixing.mix(messy).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, same))
    by_source = {}
    for r in rows:
        by_source.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(sum(v) <= t for (_, t), v in by_source.items())
    assert mixing.mix(nothing).count() == 0


def test_rules(spark):
    urls = [
        ("http://A.Example.COM/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"), ("http://x.com/en/1", "x.com", "/en/1", "com/en/", "block"), ("http://xcom/en/1", "xcom", "/en/1", None, "allow"),
        ("http://com/en/", "com", "/en/", "com/en/", "block"), ("https://n.net/de/8#x", "n.net", "/de/8", "net/de/", "block"), ("ftp://b.example.net/de/81", "b.example.net", "/de/81", "example.net/de/8", "allow"),
        (None, "", "", None, "allow"), ("no scheme/en/", "", "", None, "allow"), ("http://", "", "", None, "allow"), ("http://o.org?/es/", "o.org", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rows = url_filter.judge(pages).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [u[1:] for u in urls]
    assert url_filter.judge(pages.where("false")).count() == 0


def test_rules_are_those_of_the_contract(spark):
    """Each rule's word by the contract: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {host + path: verdict for verdict, host, path in url_filter.RULES} == want
    urls = {"http://a.com/en/1": "com/en/", "http://b.example.com/en/71": "example.com/en/7", "http://n.net/de/8": "net/de/", "http://b.example.net/de/81": "example.net/de/8", "http://example.net/de/7": "net/de/", "http://o.org/es/": "org/es/"}
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == [(rule, want[rule]) for rule in urls.values()]


def test_a_long_list_of_rules(spark):
    """20,000 rules, of which some block and some allow, against a plain loop."""
    rules = [("block" if k % 3 else "allow", f"h{k}.example.{'com' if k % 2 else 'net'}", "/" * (k % 5 > 0) + "a" * (k % 5)) for k in range(20_000)]
    listed = {h + p: v for v, h, p in rules}
    urls = [f"http://{'w.' * (k % 2)}h{k * 7}.example.{'com' if k % 4 else 'net'}/aa{'a' * (k % 4)}?x" for k in range(3000)]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), tuple(rules)).collect()
    assert len(rows) == 3000
    for r in rows:
        labels = r.host.split(".")
        fit = [".".join(labels[i:]) + r.path[:n] for i in range(len(labels)) for n in range(len(r.path) + 1)]
        fit = [k for k in fit if k in listed]
        want = max(fit, key=len) if fit else None
        assert r.rule == want and r.verdict == (listed[want] if want else "allow")
    assert sum(r.rule is not None for r in rows) > 500


def test_cascade_is_exact_even_with_small_filters(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key LIKE '%7'")
    levels = url_filter.cascade(listed, universe, bits_per_key=(3, 3))
    assert len(levels) > 2
    wrong = universe.where(url_filter.member(levels, F.col("key")) != F.col("key").like("%7")).count()
    assert wrong == 0
    assert url_filter.cascade(listed.where("false"), universe) == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, before, SF), f"test-{name}")
        assert after.columns == columns and 0 < after.count()
        if name != "source_mix":
            assert after.join(before, "doc_id", "left_anti").count() == 0 and after.count() <= before.count()
        before = after
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_of_messy_rows(spark, messy, nothing, tmp_path):
    spark.createDataFrame([(1, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (messy, nothing):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), f"test-{name}")
    assert docs.count() == 0
