"""The pipeline on the smallest tables, each stage held against what it says."""

import hashlib
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from formline.llm import quality_knn, trie_join

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, DATA).cache()
    scores = quality_knn.score(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scores.where("predicted = 1").collect())
    single = corpus_pipeline.near_duplicates(spark, kept, DATA).cache()
    groups = trie_join.jaccard_components(kept).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})
    clean = corpus_pipeline.personal_data(spark, single, DATA).cache()
    assert clean.count() == single.count() and clean.columns == corpus_pipeline.COLUMNS
    mixed = corpus_pipeline.mixing(spark, clean, DATA)
    assert mixed.columns == corpus_pipeline.COLUMNS
    n = mixed.count()
    assert corpus_pipeline.encoding(spark, mixed, DATA).count() == n
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_shared_and_null_ids(spark, monkeypatch):
    a, b, c = ("".join(f"{w}{i} " for i in range(60)) for w in ("alpha", "beta", "gamma"))
    rows = [(None, a, "en", "s", 1), (None, b, "en", "s", 1), (7, b + "end", "en", "s", 1), (8, c, "en", "s", 1), (8, c, "en", "s", 1), (8, a + "x", "en", "s", 1), (9, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == [(False, 8, c), (False, 9, ""), (True, 0, a), (True, 0, b)]
    real = quality_knn.score
    labels = spark.createDataFrame([], "doc_id long, quality int")
    monkeypatch.setattr(quality_knn, "score", lambda d, _, **k: real(d, labels, **k))  # no label: empty texts score 0, all others 0.5
    more = docs.union(spark.createDataFrame([(None, "", "en", "s", 0), (8, "", "en", "s", 0)], docs.schema))
    got = corpus_pipeline.quality(spark, more, f"{DATA}").collect()
    assert len(got) == 6 and all(r.text for r in got)


ODD = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Nulls in every column, an empty and a very long text, repeated rows, ties, and texts with personal data."""
    body = lambda k, n=90: " ".join(f"w{k}{i * 7919 % 100_003}x" for i in range(n))
    return [
        (1, body(1), "en", "a", 5), (1, body(1), "en", "a", 5), (2, body(1), None, None, None), (None, body(2), "en", "a", 1), (None, None, None, None, None), (3, "", "en", "b", 0),
        (4, None, "en", "b", 0), (5, body(3, 60_000), "de", "c", 9), (6, body(4) + " mail jo.e@web1.com now +1 (956) 555-0122 end", "en", "a", 7), (7, body(4) + " mail jo.e@web1.com now +1 (956) 555-0122 end more", "en", "a", 7),
    ]


def test_stages_on_odd_rows(spark, monkeypatch):
    real = quality_knn.score
    labels = spark.createDataFrame([], "doc_id long, quality int")
    monkeypatch.setattr(quality_knn, "score", lambda d, _, **k: real(d, labels, **k))  # no label: empty texts score 0, all others 0.5
    docs = spark.createDataFrame(odd_rows(), ODD).withColumn("score", F.lit("clash"))
    kept = corpus_pipeline.quality(spark, docs, DATA)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, 2, None, 5, 6, 7])
    single = corpus_pipeline.near_duplicates(spark, kept, DATA)
    assert sorted((r.doc_id or 0, r.source or "") for r in single.collect()) == [(0, "a"), (1, "a"), (5, "c"), (6, "a")]
    before = {r.doc_id: r.text for r in single.collect()}
    clean = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, single, DATA).collect()}
    assert clean.keys() == before.keys() and "jo.e@web1.com" not in clean[6].text and "555-0122" not in clean[6].text
    for i, t in before.items():
        assert clean[i].n_chars == len(clean[i].text) and set(re.findall(r"\bw[0-9]+x\b", t)) >= set(re.findall(r"\bw[0-9]+x\b", clean[i].text))
    mixed = corpus_pipeline.mixing(spark, docs.drop("score"), DATA)
    assert mixed.columns == corpus_pipeline.COLUMNS
    encoded = corpus_pipeline.encoding(spark, docs, DATA)
    assert Counter(r.doc_id for r in encoded.collect()) == Counter(r[0] for r in odd_rows())
    assert all(r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for r in encoded.where("doc_id > 2").collect() for i, t, *_ in odd_rows() if i == r.doc_id)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0, name
        docs = out if name != "byte-level BPE" else docs
