"""The limits cover all trusted documents, however small the sample of the n-grams is."""

from collections import Counter

import numpy as np
import pytest
from loomgraph.llm import quality


def test_limits_cover_all_trusted(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(12)]
    p = np.arange(12, 0, -1) / 78
    # every tenth text has its words in other shares, so its perplexity is high
    texts = [" ".join(rng.choice(words, 30, p=p[::-1] if i % 10 == 0 else p)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs = docs.unionByName(spark.createDataFrame([(900, "w1 " * 9, "en"), (901, None, "en")], docs.schema))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)] + [(900, 0, 0), (901, 1, 0)], "doc_id long, quality int, toxic int")
    given = {"per_lang": 40, "least": 2, "few": 5}
    got = {r["doc_id"]: r for r in quality.classify(docs, labels, slack=1.0, quantile=0.9, **given).collect()}
    assert len(got) == 602
    fitted = {texts.index(r["text"]) for r in quality.trusted_sample(docs, labels, 40, 32000).filter("fit").collect()}
    assert 20 < len(fitted) < 60
    en = [r for i, r in got.items() if i < 600 and i % 3 and i not in fitted]
    assert np.mean([r["perplexity"] <= r["limit"] for r in en]) == pytest.approx(0.9, abs=0.01)


def test_classify_and_keep_good_agree(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (9, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    kept = sorted(str(r["doc_id"]) for r in quality.classify(odd_docs, labels).filter("kept").collect())
    assert kept == sorted(str(r["doc_id"]) for r in quality.keep_good(odd_docs, labels).collect())


def test_words_and_trigrams_come_from_all_trusted(spark, monkeypatch, tmp_path):
    """3,600 trusted documents of one language: every second one is fitted to, whole, in any number of shards and blocks."""
    texts = [f"g{i % 150} h{i % 7} g{i * 7 % 150} tail{i}" for i in range(3600)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs.repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    fitted = [r["text"] for r in docs.filter("xxhash64('fit', doc_id) % 2 = 0").collect()]
    counts = Counter(w for t in fitted for w in t.split())
    model = quality.fit(docs, labels, least=8)
    assert 1700 < len(fitted) < 1900
    assert set(model.vocabulary[model.langs["en"]]) == {w for w, n in counts.items() if n >= 8}
    before = {r["doc_id"]: (r["perplexity"], r["limit"], r["kept"]) for r in quality.classify(docs, labels, least=8).collect()}
    monkeypatch.setattr(quality, "SHARD_BYTES", 1500)
    many = quality.fit(docs, labels, least=8)
    assert many.shards > 5 and many.grams.count() > 5
    after = {r["doc_id"]: (r["perplexity"], r["limit"], r["kept"]) for r in quality.classify(docs, labels, least=8).collect()}
    assert before.keys() == after.keys() and all(before[i] == pytest.approx(after[i], rel=1e-6) for i in before)
