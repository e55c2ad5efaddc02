"""Source divergence: both ways of the split against sums term by term in Python's integers."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from loomgraph.llm import divergence, queries
from oracle import compare

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t in df if df[t] >= least}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        everything = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        def f(x, y):
            return (x - y) ** 2 // y

        for s, c in counts.items():
            pairs = [(-sum(f(p(c, t), p(d, t)) for t in kept), o) for o, d in counts.items() if o != s]
            terms = [(-f(p(c, t), p(everything, t)), t) for t in kept if c[t] and p(c, t) > p(everything, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def random_rows(seed, n, sources, words):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(sources)) for i in range(n)]


def got(df):
    return {tuple(r) for r in df.collect()}


WORDS = ["The", "éa", "b", "cc", "Été", "x1y", "\U0001f600z"] + [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]


@pytest.mark.parametrize("heavy", [-1.0, 0.4, 2.0])  # all heavy, split, all light
def test_sums_are_exact(spark, heavy):
    rows = random_rows(3, 300, ["a", "b", "", None, "c", "d", "é"], WORDS)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(divergence.source_divergence(df, top=20, heavy_share=heavy)) == brute(rows, top=20)


def test_blocks_of_groups(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MATRIX_CELLS", 20)
    monkeypatch.setattr(divergence, "TILE_CELLS", 16)
    monkeypatch.setattr(divergence, "MOST_ENTRIES", 50)
    rows = random_rows(4, 200, [f"s{i}" for i in range(9)], WORDS)
    sums = divergence.PairSums(np.array([5, 6, 7]), 1, 3, 0.4)
    assert sums.sums.shape == (2, 3)
    assert got(divergence.source_divergence(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_documents(spark, odd_docs, none):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd_docs.collect()]
    assert got(divergence.source_divergence(odd_docs)) == brute(rows)
    assert got(divergence.source_divergence(odd_docs, least_docs=1)) == brute(rows, 1)
    assert got(divergence.source_divergence(none)) == set()


def test_shares_of_large_counts(spark):
    counts, totals = np.array([0, 7, 10**12, 4 * 10**15]), np.array([1, 10**13, 3 * 10**12, 5 * 10**15])
    want = [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, totals)]
    assert divergence.shares(counts, totals).tolist() == want
    df = spark.createDataFrame([(int(c), int(t)) for c, t in zip(counts, totals)], "c long, t long")
    assert [r[0] for r in df.select(divergence.share(df.c, df.t)).collect()] == want


def test_query(spark):
    compare(spark, queries.op12_source_divergence, queries.ORACLES["op12_source_divergence"])
