import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from loomgraph.llm import quality


class BruteKneserNey:
    """Interpolated modified Kneser-Ney trigrams over lists of numbers, straight from the definition."""

    def __init__(self, texts):
        three = Counter()
        for t in texts:
            z = [quality.START, quality.START, *t]
            three.update(g for g in zip(z, z[1:], z[2:]) if g[2] != quality.UNKNOWN)
        two = Counter(g[1:] for g in three)
        self.k = [None, Counter(g[1:] for g in two), two, three]
        self.d, self.ctx = [None] * 4, [None] * 4
        for n in (1, 2, 3):
            c = Counter(self.k[n].values())
            y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0
            self.d[n] = [0, *[min(max(i - (i + 1) * y * c[i + 1] / c[i], 0.1), i - 0.05) if c[i] and c[i + 1] else i * 0.5 for i in (1, 2, 3)]]
            self.ctx[n] = defaultdict(list)
            for g, v in self.k[n].items():
                self.ctx[n][g[:-1]].append(v)

    def p(self, g):
        if not g:
            return 1 / (len(self.k[1]) + 1)
        low, seen = self.p(g[1:]), self.ctx[len(g)].get(g[:-1])
        if not seen:
            return low
        d, v = self.d[len(g)], self.k[len(g)].get(g, 0)
        return (v - d[min(v, 3)] + sum(d[min(x, 3)] for x in seen) * low) / sum(seen)


def test_probabilities(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, rng.integers(3, 30), p=np.arange(12, 0, -1) / 78)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, least=2, few=5)
    fit = [r["text"] for r in quality.trusted_sample(docs, labels, 1600, 32000).filter("fit").collect()]
    vocabulary = model.vocabulary[model.langs["en"]]
    numbers = lambda ts: np.split(*(lambda a, n: (a, np.cumsum(n)[:-1]))(*quality.token_numbers(pa.array(ts), vocabulary)))
    brute = BruteKneserNey([x.tolist() for x in numbers(fit)])
    new = [*texts[:5], "w1 w1 w1 w1 w9 Nope 12, ### w2", "", "w11 w0"]
    tokens, lengths = quality.token_numbers(pa.array(new), vocabulary)
    got = model.log_probabilities(tokens, lengths, model.lang_numbers(["en"] * len(new)))
    for g, t in zip(got, numbers(new), strict=True):
        assert g == pytest.approx(brute_log(brute, t.tolist()), rel=1e-4)


def brute_log(brute, tokens):
    z = [quality.START, quality.START, *tokens]
    return sum(math.log(brute.p(x)) for x in zip(z, z[1:], z[2:]))


def brute_tokens(text, vocabulary):
    """Tokens of a text word by word."""
    words, out = (text or "").split(), []
    for i, w in enumerate(words):
        run = 0
        while i - run > 0 and words[i - run - 1] == w:
            run += 1
        out.append(quality.UNKNOWN if run > 1 else quality.SAME if run else vocabulary.get(w, quality.shape(w)))
    return [*out, quality.STOP]


def test_whole_query_by_brute_force(spark):
    """Vocabulary, n-grams, means, limits and judgements of a small table, all from the definition; one doc_id repeats many times."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(160):
        lang = ("en", "fr", None)[0 if i % 2 else 1 if i % 8 else 2]
        words = [f"{lang or 'x'}{k}" for k in range(9)]
        text = " ".join(rng.choice(words, rng.integers(2, 25), p=np.arange(9, 0, -1) / 45))
        rows.append((i, text if i % 10 else " ".join(rng.choice(["Zz", "q#", "77"], 6)), lang))
        if i % 4 != 3:
            labels.append((i, int(i % 10 != 0), int(i % 50 == 1)))
    rows += [(2, rows[2][1], rows[2][2])] * 300 + [(500, None, "en"), (501, " ", "fr"), (None, "en1 en2", "en"), (502, "en1 fr1", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    settings = {"per_lang": 30, "least": 2, "few": 12, "words": 6, "words_any": 8}
    sample = [tuple(r) for r in quality.trusted_sample(docs, given, 30, 32000).collect()]
    trusted = {i for i, q, t in labels if q == 1 and t == 0}
    assert len(sample) == len({(r[0], r[1]) for r in sample}) and {r[0] for r in sample} <= trusted and max(Counter(r[1] for r in sample).values()) <= 30
    own = [x for x, n in Counter(r[1] for r in sample).items() if n >= 12 and x != "*"]
    models = {}
    for lang in ["*", *own]:
        fit = [r[2] for r in sample if r[3] and lang in ("*", r[1])]
        count = Counter(w for t in fit for w in t.split())
        top = sorted([w for w in count if count[w] >= 2], key=lambda w: (-count[w], w))[: 8 if lang == "*" else 6]
        vocabulary = {w: 1000 + i for i, w in enumerate(top)}
        models[lang] = (vocabulary, BruteKneserNey([brute_tokens(t, vocabulary) for t in fit]))

    def score(text, lang):
        vocabulary, brute = models[lang]
        t = brute_tokens(text, vocabulary)
        return len(t), -brute_log(brute, t) / len(t)

    of = lambda lang: lang if lang in models else "*"
    fitted = {r[0] for r in sample if r[3]}
    held = [(of(lang), *score(text, of(lang))) for i, text, lang in rows if text is not None and i in trusted and i not in fitted]
    held += [("*", *score(r[2], "*")) for r in sample if not r[3]]
    mean, limit = {}, {}
    for lang in models:
        mine = [(n, v) for x, n, v in held if x == lang]
        mean[lang] = sum(n * v for n, v in mine) / sum(n for n, _ in mine)
        low = sorted((n * v + 20 * mean[lang]) / (n + 20) for n, v in mine)
        limit[lang] = 1.25 * math.exp(low[math.ceil(0.9 * len(low)) - 1])
    want = []
    for i, text, lang in rows:
        n, v = score(text, of(lang))
        p = math.exp((n * v + 20 * mean[of(lang)]) / (n + 20))
        want.append((i, n, p, limit[of(lang)], p <= limit[of(lang)] and n > 1))
    got = [tuple(r) for r in quality.classify(docs, given, quantile=0.9, **settings).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-4) and g[3] == pytest.approx(w[3], rel=1e-4) and g[4] == w[4]
    kept = sorted([str(w[0]) for w in want if w[4]])
    assert kept == sorted(str(r["doc_id"]) for r in quality.keep_good(docs, given, quantile=0.9, **settings).collect())


def test_shapes_and_repeats():
    v = {"the": 100}
    tokens, lengths = quality.token_numbers(pa.array(["the the the  the the a", "", "the Cat. 12 $$ x"]), v)
    name = lambda w: quality.shape(w)
    assert tokens.tolist() == [100, quality.SAME, 0, 0, 0, name("a"), quality.STOP, quality.STOP, 100, name("Cat."), name("12"), name("$$"), name("x"), quality.STOP]
    assert lengths.tolist() == [7, 1, 6]
    assert len({name(w) for w in ("ab", "Ab", "AB", "aB", "a1", "##", "a-b", "ab.")}) == 8 and name("é") == name("ab") and name("中") == name("ab")


def test_accuracy_on_unseen_documents(spark):
    """Labels of three quarters of the documents are given; the rest is judged, in a table of its own."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("doc_id % 4 <> 1")
    got = quality.classify(docs, known).join(labels.filter("doc_id % 4 = 1"), "doc_id").selectExpr("quality", "int(kept) as k").groupBy("quality").avg("k").collect()
    kept = {r["quality"]: r["avg(k)"] for r in got}
    assert kept[1] > 0.98 and kept[0] < 0.1


def test_odd_cases(spark, odd_docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (9, 1, 1), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and not any(r["kept"] for r in got if r["doc_id"] in (4, 5, 6))
    assert next(r["kept"] for r in got if r["doc_id"] == 1)
    nothing = {r["doc_id"]: r["kept"] for r in quality.classify(odd_docs, labels.limit(0)).collect()}
    assert nothing[8] and not nothing[6]
    assert quality.classify(none, labels).count() == 0
    assert quality.keep_good(odd_docs, labels).columns == odd_docs.columns
