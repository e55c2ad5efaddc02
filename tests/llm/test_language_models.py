import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from loomgraph.llm import language_id, licenses, lm_scoring


def tokens_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + [None]


def brute_scores(rows):
    """The trigram model, arc by arc from plain counts."""
    out = []
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    c, pairs, triples, followed, starts = Counter(), Counter(), Counter(), defaultdict(set), 0
    for r, h in zip(rows, held):
        if not h:
            t = tokens_of(r["text"])
            c.update(t)
            line = ["<s>", "<s>", *t]
            pairs.update(zip(line[1:], line[2:]))
            triples.update(zip(line, line[1:], line[2:]))
            triples.update([(*line[-2:], "<pad>")])
            starts += 1
    for u, v, w in triples:
        followed[u, v].add(w)
    pairs["<s>", "<s>"] = starts
    n, v, m = sum(c.values()), len(c), lm_scoring.PRIOR
    ranks = Counter(triples.values())
    d = min(max(ranks[1] / (ranks[1] + 2 * ranks[2]), 0.1), 0.95) if ranks[1] else 0.5
    one = lambda w: (c[w] + 1) / (n + v + 1)
    two = lambda u, w: (pairs[u, w] + m * one(w)) / ((starts if u == "<s>" else c[u]) + m)

    def three(t, u, w):
        if not pairs[t, u]:
            return two(u, w)
        left = d * len(followed[t, u]) / pairs[t, u]
        return max(triples[t, u, w] - d, 0) / pairs[t, u] + left * two(u, w)

    for r, h in zip(rows, held):
        t = tokens_of(r["text"])
        line = ["<s>", "<s>", *t]
        score = sum(math.log10(three(*x)) for x in zip(line, line[1:], t))
        out.append((r["doc_id"], h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(one(w)) for w in t), score))
    if n:  # a distribution: all next words and an unknown one add up to 1
        for t, u in list(pairs)[:3]:
            if u is not None:
                total = sum(three(t, u, w) for w in [*c, "<never seen>"]) if (t, u) in followed or not pairs[t, u] else 1
                assert total == pytest.approx(1)
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_scores(spark, odd_docs, none, monkeypatch):
    got = [tuple(r) for r in lm_scoring.score_texts(odd_docs).collect()]
    same(got, brute_scores(odd_docs.collect()))
    assert lm_scoring.score_texts(none).count() == 0


def test_scores_of_many(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)] + ["A", "a", "É", "é"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in lm_scoring.score_texts(docs).collect()]
    same(got, brute_scores(docs.collect()))


def test_many_blocks_and_shards(monkeypatch):
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    at = lm_scoring.cuts(keys, 7)
    assert at[0] == 0 and at[-1] == len(keys) and (np.diff(at) > 500).all()
    part = keys[at[2] : at[3]]
    assert (lm_scoring.unpack_keys(lm_scoring.pack_keys(part), len(part)) == part).all()
    assert lm_scoring.unpack_keys(lm_scoring.pack_keys(keys[:0]), 0).tolist() == []
    assert lm_scoring.unpack_keys(lm_scoring.pack_keys(keys[:1]), 1).tolist() == keys[:1].tolist()
    for shape in (0, 1, 5000):
        words, word = lm_scoring.numbered(keys[rng.integers(0, len(keys), shape) ** 2 // len(keys)])
        again = lm_scoring.unpack_words(*lm_scoring.pack_words(words, word))
        assert again[0].tolist() == words.tolist() and again[1].tolist() == word.tolist()
    for values in ([], [0], [1, 2**40, 0], [255, 256]):
        assert lm_scoring.unpack(lm_scoring.pack(np.array(values, np.uint64))).tolist() == values


def test_blocks_do_not_change_scores(spark, monkeypatch):
    rows = [(i, f"the word{i % 7} and the other{i % 11} the end") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 500)
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", 1000)
    same([tuple(r) for r in lm_scoring.score_texts(docs).collect()], brute_scores(docs.collect()))


def test_held_out_texts_score_better_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_scoring.score_texts(docs).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got["s"] > got["b"]


# ---- language identification ---------------------------------------------------------------------


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.selectExpr("avg(int(lang_pred = lang)) a", "count(*) n").first()
    assert n > 150 and right > 0.97


def test_a_doc_id_of_many_rows_and_texts_without_letters(spark):
    rows = [(7, "the cat and the dog", "en")] * 1000 + [(8, "le chat et le chien", "fr"), (9, "\u00bd \u00b2", "en"), (10, "\u2460", "fr"), (11, "\u00e9", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.language_report(docs).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got if r["doc_id"] in (9, 10)} == {"und"}
    assert all(r["lang_pred"] in ("en", "fr") for r in got if r["doc_id"] in (7, 8, 11))
    text_ids = language_id.language_report(docs.withColumn("doc_id", docs.doc_id.cast("string")))
    assert text_ids.count() == len(rows) and text_ids.schema["doc_id"].dataType.simpleString() == "string"


def test_predictions_by_brute_force():
    """Family first, then the language: votes of all machines, by the definition."""
    rng = np.random.default_rng(0)
    texts = {"en": "the and of to in", "de": "der und von zu im", "fr": "le et de la dans", "es": "el y de la en", "zz": "qa xo qi xu"}
    langs = [x for x in texts for _ in range(30)]
    x = np.stack([language_id.features(" ".join(rng.choice(texts[g].split(), 8))) for g in langs])
    model = language_id.LanguageModel(x, langs)
    new = [" ".join(rng.choice(texts[g].split(), 5)) for g in texts for _ in range(6)]
    for text, (lang, score) in zip(new, model.predict(new), strict=True):
        f = language_id.features(text)
        of = {pair: float(f @ model.weights[:, i]) for i, pair in enumerate(model.pairs)}

        def winner(name, classes):
            beats = {c: [m if a == c else -m for (g, a, b), m in of.items() if g == name and c in (a, b)] for c in classes}
            return max(classes, key=lambda c: (sum(m > 0 for m in beats[c]), sum(beats[c])))

        first = winner("", model.families) if len(model.families) > 1 else model.families[0]
        own = [g for g in model.langs if language_id.family(g) == first]
        assert lang == (winner(first, own) if len(own) > 1 else own[0]) and 0 <= score <= 1


def test_language_odd_cases(odd_docs, none):
    got = {r["doc_id"]: r for r in language_id.language_report(odd_docs.withColumnRenamed("x", "y")).collect()}
    assert len(got) == odd_docs.select("doc_id").distinct().count()
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6))
    assert all(r["lang_pred"] in ("en", "fr", "de", "und") and 0 <= r["score"] <= 1 for r in got.values())
    assert language_id.language_report(none).count() == 0
    empty = language_id.LanguageModel(np.zeros((0, language_id.DIMENSIONS + 1), np.float32), [])
    assert empty.predict(["some words"]) == [("und", 0.0)]
    one = language_id.LanguageModel(np.stack([language_id.features("bonjour")]), ["fr"])
    assert one.predict(["some words", None, "12 34"]) == [("fr", 1.0), ("und", 0.0), ("und", 0.0)]


# ---- licenses --------------------------------------------------------------------------------------


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "Released under the MIT License. under  the\nmit-license",
    "x Apache License, Version 2.0, CC BY-NC 4.0; cc by nc nc",
    "Licensed under tje MIT License",
    "GNU Generall Public Licence, version 3",
    "gnu general public license version 4",
    "ÉCC BY NC \u0080 cc by nc",
    None, "", " .,; ", "the word " * 3000 + "under the mit license",
]


def test_base_places_and_spans():
    s = licenses.LicenseScanner()
    for t in TEXTS:
        got = s.scan(t)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == brute_base(t)
        assert set(filter(None, got["base_labels"].split(","))) <= set(got["labels"].split(","))
    got = s.scan(TEXTS[2])
    assert got["labels"] == "mit" and got["spans"][0]["errors"] == 1 and 0.9 < got["score"] < 1
    span = got["spans"][0]
    assert TEXTS[2][span["start_char"] : span["end_char"]] == "under tje MIT License" and (span["start_word"], span["end_word"]) == (1, 5)
    assert s.scan(TEXTS[3])["labels"] == "gpl-3" and s.scan(TEXTS[4])["labels"] == ""


def test_spans_against_search_everywhere():
    """The pieces lose no match: each notice with random errors is found."""
    import random

    rng, s = random.Random(7), licenses.LicenseScanner()
    for _ in range(300):
        n = rng.choice([n for n in s.notices if n.errors])
        body = n.phrase[:-2] if n.phrase[-1].isdigit() else n.phrase
        tail, chars = n.phrase[len(body) :], list(body)
        for at in rng.sample(range(1, len(chars) - 1), rng.randint(0, n.errors)):
            chars[at] = rng.choice(["", chars[at] + "q", "z"]) if chars[at] != " " else " "
        got = s.scan(f"some words {''.join(chars)}{tail} and more")
        assert n.label in got["labels"], "".join(chars)


def test_scan_licenses(odd_docs, none):
    got = licenses.scan_licenses(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r["labels"] == "" and r["score"] == 0 for r in got)
    assert licenses.scan_licenses(none).count() == 0
