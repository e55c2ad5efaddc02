"""Spelling variants: the trie join and the whole query by brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from loomgraph.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :])


def words_of(rows, least=7, slips=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= 2}


def grouped(n, times=10):
    """By the words that one letter less, or another, makes; each found pair is checked."""
    slots = {}
    for w in n:
        for i in range(len(w)):
            slots.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for (a, b), same in slots.items():
        for w in same | ({a + b} & n.keys()):
            near[w] |= {x for x in same | ({a + b} & n.keys()) if is_near(w, x)}
    out = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        out[w] = (n[w], len(near[w]), best) if best is not None and n[best] >= times * n[w] else (n[w], len(near[w]), None)
    rows = set()
    for w, (c, k, form) in out.items():
        end = w
        while out[end][2] is not None:
            end = out[end][2]
        rows.add((w, c, k, form, n[form] if form else None, end))
    return rows


def got(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_subtries(monkeypatch):
    rng = random.Random(1)
    for _ in range(300):
        monkeypatch.setattr(spelling, "FEW_LEVELS", rng.choice([0, 1, 2, 3, 5, 24]))
        letters = rng.choice(["ab", "abc", "abé"])
        d = rng.randint(0, 1)
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([4, 7, 9])))) for _ in range(rng.randint(1, 60))}
        rows = sorted((w[:d], w) for w in words)
        rests = [w[len(r) :].encode("latin-1") for r, w in rows]
        length = np.array([len(x) for x in rests])
        root = np.cumsum([i == 0 or rows[i][0] != rows[i - 1][0] for i in range(len(rows))]) - 1
        a, b = spelling.near_pairs(np.frombuffer(b"".join(rests), np.uint8), np.cumsum(length) - length, length, root)
        found = sorted(tuple(sorted((rows[i][1], rows[j][1]))) for i, j in zip(a, b))
        assert found == sorted((x, y) for x in words for y in words if x < y and is_near(x, y) and x[:d] == y[:d])


@pytest.mark.parametrize("most", [1, 5, 40, 10_000])
def test_cut_into_subtries(spark, most):
    """However much of the trie is above the cut, each near word is counted once."""
    rng = random.Random(most)
    words = {"hotprefix" * rng.randint(0, 1) + "".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(300)}
    n = {w: rng.choice([2, 2, 3, 40, 500]) for w in words}
    found = {r["word"]: tuple(r)[1:] for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), most).collect()}
    want = {}
    for w in words:
        near = [x for x in words if is_near(w, x)]
        if near:
            best = min(near, key=lambda x: (-n[x], x))
            want[w] = (len(near), n[best], best)
    assert found == want


def test_chains_and_ties(spark):
    said = {"abcdefg": 1000, "abcdefgh": 100, "abcdefghi": 10, "bbcdefg": 1000, "cbcdefg": 30, "éèêëàâä": 40, "éèêëàâ÷": 4, "lonelyword": 2, "oncesaid": 1}
    text = " ".join(f"{w}," * c for w, c in said.items())
    rows = got(spelling.group_spellings(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")))
    assert rows == grouped({w: c for w, c in said.items() if c > 1})
    by = {r[0]: r for r in rows}
    assert by["abcdefghi"][3] == "abcdefgh" and by["abcdefghi"][5] == "abcdefg" and by["cbcdefg"][3] == "abcdefg" and by["lonelyword"][3:] == (None, None, "lonelyword")


def test_odd_documents(spark, odd_docs, none):
    long_run = "z" * 3000
    more = spark.createDataFrame([(11, long_run), (12, f"{long_run} {long_run}z y{long_run} {long_run}z y{long_run}"), (13, None)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more).selectExpr("*", "'x' as word", "1 as n", "'x' as root", "'x' as near")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(spelling.group_spellings(docs, slips=31)) == grouped(words_of(rows))
    assert got(spelling.group_spellings(none)) == set()


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    n = words_of([tuple(r) for r in docs])
    found = got(queries.op13_spelling_groups(spark, SF))
    assert found == grouped(n) and any(r[3] for r in found) and len(found) > 1000
