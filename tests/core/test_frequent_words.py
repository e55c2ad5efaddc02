"""Retrieval where words are in very many titles: the shown nodes as by scoring all pairs, of far fewer rows."""

from loomgraph.model import NODES
from loomgraph.operators import retrieve as rt

MOST = 5


def test_frequent_words(spark):
    titles = [f"Group {'of rings ' if i % 3 == 0 else ''}{'abelian ' if i % 4 == 0 else ''}number{i:04d}" for i in range(120)]
    nodes = [(f"n{i}", "Lemma", t, None, (None, None, f"lab{i}" if i % 50 == 7 else None, ["a.tex", f"s{i % 2}"]), None, (i * 7 % 120, 0)) for i, t in enumerate(titles)]
    asks = [(i, f"the group {'abelian' if i % 2 else 'of rings'} number{i * 9:04d}", ["a.tex", f"s{i % 3}"], f"\\ref{{lab{57 if i % 5 else 107}}}") for i in range(12)]
    chunks = spark.createDataFrame([(f"c{i}", "a.tex", title, path, text, i) for i, title, path, text in asks], "id string, file string, title string, section_path array<string>, text string, chunk_seq long")
    n, asked = rt.by_terms(spark.createDataFrame(nodes, NODES)), rt.queries(chunks)
    want = {}
    for q in asked.collect():
        scores = []
        for r in n.collect():
            s = 20 * (r["label"] in q["labels"]) + 2 * sum(w in r["t"] for w in q["words"])
            s += 3 * (r["end"] != "" and r["end"] == q["hint"])
            scores.append((-s, r["seq"]["major"], r["id"]))
        want[q["chunk_seq"]] = [(-s, i) for s, _, i in sorted(scores)[:MOST]]
    scored = rt.scored(spark.createDataFrame(nodes, NODES), asked, MOST).collect()
    got = {}
    for r in sorted(scored, key=lambda r: (-r["score"], r["seq"]["major"])):
        got.setdefault(r["chunk_seq"], []).append((r["score"], r["id"]))
    assert {k: v[:MOST] for k, v in got.items()} == want
    assert len(scored) < 120 * 12 // 2  # every title has the word group, every chunk asks for it
