"""Cases traced by hand: segmentation, comments, windows, extraction, pruning, freezing, scores, views, upserts, filters."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.text import WS, display_math, trim, uri_component, uri_decode
from loomgraph.model import EDGES, NODES, Graph, Selection
from loomgraph.operators import extract, graph as g, normalize, retrieve, segment

A = "preamble % c\n\\chapter{Intro}\n\\section{Groups}\ntext 50\\% done % drop\n\\subsection{Def}\nx\n\\section{Rings}\ny"


def files(spark, *contents):
    return spark.createDataFrame([(f"{chr(97 + i)}.tex", c, i) for i, c in enumerate(contents)], "path string, content string, file_seq long")


def nodes(spark, rows):
    full = []
    for i, r in enumerate(rows):
        label = r.get("label")
        source = (r.get("file"), None, label, r.get("path")) if label or r.get("path") or r.get("file") else None
        full.append((r["id"], r["type"], r.get("title", r["id"]), r.get("content"), source, r.get("meta"), (r.get("seq", i), 0)))
    return spark.createDataFrame(full, NODES)


def edges(spark, rows):
    return spark.createDataFrame([(None, t, s, o, (rest or [None])[0], rest[1] if len(rest) > 1 else None, (i, 0)) for i, (s, t, o, *rest) in enumerate(rows)], EDGES)


def test_segmentation(spark):
    got = segment.chunk_files(files(spark, A, "\\section{Z}\nz")).orderBy("chunk_seq").collect()
    assert [(r["id"], r["title"], r["section_path"]) for r in got] == [
        ("chunk:a.tex:0", "a.tex", ["a.tex"]),
        ("chunk:a.tex:1", "Intro", ["a.tex", "Intro"]),
        ("chunk:a.tex:2", "Groups", ["a.tex", "Intro", "Groups"]),
        ("chunk:a.tex:3", "Rings", ["a.tex", "Intro", "Rings"]),
        ("chunk:b.tex:4", "Z", ["b.tex", "Z"]),
    ]
    assert got[2]["text"] == "\\section{Groups}\ntext 50\\% done \n\\subsection{Def}\nx"
    shown = segment.preview_titles(segment.chunk_files(files(spark, A))).orderBy("place").collect()
    assert [(r["total"], r["title"]) for r in shown] == [(4, t) for t in ("a.tex", "Intro", "Intro / Groups", "Intro / Rings")]


def stack_brute(lines, wanted):
    """The chunks of one file, from a stack of headings."""
    import re

    levels = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 5}
    stack, out, last = [], [], None
    for line in lines:
        m = re.match(r"\\(chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{(.+?)\}\s*$", line)
        if m:
            level = levels[m[1]]
            stack = [h for h in stack if h[0] < level] + [(level, m[2])]
        exact = [h for h in stack if h[0] == wanted] or [h for h in stack if h[0] < wanted][-1:]
        level = exact[0][0] if exact and wanted else 0
        key = (level, [t for n, t in stack if n <= level])
        if key != last:
            out.append((key, []))
        last = key
        out[-1][1].append(line)
    return [(k[1], "\n".join(t).strip()) for k, t in out if "\n".join(t).strip()]


@pytest.mark.parametrize("granularity", list(segment.GRANULARITIES))
def test_segmentation_against_a_stack(spark, granularity):
    import random

    rng = random.Random(granularity)
    texts = []
    for _ in range(12):
        texts.append([rng.choice(["\\chapter{A}", "\\section{B}", "\\section{C}", "\\subsection*{D}", "\\subsubsection{E}", "\\paragraph{F}", "\\subparagraph{G}", "x", "", "y z", " \\section{no}"]) for _ in range(40)])
    got = segment.chunk_files(files(spark, *["\n".join(t) for t in texts]), granularity).orderBy("chunk_seq").collect()
    want = [(chr(97 + i), p, t) for i, lines in enumerate(texts) for p, t in stack_brute(lines, segment.GRANULARITIES[granularity])]
    assert [(r["file"][0], r["section_path"][1:], r["text"]) for r in got] == want
    assert [r["id"].rsplit(":", 1)[1] for r in got] == [str(i) for i in range(len(want))]


def test_comments(spark):
    cases = {"a\\%b % c": "a\\%b ", "a\\\\% c": "a\\\\", "none\\": "none\\", "%all": "", "x % c\r": "x ", "a\n%b\nc\\%%d": "a\n\nc\\%"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert df.withColumn("got", segment.strip_comments(F.col("t"))).filter("not got <=> want").count() == 0


def test_windows(spark):
    c = spark.createDataFrame([("X", "f", "t", ["f"], "a b c d e f g", 0), ("Y", "f", "t", ["f"], "a b c d", 1 << 16)], "id string, file string, title string, section_path array<string>, text string, chunk_seq long")
    got = segment.split_windows(c, 4).orderBy("chunk_seq").collect()
    assert [(r["id"], r["text"]) for r in got] == [("X:w0", "a b c d"), ("X:w1", "c d e f"), ("X:w2", "e f g"), ("Y", "a b c d")]
    assert segment.split_windows(c, 0).count() == 2
    n = spark.range(1, 40).selectExpr("'i' id", "'f' file", "'t' title", "array('f') section_path", "array_join(transform(sequence(1, id), x -> concat('w', x)), ' ') text", "id * 65536 chunk_seq")
    for size in range(1, 12):
        for r in segment.split_windows(n, size).groupBy(F.expr("chunk_seq >> 16").alias("n")).agg(F.count("*").alias("k")).collect():
            stride, starts = max(1, size // 2), 0
            if r["n"] > size:
                for s in range(0, r["n"], stride):
                    starts += 1
                    if s + size >= r["n"]:
                        break
            assert r["k"] == max(1, starts)


G4 = "\\begin{definition}[Group]\\label{def:g} A set. \\end{definition}\n\\begin{example} uses \\ref{def:g} $$ab$$ \\end{example}\n\\[ x_1 = 2 \\]"


def chunk_of(spark, *texts):
    return spark.createDataFrame([(f"chunk:a.tex:{i}", "a.tex", "S", ["a.tex", "S"], t, i << 16) for i, t in enumerate(texts)], "id string, file string, title string, section_path array<string>, text string, chunk_seq long")


def test_extraction(spark):
    made = extract.extract(chunk_of(spark, G4))
    assert [(r["id"], r["type"], r["title"], r["content"]) for r in made.nodes.orderBy("seq").collect()] == [
        ("sec:a.tex / S", "Conclusion", "S", ""),
        ("tex:def:g", "Definition", "Group", "[Group]\\label{def:g} A set."),
        ("chunk:a.tex:0:example:1", "Example", "Example 2", "uses \\ref{def:g} $$ab$$"),
        ("chunk:a.tex:0:formula:0", "Formula", "Formula 1", "x_1 = 2"),
    ]
    example, formula, section = "chunk:a.tex:0:example:1", "chunk:a.tex:0:formula:0", "sec:a.tex / S"
    got = made.edges.orderBy("seq").collect()
    assert [(r["type"], r["source"], r["target"], r["evidence"]) for r in got] == [
        ("AssistsIn", example, "tex:def:g", None),
        ("Contains", section, "tex:def:g", None),
        ("Contains", section, example, None),
        ("Contains", section, formula, None),
        ("DependsOn", example, "tex:def:g", "reference: def:g"),
        ("DependsOn", formula, "tex:def:g", "reference: def:g"),
    ]
    assert all(r["meta"] == {"chunkId": "chunk:a.tex:0"} for r in got)


def test_labels_are_known_from_their_chunk_on(spark):
    early, late = "\\begin{lemma} by \\ref{x} \\end{lemma}", "\\begin{theorem}\\label{x} t \\end{theorem} Derived  from \\ref{x}. \\begin{exercise} e \\begin{solution} s \\end{solution} \\begin{answer} a \\end{answer} \\end{exercise}"
    seen = extract.extract(chunk_of(spark, early, late)).edges
    assert seen.filter("type = 'DependsOn' and source like 'chunk:a.tex:0%'").count() == 0
    everywhere = extract.extract(chunk_of(spark, early, late), label_scope="global").edges
    assert everywhere.filter("type = 'DependsOn' and source like 'chunk:a.tex:0%'").count() == 1
    derived = seen.filter("type = 'DerivedFrom'").collect()
    assert [(r["source"], r["evidence"]) for r in derived] == [("chunk:a.tex:1:exercise:1", "Derived  from \\ref{x}")]
    assert seen.filter("type = 'AppliesTo'").count() == 1
    meta = extract.extract(chunk_of(spark, early, late)).nodes.filter("type = 'Exercise'").first()["meta"]
    assert meta == {"problem": "e", "solution": "s", "answer": "a"}
    few = extract.extract(chunk_of(spark, early, late), Selection(entities=("Theorem",), relations=("Contains",)))
    assert few.nodes.count() == 1 and few.edges.count() == 0


def test_worked_marks(spark):
    cases = [("p\n解答：\ns\n答案\na", ("p", "解答：\ns", "答案\na")), ("p\n答案:\na\n证明\ns", ("p", "证明\ns", "答案:\na\n证明\ns")), ("plain", None), ("", None)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c string").withColumn("p", extract.split_worked(F.col("c")))
    got = {r["c"]: tuple(r["p"]) if r["p"] else None for r in df.collect()}
    assert got == dict(cases)


def test_formula_numbers(spark):
    text = "\\begin{align}\\label{q} y \\end{align} $$u$$ \\begin{equation}v\\end{equation} $$ $$ \\[w\\]"
    got = extract.extract(chunk_of(spark, text)).nodes.filter("type = 'Formula'").orderBy("seq").collect()
    c = "chunk:a.tex:0:formula:"
    assert [(r["id"], r["title"], r["content"]) for r in got] == [(c + "0", "Formula 1", "v"), ("tex:q", "Formula (q)", "\\label{q} y"), (c + "1", "Formula 2", "u"), (c + "2", "Formula 3", "w")]


def test_prune(spark):
    made = extract.extract(chunk_of(spark, G4))
    assert g.prune_stats(made) == {"dropped_nodes": [], "dropped_edges": 0}
    fewer = Graph(made.nodes, made.edges.filter("not (type = 'DependsOn' and source like '%formula%')"))
    assert g.prune_stats(fewer) == {"dropped_nodes": ["chunk:a.tex:0:formula:0"], "dropped_edges": 1}
    cases = {"f_X(x)": True, "\\pi(x)": True, "f(x)": False, "P(X = x) = p(": True, "P\\left( X = x \\right) = p\\left(": True, "-\\infty < x < \\infty": True, "xf_X(x)": False}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want boolean")
    assert df.filter(g.is_template(F.col("t")) != F.col("want")).count() == 0
    long = "x_1 " + "y" * 200
    kept = Graph(nodes(spark, [{"id": "f", "type": "Formula", "content": long, "title": "t"}, {"id": "h", "type": "Formula", "content": "z" * 200 + "\\Omega_{5}"}, {"id": "tex:k", "type": "Formula", "content": "s"}]), edges(spark, []))
    assert g.prune_stats(kept)["dropped_nodes"] == ["h"]


def test_freeze(spark):
    rows = [{"id": "c1", "type": "Definition", "title": "Grp", "content": "x", "label": "g"}, {"id": "tex:g", "type": "Definition", "title": "Group", "content": "xy"}, {"id": "c2", "type": "Notation", "title": "G"}]
    e = edges(spark, [("c2", "EquivalentTo", "c1"), ("c1", "DependsOn", "tex:g")])
    frozen, alias = g.freeze(Graph(nodes(spark, rows), e))
    got = frozen.nodes.collect()
    assert [(r["id"], r["type"], r["title"], r["content"]) for r in got] == [("tex:g", "Notation", "Group", "xy")] and frozen.edges.count() == 0
    assert {r["id"]: r["canonical"] for r in alias.collect()} == {i: "tex:g" for i in ("c1", "c2", "tex:g")}
    frozen, alias = g.freeze(Graph(nodes(spark, [rows[0], rows[2]]), e))
    assert {r["id"]: r["canonical"] for r in alias.collect()} == {"c1": "c1", "c2": "c1"}
    later = g.apply_alias(Graph(nodes(spark, [{"id": "n", "type": "Lemma", "label": "g"}, {"id": "c2", "type": "Lemma"}]), edges(spark, [("c2", "Uses", "n"), ("c2", "Uses", "c1")])), alias)
    assert {r["id"] for r in later.nodes.collect()} == {"tex:g", "c1"} and [(r["source"], r["target"]) for r in later.edges.collect()] == [("c1", "n")]


def test_relevance(spark):
    chunk = spark.createDataFrame([("c", "a.tex", "S", ["a.tex", "S"], "\\ref{thm:a} rings", 0)], "id string, file string, title string, section_path array<string>, text string, chunk_seq long")
    q = retrieve.queries(chunk).first()
    assert q["labels"] == ["thm:a"] and q["words"] == ["rings"]
    n = nodes(spark, [{"id": "tex:thm:a", "type": "Theorem", "title": "Rings", "label": "thm:a", "path": ["a.tex", "S"]}, {"id": "z", "type": "Lemma", "title": "other"}])
    assert [(r["id"], r["score"]) for r in retrieve.scored(n, retrieve.queries(chunk)).collect()] == [("tex:thm:a", 45)]
    e = edges(spark, [("z", "Uses", "tex:thm:a"), ("z", "Uses", "q")])
    shown = retrieve.shown_nodes(Graph(n, e), chunk, 1)
    assert [r["id"] for r in shown.collect()] == ["tex:thm:a"] and retrieve.shown_edges(Graph(n, e), shown).count() == 1
    text = retrieve.summaries(Graph(n, e), chunk).first()["summary"]
    assert text == "nodes(2) showing 2:\n- tex:thm:a | Theorem | Rings label=thm:a sec=a.tex/S\n- z | Lemma | other\n\nedges(2) showing 2:\n- (Uses) z -> tex:thm:a\n- (Uses) z -> q"


def test_views(spark):
    graph = Graph(nodes(spark, [{"id": "E", "type": "Example"}, {"id": "T", "type": "Theorem"}, {"id": "D", "type": "Definition"}]), edges(spark, [("E", "AssistsIn", "T"), ("X", "Uses", "Y")]))
    ids = lambda v: (sorted(r["id"] for r in v.nodes.collect()), v.edges.count())
    assert ids(g.view(graph, show_examples=False)) == (["D", "T"], 0)
    assert ids(g.view(graph, show_examples=False, show_isolated=False)) == ([], 0)
    assert ids(g.view(graph)) == (["D", "E", "T"], 2)
    once = g.view(graph, show_isolated=False)
    assert ids(once) == ids(g.view(once, show_isolated=False)) == (["E", "T"], 1)


def test_upserts(spark):
    old = Graph(nodes(spark, [{"id": "n1", "type": "Lemma", "title": "A", "content": "c", "meta": {"a": "1"}}, {"id": "n2", "type": "Lemma"}]), edges(spark, [("s", "Uses", "t", None, {"chunkId": "k1"})]))
    new = Graph(nodes(spark, [{"id": "n1", "type": "Lemma", "title": "B", "meta": {"b": "2"}}, {"id": "n3", "type": "Lemma"}]), edges(spark, [("s", "Uses", "t", "e", {"chunkId": "k2"}), ("s", "Uses", "t"), ("s", "Uses", "t", "w")]))
    merged = g.merge_graphs(old, new)
    rows = merged.nodes.orderBy("seq").collect()
    assert [r["id"] for r in rows] == ["n1", "n2", "n3"] and (rows[0]["title"], rows[0]["content"], rows[0]["meta"]) == ("B", "c", {"a": "1", "b": "2"})
    assert sorted((r["meta"] or {}).get("chunkId", "") + (r["evidence"] or "") for r in merged.edges.collect()) == ["k1", "k2e", "w"]
    assert g.merge_graphs(old, new, null_overwrites=True).nodes.filter("id = 'n1'").first()["content"] is None
    again = {r["id"]: (r["title"], r["content"], r["meta"]) for r in g.merge_graphs(merged, merged).nodes.collect()}
    assert again == {r["id"]: (r["title"], r["content"], r["meta"]) for r in rows}
    patched = g.patch_nodes(old.nodes, spark.createDataFrame([("n1", "P", None, {"a": "9"}), ("zz", "Q", None, None)], "id string, title string, content string, meta map<string,string>"))
    assert [(r["title"], r["content"], r["meta"]) for r in patched.orderBy("seq").collect()] == [("P", "c", {"a": "9"}), ("n2", None, None)]


def test_filters(spark):
    chunk = chunk_of(spark, "some text a = b")
    rows = [
        {"id": "t3", "type": "Theorem", "title": "Theorem 3", "content": "short", "seq": 0},
        {"id": "t4", "type": "Theorem", "title": "Theorem 3", "content": "short", "label": "l", "seq": 0},
        {"id": "f1", "type": "Formula", "title": "F", "content": "hello", "seq": 0},
        {"id": "f2", "type": "Formula", "title": "F", "content": "a = b", "seq": 0},
        {"id": "f3", "type": "Formula", "title": "F", "label": "l2", "seq": 0},
    ]
    e = spark.createDataFrame([(None, "Uses", s, t, None, None, (0, i)) for i, (s, t) in enumerate([("t4", "f2"), ("t3", "f2"), ("t4", "old"), ("t4", "none")])], EDGES)
    kept, said = normalize.filtered(Graph(nodes(spark, rows), e), chunk, existing=nodes(spark, [{"id": "old", "type": "Lemma"}]))
    assert {r["id"] for r in kept.nodes.collect()} == {"t4", "f2", "f3"} and {r["target"] for r in kept.edges.collect()} == {"f2", "old"}
    assert "dropped 2 dangling edges" in {r["warning"] for r in said.collect()} and said.count() == 3


def test_normal_form(spark):
    text = '{"nodes": [{"id": "a", "type": "T", "title": "x", "content": 3, "source": {"file": "f", "latexLabel": null, "sectionPath": ["p"]}, "meta": {"k": "v", "n": 0.5}}, {"id": 1, "type": "T", "title": "x"}, null], "edges": [{"type": "Uses", "source": "a", "target": "b", "id": "z"}, {"type": "Uses", "source": "a", "target": "a"}, {"type": "Uses", "source": "a"}]}'
    made = normalize.normalized(spark.createDataFrame([(0, text), (1, "no json"), (2, "[]"), (3, None)], "chunk_seq long, response string"))
    got = made.nodes.collect()
    assert len(got) == 1 and got[0]["content"] is None and got[0]["source"]["sectionPath"] == ["p"] and got[0]["meta"] == {"k": "v", "n": "0.5"}
    assert [(r["id"], r["source"], r["target"]) for r in made.edges.collect()] == [(None, "a", "b")]
    assert normalize.normalized(spark.createDataFrame([(0, text)], "chunk_seq long, response string"), strict=True).nodes.count() == 0


def test_completion(spark):
    body = "\\begin{align*}\\label{q} a = b \\end{align*} and the proof goes on for long until it is done here"
    chunk = chunk_of(spark, body)
    rows = [{"id": "tex:q", "type": "Formula", "title": "formula", "content": "…", "seq": 0}, {"id": "p", "type": "Lemma", "title": "P", "content": "the proof goes ... it is done here", "seq": 0}, {"id": "k", "type": "Lemma", "title": "K", "content": "long enough content to be kept", "label": "none", "seq": 0}]
    got = {r["id"]: (r["title"], r["content"]) for r in normalize.completed(Graph(nodes(spark, rows), edges(spark, [])), chunk).nodes.collect()}
    assert got["tex:q"] == ("Formula (q)", "\\label{q} a = b") and got["p"][1] == body[body.index("the proof") :] and got["k"][1] == rows[2]["content"]


def test_text(spark):
    df = spark.createDataFrame([("\u00a0\ufeff a b\u3000\n",), ("a+b c/é~'()!*%41",)], "t string")
    got = [r[0] for r in df.select(trim(F.col("t"))).collect()]
    assert got[0] == "a b"
    assert df.select(uri_component(F.col("t"))).collect()[1][0] == "a%2Bb%20c%2F%C3%A9~'()!*%2541"
    assert df.filter(uri_decode(uri_component(F.col("t"))) != F.col("t")).count() == 0
    assert [r[0] for r in spark.createDataFrame([(" x ",), ("$$y$$",), ("\\[z\\]",), ("",)], "t string").select(display_math(F.col("t"))).collect()] == ["$$\nx\n$$", "$$y$$", "\\[z\\]", ""]
    assert "\\u3000" in WS
