"""Turtle: the grammar's forms, and files cut anywhere into splits and pieces."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import graph_files as gf
from loomgraph.sources import turtle
from loomgraph.sources.turtle import RDF, parse_turtle

E = "http://e/"


def test_forms():
    text = """@base <http://e/> . PREFIX k: <http://k/> # a note . with [ marks
    <a> a k:T ; k:p 'one', "two"@en-GB, "3"^^<http://x#int>, -4.5e1, 6, true ;; .
    _:b1 k:q [ k:r ( 1 "x" k:z.y ) ; k:s _:b1 ] .
    [ k:t <#frag> ] . <u\\u00e9> k:l \"\"\"long
    "quoted" . [ ( \"\"\" , '''it's''' , () . k:a\\~b k:v <urn:x:y> ."""
    d = [(s.removeprefix(E), p, o) for s, p, o, _ in parse_turtle(text)]
    assert d[:7] == [("a", RDF + "type", "http://k/T")] + [("a", "http://k/p", o) for o in ("one", "two", "3", "-4.5e1", "6", "true")]
    lists = [(p.removeprefix(RDF), o) for s, p, o, _ in parse_turtle(text) if p.startswith(RDF) and "#rest" in p or "#first" in p]
    assert [o for p, o in lists if p == "first"] == ["1", "x", "http://k/z.y"] and ("rest", RDF + "nil") in lists
    assert ("_:b1", "http://k/q") in {(s, p) for s, p, _ in d} and any(p == "http://k/s" and o == "_:b1" for _, p, o in d)
    assert [o for _, p, o in d if p == "http://k/t"] == ["http://e/#frag"]
    assert [(s, o) for s, p, o in d if p == "http://k/l"] == [("u\u00e9", 'long\n    "quoted" . [ ( '), ("u\u00e9", "it's"), ("u\u00e9", RDF + "nil")]
    assert d[-1] == ("http://k/a~b", "http://k/v", "urn:x:y")


@pytest.mark.parametrize("text", ["? ? ?", "<a> <b>", "x:a <b> <c> .", '"s" <p> <o> .', "<a> _:b <c> .", "<a> <b> [ <c> <d> .", "<a> <b> <c> . ."])
def test_what_is_not_turtle(text):
    with pytest.raises(ValueError):
        parse_turtle(text)


def document(seed, n=120):
    rng = random.Random(seed)
    words = ["x", 'say "hi"', "dot .", "[ (", "# no note", "@prefix z: <http://no/> .", "'''", "\u00e9"]
    out = ["@prefix k: <http://k/> .", "@prefix n: <http://one/> ."]
    for i in range(n):
        kind = rng.randrange(7)
        said = "\n".join(rng.choice(words) for _ in range(rng.randint(1, 5))).replace('"', '\\"')
        if kind == 0:
            out.append(f'k:s{i} k:text """{said}""" ; # end .\n k:more 5. ')
        elif kind == 1:
            out.append(f"k:s{i} k:list ( 1\n 2 [ k:in\n k:out ; k:and _:b{i % 3} ]\n) .")
        elif kind == 2:
            out.append(f"k:s{i} k:a k:b . k:s{i} k:c k:d . k:s{i}\nk:e k:f")
            out.append(".")
        elif kind == 3:
            out.append(f"PREFIX n: <http://{rng.randrange(5)}/>")
        elif kind == 4:
            out.append(f"n:s{i} k:has '''{said.replace(chr(39), chr(96))}''' .")
        else:
            out.append(f"k:s{i} k:to n:t{i} .")
    return "\n".join(out) + "\n"


def plain(t):
    """Without the names of blank nodes."""
    return [tuple("_" if isinstance(x, str) and x.startswith("_:") else x for x in r) for r in t]


@pytest.mark.parametrize("split,size", [("100b", 50), ("700b", 1), ("64m", 1 << 18)])
def test_files_in_splits(spark, tmp_path, split, size):
    """However files are cut, their triples are those of each parsed whole, in order."""
    want = []
    for i in range(3):
        (tmp_path / f"d{i}.ttl").write_text(document(i))
        want += parse_turtle(document(i))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = turtle.triples_of_files(spark, str(tmp_path), size)
        rows = [tuple(r)[:4] for r in got.orderBy("place").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert plain(rows) == plain(want)
    blanks = lambda t: [len({x for r in t for x in r if isinstance(x, str) and x.startswith("_:")})]
    assert blanks(rows)[0] == sum(blanks(parse_turtle(document(i)))[0] for i in range(3))  # names of documents don't meet


def test_order_of_documents(spark, tmp_path):
    """Of values in several documents the last document's wins, and nodes stand by their first."""
    node = lambda i, title: f'{{"id": "{i}", "type": "Lemma", "title": "{title}"}}'
    docs = [("b", f'{{"nodes": [{node("x", "late")}, {node("y", "y")}], "edges": []}}'), ("a", f'{{"nodes": [{node("z", "z")}, {node("x", "early")}], "edges": []}}')]
    g = gf.from_json(spark.createDataFrame(docs, "doc string, value string"))
    assert [(r["id"], r["title"], tuple(r["seq"])) for r in g.nodes.orderBy("seq").collect()] == [("z", "z", (0, 0)), ("x", "early", (0, 1)), ("x", "late", (1, 0)), ("y", "y", (1, 1))]
    line = lambda i, title: f'<{gf.BASE}node:{i}> <{gf.RDFS}label> "{title}" . _:b <{gf.RDFS}label> "not a node" .'
    ttl = [(2, line("x", "late")), (1, line("z", "z") + "\n" + line("x", "early"))]
    t = gf.from_turtle(spark.createDataFrame(ttl, "doc int, value string"))
    assert [(r["id"], r["title"], tuple(r["seq"])) for r in t.nodes.orderBy("seq").collect()] == [("z", "z", (0, 0)), ("x", "late", (0, 2))]
    assert t.nodes.filter(F.col("id").startswith("_")).isEmpty()


def test_simple_statements_make_no_tokens(monkeypatch):
    """Statements of one triple with IRIs in full are taken whole, with their escapes and under a base; others go by tokens as before."""
    simple = '<http://a/s> <http://a/p> "say \\"x\\" .\\n" .\n<http://a/s> <http://a/p\\u0041> <http://a/o> .\n<http://a/s> <http://a/p> "" .'
    by_tokens = turtle.parse_turtle("<> <u:p> 5 .\n" + simple)[1:]
    assert turtle.parse_turtle(simple + "\n<> <u:p> 5 .") == [*by_tokens, ("", "u:p", "5", True)]
    assert turtle.Statements("<s> <u:p> <o> .", base="http://b/").out == [("http://b/s", "u:p", "http://b/o", False)]
    for line in simple.split("\n"):
        assert turtle.over_line(line, "") == ("", 0, True) and turtle.over_line(line, '"""') == ('"""', 0, False)
    monkeypatch.setattr(turtle, "_TOKEN", None)
    assert turtle.parse_turtle(simple) == by_tokens


def test_rows_are_small(spark, tmp_path):
    """What readers and Arrow take at once, thousands of rows, is small, and nothing is lost between pieces."""
    text = "@prefix k: <http://k/> .\n" + "".join(f'<http://k/s{i}> <http://k/p> "value {i}" .\n' for i in range(20_000))
    (tmp_path / "d.ttl").write_text(text)
    made = sorted((r["major"], r["text"]) for r in turtle.pieces(spark, str(tmp_path)).collect())
    assert "\n".join(t for _, t in made) + "\n" == text and made[0][0] == 0
    assert max(len(t) for _, t in made) * spark._jvm.org.apache.spark.sql.internal.SQLConf.get().arrowMaxRecordsPerBatch() < 1 << 26


def test_long_statements_are_cut(monkeypatch):
    """A statement without an end in sight is held up to LONG bytes alone; its rows join to what they were cut from."""
    monkeypatch.setattr(turtle, "LONG", 30)
    lines = ["<a> <b> <c> .", "<a> <b> <c> .", '<a> <b> """x', *["no . end"] * 9, '""" .', "<a> <b> <c> .", "<a> <b> (", "<c>"]
    cut = turtle.Cut(1000)
    rows = [r for i, line in enumerate(lines) for r in cut.push(i, line)] + cut.end()
    assert "\n".join(t for _, t, _ in rows) == "\n".join(lines) and max(len(t) for _, t, _ in rows) < 60
    assert [k for _, _, k in rows] == ["head", "whole", "open", "all", "all", "head", "whole", "open"]
    assert [n for n, _, _ in rows] == [0, 1, 2, 4, 8, 12, 13, 14]
