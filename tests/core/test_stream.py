"""Streams, increments, snapshots, files and model-backed runs."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.model import CHUNKS, EDGES, NODES, Graph, ModelConfig, Selection
from loomgraph.operators import align, extract, graph as g, repair
from loomgraph.plans import extractors, pipeline, snapshots
from loomgraph.plans.snapshots import SnapshotStore
from loomgraph.sources import graph_files as gf
from loomgraph.streaming.commits import CommitLog
from loomgraph.streaming.ingest import GraphTable, extract_stream, upsert_stream, with_number


def increments(spark):
    nodes = [(f"n{i % 4}", f"T{i % 3}", f"t{i}", f"c{i}" if i % 3 == 0 else None, ("f", i, None, None) if i % 5 == 0 else None, {f"k{i % 2}": f"v{i}"} if i % 2 else None, (i, 0)) for i in range(40)]
    edges = [(None, "Uses", f"n{i % 2}", "m", f"e{i}" if i % 3 else None, {"chunkId": f"c{i % 3}", "x": str(i)} if i % 4 else {"y": str(i)}, (i, 0)) for i in range(40)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def rows(df):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect()))


@pytest.mark.parametrize("order", [1, -1, 7])
def test_any_order_of_batches(spark, tmp_path, order):
    inc = increments(spark)
    table = GraphTable(spark, str(tmp_path / f"g{order}"), fan=2)
    parts = [i * order % 10 for i in range(10)]
    for v, part in enumerate(parts[:5]):
        mine = lambda df: df.filter((F.col("seq.major") % 10 == part) | (F.col("seq.major") % 10 == (part + 5) % 10))
        table.upsert(Graph(mine(inc.nodes), mine(inc.edges)), v)
        table.upsert(Graph(mine(inc.nodes), mine(inc.edges)), v)
    seen = {(part + k) % 10 for part in parts[:5] for k in (0, 5)}
    own = lambda df: df.filter((F.col("seq.major") % 10).isin(*seen))
    got = table.read()
    assert rows(got.nodes) == rows(g.upsert_nodes(own(inc.nodes))) and rows(got.edges) == rows(g.upsert_edges(own(inc.edges)))
    assert [r["tier"] for r in table.runs()] == [2, 0] and table.batches() == {"": [[0, 4]]}


def test_sources_do_not_meet(spark, tmp_path):
    """Batch 5 of one checkpoint, then batches 0 and 5 of another: all three are in, and stay in through merges."""
    inc = increments(spark)
    part = lambda k: Graph(inc.nodes.filter(F.col("seq.major") % 3 == k), inc.edges.filter(F.col("seq.major") % 3 == k))
    table = GraphTable(spark, str(tmp_path / "g"), fan=3)
    for k, (batch, source) in enumerate([(5, "a"), (0, "b"), (5, "b")]):
        table.upsert(part(k), batch, source)
        table.upsert(part((k + 1) % 3), batch, source)  # a batch that is in is left out, whatever it holds now
    assert rows(table.read().nodes) == rows(g.upsert_nodes(inc.nodes)) and rows(table.read().edges) == rows(g.upsert_edges(inc.edges))
    assert len(table.runs()) == 1 and table.batches() == {"a": [[5, 5]], "b": [[0, 0], [5, 5]]}


def test_commits_of_two_writers(spark, tmp_path):
    """A writer whose number is taken starts again from the state that took it."""
    a, b = CommitLog(spark, str(tmp_path / "log")), CommitLog(spark, str(tmp_path / "log"))
    met = []

    def slow(state):
        if not met:
            met.append(b.commit(lambda s: {**s, "b": 1}))
        return {**state, "a": 1}

    assert a.commit(slow) == {"a": 1, "b": 1} and b.state() == (1, {"a": 1, "b": 1})
    assert a.commit(lambda s: None) == {"a": 1, "b": 1} and a.numbers() == [0, 1]
    for i in range(30):
        a.commit(lambda s, i=i: {"i": i})
    assert b.state() == (31, {"i": 29}) and len(b.numbers()) == 20


def test_ranges():
    out = []
    for n in (5, 3, 4, 9, 0, 4, 1):
        out = with_number(out, n)
    assert out == [[0, 1], [3, 5], [9, 9]]


def test_streams(spark, tmp_path):
    inc = increments(spark)
    inc.nodes.repartition(4).write.parquet(str(tmp_path / "in"))
    table = GraphTable(spark, str(tmp_path / "graph"))
    stream = lambda: spark.readStream.schema(NODES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert_stream(stream(), table, lambda b, own: Graph(b, inc.edges.limit(0)), str(tmp_path / "check")).awaitTermination()
    assert rows(table.read().nodes) == rows(g.upsert_nodes(inc.nodes))
    more = inc.nodes.withColumn("id", F.concat(F.lit("more"), "id")).withColumn("seq", F.struct((F.col("seq.major") + 100).alias("major"), F.col("seq.minor").alias("minor")))
    more.write.parquet(str(tmp_path / "in2"))  # a second checkpoint starts at batch 0 again
    second = spark.readStream.schema(NODES).parquet(str(tmp_path / "in2"))
    for _ in range(2):
        upsert_stream(second, table, lambda b, own: Graph(b, inc.edges.limit(0)), str(tmp_path / "check3")).awaitTermination()
    assert len(table.batches()) == 2
    assert rows(table.read().nodes) == rows(g.upsert_nodes(inc.nodes.unionByName(more)))
    chunks = spark.createDataFrame([(f"chunk:a:{i}", "a", "A", ["a", "A"], f"\\begin{{lemma}}\\label{{l{i}}} x \\ref{{l0}} \\end{{lemma}}", i << 16) for i in range(3)], CHUNKS)
    for i in range(3):
        chunks.filter(f"chunk_seq = {i << 16}").coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    table = GraphTable(spark, str(tmp_path / "made"))
    extract_stream(spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "chunks")), table, str(tmp_path / "check2")).awaitTermination()
    whole = extract.extract(chunks)
    got = table.read()
    assert rows(got.nodes) == rows(whole.nodes) and rows(got.edges.drop("seq")) == rows(whole.edges.drop("seq"))


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "snaps"))
    assert store.list().count() == 0
    inc = increments(spark)
    graph = Graph(g.upsert_nodes(inc.nodes), g.upsert_edges(inc.edges))
    first = store.save(graph, note="a", model=ModelConfig(api_key="secret"))
    second = store.save(graph, Selection(notes="n"), {"show_examples": False})
    assert [r["id"] for r in store.list().collect()] == [second, first] and store.list().first()["nodes"] == 4
    loaded, settings = store.load(first)
    assert rows(loaded.nodes) == rows(graph.nodes) and "secret" not in json.dumps(settings) and settings["model"]["protocol"] == "openai"
    with pytest.raises(KeyError):
        store.load("none")
    store.keep_latest()
    kept = store.list().collect()
    assert len(kept) == 1 and kept[0]["nodes"] == 4 and rows(store.load(kept[0]["id"])[0].nodes) == rows(graph.nodes)
    store.clear()
    assert store.list().count() == 0


def test_snapshots_write_what_changed(spark, tmp_path, monkeypatch):
    """Rows that change, come, go and come again, and rows that are there twice: each snapshot loads as it was saved, and small changes are small."""
    monkeypatch.setattr(snapshots, "CHAIN", 3)
    store, saved = SnapshotStore(spark, str(tmp_path / "snaps")), []
    base = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("Lemma").alias("type"), F.sha2(F.col("id").cast("string"), 512).alias("title"), F.lit(None).cast("string").alias("content"), F.lit(None).cast(NODES["source"].dataType).alias("source"), F.create_map(F.lit("k"), F.lit("v")).alias("meta"), F.struct(F.col("id").alias("major"), F.lit(0).cast("long").alias("minor")).alias("seq"))
    edges = increments(spark).edges
    states = [base, base.filter("id <> 'n7'"), base.unionByName(base.limit(2)), base.withColumn("title", F.when(F.col("id") == "n9", "new").otherwise(F.col("title"))), base.limit(0), base]
    for nodes in states:
        saved.append(store.save(Graph(nodes, edges)))
    for name, nodes in zip(saved, states):
        got = store.load(name)[0]
        assert rows(got.nodes) == rows(nodes) and rows(got.edges) == rows(edges)
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / "snaps" / name / "nodes").glob("*.parquet"))
    changed = lambda name: spark.read.parquet(str(tmp_path / "snaps" / name / "nodes")).count()
    assert [changed(name) for name in saved] == [3000, 1, 3, 4, 0, 3000] and size(saved[1]) < size(saved[0]) / 10
    assert [json.loads(r["chain"]).index(r["id"]) for r in store.list().orderBy("createdAt").collect()] == [0, 1, 2, 3, 0, 1]


def test_files(spark, tmp_path):
    chunk = spark.createDataFrame([("chunk:a:0", "a b.tex", "S", ["a b.tex", "S"], "\\begin{theorem}[Ü \"q\" & <x>]\\label{t:1} line\n\\end{theorem} \\ref{t:1} \\begin{example} e \\end{example}", 0)], CHUNKS)
    graph = extract.extract(chunk)
    for name in ("g.json", "g.ttl"):
        path = str(tmp_path / name)
        gf.write_graph(graph, path)
        back = gf.read_graph(spark, path)
        if name == "g.json":
            assert rows(back.nodes.drop("seq")) == rows(graph.nodes.drop("seq")) and rows(back.edges.drop("seq")) == rows(graph.edges.drop("seq"))
            document = "\n".join(r["value"] for r in spark.read.text(path).collect())
            assert document.count("nodes") == 1
        else:
            assert rows(back.nodes.select("id", "type", "title")) == rows(graph.nodes.select("id", "type", "title"))
            assert rows(back.edges.select("source", "type", "target")) == rows(graph.edges.select("source", "type", "target"))
    gf.write_graph(graph, str(tmp_path / "g.owl"))
    import xml.etree.ElementTree as et

    text = "".join(p.read_text() for p in sorted((tmp_path / "g.owl").glob("part-*")))
    types = graph.nodes.select("type").distinct().count() + graph.edges.select("type").distinct().count()
    assert len(list(et.fromstring(text))) == 1 + types + graph.nodes.count() + graph.edges.count()
    assert json.loads(gf.to_json_text(graph))["version"] == 1
    with pytest.raises(ValueError):
        gf.read_graph(spark, str(tmp_path / "g.owl"))
    with pytest.raises(Exception, match="expected"):
        gf.from_json(spark.createDataFrame([('{"x": 1}',)], "value string")).nodes.collect()


def test_turtle_subset():
    text = '@prefix k: <https://example.org/latexkg#> .\n# note\n<https://example.org/latexkg#node:a> a k:Lemma ; k:content "x\\n\\"y\\"", """long "q" text""" .\nk:node:b k:Uses k:node:a .'
    b = gf.BASE
    assert gf.parse_turtle(text) == [(b + "node:a", gf.RDF + "type", b + "Lemma", False), (b + "node:a", b + "content", 'x\n"y"', True), (b + "node:a", b + "content", 'long "q" text', True), (b + "node:b", b + "Uses", b + "node:a", False)]
    with pytest.raises(ValueError):
        gf.parse_turtle("? ? ?")


def chunks_for_model(spark):
    return spark.createDataFrame([(f"chunk:a:{i}", "a", f"C{i}", ["a", f"C{i}"], f"text {i}", i << 16) for i in range(3)], CHUNKS)


def test_run_with_a_model(spark, tmp_path):
    def model(prompt):
        place = prompt.split("LaTeX:\ntext ")[1][0]
        if "Phase 1" in prompt:
            return json.dumps({"nodes": [{"id": f"d{place}", "type": "Definition", "title": f"Def {place}", "content": "the content of a definition"}], "edges": []})
        if place == "1":
            raise RuntimeError("no answer")
        return json.dumps({"nodes": [{"id": f"t{place}", "type": "Theorem", "title": "Main", "content": "x"}], "edges": [{"type": "Uses", "source": f"t{place}", "target": f"d{place}"}, {"type": "Uses", "source": f"t{place}", "target": "gone"}]})

    def same(cards):
        return cards.assign(alias=cards["id"], canonical="d0", confidence=0.95, reason="r")[["alias", "canonical", "confidence", "reason"]]

    run = pipeline.build_with_model(chunks_for_model(spark), model, config=ModelConfig(parallelism=2), aligner=same)
    assert {r["id"] for r in run.graph.nodes.collect()} == {"d0", "t0", "t2"}
    assert {(r["source"], r["target"]) for r in run.graph.edges.collect()} == {("t0", "d0")}  # d2 is an alias: not in the frozen graph that chunk 2 sees
    assert any("no answer" in w for w in run.warnings) and run.status == "done" and "in all" in run.message()
    stopped = pipeline.build_with_model(chunks_for_model(spark), model, cancelled=lambda: True)
    assert stopped.status == "stopped"
    ended = pipeline.build_with_model(chunks_for_model(spark), lambda p: (_ for _ in ()).throw(RuntimeError("no answer")))
    assert ended.status == "error" and "no answer" in ended.error


def test_services():
    assert extractors.answer_text("openai", {"choices": [{"message": {"content": "x"}}]}) == extractors.answer_text("openai", {"output": [{"content": [{"text": "x"}]}]}) == "x"
    assert extractors.answer_text("anthropic", {"content": [{"type": "other"}, {"type": "text", "text": "y"}]}) == "y"
    assert extractors.answer_text("gemini", {"candidates": [{"content": {"parts": [{"text": "z"}]}}]}) == "z"
    assert extractors.looks_like_html(" <!DOCTYPE html>") and not extractors.looks_like_html('{"a": 1}')
    with pytest.raises(ValueError, match="page"):
        extractors.answer_json("<html></html>")
    asked = []

    def post(path, body):
        asked.append(path)
        return json.dumps({"choices": [{"message": {"content": '{"nodes": []}'}}]}) if path == "chat/completions" else "<html>"

    assert json.loads(extractors.service(ModelConfig(), post)("p")) == {"nodes": []} and asked == ["responses", "chat/completions"]
    good = lambda path, body: json.dumps({"output_text": '{"nodes": [1]}'})
    assert json.loads(extractors.service(ModelConfig(), good)("p")) == {"nodes": [1]}
    with pytest.raises(ValueError, match="page"):
        extractors.service(ModelConfig(), lambda path, body: "<html>")("p")
    assert extractors.safe_text(lambda: 1 / 0) == "" and extractors.safe_text(lambda: "x") == "x"


def test_prompts_of_alignment_and_repair():
    cards = pd.DataFrame([("a", "Definition", "Group", "1", None), ("b", "Notation", "G", "2", "x")], columns=["id", "type", "title", "section", "evidence"])
    answer = {"decisions": [{"alias": "a", "canonical": "b", "confidence": 1}, {"alias": "a"}, 5]}
    got = align.prompted(lambda p: json.dumps(answer) if "title: Group" in p and "evidence: none" in p else "{}")(cards)
    assert got.values.tolist() == [["a", "b", 1.0, ""]]
    assert align.prompted(lambda p: "[]")(cards).empty
    assert repair.prompted(lambda p: json.dumps({"content": p.rsplit("\n", 1)[1] + "$"}))("$x") == "$x$"
    with pytest.raises(ValueError, match="no content"):
        repair.prompted(lambda p: '{"content": ""}')("$x")


def test_failures_end_the_run_with_what_was_committed(spark):
    chunks = spark.createDataFrame([("c0", "a.tex", "t", ["a.tex"], "x", 0)], "id string, file string, title string, section_path array<string>, text string, chunk_seq long")
    answer = '{"nodes": [{"id": "d", "type": "Definition", "title": "Group"}], "edges": []}'

    def broken(batch):
        raise ValueError("out of order")

    run = pipeline.build_with_model(chunks, lambda prompt: answer, aligner=broken)
    assert run.status == "error" and "out of order" in run.error and [r["id"] for r in run.graph.nodes.collect()] == ["d"]
    run = pipeline.build_with_model(chunks, broken)
    assert run.status == "error" and "phase 1" in run.error and run.graph.nodes.count() == 0


def test_build(spark):
    files = spark.createDataFrame([("a.tex", "\\section{A}\n\\begin{lemma} x \\end{lemma}\n$$y_1$$", 0)], "path string, content string, file_seq long")
    run = pipeline.build(files)
    assert {r["type"] for r in run.graph.nodes.collect()} == {"Conclusion", "Lemma"} and run.warnings == ["dropped 1 formulas as noise"]


def test_repair(spark):
    n = spark.createDataFrame([("a", "Formula", "t", "bad", None, None, (0, 0)), ("b", "Formula", "t", " ", None, None, (1, 0))], NODES)
    once = repair.repair(n, lambda c: c + "!")
    twice = {r["id"]: (r["content"], r["meta"]) for r in repair.repair(once, lambda c: c + "!").collect()}
    assert twice["a"] == ("bad!!", {"originalContent": "bad", "mathjaxFixed": "true"}) and twice["b"] == (" ", None)
    back = {r["id"]: (r["content"], r["meta"]) for r in repair.restore(once).collect()}
    assert back["a"] == ("bad", {"originalContent": "bad", "mathjaxFixed": "false"})
    assert align.label_rule(n).count() == 0


def test_answers_are_kept(spark, tmp_path):
    """A run that ends at its third call and is started anew asks for no answer twice, in either phase."""
    chunks, calls = chunks_for_model(spark), tmp_path / "calls"
    calls.mkdir()

    def model(broken):
        def ask(prompt):
            (calls / str(len(list(calls.iterdir())))).write_text(prompt)
            if broken and len(list(calls.iterdir())) == 2:
                raise RuntimeError("killed")
            return '{"nodes": [{"id": "d", "type": "Definition", "title": "D", "content": "c"}], "edges": []}'

        return ask

    keep = str(tmp_path / "answers")
    first = pipeline.build_with_model(chunks, model(True), answers=keep)
    assert first.status == "error" and len(list(calls.iterdir())) == 2
    second = pipeline.build_with_model(chunks, model(False), answers=keep)
    n = 2 * chunks.count()
    assert second.status == "done" and len(list(calls.iterdir())) == n + 1  # the failed call alone is made again
