import math

from loomgraph.llm import decontamination, mixing


def test_mixing(spark, odd_docs, none):
    docs = spark.range(30000).selectExpr("id as doc_id", "if(id % 3 = 0, 'big', concat('s', id % 20)) as source", "'t' as text")
    n = {r["source"]: r["n"] for r in docs.groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    got = {r["source"]: r["n"] for r in mixing.mix_sources(docs, weights={"big": 1.0, "s1": 3.0}).groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert set(got) == {"big", "s1"}
    assert abs(got["big"] / 7500 - 1) < 0.05 and abs(got["s1"] / 22500 - 1) < 0.05
    share = {s: v**0.7 for s, v in n.items()}
    mixed = mixing.mix_sources(docs).groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()
    assert all(abs(r["n"] / (30000 * share[r["source"]] / sum(share.values())) - 1) < 0.15 for r in mixed)
    odd = mixing.mix_sources(odd_docs)
    assert set(odd.columns) == {*odd_docs.columns, "mix_copy", "mix_copies", "mix_key"} and {r["parts"] for r in odd.collect()} <= {"x"}
    assert mixing.mix_sources(none).count() == 0


def test_counts_are_poisson(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "'a' as source")
    for total in (0.5, 3.0, 20.0):
        counts = [r["mix_copies"] for r in mixing.mix_sources(docs, total=total).select("doc_id", "mix_copies").distinct().collect()]
        missing = 1 - len(counts) / 20000
        assert abs(missing - math.exp(-total)) < 0.02 and abs(sum(counts) / 20000 / total - 1) < 0.05


def brute_leaks(docs, items):
    def runs(text, n=5):
        w = (text or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = set()
    for i in items:
        n = min(5, len((i["text"] or "").split()))
        own = runs(i["text"], n) if n else set()
        for d in docs:
            shared = len(own & runs(d["text"], n)) if n else 0
            if own and shared >= math.ceil(0.8 * len(own) - 1e-9) and d["doc_id"] is not None and i["item_id"] is not None:
                out.add((d["doc_id"], i["item_id"], shared))
    return out


def test_leaks(spark, odd_docs, none):
    words = [f"w{i}" for i in range(60)]
    long = [f"x{i}" for i in range(3000)]
    texts = [" ".join(long[:500] + words[:30] + long[500:]), " ".join(words[:27] + ["zz"] + words[28:30]), " ".join(words[:25]), " ".join(words[:23]), "w1 w2", "w1 w2 w3"]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    items = spark.createDataFrame([(0, " ".join(words[:30])), (1, " ".join(words)), (2, "W1  w2"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon zeta"), (None, "one"), (7, "one"), (7, "one")], "item_id long, text string")
    want = brute_leaks(docs.collect(), items.collect())
    for bound in (64 << 20, 0):
        got = {(r["doc_id"], r["item_id"], r["shared"]) for r in decontamination.leaks(docs, items, broadcast_bytes=bound).collect()}
        assert got == want and len(want) >= 8
    assert decontamination.leaks(none, items).count() == 0 and decontamination.leaks(docs, items.limit(0)).count() == 0
    left = decontamination.decontaminate(odd_docs, items)
    assert {r["doc_id"] for r in left.collect()} == {4, 5, 6, 8, 9, None} and (104, 2, 1) in want and (105, 2, 1) in want and left.columns == [c for c in odd_docs.columns]
