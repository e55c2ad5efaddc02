import zlib
from collections import Counter

import numpy as np
import pytest
from loomgraph.llm import elias_fano, sharding, token_output
from loomgraph.llm.queries import tokenizer_path
from pyspark.sql import functions as F


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0, 5, 5, 900], list(range(0, 3000, 3)), [2**40, 2**40 + 1, 2**41]])
def test_elias_fano(values):
    e = elias_fano.EliasFano.load(elias_fano.EliasFano.of(np.array(values, np.int64)).dump())
    assert e.all().tolist() == values
    assert [e.select(i) for i in range(len(values))] == values
    some = np.arange(len(values))[::-1]
    assert e.select_many(some).tolist() == values[::-1]


def test_token_file_round_trip():
    rng = np.random.default_rng(1)
    docs = np.sort(rng.integers(-5, 10**6, 1000))
    sizes = rng.integers(0, 40, 1000)
    ids = rng.integers(0, 49408, sizes.sum())
    f = elias_fano.TokenFile(elias_fano.dump_tokens(docs, sizes, ids))
    at = np.append(0, np.cumsum(sizes))
    for i in range(0, 1000, 37):
        doc, own = f.document(i)
        assert doc == docs[i] and own.tolist() == ids[at[i] : at[i + 1]].tolist()
    assert elias_fano.TokenFile(elias_fano.dump_tokens(np.array([3]), np.array([1]), np.array([70000]))).document(0)[1].tolist() == [70000]


def test_tokens_against_the_library(spark, with_ids, odd_docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = {}
    rows = odd_docs.unionByName(odd_docs.filter("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    for r in token_output.write_tokens(rows, tokenizer_path()).digest().collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    assert sorted(map(len, got.values())) == sorted(Counter(r["doc_id"] for r in rows.collect()).values())
    without = [r for r in rows.collect() if r["doc_id"] is None]
    at = sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in without)
    assert sorted(n for _, n, _ in got[None]) == sorted(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in without)
    for r in sorted(with_ids.collect(), key=lambda r: r["doc_id"]):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        assert (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in got[r["doc_id"]]
        at += len(ids)
    assert token_output.write_tokens(none, tokenizer_path()).digest().count() == 0


def test_order_holds_for_small_files(spark, tmp_path):
    rows = [(i * 37 % 500, f"text {i}") for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in token_output.write_tokens(spark.read.parquet(f"{tmp_path}/d"), tokenizer_path()).digest().collect())
    assert [d for d, _, _ in got] == list(range(500)) and [s for _, s, _ in got] == np.cumsum([0, *[n for _, _, n in got[:-1]]]).tolist()


def test_word_cache_is_emptied(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_output, "KEPT", 20)
    e = token_output.WordEncoder(tokenizer_path())
    assert e.safe
    for k in range(5):
        texts = [" ".join(f"word{k}x{i} the" for i in range(15)), "", "the a"]
        ids, n = e.encode(pa.array(texts))
        assert [e._ids(x) for x in texts] == [ids[a - b : a].tolist() for a, b in zip(np.cumsum(n), n)]


def test_shards(spark, odd_docs, none):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id % 100) as text")
    rows = sharding.shard_digest(docs, shards=7).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    for k in range(7):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots))) and 300 < len(slots) < 560
    assert all(r["grown_shard"] in (r["shard"], 7) for r in rows)
    assert 250 < sum(r["grown_shard"] == 7 for r in rows) < 500
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_digest(docs.repartition(13), shards=7).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    in_order = [r["doc_id"] for r in sorted((r for r in rows if r["shard"] == 0), key=lambda r: r["slot"])]
    assert in_order != sorted(in_order)
    odd = sharding.shard_digest(odd_docs, shards=7).collect()
    assert len(odd) == odd_docs.count() and {r["size"] for r in odd if r["doc_id"] in (4, 5)} == {16}
    assert sharding.shard_digest(none).count() == 0


def test_shards_pass_columns_through(odd_docs):
    docs = odd_docs.selectExpr("*", "'mine' as _bucket", "'tie' as _tie", "'n' as _n")
    got = sharding.sharded(docs, shards=3)
    assert set(got.columns) == {*docs.columns, "_own_shard", "_own_slot"}
    back = got.drop("shard", "slot").withColumnsRenamed({"_own_shard": "shard", "_own_slot": "slot"})
    assert back.select(*docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()


def test_sharding_query_by_brute_force(spark):
    """Sizes, checksums and shards of the whole query from the definition: the last n whose hash takes the key."""
    docs = spark.createDataFrame([(i, "é" * (i % 7) if i % 11 else None) for i in range(400)], "doc_id long, text string")
    takes = docs.select("doc_id", *[F.expr(f"pmod(xxhash64(xxhash64(0, doc_id), {n}), {1 << 40})").alias(str(n)) for n in range(1, 41)]).collect()
    of = {r["doc_id"]: [n for n in range(1, 41) if r[str(n)] * (n + 1) < 1 << 40] for r in takes}
    rows = sharding.shard_digest(docs, shards=40).collect()
    for r in rows:
        text = ("é" * (r["doc_id"] % 7) if r["doc_id"] % 11 else "").encode()
        shard = max([n for n in of[r["doc_id"]] if n < 40], default=0)
        assert (r["size"], r["text_crc32"], r["law"], r["shard"]) == (len(text) + 16, zlib.crc32(text), "key", shard)
        assert r["grown_shard"] == max(of[r["doc_id"]], default=0)
    for k in range(40):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))
