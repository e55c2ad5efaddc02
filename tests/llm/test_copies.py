import random
import re
import pytest
from collections import defaultdict

import numpy as np
import xxhash

from loomgraph.llm import components, exact_dedup, simhash


def brute_dedup(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    return groups


def test_exact_dedup(spark, odd_docs, none):
    got = exact_dedup.exact_dedup(odd_docs, tracked=64).collect()
    assert len(got) == odd_docs.count()
    groups = brute_dedup([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    want = {}
    for ids in groups.values():
        low = min((i for i in ids if i is not None), default=None)
        want |= {i: (low, len(ids), i == low) for i in ids}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_hot(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot text', if(id % 7 = 0, 'warm', concat('t', id div 2))) as text")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(rows, tracked=64).collect()}
    for ids in brute_dedup([(r["doc_id"], r["text"]) for r in rows.collect()]).values():
        assert all(got[i] == (min(ids), len(ids)) for i in ids)


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(odd_docs):
    for r in odd_docs.collect():
        assert simhash.fingerprint(r["text"]) == (brute_fingerprint(r["text"]), 0)
        assert simhash.fingerprint(r["text"], second=True)[0] == brute_fingerprint(r["text"])


def brute_components(ids, prints, limit):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= limit:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_links_against_all_pairs(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(40)]
    while len(prints) < 700:
        base = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            base ^= 1 << b
        prints.append(base)
    distinct = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(simhash.signed(p), 0, i) for i, p in enumerate(distinct)], "fp long, fp2 long, rep long")
    for split in (20_000, 12):
        found = components.connected_components(simhash.links(nodes, 3, split))
        got = {r["node"]: r["component"] for r in found.collect()}
        want = brute_components(range(len(distinct)), dict(enumerate(distinct)), 3)
        assert {i: got.get(i, i) for i in range(len(distinct))} == want


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(30)]))
    index = simhash.GrayIndex(values)
    q, place, far = index.pairs(values, 3)
    got = {(int(a), int(index.order[b])): int(d) for a, b, d in zip(q, place, far)}
    want = {(i, j): d for i in range(len(values)) for j in range(len(values)) if (d := (int(values[i]) ^ int(values[j])).bit_count()) <= 3}
    assert got == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 250), (5, 5), (400, 400)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 250: 200, 300: 200}


def test_near_duplicates(odd_docs, none):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of[1] == of[2] == of[3] == 1 and of[4] == of[5] == of[6] == 4 and of[7] == 7 and of[None] is None
    assert simhash.near_duplicates(none).count() == 0


def test_wide_links(spark):
    rng = random.Random(11)
    prints = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(30)]
    while len(prints) < 400:
        a, b = rng.choice(prints)
        for bit in rng.sample(range(128), rng.randint(0, 20)):
            a, b = (a ^ 1 << bit, b) if bit < 64 else (a, b ^ 1 << bit - 64)
        prints.append((a, b))
    prints = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(simhash.signed(a), simhash.signed(b), i) for i, (a, b) in enumerate(prints)], "fp long, fp2 long, rep long")
    near = lambda x, y: (d := (x[0] ^ y[0]).bit_count()) <= 3 or d <= 7 and d + (x[1] ^ y[1]).bit_count() <= 16
    parent = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i], prints[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    for split in (20_000, 15):
        got = {r["node"]: r["component"] for r in components.connected_components(simhash.links(nodes, 7, split, 16)).collect()}
        assert [got.get(i, i) for i in range(len(prints))] == parent


def test_either_fingerprint_links(spark):
    """Near in the first or in the second fingerprint, and not too far in both: as all pairs say."""
    rng = random.Random(3)
    base = " ".join(f"word{rng.randrange(400)}" for _ in range(300)).split()
    rows = []
    for i in range(60):
        words = list(base) if i % 3 else [f"other{rng.randrange(400)}" for _ in range(300)]
        for k in rng.sample(range(300), rng.randrange(0, 40)):
            words[k] = f"new{i}x{k}"
        rows.append((str(1000 - i), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    prints = [simhash.fingerprint(t, 3, True) for _, t in rows]

    def near(x, y):
        a, b = ((p ^ q).bit_count() for p, q in zip(x, y))
        return min(a, b) <= 3 or min(a, b) <= 8 and a + b <= 18

    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near(prints[i], prints[j]):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    want = {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if group[j] == group[i]) for i in range(len(rows))}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, limit=8, total=18).collect()}
    assert got == want and 20 < len(set(want.values())) < 60


@pytest.mark.parametrize("split", [20_000, 10])
def test_nodes_of_one_fingerprint(spark, split):
    """Nodes that agree in one fingerprint and differ widely in the other: each is set against all, in any order of rows."""
    rng = random.Random(4)
    prints = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(8)] + [(0, 0), (0, (1 << 30) - 1), (0xFF, ((1 << 30) - 1) ^ 0x1FF00000000)]
    while len(prints) < 300:
        a, b = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randint(3, 9)):
            a, b = (a ^ 1 << bit, b) if len(prints) % 3 == 0 else (a, b ^ 1 << bit)
        prints.append((a, b))
    prints = list(dict.fromkeys(prints))
    near = lambda x, y: (d := (x[0] ^ y[0]).bit_count()) <= 3 or d <= 8 and d + (x[1] ^ y[1]).bit_count() <= 17
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i], prints[j]):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    want = sorted(sorted(j for j in range(len(prints)) if group[j] == g) for g in set(group))
    assert group[10] == group[9] == group[8] and (prints[8][0] ^ prints[10][0]).bit_count() + (prints[8][1] ^ prints[10][1]).bit_count() > 17
    for seed in range(2):
        order = random.Random(seed).sample(range(len(prints)), len(prints))
        nodes = spark.createDataFrame([(simhash.signed(prints[i][0]), simhash.signed(prints[i][1]), rep) for rep, i in enumerate(order)], "fp long, fp2 long, rep long")
        got = {r["node"]: r["component"] for r in components.connected_components(simhash.links(nodes, 8, split, 17)).collect()}
        groups = defaultdict(list)
        for rep, i in enumerate(order):
            groups[got.get(rep, rep)].append(i)
        assert sorted(map(sorted, groups.values())) == want and 1 < len(want) < len(prints)


def test_query_by_brute_force(spark, tmp_path):
    """op9 end to end on a table: fingerprints from the definition, components from all pairs."""
    from loomgraph.llm.queries import op9_simhash

    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    texts = base + [t.replace("w1 ", "zz ", 1) for t in base] + [t.upper() for t in base] + [None, "", " \t", "a b"]
    rows = [(1000 + 7 * i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    group = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op9_simhash(spark, str(tmp_path)).collect()}
    assert got == {i: (f"{prints[i]:016x}", group[i]) for i in ids}


def test_one_fingerprint_in_more_nodes_than_a_group_takes(spark):
    nodes = spark.createDataFrame([(5, i * 7919, i) for i in range(40)] + [(-1, 3, 99)], "fp long, fp2 long, rep long")
    got = {r["node"]: r["component"] for r in components.connected_components(simhash.links(nodes, 3, 10, 18)).collect()}
    assert got == dict.fromkeys(range(40), 0)


def test_near_copies_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 1500").select("doc_id", "text")
    edited = docs.selectExpr("doc_id + 100000 as doc_id", "concat(substr(text, 1, 400), 'changed ', substr(text, 420, 500), ' other ', substr(text, 930)) as text")
    both = docs.unionByName(edited)
    n = docs.count()
    left = simhash.keep_one_of_each(both, limit=8, total=18)
    assert left.filter("doc_id >= 100000").count() < 0.05 * n


def test_frequent_digests_are_found(spark):
    """Each digest over n / tracked rows is a candidate, also with many of them just over it."""
    rows = spark.range(200_000).selectExpr("cast(if(id % 2 = 0, id % 100, 1000 + id) as string) as digest")
    found = {r["digest"] for r in exact_dedup.heavy_candidates(rows.repartition(9), 256).collect()}
    assert {str(2 * k) for k in range(50)} <= found and len(found) <= 512
