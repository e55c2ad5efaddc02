"""The pipeline's stages on a small table, each against brute force on its own input."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
from test_mixing_leaks import brute_leaks

from loomgraph.llm import quality, simhash

SF = "/root/testdata/sf0.001"


def near_kept(docs):
    """Ids of the documents that stay: the smallest of each group that links of all pairs make."""
    prints = {d["doc_id"]: simhash.fingerprint(d["text"], 3, True) for d in docs}
    group = {i: i for i in prints}
    for i in sorted(prints):
        for j in sorted(prints):
            a, b = ((x ^ y).bit_count() for x, y in zip(prints[i], prints[j]))
            if i < j and group[i] != group[j] and (min(a, b) <= 3 or min(a, b) <= 8 and a + b <= 18):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {i for i in group if group[i] == i}


def mixed(docs, power=0.7):
    """doc_id to copies: the Poisson distribution of each source's rate inverted at a hashed number; rates up to 8."""
    sizes = Counter(d["source"] for d in docs)
    share = {s: n**power for s, n in sizes.items()}
    out = Counter()
    for d in docs:
        rate = len(docs) * share[d["source"]] / sum(share.values()) / sizes[d["source"]]
        assert rate <= 8
        said = f"mix:{d['doc_id']}:{hashlib.md5((d['text'] or '').encode()).hexdigest()}:1"
        u, n, step = int(hashlib.md5(said.encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        below = step
        while below <= u:
            n += 1
            step *= rate / n
            below += step
        out[d["doc_id"]] = n
    return +out


def test_stages_by_brute_force(spark):
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality.classify(docs.select("doc_id", "text", "lang"), labels).filter("kept").select("doc_id").collect()}
    docs = stages["quality classifier"](spark, docs, SF).cache()
    before = docs.collect()
    assert {d["doc_id"] for d in before} == kept and len(before) == len(kept)

    docs = stages["SimHash near-dedup"](spark, docs, SF).cache()
    after = docs.collect()
    assert {d["doc_id"] for d in after} == near_kept(before) and len(after) < len(before)

    docs = stages["benchmark decontamination"](spark, docs, SF).cache()
    clean = docs.collect()
    leaked = {i for i, _, _ in brute_leaks(after, spark.read.parquet(f"{SF}/benchmark.parquet").collect())}
    assert {d["doc_id"] for d in clean} == {d["doc_id"] for d in after} - leaked and leaked

    docs = stages["mixing sources to target weights"](spark, docs, SF).cache()
    copies = docs.collect()
    assert Counter(d["doc_id"] for d in copies) == mixed(clean)

    last = stages["sharding"](spark, docs, SF).collect()
    assert Counter((d["doc_id"], d["text"]) for d in last) == Counter((d["doc_id"], d["text"]) for d in copies)
    slots = Counter((d["shard"], d["slot"]) for d in last)
    sizes = Counter(d["shard"] for d in last)
    assert set(sizes) <= set(range(40)) and set(slots) == {(s, k) for s, n in sizes.items() for k in range(n)} and max(slots.values()) == 1
