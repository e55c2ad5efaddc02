"""SimHash near-dedup over a Gray-order hierarchical index (op 9).

Fingerprints are grouped by what they share: 64 bits are cut into 5 blocks, and two fingerprints at
3 or fewer differing bits agree in at least 2 of them, so each fingerprint is dealt to the 10
groups of its pairs of blocks. Within a group the fingerprints are sorted by Gray rank; runs of
them become leaves of an index whose nodes hold the bits that all below share (a mask and a
pattern). A search goes down from the top, adds up the differences in the bits that are new at
each node, and drops a whole node when they exceed the limit. Groups over ``split`` fingerprints
are cut on by the bits that are still free, so no task gets an unbounded one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, mapped_pandas, pieces, without
from .components import connected_components

BITS = 64
#: So few differing bits link two texts whatever their other 64 bits are.
SURE = 3
#: Fingerprints in a leaf, and nodes below an upper node.
FAN = 16
_FOLD = bytes.maketrans(bytes(range(65, 91)) + bytes([9, 10, 11, 12, 13]), bytes(range(97, 123)) + b"     ")


def word_list(text: str | None) -> list[bytes]:
    """The words of a text between ASCII white space, A-Z in lower case, in UTF-8."""
    return [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if w]


def fingerprint(text: str | None, n: int = 3, second: bool = False) -> tuple[int, int]:
    """The SimHash of a text's shingles of n words, repeats included: a bit is 1 if set in over half of them.

    With ``second`` another 64 bits come from mixed hashes; they are 0 otherwise, and without words.
    """
    words = word_list(text)
    if not words:
        return 0, 0
    line = b" ".join(words)
    count = max(1, len(words) - n + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: count - 1].tolist()]
    stops = (ends[min(n, len(words)) - 1 :] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros((2, BITS), np.int64)
    for k in range(0, count, 1 << 16):
        h = np.fromiter((digest(line[i:j], 42) for i, j in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)], strict=False)), np.uint64)
        total[0] += bit_counts(h)
        if second:
            h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
            total[1] += bit_counts(h ^ h >> np.uint64(29))
    first, other = (int.from_bytes(np.packbits(2 * t > count).tobytes(), "big") for t in total)
    return first, other


def bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, n: int = 3, second: bool = False) -> DataFrame:
    """(doc_id, fp, fp2), written: the fingerprint's words as signed longs. Null and blank texts get 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, n, second) for t in b["text"]], np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "fp": fp[:, 0], "fp2": fp[:, 1]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped_pandas(dealt(docs.select("doc_id", "text")), run, f"doc_id {kind}, fp long, fp2 long", "fingerprints")


# ---- the index ---------------------------------------------------------------------------------


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the Gray sequence: the prefix XOR of its bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits shared by all below them.

    levels[0] is the top. A level has per node: mask (the bits shared by all below),
    pattern (their values), first and last child in the next level (or fingerprint).
    """

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order]
        every, either, bounds, levels = self.values, self.values, np.arange(len(values) + 1), []
        while len(every) > 1 or not levels:
            cuts = np.arange(0, len(every), FAN)
            every, either = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(either, cuts)
            bounds = np.append(cuts, bounds[-1] if not levels else len(levels[-1][0]))
            levels.append((~(every ^ either), every, bounds))
        self.levels = levels[::-1]

    def pairs(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, differences) of all values within ``limit`` of each query; place is in Gray order."""
        mask, pattern, bounds = self.levels[0]
        q, node = np.repeat(np.arange(len(queries)), len(mask)), np.tile(np.arange(len(mask)), len(queries))
        seen = np.zeros(len(q), np.uint64)
        far = np.zeros(len(q), np.int16)
        for depth, (mask, pattern, bounds) in enumerate(self.levels):
            far = far + popcount((queries[q] ^ pattern[node]) & mask[node] & ~seen)
            keep = far <= limit
            q, node, far = q[keep], node[keep], far[keep]
            seen = mask[node]
            size = bounds[node + 1] - bounds[node]
            child = np.repeat(bounds[node] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            q, far, seen, node = np.repeat(q, size), np.repeat(far, size), np.repeat(seen, size), child
        far = far + popcount((queries[q] ^ self.values[node]) & ~seen)
        keep = far <= limit
        return q[keep], node[keep], far[keep]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given links connect, at most one for each end: (end, smallest end that it reaches)."""
    ends, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ends))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(ends))
    return ends[keep], ends[label[keep]]


def group_links(group: np.ndarray, fp: np.ndarray, fp2: np.ndarray, rep: np.ndarray, limit: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of reps that connect all in the same group within ``limit`` bits of fp, and ``total`` bits of both or SURE of fp."""
    order = np.lexsort((gray_rank(fp), group))
    group, fp, fp2, rep = group[order], fp[order], fp2[order], rep[order]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    out_a, out_b = [], []
    in_leaf = np.repeat(sizes <= FAN, sizes)
    for s in range(1, FAN):  # groups of one leaf: each with its s-th next in Gray order
        i = np.flatnonzero((group[:-s] == group[s:]) & in_leaf[:-s]) if len(group) > s else np.empty(0, np.int64)
        far = popcount(fp[i] ^ fp[i + s])
        i = i[(far <= min(SURE, limit)) | (far <= limit) & (far + popcount(fp2[i] ^ fp2[i + s]) <= total)]
        out_a.append(rep[i])
        out_b.append(rep[i + s])
    for start, size in zip(starts[sizes > FAN], sizes[sizes > FAN], strict=True):
        a, b = class_links(fp[start : start + size], fp2[start : start + size], rep[start : start + size], limit, total)
        out_a.append(a)
        out_b.append(b)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return forest(a, b) if len(a) else (a, b)


def class_links(fp: np.ndarray, fp2: np.ndarray, rep: np.ndarray, limit: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one group in Gray order. The index holds each fp once; its nodes, which differ in fp2, are a class.

    Classes at SURE bits or fewer link whatever fp2 is. Of the others within ``limit`` any two of
    their nodes may, so all are set against each other, unless the classes are connected already.
    """
    first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
    n = np.diff(np.append(first, len(fp)))
    own = fp[first]
    index = GrayIndex(own)
    found = [index.pairs(own[k : k + 256], limit) for k in range(0, len(own), 256)]
    x = np.concatenate([q + 256 * k for k, (q, _, _) in enumerate(found)])
    y = index.order[np.concatenate([place for _, place, _ in found])]
    far = np.concatenate([f for _, _, f in found])
    x, y, far = (v[x < y] for v in (x, y, far))
    sure = far <= SURE
    a, b = forest(x[sure], y[sure]) if sure.any() else (x[:0], y[:0])
    label = np.arange(len(own))
    label[a] = b
    x, y, far = (v[~sure & (label[x] != label[y])] for v in (x, y, far))
    times = n[x] * n[y]
    out = [(rep[first[a]], rep[first[b]]), (rep[first.repeat(n)], rep)]
    for k in cut_at(times, 1 << 20):
        each = np.repeat(np.arange(k.start, k.stop), times[k])
        nth = np.arange(len(each)) - np.repeat(np.cumsum(times[k]) - times[k], times[k])
        i, j = first[x[each]] + nth // n[y[each]], first[y[each]] + nth % n[y[each]]
        near = far[each] + popcount(fp2[i] ^ fp2[j]) <= total
        a, b = rep[i[near]], rep[j[near]]
        out.append(forest(a, b) if len(a) else (a, b))
    a, b = np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])
    return a[a != b], b[a != b]


def cut_at(sizes: np.ndarray, most: int) -> list[slice]:
    """Runs of places whose sizes add up to about ``most``; a place of more is a run of its own."""
    run = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(sizes) else np.empty(0, np.int64)
    return [slice(i, j) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)])]


# ---- dealing to groups -------------------------------------------------------------------------


def cut_bits(free: int, parts: int) -> list[int]:
    """Masks that cut the set bits of ``free`` into ``parts`` runs of nearly equal size."""
    bits = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << i for i in run.tolist()) for run in np.array_split(np.array(bits, dtype=object), parts)]


def first_masks(limit: int) -> list[int]:
    """Masks of which two fingerprints within ``limit`` bits agree on at least one: pairs of limit + 2 blocks."""
    blocks = cut_bits((1 << BITS) - 1, limit + 2)
    return [a | b for a, b in combinations(blocks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def to_groups(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each node and mask: the mask and the bits under it are the group."""
    each = F.explode(F.array(*[F.lit(signed(m)).cast("long") for m in masks]))
    return nodes.withColumn("mask", each).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))


#: Parquet bytes of dealt fingerprints for each task of the search.
SEARCH_BYTES = 8 << 20


def links(nodes: DataFrame, limit: int = 3, split: int = 20_000, total: int | None = None) -> DataFrame:
    """(a, b) of reps that connect all (fp, fp2, rep) of ``nodes`` within ``limit`` differing bits of fp, and ``total`` of both or SURE of fp.

    Nodes of one fp link to the one of the smallest fp2, its head. All nodes are dealt to groups; those of more
    than ``split`` fps are dealt again by their free bits, cut into limit + 1 runs of which two close
    fingerprints agree on one, until they are smaller. At most ``limit`` free bits have fewer fps than that.
    """
    total = limit if total is None else total
    heads = cut(nodes.groupBy("fp").agg(F.min_by("rep", F.struct("fp2", "rep")).alias("head")), "heads")
    marked = cut(nodes.join(heads, "fp").select("fp", "fp2", "rep", "head"), "marked")
    found = [marked.filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))]
    dealt_nodes = marked.select("fp", "fp2", "rep", (F.col("rep") == F.col("head")).cast("int").alias("head"))
    groups = cut(to_groups(dealt_nodes, first_masks(limit)), "groups")
    while True:
        sizes = groups.groupBy("mask", "bits").agg(F.sum("head").alias("n"))
        large = cut(sizes.filter((F.col("n") > split) & (F.bit_count(F.bitwise_not("mask")) > limit)).select("mask", "bits"), "large")
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # as many as bits are cut in ways
        fit = groups.join(large, ["mask", "bits"], "left_anti") if masks else groups
        found.append(searched(fit, limit, total, pieces(groups, SEARCH_BYTES)))
        if not masks:
            break
        rest = groups.join(large, ["mask", "bits"], "left_semi")
        finer = F.array().cast("array<bigint>")
        for m in masks:
            free = ~(m & ((1 << 64) - 1)) & ((1 << 64) - 1)
            own = [signed((m & ((1 << 64) - 1)) | run) for run in cut_bits(free, limit + 1) if run]
            finer = F.when(F.col("mask") == m, F.array(*[F.lit(x).cast("long") for x in own])).otherwise(finer)
        groups = rest.withColumn("mask", F.explode(finer)).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))).distinct()
        groups = cut(groups, "groups")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def searched(groups: DataFrame, limit: int, total: int, parts: int) -> DataFrame:
    """Links within the groups; a task goes through its groups in order and holds few of them at a time."""

    def found(b: pd.DataFrame) -> pd.DataFrame:
        mask, bits = b["mask"].to_numpy(), b["bits"].to_numpy()
        group = np.cumsum(np.append(True, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])))
        a, c = group_links(group, b["fp"].to_numpy().view(np.uint64), b["fp2"].to_numpy().view(np.uint64), b["rep"].to_numpy(), limit, total)
        return pd.DataFrame({"a": a, "b": c})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            last = ((b["mask"] == b["mask"].iloc[-1]) & (b["bits"] == b["bits"].iloc[-1])).to_numpy()
            at = int(np.argmax(last))  # where the last group starts, which may go on in the next batch
            if at:
                yield found(b.iloc[:at])
            rest = b.iloc[at:]
        if rest is not None and len(rest):
            yield found(rest)

    return groups.repartition(parts, "mask", "bits").sortWithinPartitions("mask", "bits").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 3, limit: int = 3, total: int | None = None, split: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id) of each row: component_id is the smallest doc_id that links reach.

    Two rows link if their fingerprints differ in ``limit`` bits or fewer. For wide limits, at which
    unlike texts of a large corpus would meet by chance and alike ones still miss each other,
    ``total`` takes a second fingerprint of mixed hashes: two rows link if either differs in
    ``limit`` bits or fewer and both together in no more than ``total`` (or either in 3 or fewer).

    Null, empty and blank texts have fingerprint 0 and link like any other; texts with fewer than
    ``n`` words are one shingle. Rows that repeat a doc_id or a text are rows of their own. Rows of
    a null doc_id get a fingerprint and take no part in links (component_id null). doc_ids keep
    their type. Other columns are ignored; an empty table gives an empty result.
    Texts of any length are taken whole.
    """
    prints = fingerprints(docs, n, second=total is not None)
    nodes = prints.filter("doc_id is not null").groupBy("fp", "fp2").agg(F.min("doc_id").alias("least"))
    nodes = cut(nodes.withColumn("rep", F.monotonically_increasing_id()), "nodes")  # a number for each, whatever type doc_ids have
    found = links(nodes.drop("least"), limit, split, total)
    if total is not None:
        other = nodes.select(F.col("fp2").alias("fp"), F.col("fp").alias("fp2"), "rep")
        found = found.unionByName(links(other, limit, split, total))
    reached = connected_components(found)
    named = nodes.join(reached, nodes["rep"] == reached["node"], "left").withColumn("component", F.coalesce("component", "rep"))
    named = cut(named.select("fp", "fp2", "least", "component"), "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(smallest, "component").select("fp", "fp2", "component_id")
    joined = prints.join(labels, ["fp", "fp2"], "left")
    return joined.select("doc_id", "fp", F.expr("if(doc_id is null, null, component_id)").alias("component_id"))


def keep_one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the documents that have a near duplicate of a smaller doc_id, directly or through others; null doc_ids stay."""
    found = near_duplicates(docs, **parameters)
    return without(docs, found.filter("component_id < doc_id").select("doc_id"))
