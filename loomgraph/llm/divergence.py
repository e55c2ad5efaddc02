"""How far the sources of a language are apart in their words, by a heavy-light split (op 12).

Documents of one lang and source are a group. A kept term t of a language (V in all, N their
occurrences in the group) has p = 1 + floor(10^9 (count + 1) / (N + V)) there. Two groups are apart by
the sum of f(p, q) = floor((p - q)^2 / q) over all kept terms, absent ones included.

Most terms are in few groups, so the sum is not taken term by term. With p0 for a term of count 0:

* Terms in many of the groups (heavy) become dense tiles, terms by groups, and each group's column is
  set against all columns.
* A light term is a posting list. The sum starts from V_light f(p0, q0). Each posting adds, against every
  other group, f(p, q0) - f(p0, q0) and the other way around; equal counts of a group are taken once,
  by their number. Where two groups both have the term, the pair is corrected by
  f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

Both are sums of the same integers in another order, so their total is exact. Each task adds up its terms and sends
a number for each pair of groups. All is int64: p is at most 10^9 + 1, so a square is below 2^60, and
sums of f stay below 2 (10^9 + V)^2.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, dealt, small_batches

#: Bytes that part terms become spaces, A-Z become a-z: the terms `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` in UTF-8, as all bytes from 128 on are theirs.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Counters of a task with more entries than this are sent on.
MOST_ENTRIES = 300_000

#: Cells of a tile, and of the matrix of pairs that a task holds at once.
TILE_CELLS, MATRIX_CELLS = 1 << 19, 1 << 22

SCALE = 1_000_000_000


def count_terms(docs: DataFrame, numbers: dict[tuple[str, str], tuple[int, int]]) -> DataFrame:
    """(lid, g, term, n, d): occurrences of terms and rows that have them, by language and group; summed within tasks."""

    def sent(counters: dict) -> Iterator[pa.RecordBatch]:
        for (lid, g), (n, d) in counters.items():
            terms = list(n)
            for at in range(0, len(terms), 20_000):
                part = terms[at : at + 20_000]
                columns = [pa.array([lid] * len(part), pa.int32()), pa.array([g] * len(part), pa.int32()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lid", "g", "term", "n", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, held = {}, 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary())):
                n, d = counters.setdefault(numbers[lang, source], (Counter(), Counter()))
                terms = text.as_py().translate(_FOLD).split()
                held -= len(n)
                n.update(terms)
                d.update(set(terms))
                held += len(n)
                if held > MOST_ENTRIES:
                    yield from sent(counters)
                    counters, held = {}, 0
        yield from sent(counters)

    return docs.mapInArrow(run, "lid int, g int, term string, n long, d long")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), by three steps of 1000, so that no product passes 2^63."""
    p, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count + 1
    for _ in range(3):
        rest = rest * 1000
        p = p * 1000 + rest // total
        rest = rest % total
    return p + 1


def share(count: Column, total: Column) -> Column:
    """The same as shares(), of columns."""
    p, rest = F.lit(0).cast("long"), count + 1
    div = lambda a, b: F.call_function("div", a, b)
    for _ in range(3):
        p = p * 1000 + div(rest * 1000, total)
        rest = (rest * 1000) % total
    return p + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class PairSums:
    """Sums over terms of f(p of a, p of b) for the groups a from ``lo`` to ``hi`` and all groups b of a language."""

    def __init__(self, total: np.ndarray, lo: int, hi: int, heavy_share: float):
        self.total, self.lo, self.hi = total, lo, hi
        self.p0 = shares(np.zeros(len(total), np.int64), total)
        self.base = apart(self.p0[lo:hi, None], self.p0)
        self.sums = np.zeros_like(self.base)
        self.heavy = heavy_share * len(total)

    def add(self, size: np.ndarray, g: np.ndarray, n: np.ndarray) -> None:
        """Terms with posting lists of these sizes; g and n are the lists, one after the other."""
        start = np.cumsum(size) - size
        dense = size > self.heavy
        step = max(1, TILE_CELLS // len(self.total))
        rows = np.flatnonzero(dense)
        for at in range(0, len(rows), step):
            self.tile(*self.lists(rows[at : at + step], start, size, g, n))
        light = np.flatnonzero(~dense)
        self.sums += len(light) * self.base
        owner, lg, ln = self.lists(light, start, size, g, n)
        self.one_sided(lg, ln)
        for k in np.unique(size[light]):
            if k > 1:
                of_size = light[size[light] == k]
                for at in range(0, len(of_size), step):
                    own = of_size[at : at + step]
                    where = start[own][:, None] + np.arange(k)
                    self.pairs(g[where], n[where])

    @staticmethod
    def lists(rows, start, size, g, n):
        """(row from 0, group, count) of each posting of these rows."""
        k = size[rows]
        owner = np.repeat(np.arange(len(rows)), k)
        where = np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[rows], k)
        return owner, g[where], n[where]

    def tile(self, owner, g, n) -> None:
        counts = np.zeros((int(owner[-1]) + 1, len(self.total)), np.int64)
        counts[owner, g] = n
        p = shares(counts, self.total)
        for a in range(self.lo, self.hi):
            self.sums[a - self.lo] += apart(p[:, a : a + 1], p).sum(0)

    def one_sided(self, g, n) -> None:
        order = np.lexsort((n, g))
        g, n = g[order], n[order]
        first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (n[1:] != n[:-1]))) if len(g) else np.empty(0, int)
        times = np.diff(np.append(first, len(g)))
        g, n = g[first], n[first]
        p = shares(n, self.total[g])
        step = max(1, TILE_CELLS // len(self.total))
        for at in range(0, len(g), step):
            gs, ps, t = g[at : at + step], p[at : at + step, None], times[at : at + step, None]
            own = (gs >= self.lo) & (gs < self.hi)
            rows = gs[own] - self.lo
            np.add.at(self.sums, rows, t[own] * (apart(ps[own], self.p0) - self.base[rows]))
            others = t * (apart(self.p0[self.lo : self.hi], ps) - self.base[:, gs].T)
            np.add.at(self.sums.T, gs, others)

    def pairs(self, g, n) -> None:
        p, p0 = shares(n, self.total[g]), self.p0[g]
        for i in range(g.shape[1]):
            own = (g[:, i] >= self.lo) & (g[:, i] < self.hi)
            a, pa_, a0 = g[own, i : i + 1], p[own, i : i + 1], p0[own, i : i + 1]
            more = apart(pa_, p[own]) - apart(pa_, p0[own]) - apart(a0, p[own]) + apart(a0, p0[own])
            np.add.at(self.sums, (np.broadcast_to(a - self.lo, more.shape), g[own]), more)


def pair_sums(postings: DataFrame, totals: dict[int, np.ndarray], heavy_share: float) -> DataFrame:
    """(lid, a, b, value): each task's sums for the pairs of groups, from postings (lid, block, gs, ns)."""
    height = {lid: max(1, MATRIX_CELLS // len(t)) for lid, t in totals.items()}
    blocks = {lid: -(-len(t) // height[lid]) for lid, t in totals.items()}
    most = max(blocks.values(), default=1)
    if most > 1:  # with very many groups a task's matrix is some of the rows, and terms go to each block of rows
        by = F.element_at(F.create_map(*[F.lit(x) for item in blocks.items() for x in item]), F.col("lid"))
        postings = postings.withColumn("block", F.explode(F.sequence(F.lit(0), by - 1))).repartition("lid", "block", F.pmod(F.xxhash64("term"), F.lit(64))).sortWithinPartitions("lid", "block")
    else:
        postings = postings.withColumn("block", F.lit(0))

    def sent(held: dict) -> Iterator[pa.RecordBatch]:
        for (lid, _), s in held.items():
            for row in range(s.sums.shape[0]):
                b = np.flatnonzero(np.arange(len(s.total)) != s.lo + row)
                columns = [np.full(len(b), lid, np.int32), np.full(len(b), s.lo + row, np.int32), b.astype(np.int32), s.sums[row, b]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lid", "a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            lid, block = batch.column("lid").to_numpy(), batch.column("block").to_numpy()
            size = batch.column("gs").value_lengths().to_numpy().astype(np.int64)
            g, n = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("gs", "ns"))
            key = lid.astype(np.int64) * most + block
            for k in np.unique(key):
                at, rows = (int(k // most), int(k % most)), np.flatnonzero(key == k)
                if at not in held:
                    if sum(s.sums.size for s in held.values()) > MATRIX_CELLS:
                        yield from sent(held)
                        held = {}
                    t, h = totals[at[0]], height[at[0]]
                    held[at] = PairSums(t, at[1] * h, min(len(t), (at[1] + 1) * h), heavy_share)
                _, own_g, own_n = PairSums.lists(rows, np.cumsum(size) - size, size, g, n)
                held[at].add(size[rows], own_g, own_n)
        yield from sent(held)

    return postings.select("lid", "block", "gs", "ns").mapInArrow(run, "lid int, a int, b int, value long")


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, heavy_share: float = 0.4) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of ``docs`` (text, lang, source).

    part ``pair``: item is each other source of the language, value their sum of f, q being the item's p.
    part ``term``: item is each of the ``top`` terms of largest f among those whose p is over that of the whole
    language, q. Ranks go by value, descending, then by item. A term is kept in a language if at
    least ``least_docs`` rows have it; it is heavy if more than ``heavy_share`` of the groups do.

    Null texts, langs and sources count as ''. Groups without any term are groups; without kept terms
    all values are 0. Texts of any length are read whole; rows that repeat are documents of their own. An empty
    table gives an empty result; other columns are ignored. The groups' names and sums, whose pairs
    are the result's rows, go through the driver to the tasks; postings of a term are at most one for each group.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    names = sorted(tuple(r) for r in docs.select("lang", "source").distinct().collect())
    lids = {lang: i for i, lang in enumerate(sorted({lang for lang, _ in names}))}
    numbers, size = {}, Counter()
    for lang, source in names:
        numbers[lang, source] = (lids[lang], size[lang])
        size[lang] += 1

    with small_batches(spark):
        counts = count_terms(dealt(docs), numbers).groupBy("lid", "g", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        terms = counts.groupBy("lid", "term").agg(F.collect_list(F.struct("g", "n")).alias("p"), F.sum("d").alias("d"), F.sum("n").alias("all_n"))
        postings = cut(terms.filter(F.col("d") >= least_docs).select("lid", "term", "all_n", F.col("p.g").alias("gs"), F.col("p.n").alias("ns")), "postings")

    each = postings.select("lid", "term", "all_n", F.explode(F.arrays_zip("gs", "ns")).alias("x")).select("lid", "term", "all_n", F.col("x.gs").alias("g"), F.col("x.ns").alias("n"))
    kept = {r["lid"]: (r["v"], r["n"]) for r in postings.groupBy("lid").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("n")).collect()}
    own = {(r["lid"], r["g"]): r["n"] for r in each.groupBy("lid", "g").agg(F.sum("n").alias("n")).collect()}
    table = [(*numbers[k], *k, own.get(numbers[k], 0) + kept.get(numbers[k][0], (0, 0))[0], sum(kept.get(numbers[k][0], (0, 0))), size[k[0]]) for k in names]
    groups = F.broadcast(spark.createDataFrame(table, "lid int, g int, lang string, source string, total long, lang_total long, n_groups int"))
    totals = {lid: np.array([t[4] for t in table if t[0] == lid], np.int64) for lid in kept}

    with_groups = each.join(groups, ["lid", "g"]).select("lang", "source", "term", share(F.col("n"), F.col("total")).alias("p"), share(F.col("all_n"), F.col("lang_total")).alias("q"))
    terms_part = with_groups.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    found = pair_sums(postings, totals, heavy_share)
    none = groups.select("lid", F.col("g").alias("a"), F.explode(F.sequence(F.lit(0), F.col("n_groups") - 1)).alias("b"), F.lit(0).cast("long").alias("value")).filter("a <> b")
    summed = found.unionByName(none).groupBy("lid", "a", "b").agg(F.sum("value").alias("value"))
    of = lambda g, name: groups.select("lid", F.col("g").alias(g), F.col("source").alias(name), *(["lang"] if g == "a" else []))
    pairs_part = summed.join(of("a", "source"), ["lid", "a"]).join(of("b", "item"), ["lid", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part: part.withColumn("rank", F.row_number().over(by))
    return ranked(pairs_part).unionByName(ranked(terms_part).filter(F.col("rank") <= top))
