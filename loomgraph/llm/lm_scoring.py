"""LM scoring by a weighted backoff automaton (op 6).

The model is a smoothed trigram model of words. Its states are pairs of words, single words and the
empty context; a state has an arc with a weight for each word that was seen after it, and a failure
arc, with a weight too, to the state without its first word:

    p(w | u v) = (c(u v w) - D) / c(u v) + g(u v) p(w | v)   if seen, else g(u v) p(w | v)
    p(w | v)   = (c(v w) + M p(w)) / (c(v) + M)
    p(w)       = (c(w) + 1) / (N + V + 1)

with g(u v) the mass that the absolute discount D leaves; D is t1 / (t1 + 2 t2) of the triples seen once and twice. An unseen arc costs the failure weight, g(u v) or
M / (c(v) + M), and is sought again from the shorter state. One traversal of a text from left to
right carries the state and adds up log-probabilities.

The automaton of a whole corpus fits nowhere, but a block of texts only ever meets its own words,
pairs and triples. Texts are packed once into blocks (a row each, with a number of its own). A
block sends its distinct keys, with their counts in the training documents, to shards by ranges of
the keys' hashes; a pair brings the words that follow it, so its shard knows all of its arcs. A
shard adds up over all blocks and answers each block with the totals of its keys in order. Blocks
meet their answers by their number, build their part of the automaton and traverse their texts. A
key meets a shard once for each block, so frequent words are no hot keys, and no vocabulary is
broadcast. Shards grow in number with the input, and a block writes to a shard only if it has keys
there: there are never more messages than distinct keys of blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, mapped, pieces
from .token_output import chunks

#: Weight M of the single-word model in words.
PRIOR = 200.0
#: Bytes of text in a block, and Parquet bytes of input for each shard.
BLOCK_BYTES, SHARD_BYTES = 10 << 20, 5 << 20
END = np.uint64(xxhash.xxh64_intdigest(b"\x00end"))
BEGIN = np.uint64(xxhash.xxh64_intdigest(b"\x00begin"))
#: What follows an end, so that each pair, the last one too, is followed by something.
PAD = np.uint64(xxhash.xxh64_intdigest(b"\x00pad"))


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: a seventh, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words and an end after each text, tokens of each text)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
    real = np.fromiter((w != "" for w in known), bool, len(known))
    codes = coded.indices.to_numpy()
    keep = real[codes] if len(codes) else np.empty(0, bool)
    before = np.append(0, np.cumsum(keep))
    at = np.append(0, np.cumsum(lengths))
    count = before[at[1:]] - before[at[:-1]]
    return np.insert(each[codes[keep]] if len(codes) else np.empty(0, np.uint64), np.cumsum(count), END), count + 1


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 56-bit hash, in the upper bits, of an ordered pair of 64-bit hashes."""
    x = h * np.uint64(0x9E3779B97F4A7C15)
    x ^= w << np.uint64(31) | w >> np.uint64(33)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x &= np.uint64(0xFFFFFFFFFFFFFF00)
    return x


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, the place of each of ``keys`` among them, in 32 bits)."""
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, bool)
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], place


@dataclass
class Block:
    """Texts packed together: their words as numbers into ``words`` (ascending hashes), each text with an end."""

    doc_ids: list
    train: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    word: np.ndarray

    @cached_property
    def starts(self) -> np.ndarray:
        """Where each text starts among the arcs; a text has one arc more than tokens, from its last pair to PAD."""
        return np.append(0, np.cumsum(self.lengths + 1)[:-1]).astype(np.int64)

    @cached_property
    def arcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, pair before each token and PAD, arcs as pair's number and 32 bits of the word's hash, arc of each, word before each).

        Pairs and arcs are distinct and ascend. The number of words stands for BEGIN.
        """
        n = len(self.words)
        hashes = np.concatenate([self.words, [BEGIN, PAD]])
        at = np.insert(self.word, np.cumsum(self.lengths), n + 1)
        one = np.roll(at, 1)
        one[self.starts] = n
        two = np.roll(one, 1)
        two[self.starts] = n
        pairs, pair = numbered(pair_key(hashes[two], hashes[one]))
        del two
        key = pair.astype(np.uint64)
        key <<= np.uint64(32)
        key |= (hashes >> np.uint64(32))[at]
        del at
        arcs, arc = numbered(key)
        return pairs, pair, arcs, arc, one

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and each arc is in the block's training documents."""
        _, _, arcs, arc, _ = self.arcs
        return (
            np.bincount(self.word[np.repeat(self.train, self.lengths)], minlength=len(self.words)),
            np.bincount(arc[np.repeat(self.train, self.lengths + 1)], minlength=len(arcs)),
        )


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """A task's texts in blocks of about BLOCK_BYTES; a longer text is a block of its own."""
    ids, train, lengths, tokens, size = [], [], [], [], 0

    def made() -> Block:
        words, word = numbered(np.concatenate(tokens))
        tokens.clear()
        return Block(ids, np.concatenate(train).astype(bool), np.concatenate(lengths), words, word)

    for b in batches:
        at = 0
        for some in chunks(b.column("text")):
            own, n = word_hashes(some)
            tokens.append(own)
            lengths.append(n)
            ids += b.column("doc_id").slice(at, len(some)).to_pylist()
            train.append(b.column("train").slice(at, len(some)).to_numpy(zero_copy_only=False))
            at += len(some)
            size += some.nbytes
            if size >= BLOCK_BYTES:
                yield made()
                ids, train, lengths, tokens, size = [], [], [], [], 0
    if ids:
        yield made()


def pack(values: np.ndarray) -> bytes:
    """Integers from 0: their bytes of equal place together, without leading zeros, compressed."""
    values = np.asarray(values, np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return struct.pack("<QB", len(values), width) + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", data)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=n * width), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


def pack_keys(keys: np.ndarray, shift: int = 0) -> bytes:
    """Ascending 64-bit keys, whose last ``shift`` bits are 0, as the first and the steps between them."""
    keys = keys >> np.uint64(shift)
    return struct.pack("<Q", int(keys[0]) if len(keys) else 0) + pack(np.diff(keys))


def unpack_keys(data: bytes, n: int, shift: int = 0) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    return np.cumsum(np.append(np.uint64(struct.unpack_from("<Q", data)[0]), unpack(data[8:])), dtype=np.uint64) << np.uint64(shift)


def pack_words(words: np.ndarray, word: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending hashes and the texts' words as numbers into them. Frequent words take small numbers: hashes go by powers of two of their counts."""
    power = np.frexp(np.bincount(word, minlength=len(words)))[1]
    order = np.lexsort((words, -power))
    ends = np.searchsorted(-power[order], -np.arange(64, -1, -1), side="right")
    parts = [pack_keys(words[order[i:j]]) for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)]
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return several([ends]) + struct.pack(f"<{len(parts)}Q", *[len(p) for p in parts]) + b"".join(parts), pack(place[word])


def unpack_words(words: bytes, word: bytes) -> tuple[np.ndarray, np.ndarray]:
    (size,) = struct.unpack_from("<Q", words)
    ends = unpack(words[8 : 8 + size]).astype(np.int64)
    data, at = words[8 + size :], 8 * len(ends)
    found = []
    for n, length in zip(np.diff(np.append(0, ends)).tolist(), struct.unpack_from(f"<{len(ends)}Q", data), strict=True):
        found.append(unpack_keys(data[at : at + length], n))
        at += length
    own = np.concatenate(found)
    order = np.argsort(own)
    place = np.empty(len(own), np.int32)
    place[order] = np.arange(len(own), dtype=np.int32)
    return own[order], place[unpack(word).astype(np.int64)]


def cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where ascending keys pass from shard to shard; a shard is an equal range of the 64 bits."""
    edges = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


TEXTS = "block long, lengths binary, train binary, words binary, word binary"
REQUEST = pa.schema([("block", pa.int64()), ("shard", pa.int32()), *[(n, pa.int64()) for n in ("n_words", "n_pairs")], *[(n, pa.binary()) for n in ("words", "pairs", "fan", "next", "counts")]])
ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), *[(n, pa.binary()) for n in ("words", "pairs", "arcs")], *[(n, pa.int64()) for n in ("tokens", "types", "t1", "t2")]])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def one_row(schema: pa.Schema, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def packed(docs: DataFrame) -> DataFrame:
    """A row for each block: its number, doc_ids, lengths, training flags and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids = None
        for number, b in enumerate(blocks(batches)):
            ids = ids or pa.list_(id_type)
            row = [part << 24 | number, pack(b.lengths), pack(b.train), *pack_words(b.words, b.word), b.doc_ids]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), ids]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[*[c.split()[0] for c in TEXTS.split(", ")], "doc_ids"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return mapped(dealt(docs), run, f"{TEXTS}, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>", "blocks")


def block_of(row: dict) -> Block:
    return Block(row["doc_ids"], unpack(row["train"]).astype(bool), unpack(row["lengths"]).astype(np.int64), *unpack_words(row["words"], row["word"]))


def requests(texts: DataFrame, shards: int) -> DataFrame:
    """A row for each block and shard where it has keys: ascending words and pairs, the words after each pair, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = block_of(row)
                pairs, _, arcs, _, _ = b.arcs
                in_words, in_arcs = b.counts()
                first = np.searchsorted(arcs, np.arange(len(pairs) + 1, dtype=np.uint64) << np.uint64(32))
                a, c = cuts(b.words, shards), cuts(pairs, shards)
                for s in range(shards):
                    w, p, x = slice(a[s], a[s + 1]), slice(c[s], c[s + 1]), slice(first[c[s]], first[c[s + 1]])
                    if a[s] == a[s + 1] and c[s] == c[s + 1]:
                        continue
                    fan = np.diff(first[c[s] : c[s + 1] + 1])
                    yield one_row(REQUEST, [row["block"], s, a[s + 1] - a[s], c[s + 1] - c[s], pack_keys(b.words[w]), pack_keys(pairs[p], 8), pack(fan), arcs[x].astype("<u4").tobytes(), pack(np.append(in_words[w], in_arcs[x]))])

    return texts.mapInArrow(run, ddl(REQUEST))


def answers(asked: DataFrame, shards: int) -> DataFrame:
    """A row for each request: totals of its words, of its pairs (and how many arcs they have) and of its arcs.

    A shard's first row has its tokens, types and numbers of arcs with totals of 1 and 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                rows.setdefault(r["shard"], []).append(r)
        for own in rows.values():
            yield from answered(own)

    return asked.repartitionById(shards, F.col("shard")).mapInArrow(run, ddl(ANSWER))


def answered(own: list[dict]) -> Iterator[pa.RecordBatch]:
    """The answers to all requests to a shard."""
    counts = [unpack(r["counts"]) for r in own]
    n_words = np.array([r["n_words"] for r in own])
    words, place = np.unique(np.concatenate([unpack_keys(r["words"], r["n_words"]) for r in own]), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([c[:n] for c, n in zip(counts, n_words, strict=True)]).astype(float), minlength=len(words)).astype(np.int64)
    tokens, types = int(total.sum()), int((total > 0).sum())
    of_words = np.split(total[place], np.cumsum(n_words)[:-1])

    pairs, pair = np.unique(np.concatenate([unpack_keys(r["pairs"], r["n_pairs"], 8) for r in own]), return_inverse=True)
    fans = np.concatenate([unpack(r["fan"]) for r in own]).astype(np.int64)
    n_arcs = np.array([len(r["next"]) // 4 for r in own])
    key = np.repeat(pair.astype(np.uint64), fans) << np.uint64(32) | np.concatenate([np.frombuffer(r["next"], "<u4") for r in own]).astype(np.uint64)
    arcs, place = np.unique(key, return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([c[n:] for c, n in zip(counts, n_words, strict=True)]).astype(float), minlength=len(arcs)).astype(np.int64)
    owner = (arcs >> np.uint64(32)).astype(np.int64)
    of_pair = [np.bincount(owner, weights=total.astype(float), minlength=len(pairs))]
    of_pair.append(np.bincount(owner[total > 0], minlength=len(pairs)))
    each = [np.split(v.astype(np.int64)[pair], np.cumsum([r["n_pairs"] for r in own])[:-1]) for v in of_pair]
    of_arcs = np.split(total[place], np.cumsum(n_arcs)[:-1])
    numbers = [tokens, types, int((total == 1).sum()), int((total == 2).sum())]
    for i, r in enumerate(own):
        yield one_row(ANSWER, [r["block"], r["shard"], pack(of_words[i]), several([v[i] for v in each]), pack(of_arcs[i]), *(numbers if i == 0 else [0] * 4)])


def several(arrays: list[np.ndarray]) -> bytes:
    parts = [pack(a) for a in arrays]
    return struct.pack(f"<{len(parts)}Q", *[len(p) for p in parts]) + b"".join(parts)


def unpack_several(data: bytes, n: int) -> list[np.ndarray]:
    ends = np.cumsum([8 * n, *struct.unpack_from(f"<{n}Q", data)]).tolist()
    return [unpack(data[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]


@dataclass(frozen=True)
class Totals:
    """Of the training documents: their number, tokens, distinct tokens, and the discount of triples; ``prior`` is M."""

    docs: int
    tokens: int
    types: int
    discount: float
    prior: float = PRIOR


def discount(once: int, twice: int) -> float:
    """From the numbers of triples seen once and twice; a half without any."""
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5


class Automaton:
    """A block's part of the model.

    States are numbers: 0 is the empty context, then the block's words and BEGIN, then its pairs.
    ``fail`` and ``fail_weight`` have each state's failure arc. Arcs of the three orders stand by
    the places of the texts, where they can be followed: whether they were seen, their weights and
    where they lead.
    """

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, followed: np.ndarray, arcs: np.ndarray, totals: Totals):
        self.block = block
        _, pair, _, arc, before = block.arcs
        n = len(words)
        c = np.append(words, totals.docs).astype(float)  # the last is BEGIN
        real = np.ones(len(arc), bool)
        real[block.starts + block.lengths] = False  # the arcs to PAD are not followed
        at = np.flatnonzero(real)
        word, prev, own, after = block.word, before[at], pair[at], pair[at + 1]
        one = (words + 1.0) / (totals.tokens + 1 * (totals.types + 1))
        seen = pairs[after].astype(float)
        two = (seen + totals.prior * one[word]) / (c[prev] + totals.prior)
        mass = np.maximum(pairs, 1).astype(float)
        left = totals.discount * followed / mass
        times = arcs[arc[at]].astype(float)
        three = np.maximum(times - totals.discount, 0) / mass[own] + left[own] * two
        with np.errstate(divide="ignore"):
            self.fail_weight = np.concatenate([[0.0], np.log10(totals.prior / (c + totals.prior)), np.log10(left)])
            self.weights = np.log10(three), np.log10(two), np.log10(one)[word]
        last = np.zeros(len(pairs), np.int64)
        last[own] = prev
        self.fail = np.concatenate([np.zeros(n + 2, np.int64), 1 + last])
        self.seen = times > 0, seen > 0
        self.pair_states = n + 2
        self.to_pair, self.to_word = n + 2 + after.astype(np.int64), np.where(words[word] > 0, 1 + word, 0)
        self.known, self.start = words[word] > 0, np.where(totals.docs > 0, n + 2 + pair[block.starts].astype(np.int64), 0)

    def traverse(self) -> np.ndarray:
        """log10 probability of each text: all texts go on by a word at a time, each in its state."""
        lengths = self.block.lengths
        order = np.argsort(-lengths, kind="stable")
        first = np.append(0, np.cumsum(lengths)[:-1])[order]
        live = len(order) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), side="right")
        state, total = self.start[order].copy(), np.zeros(len(order))
        for k, m in enumerate(live.tolist()):
            at, s = first[:m] + k, state[:m]
            in_pair = s >= self.pair_states
            three = in_pair & self.seen[0][at]
            cost = np.where(in_pair & ~three, self.fail_weight[s], 0.0)
            s = np.where(in_pair & ~three, self.fail[s], s)
            two = ~three & (s > 0) & self.seen[1][at]
            one = ~three & ~two
            cost += np.where(one, self.fail_weight[s], 0.0)
            cost += np.where(three, self.weights[0][at], np.where(two, self.weights[1][at], self.weights[2][at]))
            total[:m] += cost
            state[:m] = np.where(one, self.to_word[at], self.to_pair[at])
        out = np.empty(len(order))
        out[order] = total
        return out


def score_texts(docs: DataFrame, held: Column | None = None, prior: float = PRIOR) -> DataFrame:
    """A row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are separated by ASCII white space, with A-Z in lower case; each text has one end more,
    which counts as a token. Learns from all rows that are not ``held``. Null texts count as empty:
    an end alone. Repeated rows count and are scored each; null doc_ids are learned from and stay
    null; doc_ids keep their type; other columns are ignored; an empty table gives an empty result.
    base_score is by single words, score by the automaton; both are log10 of probabilities.
    Texts of any length are taken whole.
    """
    held = held_out(F.col("doc_id")) if held is None else held
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (~held).alias("train"))
    shards = pieces(docs, SHARD_BYTES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = packed(docs)
    found = cut(answers(requests(texts, shards), shards), "answers")
    got = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "t1", "t2")]).first()
    n_blocks, train_docs = texts.count(), docs.filter("train").count()
    totals = Totals(train_docs, got["tokens"], got["types"], discount(got["t1"], got["t2"]), prior)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        b = block_of(left.to_pylist()[0])
        rows = sorted(right.to_pylist(), key=lambda r: r["shard"])
        words, arcs = (np.concatenate([unpack(r[c]) for r in rows]).astype(np.int64) for c in ("words", "arcs"))
        pairs, followed = (np.concatenate(v).astype(np.int64) for v in zip(*[unpack_several(r["pairs"], 2) for r in rows], strict=True))
        a = Automaton(b, words, pairs, followed, arcs, totals)
        first = np.append(0, np.cumsum(b.lengths)[:-1])
        columns = [pa.array(b.doc_ids, id_type), pa.array(~b.train), pa.array(b.lengths), pa.array(np.add.reduceat(a.known.astype(np.int64), first)), pa.array(np.add.reduceat(a.weights[2], first)), pa.array(a.traverse())]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    parts = max(1, n_blocks)
    both = texts.repartition(parts, "block").groupBy("block").cogroup(found.drop("tokens", "types", "t1", "t2").repartition(parts, "block").groupBy("block"))
    scored = cut(both.applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
