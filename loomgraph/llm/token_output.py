"""Token-id output (op 2): documents are encoded and written as token files in ascending doc_id order."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_dir, mapped, pieces, put_file, text_or_empty
from .elias_fano import TokenFile, dump_tokens

#: Parquet bytes of input to a token file.
FILE_BYTES = 8 << 20
#: Bytes of text that are split at once, and distinct units whose ids a Python worker keeps.
CHUNK, KEPT = 4 << 20, 700_000


class WordEncoder:
    """Encodes texts by a tokenizer, each distinct word once.

    The tokenizer's pieces never span white space (its pre-tokenizer drops it and its normalizer
    composes nothing across it), so a text's ids are its words' ids in a row. For the same reason an
    ASCII word's ids are those of its lower case without marks at its end, then those of the marks.
    Words whose number of pieces is plain are encoded many in a line and told apart by the pieces'
    ends; others one by one. ``safe`` is False for tokenizers of another kind: then whole texts are
    encoded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()
        probe = ["a  b\nc", " Ab, 12\tÉé's THE.\r\nx\v\fy?! ", "<|endoftext|> a", "It's re-use: U.S.A., 3.14"]
        self.safe = all(self._ids(p) == [i for w in p.split() for i in self._ids(w)] for p in probe)
        if self.safe:
            got, _ = self.encode(pa.array(probe))
            self.safe = got.tolist() == [i for p in probe for i in self._ids(p)]
            self._forget()

    def _forget(self) -> None:
        # Units are kept by a 64-bit hash in order, and their place in starts: 16 bytes each, where a dict of strings takes hundreds.
        self.keys, self.rows = np.array([xxhash.xxh64_intdigest("")], np.uint64), np.zeros(1, np.int64)
        self.starts, self.flat = np.array([0, 0], np.int64), np.empty(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if not self.safe:
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*got, np.empty(0, np.uint32)]), np.array([len(g) for g in got], np.int64)
        split = pc.ascii_split_whitespace(texts)
        words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        parts = self._places(coded.dictionary.to_pylist())
        unit = parts[coded.indices.to_numpy()].ravel() if len(parts) else np.empty(0, np.int64)
        size = self.starts[unit + 1] - self.starts[unit]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.starts[unit] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.append(0, ends[1::2])[np.append(0, np.cumsum(words))]
        return ids, np.diff(upto)

    def _places(self, words: list[str]) -> np.ndarray:
        """For each word the units of its stem and of its tail."""
        flat = [u for w in words for u in _parts(w)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat))
        every, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(every) > KEPT:
            self._forget()
        at = np.searchsorted(self.keys, every)
        new = self.keys[np.minimum(at, len(self.keys) - 1)] != every
        rows = self._learn([flat[i] for i in first[new].tolist()])
        self.keys, self.rows = np.insert(self.keys, at[new], every[new]), np.insert(self.rows, at[new], rows)
        return self.rows[np.searchsorted(self.keys, every)][place].reshape(-1, 2)

    def _learn(self, units: list[str]) -> np.ndarray:
        """Encodes units; their places in starts."""
        counts = [_pieces(u) for u in units]
        plain = [i for i, n in enumerate(counts) if n]
        other = [i for i, n in enumerate(counts) if not n]
        got, sizes, order = [self.flat], [], []
        for k in range(0, len(plain), 5000):
            some = plain[k : k + 5000]
            ids = np.array(self._ids("\n".join(units[i] for i in some)), np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([counts[i] for i in some])
            if not len(ends) or len(ends) != last[-1] or ends[-1] != len(ids):
                other += some
                continue
            got.append(ids)
            sizes.append(np.diff(np.append(0, ends[last - 1])))
            order += some
        if other:  # each is encoded by itself; the library takes them many at a time
            each = [e.ids for e in self.tokenizer.encode_batch_fast([units[i] for i in other], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
            got.append(np.fromiter(chain.from_iterable(each), np.uint32, int(sizes[-1].sum())))
        order += other
        rows = np.empty(len(units), np.int64)
        rows[order] = len(self.starts) - 1 + np.arange(len(order))
        self.flat = np.concatenate(got)
        if sizes:
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes)))
        return rows


def _parts(word: str) -> tuple[str, str]:
    """A word's stem and the marks at its end that are a piece of their own."""
    if not word.isascii() or "<|" in word or "'" in word:
        return word, ""
    stem = word.rstrip(".,;:!?")
    return (stem.lower(), word[len(stem) :]) if stem and stem[-1].isalnum() else (word, "")


_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def _pieces(unit: str) -> int:
    """How many pieces a unit is cut into; 0 if that isn't plain."""
    if unit.isascii():
        return len(_PIECE.findall(unit.lower())) if unit.isprintable() and "<|" not in unit else 0
    return int(unit.isalpha() and max(unit) < "\u0250" and "\u0130" not in unit)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker: what it knows only saves work."""
    return WordEncoder(path)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[pa.Array]:
    """Slices of about ``size`` bytes; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield texts.slice(at, to - at)
        at = to


@dataclass
class TokenFiles:
    """A folder of token files and, per file in order, what it holds: file, n_docs, n_ids (a table with one row a file)."""

    path: str
    files: DataFrame

    def digest(self) -> DataFrame:
        """Reads the files back: doc_id, start (over all files), n_tokens, ids_crc32 (of the ids as 32-bit integers)."""
        spark: SparkSession = self.files.sparkSession
        sizes = self.files.orderBy("file").select("file", "n_ids").toPandas()  # one row for each file
        start = dict(zip(sizes["file"], np.append(0, np.cumsum(sizes["n_ids"]))[: len(sizes)].tolist(), strict=True))
        given = spark.sparkContext.broadcast(start)

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for path, data in zip(b["path"], b["content"], strict=True):
                    f = TokenFile(data)
                    places = np.arange(f.documents)
                    bounds = f.bounds.select_many(np.append(places, f.documents))
                    known = pd.array(np.append(np.zeros(f.missing, np.int64), f.first + f.doc_ids.select_many(places[f.missing :] - f.missing)), "Int64")
                    known[: f.missing] = pd.NA
                    crc = [zlib.crc32(f.ids[i:j].astype("<u4").tobytes()) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pd.DataFrame({"doc_id": known, "start": bounds[:-1] + given.value[path.rsplit("/", 1)[1]], "n_tokens": np.diff(bounds), "ids_crc32": np.array(crc, np.int64)})

        out = "doc_id long, start long, n_tokens long, ids_crc32 long"
        if not len(sizes):
            return spark.createDataFrame([], out)
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.lgt").load(self.path).select("path", "content")
        return raw.mapInPandas(read, out)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> TokenFiles:
    """Encode every whole text and write token files in ascending doc_id order.

    Each document's ids end with ``end_id``; null and empty texts have that id alone. Rows of a
    null doc_id come first. Rows that repeat a doc_id, or have none, follow each other ordered by a
    hash of their text, which spreads them over files. An empty table gives no files. Other columns are ignored. Each file is
    the documents of one range of doc_ids; a task that is run again writes the same file.
    Texts of any length are taken whole.
    """
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(pieces(rows, FILE_BYTES), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, lengths, ids, missing = [], [], [], 0
        for b in batches:
            missing += b.column("doc_id").null_count
            doc_ids.append(b.column("doc_id").drop_null().to_numpy())
            for some in chunks(b.column("text")):
                got, n = encoder(tokenizer).encode(some)
                ids.append(np.insert(got, np.cumsum(n), end_id).astype(np.uint32))
                lengths.append(n + 1)
        if doc_ids:
            d, n, t = np.concatenate(doc_ids), np.concatenate(lengths), np.concatenate(ids)
            del ids
            name = f"{TaskContext.get().partitionId():08d}.lgt"
            put_file(path, name, dump_tokens(d, n, t, missing))
            yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(n)], "n_ids": [len(t)]})

    return TokenFiles(path, mapped(dealt, write, "file string, n_docs long, n_ids long", "token-files"))
