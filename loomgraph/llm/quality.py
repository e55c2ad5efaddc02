"""Quality classifier by the perplexity of an interpolated modified Kneser-Ney trigram model (op 7).

The model is trained on trusted text: documents labelled of good quality and not toxic, every second
one of them; the others set its limits. Tokens are words of a vocabulary of the language, taken from
it; other words stand for their shape. A word that repeats the one before it is ``<same>``, and from
the second repetition on it is unknown, which no trusted text is: n-grams alone find a run of one
frequent word likely.

Trigrams go to shards by their language and middle word, so a shard has all that the probability of
its trigrams depends on but single words: the pairs that start with the middle word and the contexts
that end with it. Blocks of documents send their distinct trigrams there, and the answers, a logarithm
for each, come back to the block. No task holds more of the model than a shard. A document is rejected
above the limit of its language, a quantile of all trusted documents that the model has not seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, dealt, fresh_dir, if_small, mapped, pieces, put_file, sampled, store
from .lm_scoring import pack, pack_keys, several, unpack, unpack_keys, unpack_several
from .token_output import chunks

#: The model of all languages, for those with few trusted documents or none.
ANY = "*"
#: Bits of a token's number in an n-gram's key.
WIDTH = 16
UNKNOWN, START, STOP, SAME = 0, 1, 2, 3
#: Bytes of text in a block, and Parquet bytes of input for each shard.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 5 << 20
#: Logarithms of probabilities travel as whole numbers of so small a part.
PART = 1 << 18
#: Trigrams of a shard that are added up at once.
ADDED = 1 << 22
#: Ranks that a quantile over all trusted documents tells apart.
RANKS = 20_000
# Shapes of words outside the vocabulary, each with and without an ending mark.
SHAPES = ("lower", "Title", "UPPER", "mixed", "number", "marks", "other")
MARKS = ".,;:!?"
FIRST_SHAPE = 4
FIRST_WORD = FIRST_SHAPE + 2 * len(SHAPES)


def shape(word: str) -> int:
    """The number of a word's shape."""
    core = word.strip(".,;:!?\"'()[]")
    if not any(c.isalnum() for c in core):
        name = "marks"
    elif core.isalpha():
        name = "lower" if core.islower() else "Title" if core[0].isupper() and (len(core) == 1 or core[1:].islower()) else "UPPER" if core.isupper() else "mixed"
        if not (core.islower() or core[0].isupper() or core.isupper()) and core.lower() == core.upper():
            name = "lower"  # scripts without case
    else:
        name = "number" if any(c.isdigit() for c in core) else "other"
    return FIRST_SHAPE + 2 * SHAPES.index(name) + (word[-1] in MARKS)


def token_numbers(texts: pa.Array, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts, each with a stop after its words; tokens of each)."""
    split = pc.ascii_split_whitespace(texts)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    number = np.fromiter((vocabulary.get(w) or (shape(w) if w else -1) for w in words), np.int64, len(words))
    codes = coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    keep = number[codes] >= 0 if len(codes) else np.empty(0, bool)
    codes, text = codes[keep], text[keep]
    again = np.append(False, (codes[1:] == codes[:-1]) & (text[1:] == text[:-1]))[: len(codes)]
    more = again & np.append(False, again[:-1])[: len(codes)]
    tokens = np.where(more, UNKNOWN, np.where(again, SAME, number[codes] if len(codes) else codes))
    count = np.bincount(text, minlength=len(lengths))
    return np.insert(tokens, np.cumsum(count), STOP), count + 1


def contexts(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each and the one before that; START before a text."""
    first = np.append(0, np.cumsum(lengths)[:-1]).astype(np.int64)
    b = np.roll(tokens, 1)
    b[first] = START
    a = np.roll(b, 1)
    a[first] = START
    return a, b


def trigrams(tokens: np.ndarray, lengths: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """The key of each token's trigram: the text's language, the middle word, the first and the last."""
    a, b = contexts(tokens, lengths)
    return ((np.repeat(lang, lengths) << WIDTH | b) << WIDTH | a) << WIDTH | tokens


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys in their order) by a hash of the keys' language and middle word."""
    own = ((keys >> 2 * WIDTH).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)
    order = np.argsort(own, kind="stable")
    numbers, first = np.unique(own[order], return_index=True)
    yield from zip(numbers.tolist(), np.split(order, first[1:]), strict=True)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate([n for _, n in parts]).astype(float), minlength=len(keys)).astype(np.int64)


def discounts(n: np.ndarray) -> list[float]:
    """By a count of 0 to 3 and more, from how many n-grams have counts of 1 to 4; half of the count where they tell nothing."""
    n = [0, *n.tolist()]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.0
    return [0.0, *[min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i - 0.05) if n[i] * n[i + 1] else i * 0.5 for i in (1, 2, 3)]]


class Grams:
    """A shard of the model: ``levels`` has its pairs, with how many words come before, and its trigrams with their counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        pairs = np.unique(keys >> 2 * WIDTH << WIDTH | keys & (1 << WIDTH) - 1, return_counts=True)
        self.levels = [pairs, (keys, n)]

    def probabilities(self, keys: np.ndarray, p: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Of trigrams, whose last words alone have the probabilities ``p``; ``d`` has the discounts by level, language and count."""
        lang = keys >> 3 * WIDTH
        asked = keys >> 2 * WIDTH << WIDTH | keys & (1 << WIDTH) - 1, keys
        for (known, n), off, q in zip(self.levels, d, asked, strict=True):
            if not len(known):
                continue
            of, start = np.unique(known >> WIDTH, return_index=True)
            every = np.add.reduceat(n, start)
            weight = np.add.reduceat(off[known >> (3 if q is keys else 2) * WIDTH, np.minimum(n, 3)], start) / every
            at = np.minimum(np.searchsorted(of, q >> WIDTH), len(of) - 1)
            place = np.minimum(np.searchsorted(known, q), len(known) - 1)
            count = np.where(known[place] == q, n[place], 0)
            held = np.maximum(count - off[lang, np.minimum(count, 3)], 0.0) / every[at]
            p = np.where(of[at] == q >> WIDTH, held + weight[at] * p, p)
        return p


@dataclass
class QualityModel:
    """Vocabulary by number of language; number of each language; the trigrams' written shards; probabilities of single words by language and number; discounts by level, language and count; per language the mean and the limit."""

    vocabulary: list[dict[str, int]]
    langs: dict[str, int]
    shards: int
    grams: DataFrame | None = None
    one: list[np.ndarray] = field(default_factory=list)
    discounts: np.ndarray = field(default_factory=lambda: np.zeros((2, 1, 4)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    limit: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def without_grams(self) -> QualityModel:
        """What every task gets."""
        return replace(self, grams=None)

    def lang_numbers(self, langs: list) -> np.ndarray:
        return np.array([self.langs.get(x, self.langs[ANY]) for x in langs], np.int64)

    def log_of(self, grams: Grams, keys: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of trigrams of one shard."""
        first = np.append(0, np.cumsum([len(x) for x in self.one]))[keys >> 3 * WIDTH]
        return np.log(grams.probabilities(keys, np.concatenate(self.one)[first + (keys & (1 << WIDTH) - 1)], self.discounts))

    def log_probabilities(self, tokens: np.ndarray, lengths: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The sum over each text of the natural logarithms of its tokens' probabilities, for a few texts and a model that fit one process."""
        keys, place = np.unique(trigrams(tokens, lengths, lang), return_inverse=True)
        rows = self.grams.select("n", "keys", "counts").collect()
        parts = [(unpack_keys(r["keys"], r["n"]).astype(np.int64), unpack(r["counts"]).astype(np.int64)) for r in rows]
        grams = Grams(*summed(parts)) if parts else Grams(*NOTHING)
        return np.add.reduceat(self.log_of(grams, keys)[place], np.append(0, np.cumsum(lengths)[:-1]))


NOTHING = np.empty(0, np.int64), np.empty(0, np.int64)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents labelled of good quality and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()


def trusted_sample(docs: DataFrame, labels: DataFrame, per_lang: int | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, lang, text, fit): all trusted documents; every second, by a hash of the doc_id, is not for fitting.

    Null langs count as the lang ``*``. Of rows that repeat a doc_id and lang one is taken: that of the smallest hash of its text.
    Given ``per_lang`` or ``most``, at most so many of each lang or in all, chosen by a hash of the doc_id.
    """
    rows = docs.filter("text is not null").select("doc_id", F.coalesce("lang", F.lit(ANY)).alias("lang"), "text")
    trusted = rows.join(if_small(trusted_ids(labels)), "doc_id", "left_semi")
    if per_lang is None and most is None:
        again = if_small(trusted.groupBy("doc_id", "lang").count().filter("count > 1").select("doc_id", "lang"))
        got = trusted
        if not again.isEmpty():  # no text moves but those of repeated ids
            one = trusted.join(again, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
            got = trusted.join(again, ["doc_id", "lang"], "left_anti").unionByName(one)
    else:
        every = (1 << 31) - 1
        got = sampled(rows, "lang", "trusted", per_lang or most, most or every, trusted.select("doc_id", "lang"))
    return got.select("doc_id", "lang", "text", (F.xxhash64(F.lit("fit"), "doc_id") % 2 == 0).alias("fit"))


def vocabulary_of(sample: DataFrame, langs: dict[str, int], size: int, size_any: int, least: int) -> list[dict[str, int]]:
    """For each language's number, numbers of the ``size`` commonest of its words that occur ``least`` times in the texts for fitting; for that of all, ``size_any``."""
    if max(size, size_any) > (1 << WIDTH) - FIRST_WORD:
        raise ValueError("more words than numbers")
    own = F.lit(None).cast("int")
    for lang, number in langs.items():
        own = F.when(F.col("lang") == lang, F.lit(number)).otherwise(own)
    each = F.explode(F.array_distinct(F.array_compact(F.array(own, F.lit(langs[ANY])))))
    words = sample.filter("fit").select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")).filter("w <> ''").groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    counted = words.select(each.alias("number"), "w", "n").groupBy("number", "w").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    w = Window.partitionBy("number").orderBy(F.desc("n"), "w")
    ranked = counted.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(size, size_any)).filter(F.col("r") <= F.when(F.col("number") == langs[ANY], size_any).otherwise(size))
    found: list[dict[str, int]] = [{} for _ in langs]
    for r in ranked.select("number", "w", "r").collect():  # at most `size` a language
        found[r["number"]][r["w"]] = FIRST_WORD + r["r"] - 1
    return found


#: Trigrams of a block and shard, or all of a shard.
COUNTS = "shard int, n long, keys binary, counts binary"


def gram_counts(sample: DataFrame, vocabulary: list[dict[str, int]], langs: dict[str, int], shards: int) -> DataFrame:
    """COUNTS: how often each trigram of known tokens is in the texts for fitting, by language; all count for ``*`` too. Rows of blocks and shards."""
    given = sample.sparkSession.sparkContext.broadcast((vocabulary, langs))

    def made(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, n = summed(held)
        for shard, at in by_shard(keys, shards):
            yield pa.RecordBatch.from_pylist([{"shard": shard, "n": len(at), "keys": pack_keys(keys[at].astype(np.uint64)), "counts": pack(n[at])}], schema=arrow_schema(COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, numbers = given.value
        held, size = [], 0
        for batch in batches:
            at = 0
            for some in chunks(batch.column("text")):
                names = batch.column("lang").slice(at, len(some)).to_pylist()
                at += len(some)
                size += some.nbytes
                for lang in {ANY, *names} & set(numbers):
                    rows = [i for i, x in enumerate(names) if lang in (ANY, x)]
                    tokens, lengths = token_numbers(some.take(pa.array(rows)), vocab[numbers[lang]])
                    keys = trigrams(tokens, lengths, np.full(len(rows), numbers[lang]))
                    held.append(np.unique(keys[tokens != UNKNOWN], return_counts=True))
                if size >= BLOCK_BYTES:
                    yield from made(held)
                    held, size = [], 0
        if held:
            yield from made(held)

    return dealt(sample.filter("fit").select("lang", "text")).mapInArrow(run, COUNTS)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def shard_rows(counts: DataFrame, shards: int) -> DataFrame:
    """A row for each shard: its trigrams, of_counts (how many of its pairs and trigrams have counts of 1 to 4, by level and language) and words (how many words are before each)."""

    def row(shard: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, n = summed(held)
        tell, (pairs, before) = [], Grams(keys, n).levels[0]
        for level, (known, times) in enumerate(((pairs >> 2 * WIDTH, before), (keys >> 3 * WIDTH, n))):
            kind, many = np.unique((known * 5 + times)[times <= 4], return_counts=True)
            tell += [{"level": level, "lang": int(k) // 5, "times": int(k) % 5, "m": int(m)} for k, m in zip(kind, many, strict=True)]
        word, m = np.unique(pairs >> 2 * WIDTH << WIDTH | pairs & (1 << WIDTH) - 1, return_counts=True)
        values = {"shard": shard, "n": len(keys), "keys": pack_keys(keys.astype(np.uint64)), "counts": pack(n), "of_counts": tell, "words": [{"word": int(k), "m": int(x)} for k, x in zip(word, m, strict=True)]}
        return pa.RecordBatch.from_pylist([values], schema=schema)

    schema = arrow_schema(COUNTS)
    schema = schema.append(pa.field("of_counts", pa.list_(pa.struct([("level", pa.int32()), ("lang", pa.int32()), ("times", pa.int32()), ("m", pa.int64())]))))
    schema = schema.append(pa.field("words", pa.list_(pa.struct([("word", pa.int64()), ("m", pa.int64())]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size, most = -1, [], 0, ADDED
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    if held:
                        yield row(shard, held)
                    shard, held, size, most = r["shard"], [], 0, ADDED
                held.append((unpack_keys(r["keys"], r["n"]).astype(np.int64), unpack(r["counts"]).astype(np.int64)))
                size += r["n"]
                if size > most:
                    held = [summed(held)]
                    size = len(held[0][0])
                    most = max(ADDED, 2 * size)
        if held:
            yield row(shard, held)

    dealt_rows = counts.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    return mapped(dealt_rows, run, f"{COUNTS}, of_counts array<struct<level: int, lang: int, times: int, m: bigint>>, words array<struct<word: bigint, m: bigint>>", "grams")


def smoothed(model: QualityModel) -> None:
    """Sets the discounts and the single words' probabilities from sums over the shards: some numbers a language, and one for each of its vocabulary."""
    n = np.zeros((2, len(model.langs), 4), np.int64)
    for r in model.grams.select(F.explode("of_counts").alias("c")).select("c.*").groupBy("level", "lang", "times").agg(F.sum("m").alias("m")).collect():
        n[r["level"], r["lang"], r["times"] - 1] = r["m"]
    model.discounts = np.array([[discounts(x) for x in level] for level in n])
    before = [np.zeros(FIRST_WORD + len(v), np.int64) for v in model.vocabulary]
    for r in model.grams.select(F.explode("words").alias("w")).select("w.*").groupBy("word").agg(F.sum("m").alias("m")).collect():
        before[r["word"] >> WIDTH][r["word"] & (1 << WIDTH) - 1] = r["m"]
    model.one = []
    for m in before:
        d = np.array(discounts(np.bincount(m[m <= 4], minlength=5)[1:]))[np.minimum(m, 3)]
        rest = d.sum() / max(1, m.sum()) / ((m > 0).sum() + 1)
        model.one.append(np.maximum(m - d, 0) / max(1, m.sum()) + rest if m.any() else np.full(len(m), np.exp(-12.0)))


def fit(docs: DataFrame, labels: DataFrame, **parameters) -> QualityModel | None:
    """The model of learned() alone."""
    return learned(docs, labels, **parameters)[0]


def learned(docs: DataFrame, labels: DataFrame, per_lang: int | None = None, most: int | None = None, words: int = 2000, words_any: int = 16_000, least: int = 20, few: int = 40, quantile: float = 0.995, slack: float = 1.25, prior: float = 20.0) -> tuple[QualityModel | None, DataFrame | None]:
    """The model, and each row's doc_id, lang, given (has a text), text_key, model, n_tokens and perplexity without prior.

    The n-grams and words are learned from every second trusted document (of a sample, if ``per_lang`` or
    ``most`` is given, which bound it); a language has ``words`` words of its own, all others are told by
    their shapes; languages with under ``few`` documents take the model of all. The mean of a language is
    that of all trusted documents not used for fitting, and the limit the ``quantile`` of their
    perplexities, times ``slack``. None and None if no document is trusted.
    """
    sample = trusted_sample(docs, labels, per_lang, most)
    sample = sample if per_lang is None and most is None else cut(sample, "sample")
    ids = cut(sample.select("doc_id", "lang", "fit"), "trusted")
    known = [r["lang"] for r in ids.groupBy("lang").count().filter(F.col("count") >= few).orderBy("lang").collect()]  # a row a language
    if ids.isEmpty():
        return None, None
    langs = {lang: i for i, lang in enumerate([ANY, *[x for x in known if x != ANY]])}
    vocabulary = vocabulary_of(sample, langs, words, words_any, least)
    if len(langs) >= 1 << 63 - 3 * WIDTH:
        raise ValueError("more languages than numbers")
    shards = pieces(docs.select("text"), SHARD_BYTES)
    model = QualityModel(vocabulary, langs, shards, shard_rows(gram_counts(sample, vocabulary, langs, shards), shards))
    smoothed(model)
    rows = docs.select("doc_id", "lang", F.col("text").isNotNull().alias("given"), text_key().alias("text_key"), F.lit(False).alias("again"), "text")
    scores = scored(rows, model, others_of(sample, ids, rows))
    set_limits(model, held_out(scores, labels, ids), quantile, slack, prior)
    return model, scores.filter("not again").drop("again")


def others_of(sample: DataFrame, ids: DataFrame, rows: DataFrame) -> DataFrame:
    """The trusted documents not used for fitting (all, if all were used) once more as rows like ``rows``, under the language ``*``."""
    others = sample.filter("not fit")
    others = sample if ids.filter("not fit").isEmpty() else others
    key = F.lit(None).cast(rows.schema["text_key"].dataType).alias("text_key")
    return others.select("doc_id", F.lit(ANY).alias("lang"), F.lit(True).alias("given"), key, F.lit(True).alias("again"), "text")


def text_key() -> Column:
    """What the judgement depends on, in 128 bits: two rows of equal lang and text have one."""
    return F.struct(F.xxhash64(F.lit("a"), "lang", "text").alias("a"), F.xxhash64(F.lit("b"), "text", "lang").alias("b"))


def held_out(scores: DataFrame, labels: DataFrame, ids: DataFrame) -> DataFrame:
    """(model, n_tokens, nll): a row for each trusted document not used for fitting, by its language's model; all trusted ones if all were used.

    The model of all languages is held against those too that have none of their own, and against
    the part of the sample that it was not fitted to (``again``).
    """
    trusted = scores.filter("given and not again").withColumn("lang", F.coalesce("lang", F.lit(ANY))).join(if_small(trusted_ids(labels)), "doc_id", "left_semi")
    fitted = if_small(ids.filter("fit").select("doc_id", "lang").distinct())
    rest = trusted.join(fitted, ["doc_id", "lang"], "left_anti")
    rest = cut(trusted if rest.isEmpty() else rest, "held-out")
    return rest.select("model", "n_tokens", "perplexity").unionByName(scores.filter("again").select("model", "n_tokens", "perplexity")).selectExpr("model", "n_tokens", "ln(perplexity) as nll")


def set_limits(model: QualityModel, held: DataFrame, quantile: float, slack: float, prior: float) -> None:
    """Sets the means and limits; languages with no row in ``held`` take those of all languages."""
    held = cut(held, "held")
    model.mean = np.zeros(len(model.langs))
    for r in held.groupBy("model").agg((F.sum(F.col("nll") * F.col("n_tokens")) / F.sum("n_tokens")).alias("mean")).collect():  # a row a language
        model.mean[r["model"]] = r["mean"]
    nll = drawn(F.col("nll"), F.col("model"), model, prior)
    model.limit = np.full(len(model.langs), np.inf)
    for r in held.groupBy("model").agg(F.percentile_approx(nll, quantile, RANKS).alias("limit")).collect():
        model.limit[r["model"]] = np.exp(r["limit"]) * slack
    model.mean[~np.isfinite(model.limit)] = model.mean[0]
    model.limit[~np.isfinite(model.limit)] = model.limit[0]


def drawn(nll: Column, number: Column, model: QualityModel, prior: float) -> Column:
    """The logarithm of a perplexity of n_tokens tokens, drawn to the mean of the model of that number as by ``prior`` tokens of it."""
    n = F.col("n_tokens")
    return (nll * n + prior * by_model(model.mean, number)) / (n + prior)


def by_model(values: np.ndarray, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in values]), (number + 1).cast("int"))


def packed(docs: DataFrame, model: QualityModel, folder: str) -> DataFrame:
    """(block, file, rows), written: of each block the file in ``folder`` of its texts' models, lengths and tokens, and the texts' other columns."""
    given = docs.sparkSession.sparkContext.broadcast(model.without_grams())
    others = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in others)

    def made(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]]) -> pa.RecordBatch:
        name = uuid.uuid4().hex
        put_file(folder, name, several([np.concatenate([h[i] for h in held]) for i in range(3)]))
        rows = pa.concat_arrays([h[3] for h in held])
        whole = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        return pa.RecordBatch.from_arrays([pa.array([name]), whole], names=["file", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, size = given.value, [], 0
        for batch in batches:
            at = 0
            for some in chunks(batch.column("text")):
                part = batch.slice(at, len(some))
                at += len(some)
                size += some.nbytes
                langs = m.lang_numbers(part.column("lang").to_pylist())
                for own in np.unique(langs):
                    rows = pa.array(np.flatnonzero(langs == own))
                    tokens, lengths = token_numbers(some.take(rows).fill_null(""), m.vocabulary[own])
                    columns = part.select(others).take(rows)
                    held.append((np.full(len(rows), own), lengths, tokens, pa.StructArray.from_arrays(columns.columns, fields=list(columns.schema))))
                if size >= BLOCK_BYTES:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return mapped(dealt(docs), run, f"file string, rows array<struct<{kinds}>>", "blocks")


def block_of(folder: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths of the texts, their models, the trigrams of all tokens) of a block."""
    fs, path = store(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        lang, lengths, tokens = (x.astype(np.int64) for x in unpack_several(f.read(), 3))
    return lengths, lang, trigrams(tokens, lengths, lang)


def requests(blocks: DataFrame, folder: str, shards: int) -> DataFrame:
    """The distinct trigrams of each block (file), by shard."""
    out = pa.schema([("file", pa.string()), *arrow_schema(COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                keys = np.unique(block_of(folder, name)[2])
                for shard, at in by_shard(keys, shards):
                    yield pa.RecordBatch.from_pylist([{"file": name, "shard": shard, "n": len(at), "keys": pack_keys(keys[at].astype(np.uint64)), "counts": None}], schema=out)

    return blocks.mapInArrow(run, f"file string, {COUNTS}")


def answers(asked: DataFrame, model: QualityModel) -> DataFrame:
    """(file, shard, answer): the logarithms of the probabilities of the trigrams that blocks ask for. A shard's trigrams come first, then a block's at a time."""
    given = asked.sparkSession.sparkContext.broadcast(model.without_grams())
    out = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("answer", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, shard, grams = given.value, -1, Grams(*NOTHING)
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                keys = unpack_keys(r["keys"], r["n"]).astype(np.int64)
                if r["shard"] != shard:
                    shard, grams = r["shard"], Grams(*NOTHING)
                if r["file"] is None:
                    grams = Grams(keys, unpack(r["counts"]).astype(np.int64))
                    continue
                values = {"file": r["file"], "shard": shard, "answer": pack(np.rint(-PART * m.log_of(grams, keys)).astype(np.int64))}
                yield pa.RecordBatch.from_pylist([values], schema=out)

    both = model.grams.select(F.lit(None).cast("string").alias("file"), "shard", "n", "keys", "counts").unionByName(asked)
    both = both.repartitionById(model.shards, F.col("shard")).sortWithinPartitions("shard", "file")  # nulls first
    return both.mapInArrow(run, "file string, shard int, answer binary")


def scored(docs: DataFrame, model: QualityModel, more: DataFrame) -> DataFrame:
    """The columns other than text of ``docs`` and ``more``, with model (the number of the language's), n_tokens and the perplexity by it.

    What a block's texts are made of stays in its file; the shuffles have its distinct trigrams and their answers.
    """
    others = [c for c in docs.columns if c != "text"]
    folder, shards = fresh_dir(docs.sparkSession, "tokens"), model.shards
    blocks = packed(docs, model, folder).unionByName(packed(more, model, folder))
    parts = max(1, blocks.count())
    found = answers(requests(blocks.select("file").repartition(parts, "file"), folder, shards), model)

    def judged(name: str, rows: pa.StructArray, got: dict[int, bytes]) -> pa.RecordBatch:
        lengths, lang, every = block_of(folder, name)
        keys, place = np.unique(every, return_inverse=True)
        log = np.empty(len(keys))
        for shard, at in by_shard(keys, shards):
            log[at] = unpack(got[shard])
        total = np.add.reduceat(log[place], np.append(0, np.cumsum(lengths)[:-1])) / PART
        return pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(lang), pa.array(lengths), pa.array(np.exp(total / lengths))], names=[*others, "model", "n_tokens", "perplexity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, got = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                if (shard := batch.column("shard")[i].as_py()) >= 0:
                    got[shard] = batch.column("answer")[i].as_py()
                    continue
                if block is not None:
                    yield judged(*block, got)
                block, got = (batch.column("file")[i].as_py(), batch.column("rows")[i].values), {}
        if block is not None:
            yield judged(*block, got)

    texts = blocks.select("file", F.lit(-1).alias("shard"), "rows", F.lit(None).cast("binary").alias("answer"))
    both = texts.unionByName(found.select("file", "shard", F.lit(None).cast(texts.schema["rows"].dataType).alias("rows"), "answer"))
    both = both.repartition(parts, "file").sortWithinPartitions("file", "shard")
    out = [*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others], "model long", "n_tokens long", "perplexity double"]
    return mapped(both, run, ", ".join(out), "scores")


def classify(docs: DataFrame, labels: DataFrame, prior: float = 20.0, **parameters) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, perplexity, limit, kept.

    A text is kept if its perplexity is within the limit of its language.

    Texts without words (null, empty, blank) are rejected. Without any trusted document nothing can
    be judged: perplexity and limit are null and all texts with words are kept. Null and rare langs
    are judged by the model of all languages and its limit. Rows that repeat a doc_id get a row
    each, and are one document in the sample; null doc_ids stay null; other columns are ignored; an
    empty table gives an empty result.
    Texts of any length are taken whole.
    """
    docs = docs.select("doc_id", "lang", "text")
    model, scores = learned(docs, labels, prior=prior, **parameters)
    if model is None:
        none = {"n_tokens": "long", "perplexity": "double", "limit": "double"}
        return docs.select("doc_id", *[F.lit(None).cast(v).alias(k) for k, v in none.items()], has_words().alias("kept"))
    return limited(scores, model, prior).drop("lang", "given", "text_key", "model")


def has_words() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def limited(scores: DataFrame, model: QualityModel, prior: float) -> DataFrame:
    """``scores`` (without prior) with the perplexity drawn to the mean, limit and kept."""
    got = scores.withColumn("perplexity", F.exp(drawn(F.ln("perplexity"), F.col("model"), model, prior)))
    return got.withColumn("limit", by_model(model.limit, F.col("model"))).withColumn("kept", F.expr("perplexity <= `limit` and n_tokens > 1"))


def keep_good(docs: DataFrame, labels: DataFrame, prior: float = 20.0, **parameters) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns; columns named like those of classify() are not used.

    Rows are dropped by what the judgement depends on, their lang and text, whatever their doc_ids.
    """
    model, scores = learned(docs.select("doc_id", "text", "lang"), labels, prior=prior, **parameters)
    if model is None:
        return docs.filter(has_words())
    rejected = if_small(limited(scores, model, prior).filter("not kept").select("text_key").distinct().withColumnRenamed("text_key", "_key"))
    return docs.join(rejected, text_key() == F.col("_key"), "left_anti")
