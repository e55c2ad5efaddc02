"""Language identification by hierarchical discrimination (op 3).

Linear support vector machines over hashed byte trigrams: first one against one between language
families, then one against one between the languages of the family that won. They are fitted on a
bounded sample of labelled rows and broadcast (PAIRS x 2^13 weights).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, mapped_pandas, sampled

# Families of languages; one that is not named is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indic": "hi bn ur mr gu pa ne si",
    "sinitic": "zh yue wuu",
}
DIMENSIONS = 1 << 13
_LETTER = regex.compile(r"\p{L}")
_DROP = bytes(b if b >= 128 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))


def family(lang: str) -> str:
    return next((name for name, of in FAMILIES.items() if lang.lower().split("-")[0] in of.split()), f"only {lang}")


def features(text: str) -> np.ndarray:
    """Square roots of the counts of hashed trigrams of bytes, of length 1, and a constant.

    The text is in lower case; digits, punctuation and white space become a space.
    """
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_DROP), np.uint8)
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))].astype(np.uint32)
    out = np.zeros(DIMENSIONS + 1, np.float32)
    if len(raw) >= 3:
        code = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 13)
        x = np.sqrt(np.bincount(code, minlength=DIMENSIONS).astype(np.float32))
        out[:DIMENSIONS] = x / np.linalg.norm(x)
    out[DIMENSIONS] = 0.3
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """A linear support vector machine (hinge loss, L2) by dual coordinate descent; y is 1 or -1.

    Classes weigh the same in all, whatever their numbers of rows.
    """
    upper = c * len(y) / 2 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum()))
    w, alpha, diagonal = np.zeros(x.shape[1], np.float32), np.zeros(len(y)), (x * x).sum(1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / diagonal[i], 0.0), upper[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


class LanguageModel:
    """Machines between each two families, and between each two languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(lang) for lang in self.langs})
        of, own = np.array([family(lang) for lang in langs]), np.array(langs)
        self.groups = [("", self.families), *[(f, [g for g in self.langs if family(g) == f]) for f in self.families]]
        self.pairs, weights = [], []
        for name, classes in self.groups:
            label = own if name else of
            for a, b in combinations(classes, 2):
                rows = np.flatnonzero((label == a) | (label == b))
                self.pairs.append((name, a, b))
                weights.append(fit_svm(x[rows], np.where(label[rows] == a, 1.0, -1.0)))
        self.weights = np.stack(weights, 1) if weights else np.zeros((DIMENSIONS + 1, 0), np.float32)

    def _winner(self, name: str, classes: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The class with most votes (ties: the larger sum of margins), and how sure its closest vote is, 0 to 1."""
        if len(classes) == 1:
            return classes[0], 1.0
        votes = {c: [0, 0.0, 1e9] for c in classes}
        for (group, a, b), m in zip(self.pairs, margins, strict=True):
            if group == name:
                for c, value in ((a, m), (b, -m)):
                    votes[c] = [votes[c][0] + (value > 0), votes[c][1] + value, min(votes[c][2], value)]
        best = max(classes, key=lambda c: (votes[c][0], votes[c][1]))
        return best, float(1 / (1 + np.exp(-4 * votes[best][2])))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for k in range(0, len(texts), 128):
            some = texts[k : k + 128]
            known = [bool(t and self.langs and _LETTER.search(t)) for t in some]
            x = np.stack([features(t) if ok else np.zeros(DIMENSIONS + 1, np.float32) for t, ok in zip(some, known, strict=True)])
            for ok, margins in zip(known, x @ self.weights, strict=True):
                if not ok:
                    out.append(("und", 0.0))
                    continue
                first, sure = self._winner("", self.families, margins)
                lang, surer = self._winner(first, dict(self.groups)[first], margins)
                out.append((lang, sure * surer))
        return out


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: a quarter, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = 400, most: int = 4000) -> LanguageModel:
    """Learns from at most ``per_lang`` rows of each lang and ``most`` in all, chosen by a hash of the doc_id.

    Rows without a lang or doc_id, or whose text has no letter, are not chosen; of rows that repeat a doc_id and lang
    one is. Each chosen row comes to the driver as its 2^13 features, so the sample takes under 70 MB there whatever
    the texts' lengths.
    """
    base = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null and doc_id is not null").filter(F.col("text").rlike(r"\p{L}"))
    chosen = sampled(base, "lang", "fit", per_lang, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(str), "lang": b["lang"], "x": [features(t).astype("<f2").tobytes() for t in b["text"]]})

    rows = chosen.select("doc_id", "lang", "text").mapInPandas(run, "doc_id string, lang string, x binary").toPandas()
    rows = rows.sort_values(["doc_id", "lang"]).reset_index(drop=True)
    x = np.stack([np.frombuffer(v, "<f2").astype(np.float32) for v in rows["x"]]) if len(rows) else np.zeros((0, DIMENSIONS + 1), np.float32)
    return LanguageModel(x, rows["lang"].tolist())


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of each row, from the whole text alone.

    Null texts and texts without letters (of Unicode's class L) get ``und`` and 0; so do all if nothing was learned.
    Repeated rows get a row each; other columns are ignored; an empty table gives an empty result.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = given.value.predict(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped_pandas(dealt(docs.select("doc_id", "text")), run, f"doc_id {kind}, lang_pred string, score double", "languages")


def language_report(docs: DataFrame, per_lang: int = 400, most: int = 4000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, with a model that has not seen the documents held out. Texts of any length are taken whole."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))), per_lang, most)
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
