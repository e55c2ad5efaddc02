"""Turtle: a parser of statements, and documents of any size cut at statement ends.

Lines of a file are read by Spark in splits. Whether a line starts within a long string or within
brackets hangs on all lines before it, so each split is cut at the ends of statements as if it were entered outside of both, and folded to what it makes of each way in which it may
be entered; the folds, a row a split, are put together in order, and splits that are entered otherwise are
cut once more. Pieces that go over splits are joined again, and each piece is
parsed by itself with the prefixes that were declared before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..storage import broadcast_if_small, plan_bytes, stored

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TRIPLES = "s string, p string, o string, literal boolean, place struct<major:long,minor:long>"
#: Bytes of statements that are parsed at once. Readers and Arrow take thousands of rows at once, so rows are small.
PIECE = 1 << 12
#: A statement of more bytes goes on in another row until it is parsed; a task gives so many bytes of rows at once.
LONG, OUT = 1 << 22, 1 << 20

_LOCAL = r"(?:[\w:\-\u00B7]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])"
_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#[^\n\r]*)
    |(?P<iri><[^\x00-\x20<>"{}|^`]*>)
    |(?P<long>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*''')
    |(?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@(?:prefix|base)\b|(?i:prefix|base)(?=[ \t\r\n]))
    |(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<blank>_:\w(?:[\w.\-\u00B7]*[\w\-\u00B7])?)
    |(?P<name>(?:[^\W\d_](?:[\w.\-\u00B7]*[\w\-\u00B7])?)?:(?:(?:LOCAL)(?:(?:\.*LOCAL)*))?)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<word>a(?![\w:])|true\b|false\b)
    |(?P<mark>[.;,\[\]()])""".replace("LOCAL", _LOCAL),
    re.X | re.S,
)
_ESCAPE = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


#: A statement of one triple as most files have it, with IRIs in full and a plain literal; what it matches is what _TOKEN makes of it.
_TRIPLE = re.compile(r"""[ \t\r\n]*<([^\x00-\x20<>"{}|^`]*)> <([^\x00-\x20<>"{}|^`]*)> (?:<([^\x00-\x20<>"{}|^`]*)>|"(?!"")((?:[^"\\\n\r]|\\.)*+)") \.(?=[ \t\r\n]|\Z)""", re.S)


def unescape(x: str) -> str:
    r"""Escapes of strings and IRIs: \n and such, \uXXXX, \UXXXXXXXX, and any other character for itself."""
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPE.get(m[1], m[1]), x, flags=re.S)


class Statements:
    """The triples (s, p, o, literal) of statements. Blank nodes are ``_:`` and a name; literals are their text."""

    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str = "", scope: str = "", own: str = ""):
        self.prefixes, self.base, self.scope, self.own = dict(prefixes or {}), base, scope, own
        self.out: list[tuple[str, str, str, bool]] = []
        text = text[self._triples(text) :]
        self.tokens, self.at, self.blanks = list(self._tokens(text)), 0, 0
        while self.at < len(self.tokens):
            self._statement()

    def _triples(self, text: str) -> int:
        """Takes the statements of one triple that the text begins with; where they end."""
        iri = lambda x: self._iri(f"<{x}>") if self.base or "\\" in x else x
        at = 0
        while m := _TRIPLE.match(text, at):
            s, p, o, said = m.groups()
            self.out.append((iri(s), iri(p), iri(o), False) if said is None else (iri(s), iri(p), unescape(said) if "\\" in said else said, True))
            at = m.end()
        return at

    @staticmethod
    def _tokens(text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not Turtle at {text[at : at + 40]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m.group()

    def _next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("Turtle ends within a statement")
        self.at += 1
        return self.tokens[self.at - 1]

    def _is(self, *marks: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "mark" and self.tokens[self.at][1] in marks

    def _expect(self, mark: str) -> None:
        kind, x = self._next()
        if (kind, x) != ("mark", mark):
            raise ValueError(f"expected {mark!r}, not {x!r}")

    def _fresh(self) -> str:
        self.blanks += 1
        return f"_:{self.scope}{self.own}.{self.blanks}"

    def _iri(self, x: str) -> str:
        iri = unescape(x[1:-1])
        return urljoin(self.base, iri) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri) else iri

    def _statement(self) -> None:
        if self.tokens[self.at][0] == "directive":
            word = self._next()[1]
            if word.lower().endswith("prefix"):
                name = self._next()[1]
                self.prefixes[name.rstrip(":")] = self._iri(self._next()[1])
            else:
                self.base = self._iri(self._next()[1])
            if word.startswith("@"):
                self._expect(".")
            return
        anonymous = self._is("[")
        subject, literal = self._term()
        if literal:
            raise ValueError(f"a literal as subject: {subject!r}")
        if not (anonymous and self._is(".")):
            self._predicates(subject)
        self._expect(".")

    def _predicates(self, subject: str) -> None:
        while True:
            if not self._is(";", ".", "]"):
                predicate, literal = self._term()
                if literal or predicate.startswith("_:"):
                    raise ValueError(f"not a predicate: {predicate!r}")
                while True:
                    value, literal = self._term()
                    self.out.append((subject, predicate, value, literal))
                    if not self._is(","):
                        break
                    self.at += 1
            if not self._is(";"):
                return
            self.at += 1

    def _term(self) -> tuple[str, bool]:
        kind, x = self._next()
        if kind == "iri":
            return self._iri(x), False
        if kind == "name":
            head, _, tail = x.partition(":")
            if head not in self.prefixes:
                raise ValueError(f"unknown prefix {head}:")
            return self.prefixes[head] + re.sub(r"\\(.)", r"\1", tail), False
        if kind == "blank":
            return f"_:{self.scope}{x[2:]}", False
        if kind in ("text", "long"):
            cut = 3 if kind == "long" else 1
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "tag":
                self.at += 1
            elif self.at < len(self.tokens) and self.tokens[self.at][0] == "type":
                self.at += 1
                self._term()
            return unescape(x[cut:-cut]), True
        if kind == "word":
            return (f"{RDF}type", False) if x == "a" else (x, True)
        if kind == "number":
            return x, True
        if x == "[":
            own = self._fresh()
            if not self._is("]"):
                self._predicates(own)
            self._expect("]")
            return own, False
        if x == "(":
            return self._list(), False
        raise ValueError(f"not a term: {x!r}")

    def _list(self) -> str:
        if self._is(")"):
            self.at += 1
            return f"{RDF}nil"
        first = own = self._fresh()
        while True:
            self.out.append((own, f"{RDF}first", *self._term()))
            if self._is(")"):
                self.at += 1
                self.out.append((own, f"{RDF}rest", f"{RDF}nil", False))
                return first
            after = self._fresh()
            self.out.append((own, f"{RDF}rest", after, False))
            own = after


def parse_turtle(text: str) -> list[tuple[str, str, str, bool]]:
    """(s, p, o, literal) of a document's statements."""
    return Statements(text).out


# ---- cutting -----------------------------------------------------------------------------------------


#: How a line may be entered: outside strings, or within a long one.
WAYS = ("", '"""', "'''")
_OUTSIDE = re.compile(r"""\#.*|<[^\x00-\x20<>"{}|^`]*>|(?P<open>\"\"\"|''')|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\\.|(?P<in>[\[(])|(?P<out>[\])])|(?P<dot>\.)(?=\s|\#|$)|\S""", re.S)
_INSIDE = {'"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S), "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.S)}


def over_line(line: str, way: str) -> tuple[str, int, bool]:
    """How the next line is entered, by how many brackets more, and whether this one ends with the point of a statement (if no bracket is open)."""
    if way:
        if way not in line:  # nothing ends the string
            return way, 0, False
    elif _TRIPLE.fullmatch(line):
        return way, 0, True
    at, depth, dot = 0, 0, False
    while True:
        if way:
            m = _INSIDE[way].match(line, at)
            if not m:
                return way, depth, False
            at, way, dot = m.end(), "", False
        m = _OUTSIDE.search(line, at)
        if not m:
            return way, depth, dot
        at = m.end()
        if m.group().startswith("#"):
            return way, depth, dot
        dot = m["dot"] is not None
        depth += (m["in"] is not None) - (m["out"] is not None)
        way = m["open"] or ""


class Cut:
    """A split's lines, cut at the ends of statements by way of ``way`` and ``depth``: rows (nth, text, kind) from push() and end().

    Kinds: ``whole`` are whole statements, about ``size`` bytes of them together; ``head`` ends what stands before the split's first end of a statement,
    ``open`` goes on after its last, ``all`` has no end. A statement of more than LONG bytes is cut into such rows, too.
    """

    def __init__(self, size: int, way: str = "", depth: int = 0):
        self.size, self.way, self.depth, self.begun = size, way, depth, False
        self._emptied()

    def _emptied(self) -> None:
        self.held, self.first, self.bytes, self.whole = [], 0, 0, 0

    def push(self, nth: int, line: str) -> list[tuple[int, str, str]]:
        if not self.held:
            self.first = nth
        self.way, more, dot = over_line(line, self.way)
        self.depth += more
        self.held.append(line)
        self.bytes += len(line) + 1
        if dot and not self.depth and not self.way:
            if not self.begun:
                rows, self.begun = [(self.first, "\n".join(self.held), "head")], True
                self._emptied()
                return rows
            self.whole = len(self.held)
            return self.end() if self.bytes >= self.size else []
        if self.bytes >= LONG:
            rows, self.begun = self.end(), False
            return rows
        return []

    def end(self) -> list[tuple[int, str, str]]:
        """What is held: what is whole, and what goes on."""
        whole, more = self.held[: self.whole], self.held[self.whole :]
        rows = [(self.first, "\n".join(whole), "whole")] if whole else []
        if more:
            rows.append((self.first + len(whole), "\n".join(more), "open" if self.begun else "all"))
        self._emptied()
        return rows


_CUT = pa.schema([("doc", pa.string()), ("block", pa.int64()), ("nth", pa.int64()), ("text", pa.string()), ("kind", pa.string()), ("fold", pa.string()), ("n", pa.int64())])


def cut_splits(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(doc, block, nth, text, kind, fold, n) of the files under ``path``, written: splits cut as if each were entered outside strings and brackets.

    A split's last row has the number of its lines, and what it makes of WAYS, by which entered() tells how it is entered.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nth, cut, others, rows, held = None, 0, None, {}, [], 0

        def ended():
            fold = "\t".join(f"{w} {d}" for w, d in ((cut.way, cut.depth), *others.values()))
            last = [(*at, *r, None, None) for r in cut.end()]
            return [*last, (*at, nth, "", "whole", fold, nth)]

        for b in batches:
            for doc, block, line in zip(*(b.column(c).to_pylist() for c in ("doc", "block", "line"))):
                if (doc, block) != at:
                    if at is not None:
                        rows += ended()
                    at, nth, cut, others = (doc, block), 0, Cut(size), {w: (w, 0) for w in WAYS[1:]}
                for w, (way, depth) in others.items():
                    if not way or way in line:
                        way, more, _ = over_line(line, way)
                        others[w] = way, depth + more
                for r in cut.push(nth, line):
                    rows.append((*at, *r, None, None))
                    held += len(r[1])
                nth += 1
                if held >= OUT:
                    yield _rows(rows, _CUT)
                    rows, held = [], 0
        if at is not None:
            yield _rows(rows + ended(), _CUT)

    cut = raw.mapInArrow(run, "doc string, block long, nth long, text string, kind string, fold string, n long")
    few = max(spark.sparkContext.defaultParallelism, -(-plan_bytes(raw) // (16 << 20)))  # small splits share files
    return stored(cut.coalesce(few), "turtle-cut")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def entered(cut: DataFrame) -> DataFrame:
    """(doc, block, way, depth, n): how each split is entered, and its lines. A document's splits, a row each, are put together in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        way, depth, out = "", 0, []
        for r in rows.sort_values("block").itertuples():
            out.append((r.doc, r.block, way, depth, r.n))
            left = [x.rsplit(" ", 1) for x in r.fold.split("\t")][WAYS.index(way)]
            way, depth = left[0], depth + int(left[1])
        return pd.DataFrame(out, columns=["doc", "block", "way", "depth", "n"])

    return cut.filter("fold is not null").select("doc", "block", "fold", "n").groupBy("doc").applyInPandas(run, "doc string, block long, way string, depth long, n long")


def cut_again(cut: DataFrame, ways: DataFrame, size: int) -> DataFrame:
    """Rows of cut_splits() of the splits in ``ways``, which are entered otherwise than was taken: cut once more, by how they are."""
    lines = cut.filter("fold is null").join(ways.select("doc", "block", "way", "depth"), ["doc", "block"])
    lines = lines.repartition("doc", "block").sortWithinPartitions("doc", "block", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cut, schema = None, None, pa.schema(list(_CUT)[:5])
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                doc, block, nth, text, way, depth = (b.column(c)[i].as_py() for c in ("doc", "block", "nth", "text", "way", "depth"))
                if (doc, block) != at:
                    if at is not None:
                        rows += [(*at, *r) for r in cut.end()]
                    at, cut = (doc, block), Cut(size, way, depth)
                for k, line in enumerate(text.split("\n")):
                    rows += [(*at, *r) for r in cut.push(nth + k, line)]
            yield _rows(rows, schema)
        if at is not None:
            yield _rows([(*at, *r) for r in cut.end()], schema)

    return lines.select("doc", "block", "nth", "text", "way", "depth").mapInArrow(run, "doc string, block long, nth long, text string, kind string")


def pieces(spark: SparkSession, path: str, size: int = PIECE) -> DataFrame:
    """(doc, major, text): statements, about ``size`` bytes of them together, by the number of their first line over all files by their paths.

    Files are read once and written as pieces, whose order their numbers tell: nothing is sorted, and of the splits alone there is a table (a row each) that one
    task and the driver see. What stands before the first and after the last end of a statement in a split is joined to statements over splits, which are pieces of their own.
    """
    cut = cut_splits(spark, path, size)
    ways = stored(entered(cut), "turtle-ways")
    others = ways.filter("way <> '' or depth <> 0")
    made = cut.filter("fold is null").select("doc", "block", "nth", "text", "kind")
    if not others.isEmpty():
        others = F.broadcast(others)
        made = made.join(others.select("doc", "block"), ["doc", "block"], "left_anti").unionByName(stored(cut_again(cut, others, size), "turtle-again"))
    edges = made.filter("kind <> 'whole'")

    def join(rows: pd.DataFrame) -> pd.DataFrame:  # an open end takes all rows without an end, and the head that follows
        out, held = [], []
        for r in rows.sort_values(["block", "nth"]).itertuples():
            held.append(r)
            if r.kind == "head":
                out.append((r.doc, held[0].block, held[0].nth, "\n".join(h.text for h in held)))
                held = []
        if held:
            out.append((held[0].doc, held[0].block, held[0].nth, "\n".join(h.text for h in held)))
        return pd.DataFrame(out, columns=["doc", "block", "nth", "text"])

    joined = stored(edges.groupBy("doc").applyInPandas(join, "doc string, block long, nth long, text string"), "turtle-joined")
    every = made.filter("kind = 'whole'").drop("kind").unionByName(joined)
    table, at = [], 0
    for r in sorted(ways.select("doc", "block", "n").collect(), key=lambda r: (r["doc"], r["block"])):  # a row a split
        table.append((r["doc"], r["block"], at))
        at += r["n"]
    starts = F.broadcast(spark.createDataFrame(table, "doc string, block long, _start long"))
    return every.join(starts, ["doc", "block"]).select("doc", (F.col("_start") + F.col("nth")).alias("major"), "text")


#: Statements without this declare nothing.
_MAY_DECLARE = r"@prefix|@base|(?i:\b(prefix|base)\s+[\w<:])"


def triples_of_files(spark: SparkSession, path: str, size: int = PIECE) -> DataFrame:
    """TRIPLES of the Turtle files under ``path``, of any size; place is a piece's first line over all files by their paths, and counts triples in it.

    Prefixes and bases are few in a document, which is not checked: each piece gets its document's.
    """
    texts = pieces(spark, path, size)
    said = texts.filter(F.col("text").rlike(_MAY_DECLARE)).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("major", declarations("text").alias("text")))).alias("said"))
    every = texts.join(broadcast_if_small(stored(said, "turtle-prefixes")), "doc", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, said, known, held = None, [], {}, []

        def given():
            *columns, major, minor = zip(*held)
            place = pa.StructArray.from_arrays([pa.array(major, pa.int64()), pa.array(minor, pa.int64())], names=["major", "minor"])
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, ARROW_TRIPLES)), place], schema=ARROW_TRIPLES)

        for b in batches:
            docs, majors, texts = (b.column(c) for c in ("doc_no", "major", "text"))
            for i in range(b.num_rows):  # a row at a time: no more than one piece and some thousand triples are Python's
                doc_no, major = docs[i].as_py(), majors[i].as_py()
                if doc_no != doc:
                    doc, said = doc_no, b.column("said")[i].as_py() or []
                before = "\n".join(s["text"] for s in said if s["major"] < major)
                if known.get("text") != before:
                    known = {"text": before, "read": Statements(before)}
                read = Statements(texts[i].as_py(), known["read"].prefixes, known["read"].base, f"d{doc_no}.", f"p{major}")
                for k in range(0, len(read.out), 10_000):
                    held += [(*t, major, k + n) for n, t in enumerate(read.out[k : k + 10_000])]
                    if len(held) >= 4000:
                        yield given()
                        held = []
        if held:
            yield given()

    numbered_docs = every.withColumn("doc_no", F.xxhash64("doc"))
    return numbered_docs.select("doc_no", "major", "text", "said").mapInArrow(run, TRIPLES)


ARROW_TRIPLES = pa.schema([("s", pa.string()), ("p", pa.string()), ("o", pa.string()), ("literal", pa.bool_()), ("place", pa.struct([("major", pa.int64()), ("minor", pa.int64())]))])


def declared(text: str) -> str:
    """The prefixes and bases that statements declare, a line for each."""
    tokens, out = list(Statements._tokens(text)), []
    for i, (kind, x) in enumerate(tokens):
        if kind == "directive":
            own = [t for _, t in tokens[i + 1 : i + (3 if x.lower().endswith("prefix") else 2)]]
            out.append(f"@{x.lower().lstrip('@')} {' '.join(own)} .")
    return "\n".join(out)


@F.pandas_udf(StringType())
def declarations(texts: pd.Series) -> pd.Series:
    return texts.map(declared)
