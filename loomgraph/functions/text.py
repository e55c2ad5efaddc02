"""Text expressions with the semantics of the browser's strings, from built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the browser's trim and \\s have it; Java's \\s is ASCII and Spark's trim strips spaces only.
_SPACES = ("00a0", "1680", "2000-200a", "2028", "2029", "202f", "205f", "3000", "feff")
WS = r"\t\n\x0B\f\r " + "".join("-".join(f"\\u{x}" for x in s.split("-")) for s in _SPACES)
#: The characters themselves, for built-in trimming, which looks at the ends alone.
WS_CHARACTERS = "\t\n\x0b\f\r " + "".join(chr(i) for s in _SPACES for i in range(int(s.split("-")[0], 16), int(s.split("-")[-1], 16) + 1))
#: The same in RE2's syntax, for oracles.
WS_RE2 = r"\t\n\x0B\f\r " + "".join("-".join(f"\\x{{{x}}}" for x in s.split("-")) for s in _SPACES)
#: Not before a word character: Java's \b counts letters of all scripts.
END = r"(?![A-Za-z0-9_])"
START = r"(?<![A-Za-z0-9_])"


def once(make: Callable) -> Callable:
    """``make``, a function without arguments, called once for a JVM: a large Column takes longer to build than to run over a few rows."""
    made: dict = {}

    @wraps(make)
    def get():
        if made.get("of") is not SparkContext._gateway:
            made.update(of=SparkContext._gateway, value=make())
        return made["value"]

    return get


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARACTERS))


def squeeze(c: Column) -> Column:
    """White space runs as one space, and none at the ends."""
    return trim(F.regexp_replace(c, f"[{WS}]+", " "))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def group(c: Column, pattern: str, index: int) -> Column:
    """A group of the first match, null where there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, index))


def all_groups(c: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(index))


def cut_first(c: Column, part: Column) -> Column:
    """``c`` without the first occurrence of ``part``."""
    at = F.position(part, c)
    rest = F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(part), F.length(c)))
    return F.when(or_empty(part) == "", c).when(at > 0, rest).otherwise(c)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is computed once however often ``f`` uses it: expressions in lambdas aren't shared otherwise."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: Elements over which a running result is carried one by one; arrays grow by copying, so longer ones are cut.
RUN = 256


def running(x: Column, start: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element ``combine`` of ``start`` and all elements up to it; ``combine`` is associative and ``start`` neutral.

    Runs of RUN elements are done each by itself, then what the runs before come to is put to each of their
    elements, so an array of n costs some n x RUN and (n / RUN)^2 steps of copying, not n^2.
    """

    def simple(own: Column) -> Column:
        grown = F.aggregate(own, F.array(start), lambda acc, v: F.concat(acc, F.array(combine(F.element_at(acc, -1), v))))
        return F.slice(grown, F.lit(2), F.size(own))

    def by_runs(own: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / F.lit(RUN)).cast("int")), lambda k: simple(F.slice(own, k * RUN + 1, F.lit(RUN))))

        def carried(done: Column) -> Column:
            before = F.concat(F.array(start), simple(F.transform(done, lambda r: F.element_at(r, -1))))
            return F.flatten(F.zip_with(done, F.slice(before, F.lit(1), F.size(done)), lambda r, e: F.transform(r, lambda v: combine(e, v))))

        return let(runs, carried)

    return let(x, lambda own: F.when(F.size(own) <= RUN, simple(own)).otherwise(by_runs(own)))


def running_sum(x: Column) -> Column:
    """Sums of an array of ints up to each element."""
    return running(x, F.lit(0), lambda a, b: a + b)


def running_max(x: Column) -> Column:
    """The largest up to each element of an array of ints from -1 on."""
    return running(x, F.lit(-1), F.greatest)


def spans(c: Column, pattern: str) -> Column:
    """All matches in order: an array of (match, start, end), 0-based and end exclusive.

    ``pattern`` takes one group of its own around it: numbers of its back-references shift by two.
    Each match is taken with what precedes it, so lengths add up to places.
    """

    def placed(pieces: Column) -> Column:
        return F.zip_with(pieces, running_sum(F.transform(pieces, F.length)), one)

    def one(piece: Column, end: Column) -> Column:
        found = F.regexp_extract(piece, rf"(?is)\A(.*?)({pattern})\z", 2)
        return let(found, lambda m: F.struct(m.alias("match"), (end - F.length(m)).alias("start"), end.alias("end")))

    return let(all_groups(c, rf"(?is)\G(.*?)({pattern})", 0), placed)  # \G: what follows the last match is gone through once


def within(places: Column, ranges: Column) -> Column:
    """For each place (an int) whether one of the ranges (start, end; apart from each other) holds it, its end included.

    Ranges and places are put in one order, in which the largest end so far tells.
    """
    events = F.concat(
        F.transform(ranges, lambda r: F.struct(r["start"].alias("at"), F.lit(-1).alias("nth"), r["end"].alias("end"))),
        F.transform(places, lambda p, i: F.struct(p.alias("at"), i.alias("nth"), F.lit(-1).alias("end"))),
    )

    def told(e: Column) -> Column:
        held = F.zip_with(e, running_max(F.transform(e, lambda x: x["end"])), lambda x, end: F.struct(x["nth"].alias("nth"), (end >= x["at"]).alias("held")))
        return F.transform(F.array_sort(F.filter(held, lambda x: x["nth"] >= 0)), lambda x: x["held"])

    return let(F.array_sort(events), told)


def uri_component(c: Column) -> Column:
    """Percent-encoding as encodeURIComponent does it."""
    out = F.url_encode(c)
    for code, char in (("+", "%20"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%21", "!")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def uri_decode(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def xml_escape(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def display_math(c: Column, display: bool = True) -> Column:
    """Trimmed; in display mode in $$ unless delimited already."""
    t = trim(or_empty(c))
    done = t.rlike(r"(?s)\A\$\$.*\$\$\z") | t.rlike(r"(?s)\A\\\[.*\\\]\z")
    return F.when(F.lit(not display) | done | (t == ""), t).otherwise(F.concat(F.lit("$$\n"), t, F.lit("\n$$")))


def is_narrative(title: Column) -> Column:
    """A title like a sentence: of some length, with Chinese characters, without signs of mathematics."""
    return (F.length(title) >= 8) & title.rlike(r"[一-鿿]") & ~title.rlike(r"[()\\=$_^]")
