"""Grouping of spelling variants by a trie self-join with active-node sets (op 13).

Two words are near if one inserted, deleted or replaced code point makes one of the other. In the trie of all words,
a node's active nodes are those whose prefixes are within that distance of its own. Besides itself
they come in two kinds, each born at the node P where two words part:

* replaced: children P.c and P.d of one node. From there both go down by equal letters.
* inserted: P.r and P.c.r with c other than r. From there, too, both go down by equal letters.

A pair of active nodes that are both ends of words is a pair of near words, and each such pair is
born at one P only, that of their longest common prefix, so it comes once.

The trie is cut by prefixes into subtries of at most SUBTRIE words; a task builds one after the other and
goes down level by level, all pairs of a level at once in numpy. Nodes above the cut have too many words for one
task. Pairs born at such a node P must agree in all that follows, so its words meet by (P, what follows the
next letter) and (P, what follows P), groups of at most one word for each letter and one more.

Words have letters a-z and U+00C0-U+00FF, so in tasks a word is its Latin-1 bytes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import cut, dealt, if_small, pieces, small_batches

#: Words of a subtrie at most, and of those that a task goes down at once.
SUBTRIE = 40_000

#: Letters become themselves, A-Z lower-case, everything else a space.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))

#: Counters of a task with more words than this are sent on.
MOST_ENTRIES = 400_000

#: Levels that are always gone down together; below, pairs of two single words are compared whole.
FEW_LEVELS = 24


# ---- words ------------------------------------------------------------------------------------------


def count_words(docs: DataFrame, least_length: int, slips: int) -> DataFrame:
    """(word, n): occurrences of words, summed within tasks; of one in ``slips`` (document, run) the run loses a letter."""

    def sent(n: Counter) -> Iterator[pa.RecordBatch]:
        words = list(n)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([n[w] for w in part], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                runs = text.as_py().encode("latin-1", "replace").translate(_FOLD).split()
                for w, c in Counter([w for w in runs if len(w) >= least_length]).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if slips and not h % slips:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least_length:
                            continue
                    n[w] += c
                if len(n) > MOST_ENTRIES:
                    yield from sent(n)
                    n = Counter()
        yield from sent(n)

    return docs.mapInArrow(run, "word string, n long")


# ---- below the cut ------------------------------------------------------------------------------------


class Level:
    """Nodes of one depth, ordered by parent and letter: the word that ends at each (or -1) and the first one below."""

    def __init__(self, parent: np.ndarray, letter: np.ndarray, end: np.ndarray, first: np.ndarray):
        self.parent, self.letter, self.end, self.first = parent, letter, end, first
        self.key = parent * 256 + letter

    def child(self, parent: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked are there, and their nodes."""
        want = parent * 256 + letter
        at = np.searchsorted(self.key, want)
        found = np.flatnonzero(self.key[np.minimum(at, len(self.key) - 1)] == want) if len(self.key) else _NONE
        return found, at[found]


_NONE = np.zeros(0, np.int64)


def levels_of(letters: np.ndarray, start: np.ndarray, length: np.ndarray, root: np.ndarray) -> list[Level]:
    """The trie's levels, roots first, of words sorted by (root, letters), and one more.

    They end where no word goes on, or, after FEW_LEVELS, where no node has two words.
    """
    words, node, t, more = np.arange(len(start)), root, 0, 1
    parent = letter = np.zeros(int(root[-1]) + 1, np.int64)
    levels = []
    while True:
        end, first = np.full(len(parent), -1, np.int64), np.full(len(parent), -1, np.int64)
        first[node[::-1]] = words[::-1]
        ends = length[words] == t
        end[node[ends]] = words[ends]
        levels.append(Level(parent, letter, end, first))
        done = not more or len(words) == ends.sum() or (t >= FEW_LEVELS and len(np.unique(node)) == len(node))
        words, node = words[~ends], node[~ends]
        if done:
            if not more:
                return levels
            more = 0
        if not len(words):
            return [*levels, Level(_NONE, _NONE, _NONE, _NONE)]
        c = letters[start[words] + t].astype(np.int64)
        new = np.append(True, (node[1:] != node[:-1]) | (c[1:] != c[:-1]))
        parent, letter = node[new].astype(np.int64), c[new]
        node, t = np.cumsum(new) - 1, t + 1


def siblings(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of nodes with one parent."""
    a, b, i = [_NONE], [_NONE], np.arange(len(level.parent))
    for step in range(1, 256):
        i = i[i + step < len(level.parent)]
        i = i[level.parent[i] == level.parent[i + step]]
        if not len(i):
            break
        a.append(i)
        b.append(i + step)
    return np.concatenate(a), np.concatenate(b)


def go_down(a: np.ndarray, b: np.ndarray, below_a: Level, below_b: Level) -> tuple[np.ndarray, np.ndarray]:
    """The children by equal letters of pairs of nodes."""
    first = np.searchsorted(below_a.parent, a)
    k = np.searchsorted(below_a.parent, a, side="right") - first
    child = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first, k)
    found, other = below_b.child(np.repeat(b, k), below_a.letter[child])
    return child[found], other


def born_inserted(down: Level, deeper: Level) -> tuple[np.ndarray, np.ndarray]:
    """Pairs P.r (a node of ``down``) and P.c.r (of ``deeper``) with c other than r."""
    other = np.flatnonzero(deeper.letter != down.letter[deeper.parent]) if len(deeper.parent) else _NONE
    found, node = down.child(down.parent[deeper.parent[other]], deeper.letter[other]) if len(other) else (_NONE, _NONE)
    return node, other[found]


def near_pairs(letters: np.ndarray, start: np.ndarray, length: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of near words with one root: words are letters[start : start + length], ordered by (root, letters), all different."""
    levels = levels_of(letters, start, length, root)
    replaced = inserted = (_NONE, _NONE)  # of the second, the first node is of this level and the other of the next
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def ends(x, y):
        both = (x >= 0) & (y >= 0)
        out.append((x[both], y[both]))

    def join(p, q):
        return np.concatenate([p[0], q[0]]), np.concatenate([p[1], q[1]])

    last = len(levels) - 2
    for t in range(last):
        here, down, deeper = levels[t : t + 3]
        ends(here.end[replaced[0]], here.end[replaced[1]])
        ends(here.end[inserted[0]], down.end[inserted[1]])
        ends(here.end[down.parent], down.end)
        replaced = join(go_down(*replaced, down, down), siblings(down))
        inserted = join(go_down(*inserted, down, deeper), born_inserted(down, deeper))
    here, down = levels[last], levels[last + 1]  # one word below each node: what is left of both is compared
    rest = lambda w, t: letters[start[w] + t : start[w] + length[w]].tobytes()
    for pairs, lower, more in ((replaced, here, 0), (inserted, down, 1)):
        a, b = here.first[pairs[0]], lower.first[pairs[1]]
        same = np.array([rest(i, last) == rest(j, last + more) for i, j in zip(a, b)], bool)
        out.append((a[same], b[same]))
    return np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])


def best_near(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of words: each word that has one, how many it has, and the near word of largest n (ties: the first)."""
    x, y = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((y, -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else _NONE
    return x[first], np.diff(np.append(first, len(x))), y[first]


NEAR = "word string, n_near long, near_n long, near_word string"


def near_in_subtries(words: DataFrame) -> DataFrame:
    """NEAR for pairs within the subtries of ``words`` (root, word, n); all words of a root meet in a task, at most SUBTRIE."""

    def found(block: pd.DataFrame) -> pd.DataFrame:
        new_root = (block["root"] != block["root"].shift()).to_numpy()
        rests = [w[len(r) :].encode("latin-1") for w, r in zip(block["word"], block["root"])]
        length = np.fromiter(map(len, rests), np.int64, len(rests))
        n, word = block["n"].to_numpy(), block["word"].to_numpy()
        a, b = near_pairs(np.frombuffer(b"".join(rests), np.uint8), np.cumsum(length) - length, length, np.cumsum(new_root) - 1)
        x, count, y = best_near(a, b, n)
        return pd.DataFrame({"word": word[x], "n_near": count, "near_n": n[y], "near_word": word[y]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= SUBTRIE:
                block = pd.concat(held, ignore_index=True)
                at = int(np.searchsorted((block["root"] != block["root"].iloc[-1]).to_numpy()[::-1], True))  # rows of the last root, which may go on
                if at < size:
                    yield found(block.iloc[: size - at])
                    block = block.iloc[size - at :]
                held, size = [block], len(block)
        if size:
            yield found(pd.concat(held, ignore_index=True))

    parts = max(pieces(words, 1 << 20), 1)
    return words.repartition(parts, "root").sortWithinPartitions("root", "word").mapInPandas(run, NEAR)


# ---- above the cut ------------------------------------------------------------------------------------


def near_at_nodes(words: DataFrame) -> DataFrame:
    """NEAR for the pairs that are born at node P, the first ``depth`` letters of ``words`` (word, n, depth).

    Words meet that agree but for the letter after P, and the word that lacks that letter; of the
    latter's pairs those are left out that agree in a letter more, as they are born deeper.
    """
    p, skip = F.expr("left(word, depth)"), lambda k: F.expr(f"substr(word, depth + {k})")
    with_letter = F.when(F.length("word") > F.col("depth"), F.struct(F.concat_ws("\n", p, skip(2)).alias("key"), F.expr("substr(word, depth + 1, 1)").alias("c")))
    each = words.select("word", "n", F.explode(F.array_compact(F.array(with_letter, F.struct(F.concat_ws("\n", p, skip(1)).alias("key"), F.lit("").alias("c"))))).alias("e"))
    met = each.groupBy("e.key").agg(F.collect_list(F.struct("n", "word", "e.c")).alias("g")).filter("size(g) > 1")  # at most a word for each letter, and one
    next_letter = F.substring(F.substring_index("key", "\n", -1), 1, 1)

    def near(x: Column, y: Column) -> Column:
        return F.when((x["c"] != "") & (y["c"] != ""), x["c"] != y["c"]).otherwise((x["c"] != y["c"]) & (x["c"] != F.col("r")) & (y["c"] != F.col("r")))

    # The word without the letter has c = '', which no r equals unless nothing follows.
    met = met.withColumn("r", F.when(next_letter == "", "-").otherwise(next_letter)).select("g", "r", F.explode("g").alias("x"))
    others = met.select("x.word", F.filter("g", lambda y: near(F.col("x"), y)).alias("o")).filter("size(o) > 0")
    best = F.array_min(F.transform("o", lambda y: F.struct((-y["n"]).alias("n"), y["word"].alias("word"))))
    return others.select("word", F.size("o").cast("long").alias("n_near"), (-best["n"]).alias("near_n"), best["word"].alias("near_word"))


@F.pandas_udf(IntegerType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(commonprefix([x, y])) for x, y in zip(a, b)], dtype="int32")


def near_words(words: DataFrame, most: int = SUBTRIE) -> DataFrame:
    """(word, n_near, near_n, near_word) of the ``words`` (word, n; all different) that have a near one: how many, and the one of largest n.

    Words of a prefix are a subtrie once they are no more than ``most``. Of larger ones the first node
    that branches is taken by near_at_nodes(), and its children are the next prefixes.
    """
    left, found = cut(words.select("word", "n", F.lit(0).alias("depth")), "subtries"), []
    while True:
        rooted = left.withColumn("root", F.expr("left(word, depth)"))
        sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("word").alias("a"), F.max("word").alias("b"))
        large = cut(sizes.filter(F.col("size") > most).select("root", common_length("a", "b").alias("branch")), "large")
        if large.isEmpty():
            found.append(near_in_subtries(rooted.select("root", "word", "n")))
            break
        large = if_small(large)
        found.append(near_in_subtries(rooted.join(large, "root", "left_anti").select("root", "word", "n")))
        at_node = cut(rooted.join(large, "root").select("word", "n", F.col("branch").alias("depth")), "branching")
        found.append(near_at_nodes(at_node))
        left = cut(at_node.filter(F.length("word") > F.col("depth")).withColumn("depth", F.col("depth") + 1), "subtries")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near_word").alias("word"))).alias("best")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.word").alias("near_word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of each chain. Rounds double the steps; n grows tenfold a step, so they are few."""
    up = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = cut(up.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if jumped.filter("moved").isEmpty():
            return up
        up = jumped.drop("moved")


def group_spellings(docs: DataFrame, least_length: int = 7, least_n: int = 2, times: int = 10, slips: int = 0, most: int = SUBTRIE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of at least ``least_length`` code points and ``least_n`` occurrences.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. form is the near word of largest n
    (ties: the smallest in code-point order) if that is ``times`` the word's n or more; root is where forms lead to, the
    word itself without one. With ``slips``, one in so many pairs of document and run loses a letter, by a hash of
    ``doc_id:run``; it is how the query plants misspellings.

    Null texts have no words; a null doc_id hashes as an empty one. Texts and runs of any length are taken whole; rows that
    repeat count again. An empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select("doc_id", "text").filter("text is not null")
    with small_batches(docs.sparkSession):
        words = cut(count_words(dealt(texts), least_length, slips).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n), "words")
        near = cut(near_words(words, most), "near")
    is_form = F.col("near_n") >= times * F.col("n")
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near_word")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    named = cut(named, "forms")
    ends = if_small(roots(named.filter("form is not null")))
    return named.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
