"""Periodic runs of words, found with suffix trees.

A run is a stretch of words with a smallest period, repeated at least
``LEAST_EXPONENT`` times, that neither neighbouring word continues. Every
maximal repetition has a Lyndon root that is the longest Lyndon word at its
start, under the order of the words or under the reversed order. So the
candidates of a text are its longest Lyndon words under both orders: at most
two for each word. Each is extended to the right by the longest common
extension (LCE) of its two ends in the text, and to the left by that in the
reversed text; it is a run if it then holds its period twice.

Both extensions come from Ukkonen suffix trees, one of the text and one of its
reversal. An Euler tour notes the string depth at which the tour turns between
two leaves; the depth of the lowest common ancestor of two leaves is the least
of these between them, read from a sparse table in constant time. The tours of
the text's tree under both orders give the suffix ranks, and the next smaller
suffix is the end of the longest Lyndon word.

Trees are built where a run can be: in a run of exponent four or more, each
three words in a row stand at least three times, so a text is first cut at words
in no such triple (and again within the pieces until nothing changes). This
leaves out no run, and most prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaybook.llm.common import table, text_or_empty

LEAST_LENGTH = 6
LEAST_EXPONENT = 4

_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(_WORD)


# ---------------------------------------------------------------- suffix tree
class SuffixTree:
    """Ukkonen's tree of ``s`` (integers from 1 on), which is closed by a 0."""

    def __init__(self, s: list[int]):
        s = [*s, 0]
        n, width = len(s), max(s) + 1
        start, stop, link, child = [0], [0], [0], {}
        node, edge, length, open_suffixes = 0, 0, 0, 0
        for i, c in enumerate(s):
            last = 0
            open_suffixes += 1
            while open_suffixes:
                if not length:
                    edge = i
                key = node * width + s[edge]
                to = child.get(key)
                if to is None:
                    child[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    span = min(stop[to], i + 1) - start[to]
                    if length >= span:
                        node, edge, length = to, edge + span, length - span
                        continue
                    if s[start[to] + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    mid = len(start)
                    start += [start[to], i]
                    stop += [start[to] + length, n]
                    link += [0, 0]
                    child[key] = mid
                    child[mid * width + c] = mid + 1
                    start[to] += length
                    child[mid * width + s[start[to]]] = to
                    if last:
                        link[last] = mid
                    last = mid
                open_suffixes -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - open_suffixes + 1
        self.n = n
        self._spans = [b - a for a, b in zip(start, stop, strict=True)]
        keys = np.fromiter(child.keys(), np.int64, len(child))
        self._parent, self._first = keys // width, keys % width
        self._child = np.fromiter(child.values(), np.int64, len(child))
        self._leaf = (np.array(stop) == n).tolist()

    def tour(self, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Euler tour with the edges in the order of their first words (the
        closing 0 before all others in both orders): the suffixes as the leaves
        come, and the string depth where the tour turns before each."""
        first = np.where(self._first == 0, np.iinfo(np.int64).min, -self._first) if reverse else self._first
        order = np.lexsort((first, self._parent))
        kids = self._child[order].tolist()
        ends = np.searchsorted(self._parent[order], np.arange(len(self._spans) + 1)).tolist()
        span, leaf, n = self._spans, self._leaf, self.n
        suffixes, turns = [], []
        todo, turn = [(0, 0, False)], 0
        while todo:
            at, depth, again = todo.pop()
            if again:
                turn = depth
            if leaf[at]:
                suffixes.append(n - depth - span[at])
                turns.append(turn)
                continue
            depth += span[at]
            a, b = ends[at], ends[at + 1]
            todo += [(kids[k], depth, k > a) for k in range(b - 1, a - 1, -1)]
        return np.array(suffixes), np.array(turns)


class Extensions:
    """Longest common extensions between suffixes, by the lowest common ancestor."""

    def __init__(self, suffixes: np.ndarray, turns: np.ndarray):
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self._least = [turns.astype(np.int32)]
        while (half := 1 << (len(self._least) - 1)) * 2 <= len(turns):
            row = self._least[-1]
            self._least.append(np.minimum(row[:-half], row[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common length of the suffixes at ``i`` and ``j`` (each pair differs)."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for lv in np.unique(level):
            at = level == lv
            row = self._least[lv]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << lv)])
        return out


def _lyndon_ends(rank: list[int]) -> list[int]:
    """End of the longest Lyndon word at each position: the next smaller suffix.
    The closing 0 is the last suffix and the smallest."""
    n = len(rank) - 1
    ends, stack = [n] * n, [n]
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while rank[stack[-1]] > r:
            stack.pop()
        ends[i] = stack[-1]
        stack.append(i)
    return ends


def _tree_runs(ids: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of one piece."""
    n = len(ids)
    _, small = np.unique(ids, return_inverse=True)
    s = (small + 1).tolist()
    tree = SuffixTree(s)
    up = tree.tour()
    right = Extensions(*up)
    left = Extensions(*SuffixTree(s[::-1]).tour())
    down = np.empty(n + 1, np.int64)
    down[tree.tour(reverse=True)[0]] = np.arange(n + 1)
    i = np.tile(np.arange(n), 2)
    j = np.array(_lyndon_ends(right.rank.tolist()) + _lyndon_ends(down.tolist()))
    # suffix n is the closing 0 alone: nothing extends over it
    ahead = right(i, j)
    # the word before position x starts the reversed text's suffix at n - x; x = 0 is its closing 0
    behind = left(n - i, n - j)
    period = j - i
    start, length = i - behind, period + ahead + behind
    ok = (length >= max(2, least_exponent) * period) & (length >= least_length)
    return np.unique(np.stack([start, length, period], 1)[ok], axis=0)


def _pieces(ids: np.ndarray, least_length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces (start, words) that hold every run of exponent four or more: each
    word of a piece is in a triple that stands three times in it."""
    todo = [(0, ids)]
    while todo:
        base, part = todo.pop()
        n = len(part)
        if n < max(least_length, 4):
            continue
        _, one = np.unique(part, return_inverse=True)
        _, two = np.unique(one[:-1] * np.int64(n) + one[1:], return_inverse=True)
        _, three, times = np.unique(two[:-1] * np.int64(n) + one[2:], return_inverse=True, return_counts=True)
        often = times[three] >= 3
        edges = np.diff(np.concatenate(([0], often, [0])).astype(np.int8))
        begins, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0] + 2
        if len(begins) == 1 and begins[0] == 0 and ends[0] == n:
            yield base, part
        else:
            todo += [(base + int(a), part[a:b]) for a, b in zip(begins, ends, strict=True) if b - a >= least_length]


def runs_of(words: list[str], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT
            ) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a list of words, by start, then period."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # a cut by triples is right from exponent four on, in runs of six words or more
    cut = least_exponent >= 4 and least_length >= 6
    found = []
    for base, part in _pieces(ids, least_length) if cut else ([(0, ids)] if len(ids) else []):
        found += [(base + a, b, c) for a, b, c in _tree_runs(part, least_length, least_exponent).tolist()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that a run holds after its first period, joined by a blank."""
    if not runs:
        return " ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for a, b, c in runs:
        drop[a + c] += 1
        drop[a + b] -= 1
    keep = np.cumsum(drop)[:-1] == 0
    return " ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


# ---------------------------------------------------------------- operator
_RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_ARROW_RUN = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _find(least_length: int, least_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                runs, texts = [], []
                for text in part.column("_text").to_pylist():
                    words = _WORDS.findall(text)
                    got = runs_of(words, least_length, least_exponent)
                    runs.append([{"start": x, "length": y, "period": z} for x, y, z in got])
                    texts.append(collapse(words, got))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(runs, _ARROW_RUN), pa.array(texts, pa.string())],
                    ["_id", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, runs (array of start, length, period,
    by start, then period; words are numbered from 0), collapsed (the words that
    stay, joined by a blank).

    A run is at least ``least_length`` words long and ``least_exponent`` (2 or
    more) times its smallest period. Null and empty texts have no words and no
    runs. A text is worked on by itself, so memory grows with the longest piece of
    one text that a run can be in, never with the table. Repeated rows and null
    ids give a row each; an empty table gives an empty result; other columns of
    ``docs`` are not read.
    """
    d = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    schema = T.StructType([d.schema["_id"], T.StructField("runs", _RUN), T.StructField("collapsed", T.StringType())])
    return (d.mapInArrow(_find(least_length, least_exponent), schema)
            .select(F.col("_id").alias("doc_id"), "runs", "collapsed"))


# ---------------------------------------------------------------- query
def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the contract: one document in ten, by the checksum of its
    id, repeats its words from some word on; a null id counts as the empty text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = docs.select("doc_id", text_or_empty("text").alias("text"), h.alias("_h"))
    d = d.withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))))
    n = F.size("_words")
    d = d.withColumn("_g", F.floor(F.col("_h") / 10)).withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
    d = d.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    word = lambda i: F.get("_words", F.when(i < F.col("_a"), i).otherwise(
        F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    planted = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return d.select("doc_id", F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # the first of the runs with the greatest length / period, compared as products
    best = F.reduce(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
                    lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return (found.withColumn("_best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length",
                    "_best.period",
                    F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).cast("long")
                    .alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE: dict[str, str] = {}
