"""Benchmark decontamination: a BM25 index of the test items, queried by every
training passage with block-max WAND.

Impacts are divided by the item's score against itself, so a passage scores 1
for an item it holds whole and one ``THRESHOLD`` serves all items. Passages
overlap by half and are twice as long as the longest item, so any item lies
whole in one of them.

Retrieval keeps every item at or above the threshold. Terms that many items share
are set aside while what they can add to any item stays within half the threshold
(as in MaxScore; that much counts for every item until its score is summed). Each
other distinct term of a passage is a cursor on its postings, which are sorted by
item. Cursors are put in the order of their items; the pivot is the first item
where the summed bounds of the postings left reach the threshold, so no item before
it can. If the maxima of
the blocks that the pivot falls in do not reach it, the cursors skip to the first
item where a block ends or another cursor stands; otherwise the cursors behind move
up to the pivot, its score is summed, and the walk goes on after it. The threshold never
changes, so the walks of many passages are independent: numpy takes one step of
all of them at a time.

Retrieved pairs are then verified: the words of the question part and of the
answer part that the passage repeats in runs of three must reach their shares.

A word is a run of letters and digits; in scripts that are written without spaces
each character is one. Items of fewer than ``LEAST_WORDS`` words have too little
for shares and scores: they are looked up whole, all words in order, where they
stand between stops (ends of sentences, lines or the text) or where the stops
inside the item are repeated too. Words of a running sentence that happen to be
those of such an item are no copy of it.

Items are indexed in shards of about ``SHARD_ITEMS``; ``PASS_SHARDS`` of them go
to the executors at once and one pass over the documents searches them all, so
what is sent is bounded whatever the number of items, and what a pass found is
written before the next one's shards are built. Document frequencies count all
items.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from assaybook.llm.common import fresh, id_key, stage, table, text_or_empty

THRESHOLD = 0.6
QUESTION_SHARE, ANSWER_SHARE = 0.8, 0.5
RUN = 3
#: Items with fewer words are not scored but looked up whole.
LEAST_WORDS = 5
LEAST_STRIDE = 64
#: Postings of a block.
BLOCK = 8
SHARD_ITEMS = 20_000
#: Shards that one pass over the documents searches.
PASS_SHARDS = 4
#: Rounding of summed impacts.
EPS = 1e-9
K1, B = 1.2, 0.75

# Letters of scripts without spaces between words (Thai, Lao, Myanmar, Khmer, Tai, Balinese,
# Javanese, Han, kana, Bopomofo, Yi)
_UNSPACED = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u1b00-\u1b7f\u2e80-\u2fdf"
             "\u3005-\u3007\u3031-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\ua4cf\ua980-\ua9ff\uaa60-\uaa7f"
             "\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U000323af")
_WORD, _SPLIT_WORD = re.compile(r"\w+"), re.compile(rf"[^\W{_UNSPACED}]+|(?=[{_UNSPACED}])\w")
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|(?<=[。？！｡])\s*")
#: What ends a sentence or a line, in a gap between words.
_STOP = re.compile(r"[.?!:;][^\w\s]*\s|[\n\r。？！：；｡]")


def _word_pattern(low: str) -> re.Pattern:
    return _SPLIT_WORD if not low.isascii() and _HAS_UNSPACED.search(low) else _WORD


def words_of(text: str) -> list[str]:
    low = text.lower()
    return _word_pattern(low).findall(low)


def stops_of(text: str) -> list[bool]:
    """Whether a stop, or the text's start or end, stands before each word and after the last."""
    low = text.lower()
    stops, at = [], 0
    for m in _word_pattern(low).finditer(low):
        stops.append(not stops or bool(_STOP.search(low, at, m.start())))
        at = m.end()
    return [*stops, True]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; of a single sentence, its last quarter."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the words of ``part`` in runs of ``RUN`` (or all of a shorter
    part) that ``passage`` repeats; 1 for an empty part."""
    if not part:
        return 1.0
    k = min(RUN, len(part))
    grams = {tuple(passage[i:i + k]) for i in range(len(passage) - k + 1)}
    hit = np.zeros(len(part), bool)
    for i in range(len(part) - k + 1):
        if tuple(part[i:i + k]) in grams:
            hit[i:i + k] = True
    return float(hit.mean())


class ItemIndex:
    """Inverted index of one shard of the items that are scored."""

    def __init__(self, items: list[tuple[object, list[str], list[str]]], df: dict[str, int], total: int,
                 mean_words: float, threshold: float = THRESHOLD):
        """``items``: (id, question words, answer words); ``df``, ``total`` and
        ``mean_words`` describe the items of all shards."""
        self.items, self.threshold = items, threshold
        self.pivots = self.scored = 0  # pivots chosen, and those whose score was summed
        holders = defaultdict(list)
        for i, (_, q, a) in enumerate(items):
            words, tf = q + a, defaultdict(int)
            for w in words:
                tf[w] += 1
            norm = K1 * (1 - B + B * len(words) / mean_words)
            impact = {w: np.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm)
                      for w, n in tf.items()}
            own = sum(impact.values())
            for w, v in impact.items():
                holders[w].append((i, v / own))
        self.stride = max([LEAST_STRIDE, *(len(q) + len(a) for _, q, a in items)])
        # common terms, by how many items hold them, while they add at most half the threshold to any item
        common = np.zeros(len(items))
        #: Per item the impacts of its common terms.
        self.common: list[dict[str, float]] = [{} for _ in items]
        rest = sorted(holders, key=lambda w: (-len(holders[w]), w))
        while rest:
            more = common.copy()
            for i, v in holders[rest[0]]:
                more[i] += v
            if more.max() > threshold / 2:
                break
            for i, v in holders[rest[0]]:
                self.common[i][rest[0]] = v
            common, rest = more, rest[1:]
        #: The most that common terms add to an item, and to any.
        self.share, self.slack = common, max(common, default=0.0)
        self.term = {w: t for t, w in enumerate(rest)}
        postings = [holders[w] for w in rest]
        sizes = np.array([len(p) for p in postings], np.int64)
        #: First posting of each term and the end of the last; items ascend within a term.
        self.at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.item = np.array([i for p in postings for i, _ in p], np.int64)
        self.impact = np.array([v for p in postings for _, v in p])
        # (term, item) as one ascending number: a cursor moves by one binary search
        self.key = np.repeat(np.arange(len(sizes)), sizes) * (len(items) + 1) + self.item
        #: Per posting the largest impact of its term from there on.
        self.bound = np.array([m for p in postings for m in [*accumulate((v for _, v in reversed(p)), max)][::-1]])
        # blocks of BLOCK postings, none over two terms
        blocks = -(-sizes // BLOCK)
        self.block_at = np.cumsum(blocks) - blocks
        starts = np.repeat(self.at[:-1], blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(self.block_at, blocks))
        self.block_most = np.maximum.reduceat(self.impact, starts) if len(starts) else self.impact
        ends = np.minimum(starts + BLOCK, np.repeat(self.at[1:], blocks))
        self.block_last = self.item[ends - 1] if len(starts) else self.item

    @property
    def weights(self) -> list[dict[str, float]]:
        """Per item the impact of each of its words."""
        out = [dict(c) for c in self.common]
        for w, t in self.term.items():
            for x in range(self.at[t], self.at[t + 1]):
                out[self.item[x]][w] = self.impact[x]
        return out

    def _seek(self, term: np.ndarray, pos: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The first posting of each term after ``pos`` and at or after an item."""
        pos, end = pos + 1, self.at[term + 1]
        far = np.flatnonzero(pos < end)
        far = far[self.item[pos[far]] < item[far]]
        pos[far] = np.searchsorted(self.key, term[far] * (len(self.items) + 1) + item[far])
        return pos

    def retrieve(self, term: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score without common terms) of all that can reach the
        threshold, from the occurrences (term, passage number). One round is one
        WAND step of every passage."""
        if not len(term):
            return passage, term, np.zeros(0)
        over, least = len(self.items), self.threshold - self.slack - EPS
        occ = np.unique(passage * len(self.term) + term)  # a term counts once a passage
        passage, term = occ // len(self.term), occ % len(self.term)
        pos, hits = self.at[term], []
        item = self.item[pos]
        while len(term):
            order = np.argsort(passage * (over + 1) + item, kind="stable")
            passage, term, pos, item = passage[order], term[order], pos[order], item[order]
            first = np.flatnonzero(np.diff(passage, prepend=-1))
            walk = np.repeat(np.arange(len(first)), np.diff(first, append=len(term)))
            # pivot: where the bounds of what is left, summed in the order of the items, reach the threshold
            bound = self.bound[pos]
            total = np.cumsum(bound)
            reach = np.flatnonzero(total >= (total[first] - bound[first] + least)[walk])
            reach = reach[np.flatnonzero(np.diff(walk[reach], prepend=-1))]
            pivot = np.full(len(first), -1)
            pivot[walk[reach]] = item[reach]
            goal = pivot[walk]
            near, far = np.flatnonzero(item <= goal), np.flatnonzero((item > goal) & (goal >= 0))  # no pivot: the walk is over
            t, w, to, goal = term[near], walk[near], pos[near], goal[near]
            behind = np.flatnonzero(item[near] < goal)
            to[behind] = self._seek(t[behind], to[behind], goal[behind])
            held = to < self.at[t + 1]
            t, w, to, goal, number = t[held], w[held], to[held], goal[held], passage[near][held]
            # maxima of the blocks that the pivot falls in, and the first end of one or item of another cursor
            block = self.block_at[t] + (to - self.at[t]) // BLOCK
            skip = np.bincount(w, self.block_most[block], len(first)) < least
            stop = np.full(len(first), over)
            np.minimum.at(stop, w, self.block_last[block] + 1)
            after = far[np.flatnonzero(np.diff(walk[far], prepend=-1))]
            stop[walk[after]] = np.minimum(stop[walk[after]], item[after])
            at = self.item[to] == goal
            score = np.bincount(w[at], self.impact[to[at]], len(first))
            self.pivots += len(reach)
            hit = np.flatnonzero(~skip & (pivot >= 0))
            self.scored += len(hit)
            hit = hit[score[hit] + self.share[pivot[hit]] >= self.threshold - EPS]
            if len(hit):
                hits.append((passage[first[hit]], pivot[hit], score[hit]))
            # skip over the blocks, or go on after the pivot
            target = np.where(skip, stop, pivot + 1)[w]
            behind = np.flatnonzero(self.item[to] < target)
            to[behind] = self._seek(t[behind], to[behind], target[behind])
            held = to < self.at[t + 1]
            t, to, number = t[held], to[held], number[held]
            passage, term = np.concatenate([number, passage[far]]), np.concatenate([t, term[far]])
            pos, item = np.concatenate([to, pos[far]]), np.concatenate([self.item[to], item[far]])
        if not hits:
            return passage[:0], term[:0], np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*hits, strict=True))

    def search(self, texts: list[list[str]]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of the verified
        pairs, each with its best passage."""
        get = self.term.get
        ids = [np.fromiter(map(get, t, repeat(-1)), np.int64, len(t)) for t in texts]
        passages = np.array([max(1, -(-len(t) // self.stride)) for t in texts])
        base = np.cumsum(passages) - passages
        occ, where = [], []
        for n, row in enumerate(ids):
            pos = np.nonzero(row >= 0)[0]
            p = pos // self.stride
            occ += [row[pos], row[pos[p > 0]]]
            where += [base[n] + p, base[n] + p[p > 0] - 1]
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for p, i, score in zip(*self.retrieve(np.concatenate(occ), np.concatenate(where)), strict=True) if occ else ():
            n = int(np.searchsorted(base, p, "right")) - 1
            lo = (p - base[n]) * self.stride
            passage = texts[n][lo:lo + 2 * self.stride]
            terms = set(passage)
            score += sum(v for w, v in self.common[i].items() if w in terms)
            if score < self.threshold - EPS:
                continue
            q, a = overlap(self.items[i][1], passage), overlap(self.items[i][2], passage)
            if q >= QUESTION_SHARE and a >= ANSWER_SHARE:
                found[n, int(i)] = max(found.get((n, i), (0.0, 0.0, 0.0)), (min(1.0, float(score)), q, a))
        for (n, i), (score, q, a) in sorted(found.items()):
            yield n, i, score, q, a


class WholeItems:
    """Items of too few words to score, by all their words."""

    def __init__(self, items: list[tuple[object, list[str], list[bool]]]):
        """``items``: (id, words, whether a stop stands before each word and after the last)."""
        self.items = items
        self.at: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for i, (_, words, _) in enumerate(items):
            self.at[tuple(words)].append(i)
        self.first = {words[0] for words in self.at}
        self.lengths = sorted({len(words) for words in self.at})

    def search(self, text: str, words: list[str]) -> list[int]:
        """Items that ``text``, whose words are ``words``, holds."""
        if self.first.isdisjoint(words):
            return []
        found, stops = set(), None
        for lo, w in enumerate(words):
            if w not in self.first:
                continue
            for n in self.lengths:
                if lo + n > len(words):
                    break
                for i in self.at.get(tuple(words[lo:lo + n]), ()):
                    stops = stops or stops_of(text)
                    inside = [k for k in range(1, n) if self.items[i][2][k]]
                    if stops[lo] and stops[lo + n] or inside and all(stops[lo + k] for k in inside):
                        found.add(i)
        return sorted(found)


_PARTS = T.StructType([T.StructField("_q", T.ArrayType(T.StringType())), T.StructField("_a", T.ArrayType(T.StringType())),
                       T.StructField("_stops", T.ArrayType(T.BooleanType()))])


def _split_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    for b in batches:
        texts = b.column("_text").to_pylist()
        parts = [question_and_answer(t) for t in texts]
        stops = [stops_of(t) if len(q) + len(a) < LEAST_WORDS else [] for t, (q, a) in zip(texts, parts, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("_item"), pa.array([q for q, _ in parts], strings), pa.array([a for _, a in parts], strings),
             pa.array(stops, pa.list_(pa.bool_()))], ["_item", *_PARTS.names])


def _search_batches(shards: list, id_type: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [cloudpickle.loads(s.value) for s in shards]
        for b in batches:
            at, texts = 0, b.column("_text").to_pylist()
            while at < len(texts):  # some MB of text at a time
                to, size = at, 0
                while to < len(texts) and size < 2 << 20:
                    size += len(texts[to])
                    to += 1
                words = [words_of(t) for t in texts[at:to]]
                hits = []
                for scored, whole in loaded:
                    hits += [(n, scored.items[i][0], *rest) for n, i, *rest in scored.search(words)]
                    if whole.items:
                        hits += [(n, whole.items[i][0], 1.0, 1.0, 1.0)
                                 for n, (t, w) in enumerate(zip(texts[at:to], words, strict=True)) for i in whole.search(t, w)]
                if hits:
                    n, i, *rest = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("_id").take(pa.array([at + x for x in n])),
                         pa.array(i, id_type),
                         *(pa.array(c, pa.float64()) for c in rest)],
                        ["_id", "_item", "score", "question_overlap", "answer_overlap"])
                at = to
    return run


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD,
                       shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per (document, item) whose passage is verified: doc_id, item_id,
    score, question_overlap, answer_overlap. Clean documents have no row.

    Null texts, and texts without a word, match nothing. Items with fewer than
    ``LEAST_WORDS`` words are looked up whole; their scores and overlaps are 1.
    Repeated items and rows match like any other. Ids may be of any type that Arrow
    has. Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    t = items.select(F.col(item_col).alias("_item"), text_or_empty(item_text_col).alias("_text"))
    item_field = t.schema["_item"]
    parts = stage(t.mapInArrow(_split_items, T.StructType([item_field, *_PARTS.fields])), "benchmark-items")
    all_words = F.concat("_q", "_a")
    parts = parts.where(F.size(all_words) > 0)
    scored = F.size(all_words) >= LEAST_WORDS
    n_items, total, mean = parts.agg(F.count("*"), F.count_if(scored), F.avg(F.when(scored, F.size(all_words)))).first()
    d = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    schema = T.StructType([d.schema["_id"], item_field, *(T.StructField(c, T.DoubleType()) for c in (
        "score", "question_overlap", "answer_overlap"))])
    df = (parts.where(scored).select(F.explode(F.array_distinct(all_words)).alias("_term")).groupBy("_term")
          .agg(F.count("*").alias("_df")))
    shards = -(-n_items // shard_items)
    shard = F.pmod(F.xxhash64("_item", "_q", "_a"), F.lit(max(1, shards)))
    id_type = to_arrow_type(item_field.dataType)
    out = None
    for lo in range(0, shards, PASS_SHARDS):
        sent = []
        for s in range(lo, min(shards, lo + PASS_SHARDS)):
            mine = parts.where(shard == s)
            rows = mine.collect()  # about ``shard_items`` items
            terms = mine.where(scored).select(F.explode(F.array_distinct(all_words)).alias("_term")).distinct()
            counts = {r["_term"]: r["_df"] for r in terms.join(df, "_term").collect()}
            rows.sort(key=lambda r: (str(r["_item"]), r["_q"], r["_a"]))
            long, short = ([r for r in rows if (len(r["_q"]) + len(r["_a"]) >= LEAST_WORDS) == is_long] for is_long in (True, False))
            index = ItemIndex([(r["_item"], r["_q"], r["_a"]) for r in long], counts, total, mean, threshold)
            whole = WholeItems([(r["_item"], r["_q"] + r["_a"], r["_stops"]) for r in short])
            sent.append(spark.sparkContext.broadcast(cloudpickle.dumps((index, whole))))
        got = stage(d.mapInArrow(_search_batches(sent, id_type), schema), "benchmark-hits")
        for b in sent:
            b.destroy()
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select(F.col("_id").alias("doc_id"), F.col("_item").alias("item_id"), "score", "question_overlap",
                      "answer_overlap")


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item, all columns. Ids decide, so
    rows that repeat a contaminated id go too (null ids count as one id)."""
    found = find_contamination(docs, items, id_col=id_col, text_col=text_col, item_col=item_col,
                               item_text_col=item_text_col)
    key = fresh(docs, "_row_key")
    bad = stage(found.select(id_key(F.col("doc_id")).alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, id_key(F.col(id_col))).join(bad, key, "left_anti").select(*docs.columns)


# ---------------------------------------------------------------- query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE: dict[str, str] = {}
