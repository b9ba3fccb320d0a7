"""Substring dedup with difference-cover anchors.

A window of ``window`` words that occurs at two places has, within its first
``period`` words, a position that lies in the difference cover modulo the
period in both places. So only the cover positions are hashed (one in about
four for a period of 21), each over the ``window - period + 1`` words that every
such window contains. Anchors that occur once cannot belong to a repeated
window; the others extend: each window around a repeated anchor is hashed
whole (128 bits) and is repeated when its word sequence starts at another place.

How it runs:

1. one narrow pass counts words and digests the word sequence of each text.
   Texts of at least one window that occur twice are covered completely; one of
   each group takes part below, so a hot text costs no more than any other;
2. texts are dealt to groups of about ``WORDS_PER_GROUP`` words by id, once: the
   later passes read the same exchange;
3. each group sends every hash it holds once, with a mark if it holds it twice,
   to the bucket of the hash's range; a bucket answers each group with those
   hashes that are repeated. A passage that sits in a third of all texts is one
   entry per group. Buckets grow in number with the input, not in size.

No list of places is ever paired, so nothing grows with the square of a group.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaybook.llm.common import stage, table, text_or_empty

WINDOW = 35
PERIOD = 21
WORDS_PER_GROUP = 2_000_000
HASHES_PER_BUCKET = 1_000_000

_SPANS = "array<struct<start:int,stop:int>>"
_EMPTY = hashlib.sha256(b"").digest()


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences give every residue."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            d = (0, *rest)
            if len({(a - b) % period for a in d for b in d}) == period:
                return d
    raise ValueError("period must be positive")


class _Text:
    """Words of one text, joined by one space, with their offsets."""

    def __init__(self, text: str):
        words = text.encode().split()
        self.n = len(words)
        self.joined = b" ".join(words)
        lens = np.fromiter(map(len, words), np.int64, self.n) + 1
        self.ends = np.cumsum(lens) - 1
        self.starts = self.ends - lens + 1

    def spans(self, at: np.ndarray, k: int):
        """Bytes of the ``k`` words from each position."""
        j = self.joined
        return (j[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + k - 1].tolist(), strict=True))

    def digest(self) -> bytes:
        return hashlib.sha256(self.joined).digest()


def _digests(batches):
    for b in batches:
        texts = [_Text(t) for t in b.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("_id"), pa.array([t.n for t in texts], pa.int64()),
             pa.array([t.digest() for t in texts], pa.binary())], ["_id", "_words", "_sha"])


class _Method:
    """What a group of texts does, given the parameters."""

    def __init__(self, window: int, period: int, buckets: tuple[int, int]):
        self.window, self.period, self.buckets = window, period, buckets
        self.cover = np.array(difference_cover(period))
        self.k = window - period + 1

    # ------------------------------------------------------------ hashing
    def anchors(self, t: _Text) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions and the hash of the anchor at each, as (n, 1) words."""
        at = (np.arange(0, t.n, self.period)[:, None] + self.cover).ravel()
        at = at[at + self.k <= t.n]
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, t.spans(at, self.k)), np.uint64, len(at))
        return at, h[:, None]

    def windows(self, t: _Text, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows around a repeated anchor, and their hashes (n, 2)."""
        at, h = self.anchors(t)
        hit = np.zeros(t.n + 1, np.int64)
        hit[at[_among(h, repeated)] + 1] = 1
        upto = np.cumsum(hit)
        i = np.arange(t.n - self.window + 1)
        i = i[upto[i + self.period] > upto[i]]
        raw = b"".join(map(xxhash.xxh3_128_digest, t.spans(i, self.window)))
        return i, np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)

    # ------------------------------------------------------------ exchange
    def send(self, gid: int, hashes: list[np.ndarray], level: int) -> pa.Table:
        """One row per bucket: the group's distinct hashes, and which occur twice in it."""
        width = level + 1
        h = np.concatenate(hashes) if hashes else np.empty((0, width), np.uint64)
        h = h[_order(h)]
        new = np.concatenate(([True], (h[1:] != h[:-1]).any(axis=1))) if len(h) else np.empty(0, bool)
        at = np.nonzero(new)[0]
        twice = np.diff(np.append(at, len(h))) > 1
        h = h[at]
        bucket = ((h[:, 0] >> np.uint64(32)) * np.uint64(self.buckets[level]) >> np.uint64(32)).astype(np.int64)
        cut = np.nonzero(np.diff(bucket))[0] + 1
        lo, hi = np.append(0, cut)[:len(h)], np.append(cut, len(h))[:len(h)]
        return pa.table({
            "_bucket": pa.array(bucket[lo] if len(h) else [], pa.int64()),
            "_gid": pa.array([gid] * (len(lo) if len(h) else 0), pa.int64()),
            "_hashes": pa.array([h[a:b].tobytes() for a, b in zip(lo, hi, strict=True)] if len(h) else [], pa.binary()),
            "_twice": pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(lo, hi, strict=True)] if len(h) else [], pa.binary()),
        })

    # ------------------------------------------------------------ passes over a group
    def texts(self, docs: pa.Table, side: pa.Table, *, digests: bool = False):
        """The texts of a group that take part: (words, rows with that text, digest)."""
        kind = np.array(side["_kind"].to_pylist(), int)
        ids = [v for v, k in zip(side["_id"].to_pylist(), kind, strict=True) if k == 0]
        count = dict(zip((v for v in side["_sha"].to_pylist() if v is not None),
                         (v for v in side["_rows"].to_pylist() if v is not None), strict=True))
        wanted = set(ids)
        for chunk in docs.to_batches(max_chunksize=256):
            for i, text in zip(chunk.column("_id").to_pylist(), chunk.column("_text").to_pylist(), strict=True):
                if i in wanted:
                    t = _Text(text)
                    if t.n >= self.window:
                        sha = t.digest() if digests else None
                        yield t, count.get(sha), sha

    @staticmethod
    def replies(side: pa.Table, level: int) -> np.ndarray:
        raw = b"".join(v for v, k in zip(side["_payload"].to_pylist(), side["_kind"].to_pylist(), strict=True)
                       if k == level + 1)
        h = np.frombuffer(raw, np.uint64).reshape(-1, level + 1)
        return h[_order(h)]

    def send_anchors(self, key, docs: pa.Table, side: pa.Table) -> pa.Table:
        return self.send(key[0].as_py(), [self.anchors(t)[1] for t, _, _ in self.texts(docs, side)], 0)

    def send_windows(self, key, docs: pa.Table, side: pa.Table) -> pa.Table:
        repeated = self.replies(side, 0)
        return self.send(key[0].as_py(), [self.windows(t, repeated)[1] for t, _, _ in self.texts(docs, side)], 1)

    def decide(self, key, docs: pa.Table, side: pa.Table) -> pa.Table:
        anchors, repeated = self.replies(side, 0), self.replies(side, 1)
        out = []
        for t, rows, sha in self.texts(docs, side, digests=True):
            if rows != 1:
                continue  # the whole text repeats
            i, h = self.windows(t, anchors)
            i = i[_among(h, repeated)]
            if not len(i):
                continue
            edge = np.zeros(t.n + 1, np.int64)
            edge[i] += 1
            edge[i + self.window] -= 1
            gone = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
            turn = np.nonzero(np.diff(gone))[0].reshape(-1, 2)
            kept, at = [], 0
            for a, b in [*turn.tolist(), [t.n, t.n]]:
                if a > at:
                    kept.append(t.joined[t.starts[at]:t.ends[a - 1]])
                at = b
            out.append((sha, int((turn[:, 1] - turn[:, 0]).sum()),
                        [{"start": a, "stop": b} for a, b in turn.tolist()],
                        hashlib.sha256(b" ".join(kept)).digest()))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.table({"_sha": pa.array(cols[0], pa.binary()), "_removed": pa.array(cols[1], pa.int64()),
                         "_spans": pa.array(cols[2], spans), "_kept": pa.array(cols[3], pa.binary())})


def _order(h: np.ndarray) -> np.ndarray:
    return np.argsort(h[:, 0], kind="stable") if h.shape[1] == 1 else np.lexsort((h[:, 1], h[:, 0]))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which rows of ``h`` are in the sorted distinct rows ``known``."""
    found = np.zeros(len(h), bool)
    at = np.searchsorted(known[:, 0], h[:, 0])
    while True:  # again only where different rows share their first word
        alike = (at < len(known)) & ~found
        alike[alike] = known[at[alike], 0] == h[alike, 0]
        if not alike.any():
            return found
        found[alike] = (known[at[alike]] == h[alike]).all(axis=1)
        at = at + 1


def _answer(width: int):
    def run(key, sent):
        parts = [np.frombuffer(v, np.uint64).reshape(-1, width) for v in sent["_hashes"].to_pylist()]
        twice = [np.unpackbits(np.frombuffer(v, np.uint8), count=len(p)).astype(bool)
                 for v, p in zip(sent["_twice"].to_pylist(), parts, strict=True)]
        h, twice = np.concatenate(parts), np.concatenate(twice)
        order = _order(h)
        s = h[order]
        same = (s[1:] == s[:-1]).all(axis=1)
        again = np.zeros(len(s), bool)
        again[1:] |= same
        again[:-1] |= same
        hit = np.zeros(len(s), bool)
        hit[order] = again
        hit |= twice
        gids, out = sent["_gid"].to_pylist(), []
        ends = np.cumsum([len(p) for p in parts])
        for g, p, e in zip(gids, parts, ends.tolist(), strict=True):
            own = hit[e - len(p):e]
            if own.any():
                out.append((g, p[own].tobytes()))
        return pa.table({"_gid": pa.array([g for g, _ in out], pa.int64()),
                         "_payload": pa.array([p for _, p in out], pa.binary())})
    return run


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans (word
    ranges [start, stop) that windows starting at another place, too, cover) and
    kept_sha256 (of the kept words joined by one space).

    Null and empty texts have no words and keep nothing; texts shorter than a
    window keep everything. Equal texts of at least a window, repeated rows
    included, cover each other completely. An empty table gives an empty
    result; other columns of ``docs`` are not read.
    """
    if not 0 < period <= window:
        raise ValueError("period must be between 1 and the window")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    id_field = texts.schema["_id"]
    rows = stage(texts.mapInArrow(_digests, T.StructType(
        [id_field, T.StructField("_words", T.LongType()), T.StructField("_sha", T.BinaryType())])), "word-digests")
    words = rows.agg(F.sum("_words")).first()[0] or 0
    groups = max(1, -(-words // WORDS_PER_GROUP))
    method = _Method(window, period, tuple(
        max(1, -(-n // HASHES_PER_BUCKET)) for n in (words * len(difference_cover(period)) // period, words)))

    # groups are partitions by their own number: hashing it again would put several in one task
    gid = F.pmod(F.xxhash64("_id"), F.lit(groups)).cast("int").alias("_gid")
    long = (rows.where(F.col("_words") >= window).groupBy("_sha")
            .agg(F.min("_id").alias("_id"), F.count("*").alias("_rows"), F.first("_words").alias("_words")))
    long = stage(long, "distinct-texts")
    dealt = texts.select("_id", "_text", gid).repartitionById(groups, "_gid")
    none = F.lit(None).cast("binary")
    takes_part = long.select(gid, F.lit(0).alias("_kind"), "_id", "_sha", "_rows", none.alias("_payload"))

    def answers(sent: DataFrame, level: int) -> DataFrame:
        got = sent.groupBy("_bucket").applyInArrow(_answer(level + 1), "_gid long, _payload binary")
        return got.select(F.col("_gid").cast("int").alias("_gid"), F.lit(level + 1).alias("_kind"), F.lit(None).cast(id_field.dataType).alias("_id"),
                          none.alias("_sha"), F.lit(None).cast("long").alias("_rows"), "_payload")

    def each(side: DataFrame, fn, schema: str) -> DataFrame:
        side = side.repartitionById(groups, "_gid")
        return dealt.groupBy("_gid").cogroup(side.groupBy("_gid")).applyInArrow(
            lambda key, docs, own: fn(key, docs, own), schema)

    sent = "_bucket long, _gid long, _hashes binary, _twice binary"
    one = stage(answers(each(takes_part, method.send_anchors, sent), 0), "repeated-anchors")
    side = takes_part.unionByName(one)
    two = answers(each(side, method.send_windows, sent), 1)
    cut = each(side.unionByName(two), method.decide, f"_sha binary, _removed long, _spans {_SPANS}, _kept binary")

    whole = F.col("_rows") > 1
    all_of = F.array(F.struct(F.lit(0).alias("start"), F.col("_words").cast("int").alias("stop")))
    known = (long.join(cut, "_sha", "left")
             .select("_sha", F.when(whole, F.col("_words")).otherwise(F.col("_removed")).alias("_removed"),
                     F.when(whole, all_of).otherwise(F.col("_spans")).alias("_spans"),
                     F.when(whole, F.lit(_EMPTY)).otherwise(F.col("_kept")).alias("_kept"))
             .where("_removed is not null"))
    # written: the last join then has an exchange on either side, so AQE can split a hot text
    known = stage(known, "repeated-spans")
    return (rows.join(known, "_sha", "left")
            .select(F.col("_id").alias("doc_id"), F.col("_words").alias("n_words"),
                    F.coalesce("_removed", F.lit(0).cast("long")).alias("n_removed"),
                    F.coalesce("_spans", F.array().cast(_SPANS)).alias("spans"),
                    F.lower(F.hex(F.coalesce("_kept", "_sha"))).alias("kept_sha256")))


# ---------------------------------------------------------------- query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE: dict[str, str] = {}
