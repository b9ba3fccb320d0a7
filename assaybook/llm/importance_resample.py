"""Importance resampling towards a target distribution, ranked by a radix sort.

Features of a text are its runs of one to ``max_n`` words, hashed into buckets.
The bucket counts of all raw texts and of all target texts give an array of one
gain per bucket (log of the target's share over the raw share, in thousandths),
and a document's weight is the sum of the gains of its features. Gumbel noise
from the id is added, and the greatest sums are drawn: a sample without
replacement in proportion to exp(weight).

Ranks come from a distributed LSD radix sort of the composite key (score
downwards, id upwards). Each pass is a stable counting sort on one digit: every
block of rows counts its digits, prefix sums over (digit, block) give the global
offset of each block's rows with each digit, and a row's destination is its
offset plus its place among its block's equal digits. Rows then move to the block
of their destination. A block holds at most ``BLOCK`` rows whatever the keys are,
so equal or skewed keys change nothing. After the last digit the destination is
the rank. Each pass is a written table, so a lost executor repeats one pass.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaybook.llm.common import stage, table, text_or_empty

MAX_N = 1
BUCKETS = 10_000
LEAST_WORDS = 20
#: Fixed value of the contract: the prefix of the hashed id.
SEED = "2024"
#: Rows that one task sorts at once, and the bits of a digit.
BLOCK = 1 << 18
DIGIT_BITS = 13

#: Bytes of words as they are, A-Z in lower case, all others a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
               for b in range(256))
#: Words whose bucket a task remembers.
_REMEMBER = 1 << 20


# ---------------------------------------------------------------- features
class _Buckets(dict):
    """Bucket of each feature that was seen."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _REMEMBER:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.buckets
        return b


def feature_buckets(text: str, max_n: int, bucket_of: _Buckets) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature of one text."""
    words = text.encode().translate(_BYTES).split()
    parts = [np.fromiter(map(bucket_of.__getitem__, words), np.int64, len(words))]
    for k in range(2, max_n + 1):
        runs = (b" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
        parts.append(np.fromiter(map(bucket_of.__getitem__, runs), np.int64))
    return len(words), np.concatenate(parts)


def _count(max_n: int, buckets: int) -> Callable:
    """One row per bucket that the task's texts fill."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column("_text").to_pylist():
                total += np.bincount(feature_buckets(text, max_n, bucket_of)[1], minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["_bucket", "_n"])
    return run


def bucket_counts(texts: DataFrame, *, text_col: str = "text", max_n: int = MAX_N,
                  buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: ``buckets`` numbers whatever the input."""
    parts = (texts.select(text_or_empty(text_col).alias("_text"))
             .mapInArrow(_count(max_n, buckets), "_bucket long, _n long"))
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("_bucket").agg(F.sum("_n").alias("_n")).collect():
        out[r["_bucket"]] = r["_n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, add-one smoothed, floored."""
    k, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k))))
                     for s, t in zip(raw.astype(float).tolist(), target.astype(float).tolist(), strict=True)],
                    np.int64)


def noise(doc_id, seed: str = SEED) -> int:
    """Gumbel noise in thousandths from the id (null: the empty text)."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain: np.ndarray, max_n: int, seed: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Buckets(len(gain))
        for b in batches:
            words, size, weight = [], [], []
            for text in b.column("_text").to_pylist():
                n, at = feature_buckets(text, max_n, bucket_of)
                words.append(n)
                size.append(len(at))
                weight.append(int(gain[at].sum()))
            ids = b.column("_id")
            score = [w + noise(i, seed) for w, i in zip(weight, ids.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("_row"), ids, *(pa.array(c, pa.int64()) for c in (words, size, weight, score))],
                ["_row", "_id", "_words", "_size", "_weight", "_score"])
    return run


# ---------------------------------------------------------------- radix sort
def _digit(key: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")


def _counting_sort(key: str, keys: list[str], shift: int, bits: int, block: int) -> Callable:
    """Destinations of one block's rows: offset of the digit, plus the place among
    the block's rows of that digit in their present order."""
    def run(rows: pa.Table, offsets: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["_pos"].to_numpy(), kind="stable")))
        digit = (rows[key].to_numpy() >> shift) & ((1 << bits) - 1)
        order = np.argsort(digit, kind="stable")
        d = digit[order]
        first = np.searchsorted(d, d, "left")
        at, start = offsets["_digit"].to_numpy(), offsets["_offset"].to_numpy()
        by = np.argsort(at)
        dest = start[by][np.searchsorted(at[by], d)] + np.arange(len(d)) - first
        rows = rows.take(pa.array(order))
        return pa.table([rows["_row"], *(rows[k] for k in keys), pa.array(dest // block), pa.array(dest)],
                        ["_row", *keys, "_block", "_pos"])
    return run


def radix_ranks(rows: DataFrame, keys: list[str], *, row: str = "_row", block: int = BLOCK,
                bits: int = DIGIT_BITS) -> DataFrame:
    """(_row, _rank) of every row: its place from 1 in the order of ``keys``, the
    most significant first.

    Keys are non-negative longs without null; ``row`` names each row and must
    differ in all rows; its order breaks ties. An empty table gives an empty result.
    """
    top = rows.agg(F.count("*"), *[F.max(k) for k in keys]).first()
    # a row number with gaps (task, place in the task) is cut into blocks per task
    start = F.col(row)
    cur = rows.select(F.col(row).alias("_row"), *keys,
                      (F.shiftright(start, 33) * (1 << 33) + F.floor(
                          start.bitwiseAND(F.lit((1 << 33) - 1)) / block)).alias("_block"), start.alias("_pos"))
    passes = [(k, s) for k, m in zip(reversed(keys), reversed(top[1:]), strict=True)
              for s in range(0, (m or 0).bit_length(), bits)]
    for n, (key, shift) in enumerate(passes):
        counts = cur.groupBy("_block", _digit(F.col(key), shift, bits).alias("_digit")).agg(F.count("*").alias("_n"))
        counts = stage(counts, f"radix-counts{n}")
        before = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        # at most 2^bits rows: one task sums them, and each task may hold them
        smaller = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        base = (counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))
                .select("_digit", F.coalesce(F.sum("_all").over(smaller), F.lit(0)).alias("_base")))
        offsets = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
                   .join(F.broadcast(base), "_digit")
                   .select("_block", "_digit", (F.col("_base") + F.col("_before")).alias("_offset")))
        schema = T.StructType([T.StructField(c, T.LongType()) for c in ("_row", *keys, "_block", "_pos")])
        cur = stage(cur.groupBy("_block").cogroup(offsets.groupBy("_block")).applyInArrow(
            _counting_sort(key, keys, shift, bits, block), schema), f"radix-pass{n}")
    if not passes:  # all keys are zero: the order of the rows
        one = Window.partitionBy(F.shiftright("_pos", 33)).orderBy("_pos")
        per = cur.groupBy(F.shiftright("_pos", 33).alias("_task")).agg(F.count("*").alias("_n"))
        off = per.select("_task", F.coalesce(F.sum("_n").over(
            Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
        return (cur.withColumn("_task", F.shiftright("_pos", 33)).withColumn("_k", F.row_number().over(one))
                .join(off, "_task").select("_row", (F.col("_off") + F.col("_k")).alias("_rank")))
    return cur.select("_row", (F.col("_pos") + 1).alias("_rank"))


# ---------------------------------------------------------------- operator
def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", percent: int = 10, least_words: int = LEAST_WORDS,
             max_n: int = MAX_N, buckets: int = BUCKETS, seed: str = SEED, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (1, 2,
    3... of the rows drawn; null for the others).

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are
    drawn. Null text counts as empty: no features, weight 0, never drawn unless
    ``least_words`` is 0. Ids are integers (others raise); a null id takes the noise
    of the empty text and comes after every other id of the same score. Rows that
    repeat an id are drawn each for itself. An empty target leaves the smoothing
    alone to decide; an empty table gives an empty result. Other columns of
    either table are not read.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"ids must be integers, {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    sizes = dict(max_n=max_n, buckets=buckets)
    gain = gains(bucket_counts(docs, text_col=text_col, **sizes),
                 bucket_counts(target, text_col=target_text_col, **sizes))
    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("_id"),
                    text_or_empty(text_col).alias("_text"))
    schema = T.StructType([T.StructField(c, T.LongType())
                           for c in ("_row", "_id", "_words", "_size", "_weight", "_score")])
    scored = stage(d.mapInArrow(_weigh(gain, max_n, seed), schema), "weights")
    able = scored.where(F.col("_words") >= least_words)
    n, top, least, most = able.agg(F.count("*"), F.max("_score"), F.min("_id"), F.max("_id")).first()
    # keys: distance from the top score; distance from the smallest id, null after all.
    # a span beyond a signed long is cut in two keys
    least, most = (0, 0) if least is None else (least, most)
    down = (F.lit(top if n else 0) - F.col("_score")).alias("_down")
    if most - least < (1 << 62):
        ids = {"_up": F.coalesce(F.col("_id") - least, F.lit(most - least + 1))}
    else:
        ids = {"_null": F.col("_id").isNull().cast("long"),
               "_high": F.coalesce(F.shiftright("_id", 32) + (1 << 31), F.lit(0)),
               "_low": F.coalesce(F.col("_id").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0))}
    ranks = radix_ranks(able.select("_row", down, *[c.cast("long").alias(k) for k, c in ids.items()]),
                        ["_down", *ids], block=block)
    drawn = ranks.where(F.col("_rank") <= n * percent // 100)
    return (scored.join(drawn, "_row", "left")
            .select(F.col("_id").alias("doc_id"), F.col("_size").alias("n_features"),
                    F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.col("_rank").alias("rank")))


# ---------------------------------------------------------------- query
def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_importance_resample": op13_importance_resample}

ORACLE = {"op13_importance_resample": r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: xor(c >> 1, 3988292384::UBIGINT * (c & 1)))) AS t),
dw AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM documents),
bw AS (
  SELECT unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
dist AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
byt AS (
  SELECT w, list_prepend(4294967295::UBIGINT,
           list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::UBIGINT)) AS b
  FROM dist),
crc AS (
  SELECT w, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) % 256 + 1)::BIGINT])), 4294967295::UBIGINT) % 10000 AS k
  FROM byt, tab),
s AS (SELECT k, count(*) AS n FROM dw JOIN crc USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM bw JOIN crc USING (w) GROUP BY k),
g AS (
  SELECT i AS k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
           / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.k = i LEFT JOIN t ON t.k = i),
f AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM dw JOIN crc USING (w) JOIN g USING (k) GROUP BY doc_id),
x AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT::DOUBLE
           + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN f USING (doc_id)),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM x WHERE n_features >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM x LEFT JOIN r USING (doc_id)
"""}
