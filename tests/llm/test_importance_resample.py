from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from assaybook.llm import importance_resample as R

MAX, MIN = (1 << 63) - 1, -(1 << 63)


def plain(rows, target, *, percent=10, least_words=20, max_n=1, buckets=10_000):
    """The contract's rule on lists of (id, text), in plain code."""
    def features(text):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [" ".join(w[i:i + k]) for k in range(1, max_n + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(
        (t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, text in rows:
        w, fs = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))),
                    len(w) >= least_words])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[:len(able) * percent // 100], 1):
        r.append(rank)
    return [(*r[:4], r[5] if len(r) > 5 else None) for r in out]


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["Alpha", "beta", "gamma", "δέλτα", "x1", "the", "The"]) + rng.choice(["", ".", "-y"])
                     for _ in range(rng.randint(0, 60))) for _ in range(n)]


EDGES = [(900, None), (901, ""), (902, " .,!\n"), (903, "a " * 19), (904, "a " * 20), (905, "B c " * 4000),
         (None, "alpha beta " * 15), (None, None), (5, "alpha beta " * 15), (5, "alpha beta " * 15)]


@pytest.mark.parametrize("max_n", [1, 3])
def test_resample_is_the_plain_rule(spark, make_docs, max_n):
    rows = list(enumerate(texts(150, 1))) + EDGES
    target = [*texts(8, 2), "beta gamma " * 30, None]
    docs = make_docs(rows)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = [tuple(r) for r in R.resample(docs.repartition(5), items, percent=40, max_n=max_n, block=16).collect()]
    want = plain(rows, target, percent=40, max_n=max_n)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[4] is not None for r in got) > 40


@pytest.mark.parametrize("block", [4, 1 << 18])
def test_radix_ranks_with_hot_keys_and_wide_keys(spark, block):
    rng = random.Random(block)
    # a third of the rows shares all keys, others differ in the lowest or the highest bits only
    rows = ([(7, 7)] * 60 + [(rng.choice([0, 1, 7, 8, MAX, MAX - 1, 1 << 40]), rng.randrange(1 << 45))
                             for _ in range(120)])
    rng.shuffle(rows)
    df = (spark.createDataFrame(rows, "a long, b long").repartition(3)
          .select(F.monotonically_increasing_id().alias("_row"), "a", "b"))
    df = spark.createDataFrame(df.collect(), df.schema)
    got = {r["_row"]: r["_rank"] for r in R.radix_ranks(df, ["a", "b"], block=block, bits=5).collect()}
    want = sorted(df.collect(), key=lambda r: (r["a"], r["b"]))
    by_rank = {v: k for k, v in got.items()}
    keys = {r["_row"]: (r["a"], r["b"]) for r in want}
    assert sorted(by_rank) == list(range(1, len(rows) + 1))
    assert [keys[by_rank[i + 1]] for i in range(len(rows))] == [(r["a"], r["b"]) for r in want]


def test_rows_with_equal_keys_all_get_a_rank(spark):
    df = spark.createDataFrame([(i + (1 << 33) * (i % 3), 0) for i in range(50)], "_row long, a long")
    got = {r["_row"]: r["_rank"] for r in R.radix_ranks(df, ["a"]).collect()}
    assert [got[k] for k in sorted(got)] == list(range(1, 51))


def test_ids_of_the_whole_range(spark, make_docs):
    text = "same words here " * 10
    rows = [(i, text) for i in (MIN, MAX, 0, -1, 1, -(1 << 40), None)]
    target = spark.createDataFrame([(0, "same")], "item_id long, text string")
    got = R.resample(make_docs(rows), target, percent=100).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(plain(rows, ["same"], percent=100), key=repr)


def test_other_ids_are_refused(spark):
    df = spark.createDataFrame([("x", "a")], "doc_id string, text string")
    with pytest.raises(ValueError, match="integers"):
        R.resample(df, df)


def test_empty_tables(spark, make_docs, write_tables):
    none = spark.createDataFrame([], "item_id long, text string")
    df = R.resample(make_docs([]), none)
    assert df.collect() == []
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in df.dtypes} == {"bigint"}
    rows = list(enumerate(texts(60, 3)))
    got = R.resample(make_docs(rows), none).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(plain(rows, []), key=repr)


def test_query_is_the_oracle(spark, make_docs, write_tables, against_oracle):
    rows = list(enumerate(texts(120, 4))) + [(900, None), (901, ""), (902, "a " * 30)]
    sf = write_tables(documents=make_docs(rows),
                      benchmark=spark.createDataFrame([(0, "beta x1 " * 9), (1, None)], "item_id long, text string"))
    got, want = against_oracle(R, "op13_importance_resample", sf, ["documents", "benchmark"])
    assert got == want
