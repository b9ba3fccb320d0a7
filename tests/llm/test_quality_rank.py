import random
import zlib

import numpy as np

from assaybook.llm import quality_rank as Q


def good(rng, n):
    return "\n".join(" ".join(rng.choice("the red fox runs over some small hill by night".split()).capitalize()
                              if k == 0 else rng.choice("red fox runs over hill by night a lot of wet moss".split())
                              for k in range(8)) + "." for _ in range(n))


def bad(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(["Same"] * 8 * n)
    words = good(rng, n).split()
    return " ".join(w + "$$$" for w in words) if kind == 1 else " ".join(words).upper().replace(" ", "!! ")


def test_features_of_edge_texts():
    for t in ["", " ", "\n\n", "a", "é" * 10, "x" * 200_000, "$ # !"]:
        f = Q.features(t)
        assert len(f) == len(Q.FEATURES) and np.isfinite(f).all()


def test_cut_lies_on_a_quantile_of_the_scores():
    rng = np.random.default_rng(0)
    y = (rng.random(800) < 0.8).astype(int)
    x = rng.normal(0, 1, (800, len(Q.FEATURES)))
    x[:, 3] += 3 * y
    m = Q.PairwiseRank(x, y, pairs=200_000)
    s = m.score(x)
    assert ((s >= Q.CUT) == (y == 1)).mean() > 0.95
    assert abs((s < Q.CUT).mean() - m.quantile) < 0.01


def test_query_held_out(spark, make_docs, write_tables):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(500):
        q = int(rng.random() < 0.8)
        rows.append((i, (good if q else bad)(rng, rng.randrange(2, 9))))
        labels.append((i, q, 0))
    rows += [(900, None), (901, ""), (902, "z " * 50_000), (None, "a"), (903, "x"), (903, "x")]
    labels += [(900, 1, 0), (None, 1, 0), (901, None, 0), (7, 1, None)]
    d = write_tables(documents=make_docs(rows),
                     labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = Q.op8_quality_rank(spark, d).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels[:500]}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id or ("" if r.doc_id is None else 0)).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    twins = [r.score for r in got if r.doc_id == 903]
    assert twins[0] == twins[1]


def test_one_label_or_no_rows(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.fit_quality(make_docs([(1, "a")]), labels) is None
    assert [(r.score, r.predicted) for r in Q.score_quality(make_docs([(1, "a")]), None).collect()] == [(Q.CUT, 1)]
    assert Q.score_quality(make_docs([]), None).collect() == []
