import random

import numpy as np

from assaybook.llm import lang_id as L

SYL = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "und", "eit", "zur", "ber"], "cc": ["ção", "nhe", "lhá", "ões", "ém"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYL[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_gradient_is_the_loss_slope():
    rng = np.random.default_rng(0)
    model = L.BiGated(["a", "b", "c"], 4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.integers(0, 256, (6, 3)).astype(np.uint8), np.array([0, 2, 1])
    _, grad = model.gradient(x, y)
    for k, v in model.p.items():
        at = (1, x[2, 1]) if k[0] == "w" else tuple(rng.integers(0, s) for s in v.shape)
        v[at] += 1e-4
        up = model.gradient(x, y)[0]
        v[at] -= 2e-4
        down = model.gradient(x, y)[0]
        v[at] += 1e-4
        assert abs((up - down) / 2e-4 - grad[k][at]) < 1e-5


def test_prediction_is_the_mean_over_positions_and_ignores_neighbours():
    model = L.BiGated(["a", "b"], 5)
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 255, n).astype(np.uint8).tobytes() for n in (1, 7, 200, L.SEGMENT, 40)]
    got = model.predict(texts)
    for t, p in zip(texts, got, strict=True):
        x = np.frombuffer(t, np.uint8)[:, None]
        hs = [model._states(model._run(x, d)) for d in (0, 1)]
        want = []
        for i in range(len(t)):
            z = model.p["v0"] @ hs[0][i] + model.p["v1"] @ hs[1][i] + model.p["b"]
            e = np.exp(z - z.max())
            want.append((e / e.sum())[:, 0])
        assert np.allclose(p, np.mean(want, 0), atol=1e-4)
        assert np.allclose(model.predict([t])[0], p, atol=1e-5)
    long = texts[2] * 40  # many segments: every position counts once
    assert np.allclose(model.predict([long]).sum(), 1, atol=1e-5)


def test_query_held_out_accuracy_and_edge_cases(spark, make_docs, write_tables):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        lang = rng.choice(list(SYL))
        rows.append((i, text(rng, lang, rng.randrange(3, 60)), lang if i % 7 else None))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 $%& 4", "cc"), (1003, text(rng, "bb", 30_000), "bb"),
             (None, text(rng, "aa", 30), "aa"), (1004, text(rng, "cc", 9), "cc"), (1004, text(rng, "cc", 9), "cc")]
    d = write_tables(documents=make_docs(rows))
    got = L.op1_lang_id(spark, d).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows}
    by = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by[i].lang_pred, by[i].score) == (L.UNKNOWN, 0.0)
    assert by[1003].lang_pred == "bb" and by[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == L.crc_held_out(r.doc_id) for r in got)
    out = [r for r in got if r.held_out and truth.get(r.doc_id) and r.doc_id < 1000]
    assert len(out) > 50 and np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97


def test_rare_languages_are_learned(spark, make_docs, monkeypatch):
    assert L.quotas({"a": 5, "b": 1000, "c": 40}, 100) == {"a": 5, "c": 40, "b": 55}
    assert L.quotas({"a": 5, "b": 6}, 100) == {"a": 5, "b": 6} and L.quotas({}, 9) == {}
    rng = random.Random(7)
    rows = [(i, text(rng, "aa" if i % 2 else "bb", 20), "aa" if i % 2 else "bb") for i in range(3000)]
    rows += [(5000 + i, text(rng, "cc", 20), "cc") for i in range(3)]
    model = L.fit_languages(make_docs(rows), sample_rows=300)
    assert model.labels == ["aa", "bb", "cc"]
    known = make_docs(rows).selectExpr("lang _lang", "xxhash64(doc_id) _h", "text _text")
    got = [(r["_lang"], r["_h"]) for r in L._sample(known, 300).collect()]
    by_hash = sorted((r["_h"], r["_lang"]) for r in known.collect())
    firsts = {n: [x for x in by_hash if x[1] == n][:q] for n, q in (("aa", 148), ("bb", 149), ("cc", 3))}
    assert got == [(n, h) for h, n in sorted(x for part in firsts.values() for x in part)]
    # many languages: each keeps its least share, however small the sample was to be
    many = L._sample(known, 5).groupBy("_lang").count().collect()
    assert {r["_lang"]: r["count"] for r in many} == {"aa": 28, "bb": 29, "cc": 3}


def test_lanes_follow_the_labels_and_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    model = L.BiGated([f"l{i}" for i in range(300)])
    texts = [bytes(rng.integers(97, 123, n).tolist()) for n in (5, 700, 3000, 40, 0, 900)]
    want = model.predict(texts)
    seen, real = [], L.BiGated._lanes
    monkeypatch.setattr(L.BiGated, "_lanes", lambda self, x, *a: seen.append(x.shape[1]) or real(self, x, *a))
    monkeypatch.setattr(L, "LANE_BYTES", 5 * 4 * (L.SEGMENT + 2 * L.CONTEXT) * 300)
    assert np.allclose(model.predict(texts), want) and max(seen) <= 16
    assert len(L.BiGated(["a"]).predict(texts)) == 6 and max(seen) > 16


def test_labels_are_never_inputs(spark, make_docs):
    rng = random.Random(6)
    rows = [(i, text(rng, lang, 20), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    model = L.fit_languages(make_docs(rows))
    same = [(i + 5, t, None) for i, t, _ in rows]
    a = sorted((r.doc_id, r.lang_pred, r.score) for r in L.identify_languages(make_docs(rows), model).collect())
    b = sorted((r.doc_id - 5, r.lang_pred, r.score) for r in L.identify_languages(make_docs(same), model).collect())
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert np.allclose([x[2] for x in a], [x[2] for x in b])


def test_without_labels_or_rows(make_docs):
    assert L.fit_languages(make_docs([(1, "text", None), (2, None, "aa")])) is None
    got = L.identify_languages(make_docs([(1, "text")]), None).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in got] == [(1, L.UNKNOWN, 0.0)]
    assert L.identify_languages(make_docs([]), None).collect() == []
