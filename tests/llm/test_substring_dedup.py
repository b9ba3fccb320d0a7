import hashlib
import random
import re
from collections import Counter

import pytest

from assaybook.llm import substring_dedup as S


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("period", [1, 2, 7, 13, 21, 31])
def test_cover_has_every_difference(period):
    d = S.difference_cover(period)
    assert {(a - b) % period for a in d for b in d} == set(range(period))


def corpus(rng, n, vocab):
    passages = [[rng.choice(vocab) for _ in range(rng.choice([34, 35, 36, 50, 90]))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows


def test_against_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(S, "WORDS_PER_GROUP", 700)  # several groups
    monkeypatch.setattr(S, "HASHES_PER_BUCKET", 100)  # and buckets
    rng = random.Random(7)
    rows = corpus(rng, 60, [f"w{i}" for i in range(500)])
    rows += [(100 + i, rows[3][1]) for i in range(5)]  # copies
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a " * 34), (204, "b " * 35), (205, "c " * 36),
             (206, "d " * 70_000), (207, "E e " * 40), (208, "e E " * 40), (209, "x y " * 40),
             (None, rows[5][1]), (210, rows[6][1]), (210, rows[6][1]), (210, rows[7][1])]
    got = S.repeated_windows(make_docs(rows))
    assert rows_of(got) == brute(rows, 35)
    spans = {r.doc_id: r.spans for r in got.collect()}
    assert [tuple(s) for s in spans[205]] == [(0, 36)]


def test_other_parameters(make_docs):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(40))) for i in range(12)]
    assert rows_of(S.repeated_windows(make_docs(rows), window=8, period=7)) == brute(rows, 8)
    with pytest.raises(ValueError):
        S.repeated_windows(make_docs(rows), window=5, period=6)


def test_query_and_empty_table(spark, make_docs, write_tables):
    rows = [(1, "p " * 10 + " ".join(f"s{i}" for i in range(40))), (2, " ".join(f"s{i}" for i in range(40)) + " q")]
    d = write_tables(documents=make_docs(rows))
    assert rows_of(S.op10_substring_dedup(spark, d)) == brute(rows, 35)
    assert S.repeated_windows(make_docs([])).collect() == []
