from __future__ import annotations

import hashlib
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from assaybook.llm import periodic_runs as P


def plain_runs(w, least_length=6, least_exponent=4):
    """Runs by trying every period at every place."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            a = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - a + p
            x = w[a:a + length]
            if length >= max(least_length, least_exponent * p) and not any(
                    x[q:] == x[:-q] for q in range(1, p)):
                out.append((a, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """The contract's row for one document."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for a, b, c in runs for i in range(a + c, a + b)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


words = st.lists(st.sampled_from("abc"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(words, words, st.integers(1, 6), st.sampled_from([(6, 4), (1, 2), (3, 3), (8, 5)]))
def test_runs_are_those_of_a_plain_search(head, unit, times, limits):
    w = head + unit * times + head
    assert P.runs_of(w, *limits) == plain_runs(w, *limits)


def test_the_tree_gives_every_common_extension():
    s = [1, 2, 1, 1, 2, 1, 3, 1, 2, 1]
    suffixes, turns = P.SuffixTree(s).tour()
    closed = [*s, 0]
    assert suffixes.tolist() == sorted(range(len(closed)), key=lambda i: closed[i:])
    ext = P.Extensions(suffixes, turns)
    for i in range(len(s)):
        for j in range(len(s)):
            if i != j:
                k = 0
                while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                    k += 1
                assert ext(P.np.array([i]), P.np.array([j]))[0] == k


def test_the_trees_decide():
    """Without extension to both sides only whole Lyndon words would be left: no run."""
    class None_(P.Extensions):
        def __call__(self, i, j):
            return P.np.zeros(len(i), P.np.int64)

    kept = P.Extensions
    try:
        P.Extensions = None_
        assert P.runs_of(list("abababab")) == []
    finally:
        P.Extensions = kept
    assert P.runs_of(list("abababab")) == [(0, 8, 2)]


def test_long_periods_and_one_word_over_and_over():
    unit = [str(i) for i in range(3000)]
    assert P.runs_of(["x", *unit * 5, "y"]) == [(1, 15000, 3000)]
    assert P.runs_of(["a"] * 50000) == [(0, 50000, 1)]


def test_query_is_the_plain_rule(spark, make_docs, write_tables):
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:25]
    unit = "la le li lo lu"
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(3 + i % 50))) for i in planted]
    rows += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "a a a a a"), (1004, "a\ta\na  a a a"),
             (1005, f"{unit} " * 4 + "la le"), (1006, "x " * 9 + "y " * 7 + "x " * 6),
             (1007, "a b a b a b a b c a b a b a b a b"), (1008, "  é" * 20), (1009, "solo"),
             (1003, "a a a a a"), (1005, "a b " * 5), (None, "p q p q p q p q"), (None, None)]
    sf = write_tables(documents=make_docs(rows))
    got = [tuple(r) for r in P.op12_periodic_runs(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 12


def test_empty_table(spark, make_docs, write_tables):
    sf = write_tables(documents=make_docs([]))
    df = P.op12_periodic_runs(spark, sf)
    assert df.collect() == []
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint",
                               "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string",
                               "collapsed_sha256": "string"}
