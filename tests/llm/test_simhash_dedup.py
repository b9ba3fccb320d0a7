import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from assaybook.llm import simhash_dedup as S


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(values, radius=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in vs}


def test_fingerprint_matches_definition():
    for t in ["", " \n", "One", "one TWO", "a b c", "É é Z z y x w", "the cat " * 500, "x\x0by\x1cz q"]:
        assert S.fingerprint(t) % (1 << 64) == brute_fingerprint(t)


def test_tiles_lose_no_link(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for f in fps[:150]:  # chains of near fingerprints, some just beyond the radius
        for _ in range(3):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])))
            fps.append(f)
    fps += [fps[0] ^ (1 << b) for b in range(64)] + [0, 1, (1 << 64) - 1]
    fps = sorted(set(fps))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "_fp long")
    for block in (4, 8192):  # many blocks a tile, and one
        roots = {r["_node"]: r["_root"] for r in S.components(S.links(df, block=block)).collect()}
        groups = {}
        for (s,), f in zip(signed, fps, strict=True):
            groups.setdefault(roots.get(s, s), set()).add(f)
        want = {}
        for f, r in brute_roots(fps).items():
            want.setdefault(r, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_a_clump_gives_few_links(spark):
    fps = {sum(1 << b for b in bits) for bits in [(), *((i, j) for i in range(40) for j in range(i))]}
    got = S.links(spark.createDataFrame([(f,) for f in fps], "_fp long"))
    # no more than one link per fingerprint and task that sees it
    assert got.count() <= len(fps) * 10
    assert S.components(got).select("_root").distinct().count() == 1


def test_long_chain_contracts(spark):
    edges = spark.range(3000).select(F.col("id").alias("_a"), (F.col("id") + 1).alias("_b"))
    assert S.components(edges).agg(F.count_distinct("_root"), F.count("*")).first() == (1, 3001)


def test_unite_keeps_flat_roots():
    p = S._unite(np.arange(6), np.array([5, 4, 3]), np.array([4, 3, 1]))
    assert p.tolist() == [0, 1, 2, 1, 1, 1]


def test_query_against_brute_force(spark, make_docs, write_tables):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        words = [rng.choice(vocab) for _ in range(400)]
        rows.append((i, " ".join(words)))
        near = list(words)
        near[rng.randrange(400)] = "changed"
        rows.append((100 + i, " ".join(near)))
        rows.append((200 + i, " ".join(words).upper()))
    rows += [(500, None), (501, ""), (502, "\t"), (503, "one"), (504, "ONE"), (505, "z " * 30_000), (505, "z " * 30_000)]
    d = write_tables(documents=make_docs(rows))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op6_simhash_dedup(spark, d).collect()}
    fp = {i: brute_fingerprint(t) for i, t in rows}
    root = brute_roots(set(fp.values()))
    for i in fp:
        assert got[i] == (f"{fp[i]:016x}", min(j for j in fp if root[fp[j]] == root[fp[i]]))


def test_stage_and_empty_table(make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "some words here again"), (None, "other words of another kind entirely")])
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3, None]
    assert S.near_duplicates(make_docs([])).collect() == []
