import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as C
from assaybook.llm.common import stage

from .test_simhash_dedup import brute_fingerprint, brute_roots

RNG = random.Random(12)
EN = [f"{a}{b}" for a in ("the", "an", "ing", "wh", "or") for b in ("re", "th", "st", "ed", "ly", "sh")]
DE = [f"{a}{b}" for a in ("sch", "ung", "zu", "ver", "ß") for b in ("ein", "keit", "ü", "tz", "pf", "lich")]


def prose(vocab, n):
    return " ".join("".join(RNG.choice(vocab) for _ in range(RNG.randrange(1, 3))) for _ in range(n))


ITEMS = [(i, prose(EN, 30) + ". " + prose(EN, 8) + ".") for i in range(8)]


def corpus():
    rows = [(i, prose(EN if i % 3 else DE, RNG.randrange(40, 200)), "en" if i % 3 else "de") for i in range(150)]
    rows += [(200 + i, rows[i][1].replace(" ", "\n", 2), "en") for i in range(20)]  # exact copies
    for i in range(20, 30):  # copies with one late word changed
        w = rows[i][1].split()
        rows.append((300 + i, " ".join([*w[:-1], "other"]), "en"))
    rows += [(400 + i, f"{prose(EN, 60)} {t} {prose(EN, 50)}", "en") for i, t in ITEMS]  # leaks
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 34 !!", None), (503, rows[3][1], "de"), (503, rows[3][1], "de")]
    return rows


def expected(rows):
    """Ids that are left, by plain code on the stages' rules."""
    live = {i: t for i, t, _ in rows if t and any(c.isalpha() for c in t)}
    best = {}
    for i, t in live.items():
        n = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[n] = min(best.get(n, (1, None)), (-len(t), i))
    live = {i: live[i] for _, i in best.values()}
    fp = {i: brute_fingerprint(t) for i, t in live.items()}
    root = brute_roots(set(fp.values()))
    live = {i: t for i, t in live.items() if i == min(j for j in fp if root[fp[j]] == root[fp[i]])}
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    return {i: t for i, t in live.items() if not any(flat(x) in flat(t) for _, x in ITEMS)}


def test_run_against_brute_force(spark, make_docs, write_tables):
    rows = corpus()
    d = write_tables(documents=make_docs(rows), benchmark=spark.createDataFrame(ITEMS, "item_id long, text string"))
    want = expected(rows)
    got = C.run(spark, d)
    lengths = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths == {i: len(t.split()) for i, t in want.items()}
    assert not {400 + i for i, _ in ITEMS} & lengths.keys()


def test_run_leaves_the_last_stage_only(spark, make_docs, write_tables):
    from pathlib import Path

    from assaybook.session import work_dir
    d = write_tables(documents=make_docs(corpus()), benchmark=spark.createDataFrame(ITEMS, "item_id long, text string"))
    folder = Path(work_dir(spark).removeprefix("file:")) / "llm"
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    C.run(spark, d).collect()
    left = {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before}
    assert left == {"pipeline-decontamination", "pieces"}


def test_near_stage_with_clashing_and_repeated_ids(spark, make_docs):
    t, u = prose(EN, 80), prose(DE, 80)
    rows = [(3, t), (5, t), (5, u), (5, u), (None, u), (7, None), (7, None), (7, prose(EN, 60))]
    got = C.near_copies(spark, make_docs(rows), "").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted([(3, t), (5, u), (7, ""), (7, rows[-1][1])])


def test_language_stage_goes_by_the_scores_of_labelled_texts(spark, make_docs):
    """Limits per length; what scores less than every labelled text goes, short clean texts stay."""
    from assaybook.llm import lang_id

    class Model:  # a text says how likely its language is
        labels = ["a", "b"]

        def predict(self, texts):
            import numpy as np
            return np.array([[float(t.split()[-1]), 0.0] for t in texts])
    pad = "word " * 60
    known = [(i, f"{pad}{0.9 + i / 100}", "a") for i in range(5)] + [(10, "w 0.4", "b"), (11, "w 0.6", "a")]
    docs = make_docs([*known, (20, f"{pad}0.82"), (21, f"{pad}0.80"), (22, "w 0.37"), (23, "w 0.35"), (24, "0.99"),
                      (25, "word word word word word word word word word word 0.01"), (26, None)])
    limits = lang_id.score_limits(docs, Model())
    assert [round(x, 3) for x in limits] == [0.36, 0.0, 0.81]
    got = {r.doc_id for r in lang_id.keep_known(docs, Model(), limits).collect()}
    assert got == {*range(5), 10, 11, 20, 22, 25}


def test_language_limits_come_from_every_labelled_row(spark):
    """The one low score among 21,000 labelled rows, first in the hash order of the rows to learn from."""
    from assaybook.llm import lang_id

    class Model:  # a text says how likely its language is
        labels = ["a", "b"]

        def predict(self, texts):
            import numpy as np
            return np.array([[float(t.split()[-1]), 0.0] for t in texts])
    h = F.xxhash64(F.lit("lang-sample"), F.col("id"), F.lit("w 0.2"))
    low = spark.range(21_000).orderBy(h).first()["id"]
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("lang"),
                                      F.when(F.col("id") == low, "w 0.2").otherwise("w 0.9").alias("text"))
    assert [round(x, 3) for x in lang_id.score_limits(docs, Model())] == [0.18, 0.0, 0.0]


def test_stages_keep_columns_and_take_empty_tables(spark, make_docs, write_tables):
    empty = make_docs([])
    d = write_tables(documents=empty, benchmark=spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = make_docs(corpus())
    for docs in (empty, docs):
        columns = docs.columns
        for name, fn in C.STAGES[:-1]:
            docs = stage(fn(spark, docs, d), name)
            assert docs.columns == columns
    assert C.run(spark, d).collect() == []


def test_registered_beside_the_other_queries():
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", q).group() for q in names
                                                                      if re.match(r"op\d+_", q)}
