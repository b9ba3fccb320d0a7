import hashlib
import random

from assaybook.llm import exact_dedup as X

WS = " \t\n\x0b\x0c\r"


def brute(rows):
    norm = [(i, (t or ""), "".join(c for c in (t or "") if c not in WS)) for i, t in rows]
    out = []
    for i, t, n in norm:
        same = [(-len(u), j is None, j or 0, j) for j, u, m in norm if m == n]
        keep = min(same, key=lambda s: s[:3])[3]
        out.append((i, keep, len(same), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def test_ties_blanks_nulls_and_repeated_rows(make_docs):
    rows = [(3, "a b"), (1, "ab"), (2, "a  b"), (9, "a\tb\n"), (7, "a b"), (4, None), (5, ""), (6, " \r\n"),
            (8, "x"), (8, "x"), (None, "x"), (None, "only"), (10, "é" * 50_000), (11, "é" * 50_000 + " ")]
    assert rows_of(X.exact_groups(make_docs(rows))) == brute(rows)


def test_many_ranks_take_several_rounds(make_docs):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot copy", "h o t copy", f"text {rng.randrange(40)}"])) for i in range(400)]
    got = X.exact_groups(make_docs(rows).repartition(23), fan_in=2)
    assert rows_of(got) == brute(rows)


def test_empty_table(make_docs):
    assert X.exact_groups(make_docs([])).collect() == []
    assert X.drop_exact_copies(make_docs([])).collect() == []


def test_stage_keeps_one_row_with_all_columns(make_docs):
    docs = make_docs([(1, "a b"), (2, "ab"), (2, "ab"), (3, "c"), (None, "d"), (3, "c"), (4, None), (5, "")])
    got = X.drop_exact_copies(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == [
        (1, "a b"), (3, "c"), (4, None), (None, "d")]
    assert {r["_row_key"] for r in got.collect()} == {"_row_key"}


def test_no_python_in_the_plan(make_docs):
    plan = X.exact_groups(make_docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_matches_sql(make_docs, write_tables, against_oracle):
    d = write_tables(documents=make_docs([(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, "c\x0bd"), (6, "cd")]))
    got, want = against_oracle(X, "op5_exact_dedup", d, ["documents"])
    assert got == want
