import random

import numpy as np

from assaybook.llm import decontaminate as D

RNG = random.Random(9)
COMMON = "the of to and in is it that".split()
VOCAB = COMMON * 12 + [f"term{i}" for i in range(900)]


def sentence(n):
    return (" ".join(RNG.choice(VOCAB) for _ in range(n)) + ".").capitalize()


ITEMS = [(i, f"{sentence(RNG.randrange(8, 30))} {sentence(RNG.randrange(4, 12))}") for i in range(60)]


def prose(n):
    return " ".join(sentence(12) for _ in range(n))


def brute(texts, index):
    """Every (text, item, best score) at the threshold, from all items and passages."""
    out = {}
    for n, words in enumerate(texts):
        for lo in range(0, max(1, len(words)), index.stride):
            terms = set(words[lo:lo + 2 * index.stride])
            for i, w in enumerate(index.weights):
                s = sum(v for t, v in w.items() if t in terms)
                if s >= index.threshold:
                    out[n, i] = max(out.get((n, i), 0), s)
    return out


def make_index(items, threshold=D.THRESHOLD):
    parts = [(i, *D.question_and_answer(t)) for i, t in items]
    df = {}
    for _, q, a in parts:
        for w in set(q + a):
            df[w] = df.get(w, 0) + 1
    return D.ItemIndex(parts, df, len(parts), float(np.mean([len(q) + len(a) for _, q, a in parts])), threshold)


def test_pruned_search_finds_all_that_a_full_search_finds(monkeypatch):
    monkeypatch.setattr(D, "QUESTION_SHARE", 0.0)
    monkeypatch.setattr(D, "ANSWER_SHARE", 0.0)
    texts = [D.words_of(prose(RNG.randrange(1, 40)) + " " + RNG.choice(ITEMS)[1][:RNG.randrange(200)] + prose(3)) for _ in range(60)]
    texts += [[], ["the"], D.words_of(ITEMS[3][1])]
    for threshold in (0.2, 0.4, 0.6):
        index = make_index(ITEMS, threshold)
        got = {(n, i): s for n, i, s, _, _ in index.search(texts)}
        want = brute(texts, index)
        assert got.keys() == want.keys() and len(want) > 3
        assert all(abs(got[k] - min(1.0, want[k])) < 1e-9 for k in got)


def test_pivot_and_blocks_spare_items(monkeypatch):
    monkeypatch.setattr(D, "QUESTION_SHARE", 0.0)
    monkeypatch.setattr(D, "ANSWER_SHARE", 0.0)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30 if i // 100 % 4 else 8)) + f". own{i} w{i % 60} w{i % 7}.")
             for i in range(1200)]  # many postings a term, short items (of high impacts) side by side
    texts = [[rng.choice(vocab) for _ in range(rng.randrange(10, 90))] for _ in range(40)]
    texts += [D.words_of(items[i][1]) + texts[n] for n, i in enumerate((0, 7, 150, 299))]
    runs = {}
    for off in ("", "pivot", "blocks"):
        index = make_index(items, 0.8)
        assert max(np.diff(index.at)) > 4 * D.BLOCK
        if off == "pivot":
            index.bound[:] = 1.0
        if off == "blocks":
            index.block_most[:] = 1.0
        found = [(n, i, round(s, 9)) for n, i, s, _, _ in index.search(texts)]
        runs[off] = found, index.pivots, index.scored
    want = brute(texts, make_index(items, 0.8))
    assert {(n, i) for n, i, _ in runs[""][0]} == want.keys() >= {(40, 0), (41, 7), (42, 150), (43, 299)}
    assert all(found == runs[""][0] for found, *_ in runs.values())
    print({k: v[1:] for k, v in runs.items()})
    assert 2 * runs[""][1] < runs["pivot"][1] and runs[""][2] < 0.8 * runs["blocks"][2]
    low = make_index(items, 0.8)  # bounds decide: halved, copies are passed over
    low.bound /= 2
    assert len(list(low.search(texts))) < len(runs[""][0])


def test_overlap():
    assert D.overlap([], ["a"]) == 1.0
    assert D.overlap(["a", "b"], ["x", "a", "b"]) == 1.0
    assert D.overlap(list("abcdef"), list("abcxyz")) == 0.5
    assert D.overlap(list("abcdef"), list("fedcba")) == 0.0
    assert D.question_and_answer("One two. Three?\nFour") == (["one", "two", "three"], ["four"])
    assert D.question_and_answer("a b c d") == (["a", "b", "c"], ["d"])
    assert D.question_and_answer("") == ([], [])


def test_query_catches_copies_and_leaves_clean_rows(spark, make_docs, write_tables):
    rows, want = [], set()
    for n in range(40):
        item, text = ITEMS[n]
        if n % 4 == 0:
            leak = text
        elif n % 4 == 1:
            leak = text.upper().replace(" ", "\n", 3)
        elif n % 4 == 2:
            words = text.split()
            words[len(words) // 3] = "changed"
            leak = " ".join(words)
        else:
            leak = " ".join(text.split()[:len(text.split()) // 3])  # a third is no leak
        rows.append((n, f"{prose(RNG.randrange(0, 30))} {leak} {prose(RNG.randrange(0, 30))}"))
        if n % 4 != 3:
            want.add((n, item))
    rows += [(200, None), (201, ""), (202, prose(3000) + ITEMS[50][1] + prose(3000)), (203, ITEMS[51][1]), (203, ITEMS[51][1]),
             (None, ITEMS[52][1])] + [(300 + i, prose(20)) for i in range(40)]
    want |= {(202, 50), (203, 51), (None, 52)}
    items = spark.createDataFrame([*ITEMS, (1000, None), (1001, ""), (1002, "the of"), (None, sentence(30))],
                                  "item_id long, text string")
    d = write_tables(documents=make_docs(rows), benchmark=items)
    got = D.op7_decontaminate(spark, d).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(got) == len(want) + 1  # the repeated row
    some_shards = D.find_contamination(make_docs(rows), items, shard_items=13).collect()
    assert {(r.doc_id, r.item_id) for r in some_shards} == want
    docs = make_docs(rows)
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    bad = {i for i, _ in want}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in bad)


def test_words_of_unspaced_scripts():
    assert D.words_of("法国的首都是哪里？GPT-4。") == [*"法国的首都是哪里", "gpt", "4"]
    assert D.words_of("カタカナ ひら 서울 시청 тест") == [*"カタカナひら", "서울", "시청", "тест"]
    assert D.question_and_answer("法国的首都是哪里？巴黎。") == ([*"法国的首都是哪里"], [*"巴黎"])


def test_items_in_unspaced_scripts(spark, make_docs):
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    thai = [chr(c) for c in range(0x0E01, 0x0E2F)]
    run = lambda script, n: "".join(RNG.choice(script) for _ in range(n))
    items = [(i, f"{run(han, 14)}？{run(han, 6)}。") for i in range(20)] + [(20 + i, run(thai, 25)) for i in range(5)]
    items += [(30, "首都？巴黎。")]
    rows = [(i, f"{run(han, 300)}{t}{run(han, 300)}" if i < 20 else f"{prose(3)} {t} {prose(3)}") for i, t in items]
    rows += [(100 + i, run(han, 600)) for i in range(20)]
    rows.append((200, run(han, 50) + items[2][1][:4] + run(han, 50)))  # part of an item is no leak
    rows.append((201, f"{run(han, 50)}{items[3][1][:6]}的{items[3][1][7:]}{run(han, 50)}"))
    got = D.find_contamination(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [*((i, i) for i, _ in items), (201, 3)]


def test_items_of_few_words(spark, make_docs):
    items = [(0, "Capital of France? Paris."), (1, "Name the moss"), (2, "Zebra"), (3, "Capital of France? Rome."), (4, "?!"),
             (5, "Zebra"), (None, "Name the moss")]
    rows = [(0, f"{prose(9)} capital of\nFRANCE?  Paris! {prose(9)}"), (1, f"term1 term2 Capital of France? Paris term3 {prose(4)}"),
            (2, f"{prose(3)} Name the moss. {prose(3)}"), (3, f"{prose(3)}\nname THE moss\n{prose(3)}"), (4, "Zebra"),
            (5, "they name the moss green"), (6, "a zebra runs"), (7, "Capital of France Paris term4"), (8, "zebra.com"),
            (9, "Capital of France? Parisian"), (10, None), (11, "")]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(0, 0), (1, 0), (2, 1), (2, None), (3, 1), (3, None), (4, 2), (4, 5)], key=repr)
    for more in (0, 20):  # alone, and beside items that are scored
        some = items_df.unionByName(spark.createDataFrame(ITEMS, items_df.schema).where(f"item_id >= 40 and item_id < {40 + more}"))
        for shard_items in (3, 1000):
            got = D.find_contamination(make_docs(rows), some, shard_items=shard_items).collect()
            assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == want
            assert {(r.score, r.question_overlap, r.answer_overlap) for r in got} == {(1.0, 1.0, 1.0)}
    kept = D.drop_contaminated(make_docs(rows), items_df)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(5, 12))


def test_item_ids_of_any_type(spark, make_docs):
    docs = make_docs([(i, f"{prose(4)} {ITEMS[i][1]} {prose(4)}") for i in range(3)])
    base = spark.createDataFrame(ITEMS, "item_id long, text string")
    for kind in ("smallint", "decimal(20,2)", "double", "string", "binary"):
        item = "cast(cast(item_id as string) as binary)" if kind == "binary" else f"cast(item_id as {kind})"
        got = D.find_contamination(docs, base.selectExpr(f"{item} as item_id", "text"))
        assert got.schema["item_id"].dataType.simpleString() == kind
        assert sorted((r.doc_id, int(r.item_id)) for r in got.collect()) == [(0, 0), (1, 1), (2, 2)]
    got = D.find_contamination(docs, base.selectExpr("date_add(date'2020-01-01', cast(item_id as int)) as item_id", "text"))
    assert sorted((r.doc_id, r.item_id.day) for r in got.collect()) == [(0, 1), (1, 2), (2, 3)]


def test_several_passes_over_the_documents(spark, make_docs, monkeypatch):
    monkeypatch.setattr(D, "PASS_SHARDS", 2)
    docs = make_docs([(i, f"{prose(4)} {t} {prose(4)}") for i, t in ITEMS])
    got = D.find_contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), shard_items=13)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i, _ in ITEMS]


def test_empty_tables(spark, make_docs):
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    assert D.find_contamination(make_docs([]), items).collect() == []
    assert D.find_contamination(make_docs([(1, ITEMS[0][1])]), items.limit(0)).collect() == []
    assert D.drop_contaminated(make_docs([(1, "x")]), items.limit(0)).count() == 1
