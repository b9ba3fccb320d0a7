import random

from assaybook.llm import license_scan as L


def found(text):
    return [(h["license"], text[h["start"]:h["stop"]], h["missing"], h["added"]) for h in L.Scanner().text(text)]


def test_every_template_is_found_in_prose_and_named_right():
    for name, notice in L.TEMPLATES.items():
        text = f"Some words before it.\nMore of it. {notice} And then the rest of a long line goes on.\n\nLast."
        got = found(text)
        assert [g[0] for g in got] == [name]
        assert got[0][2:] == ([], [])


def test_wording_differences():
    assert found("this work is LICENSED under GNU General Public License, version 3") == [
        ("GPL-3.0", "this work is LICENSED under GNU General Public License, version 3", ["the"], [])]
    assert found("Licensed under Apache License, Version 1.1") == []
    assert [g[0] for g in found("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]
    assert [g[0] for g in found("Licensed under CC BY 4.0.")] == ["CC-BY-4.0"]
    assert [g[0] for g in found("This work is licensed under the GNU Lesser General Public License, version 3.")] == ["LGPL-3.0"]


def test_clean_text():
    for t in ["", "the driver lost a license", "copyright is a right", "No license is granted under the MIT name",
              "permission to land was given", "x" * 300_000, "licen" * 20_000]:
        assert found(t) == []


def test_several_notices_and_wrapped_lines():
    t = "Released under the MIT License. Licensed under CC BY-SA 4.0.\nReleased under the MIT License."
    assert [g[0] for g in found(t)] == ["MIT", "CC-BY-SA-4.0", "MIT"]
    wrapped = ("Intro.\n\nThis work is licensed under the GNU\nGeneral Public License,\nversion 3.\n\nReleased under the MIT\nLicense.")
    assert [g[0] for g in found(wrapped)] == ["GPL-3.0", "MIT"]


def test_long_lines():
    notice = L.TEMPLATES["GPL-3.0"]
    for at in range(1300, 2200, 37):  # on every side of the parts' edges
        t = "prose " * (at // 6) + notice + " more prose" * 300
        assert [(g[0], g[1]) for g in found(t)] == [("GPL-3.0", notice.rstrip("."))]
    many = " ".join(L.TEMPLATES[n] for n in ("MIT", "CC-BY-4.0", "Apache-2.0") for _ in range(100))
    assert [g[0] for g in found(many)] == ["MIT"] * 100 + ["CC-BY-4.0"] * 100 + ["Apache-2.0"] * 100


def test_every_template_in_a_long_block_of_varied_prose():
    rng = random.Random(5)
    parts = "ba con dor el fi gra hu in jo kel lu men nor ost pri qua ra ste tu vin".split()
    vocab = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    for name, notice in L.TEMPLATES.items():
        for _ in range(8):
            words = [rng.choice(vocab) for _ in range(500)]
            prose = " ".join(words)[:L.PART + L.OVERLAP - len(notice) - 2]
            at = prose.index(" ", rng.randrange(len(prose) - 100))
            text = f"{prose[:at]} {notice}{prose[at:]}"
            assert [(g[0], g[1]) for g in found(text)] == [(name, notice.rstrip("."))]


def test_query_against_plain_search(spark, make_docs, write_tables):
    notices = ["MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"]
    rows = []
    for i in range(60):
        lines = [f"word{i} some prose here", "another line of prose"]
        if i % 3:
            lines.insert(i % 2, L.TEMPLATES[notices[i % 4]])
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, rows[1][1]), (102, rows[1][1]), (None, rows[2][1]),
             (103, "prose " * 40_000 + "\n" + L.TEMPLATES["MIT"])]
    d = write_tables(documents=make_docs(rows))
    got = L.op3_license_scan(spark, d).collect()
    want = sorted(((i, n) for i, t in rows for n in notices if L.TEMPLATES[n] in (t or "")), key=repr)
    assert sorted(((r.doc_id, r.license) for r in got), key=repr) == want
    texts = dict(rows)
    assert all(r.exact and texts[r.doc_id][r.start:r.stop] == L.TEMPLATES[r.license].rstrip(".") for r in got)
    assert L.scan_licenses(make_docs([])).collect() == []


def forms(text, rng):
    """Ways in which files carry a license text."""
    words = text.split()
    lines, at = [], 0
    while at < len(words):
        n = rng.randrange(7, 14)
        lines.append(" ".join(words[at:at + n]))
        at += n
    yield text
    yield "\n".join(lines)
    yield "/*\n" + "\n".join(f" * {line}" for line in lines) + "\n */"
    yield "\n".join(f"# {line}" if line else "#" for line in lines).upper()
    cut = sorted(rng.sample(range(1, len(lines)), min(4, len(lines) - 1)))
    yield "\n\n".join("\n".join(lines[a:b]) for a, b in zip([0, *cut], [*cut, None], strict=True))


def test_full_texts_are_named_right_in_every_form():
    rng = random.Random(8)
    prose = " ".join(rng.choice("amber bell cedar delta ember field grove harbor".split()) for _ in range(900))
    for name, full in L.FULL_TEXTS.items():
        for text in forms(full, rng):
            for before in ("", prose[:2500] + "\n", "Copyright (c) 2020 Some One\n\n"):
                got = found(f"{before}{text}\n\n{prose[:700]}")
                assert [(g[0], g[2], g[3]) for g in got] == [(name, [], [])], (name, text[:200], got)


def test_the_ranking_names_the_winner(monkeypatch):
    """License texts that hold each other's wording: all are confirmed, most bytes saved wins."""
    pairs = [("MIT-full", "MIT-0-full"), ("BSD-3-Clause-full", "BSD-2-Clause-full"), ("ISC-full", "0BSD-full")]

    def named(pair, order):
        some = {n: L.FULL_TEXTS[n] for n in (pair if order else pair[::-1])}
        scanner = L.Scanner(full_texts=some)
        return [[h["license"] for h in scanner.text(f"Before.\n\n{some[n]}\n\nAfter it.")] for n in pair]

    for pair in pairs:
        words = [L._words(L.FULL_TEXTS[n])[0] for n in pair]
        able = {t.name: t for t in L.Scanner().full.templates}
        assert all(able[n].confirm(w) for n in pair for w in words)  # the wording tells none of them apart
        assert named(pair, True) == named(pair, False) == [[n] for n in pair]
    monkeypatch.setattr(L._Family, "rank", lambda self, able, words: [(-100 * i, t) for i, t in enumerate(able)])
    for pair in pairs:  # without the ranking the first template takes all
        assert named(pair, True) == [[pair[0]]] * 2 and named(pair, False) == [[pair[1]]] * 2


def test_differences_in_full_texts():
    full = L.FULL_TEXTS["BSD-3-Clause-full"]
    got = found("1. " + full.replace("Redistributions in", "2. Redistributions in").replace("Neither", "3. Neither")
                .replace("the copyright holder nor", "Some Company nor"))
    assert [g[0] for g in got] == ["BSD-3-Clause-full"]
    assert got[0][2] == ["the", "copyright", "holder"] and got[0][3] == ["2", "3", "some", "company"]
    assert [g[0] for g in found(L.FULL_TEXTS["GPL-3.0-header"].replace("version 3", "version 7"))] == []
    half = L.FULL_TEXTS["MIT-full"]
    assert "MIT-full" not in [g[0] for g in found(half[:len(half) // 2])]
    several = "\n\n".join([L.FULL_TEXTS[n] for n in ("MIT-full", "LGPL-3.0-header", "ISC-full", "MIT-full")] + [L.TEMPLATES["MIT"]])
    assert [g[0] for g in found(several)] == ["MIT-full", "LGPL-3.0-header", "ISC-full", "MIT-full", "MIT"]
    many = "\n\n".join([L.FULL_TEXTS["ISC-full"]] * 60)
    assert [g[0] for g in found(many)] == ["ISC-full"] * 60
