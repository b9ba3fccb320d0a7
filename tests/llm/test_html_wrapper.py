import random

import pytest

from assaybook.llm import html_wrapper as H

WORDS = "red fox hill night moss wet lot over runs small &amp; caf&eacute; 1 &lt; 2".split(" ")


def page(rng, paragraphs, *, marked=True, nav=3):
    """Html of one page and its main text."""
    import html
    body = [" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(paragraphs)]
    inner = "".join(f"<p>{b.replace('fox', '<b>fox</b>')}\n <br>" for b in body)
    menu = "".join(f'<li><a href="/{rng.random()}">Menu {rng.random()}</a>' for _ in range(nav))
    wrap = "article" if marked else "div"
    src = (f'<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul>{menu}</ul></nav>'
           f'<!-- x --><div class="ad">Buy {rng.random()}</div><div id="top">Welcome to our site</div>'
           f'<{wrap} class="post">{inner}<form>Name <input></form><div class="comments"><p>Nice {rng.random()}</div>'
           f'</{wrap}><aside>Side {rng.random()}</aside><footer>&copy; {rng.random()}</footer>')
    return src, "\n".join(" ".join(html.unescape(b).split()) for b in body)


@pytest.mark.parametrize("marked", [True, False])
def test_wrapper_of_a_host(spark, marked):
    rng = random.Random(3)
    made = [page(rng, rng.randrange(1, 9), marked=marked, nav=rng.randrange(1, 6)) for _ in range(12)]
    rows = [(i, f"http://Host.example/{i}?q=1", src, "x") for i, (src, _) in enumerate(made)]
    rows += [(100, "http://host.example/copy", made[0][0], "x")] * 2
    rows += [(200, None, None, "x"), (201, "not a url", "", "x"), (None, "http://host.example/n", made[1][0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _html string")
    got = H.extract_main_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, (_, want) in enumerate(made):
        assert by[i].text == want and by[i].n_chars == len(want) and by[i].url == rows[i][1]
    assert by[100].text == made[0][1] and by[None].text == made[1][1]
    assert (by[200].text, by[200].n_chars, by[201].text) == ("", 0, "")


def test_copies_do_not_make_template(spark):
    src, want = page(random.Random(1), 3)
    rows = [(i, "http://h.example/", src) for i in range(40)]
    got = H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {want}


def test_constant_notice_inside_articles_goes(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(9):
        src, text = page(rng, 3)
        rows.append((i, "http://h.example/", src.replace('class="post">', 'class="post"><div>Read our terms first</div>')))
        want[i] = text
    got = H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_parser_on_broken_html():
    for src in ["<", "<p", "<p>a<p>b", "</p></div>x", "<div><b>bold<p>next</div>tail", "a < b <c", "<script>never closed",
                '<p title="a>b">q', "<!-- open", "<div class=>z</div>", "&#0;&#x41;&bogus;", "<a href='x>y</a>"]:
        shape, blocks = H.parse(src)
        assert shape.startswith("-1 #") and all(b["text"] == " ".join(b["text"].split()) for b in blocks)
    assert [b["text"] for b in H.parse("<p>a<p>b<br>c<ul><li>d<li>e</ul>f&nbsp;&amp; g")[1]] == ["a", "b c", "d", "e", "f & g"]
    assert len(H.parse("<p>w " * 20_000)[1]) == 20_000


def test_alignment_of_different_shapes():
    seed = H.parse("<body><div class=a>x</div><div class=b><p>y</p></div><div class=c>z</div></body>")[0]
    other, blocks = H.parse("<body><div class=n>new</div><div class=b><h2>t</h2><p>y</p></div><div class=c>z</div></body>")
    slots = H.align(other, seed)
    ours = H.align(seed, seed)
    assert ours == [str(i) for i in range(len(ours))]
    seed_names = [line.split(" ")[1] for line in seed.split("\n")]
    placed = {b["text"]: slots[b["node"]] for b in blocks}
    assert seed_names[int(placed["y"])] == "p" and seed_names[int(placed["z"])] == "div.c"
    assert placed["new"].endswith("/div.n") and placed["t"].endswith("/h2")


@pytest.mark.parametrize("tag", ["div", "blockquote", "ul"])
def test_deeply_nested_pages(tag):
    depth = 5_000
    deep, blocks = H.parse(f"<body>{f'<{tag}>' * depth}end")
    other = H.parse(f"<body><div class=x>{f'<{tag}>' * depth}end")[0]
    assert H.align(deep, deep) == [str(i) for i in range(depth + 2)]
    placed = H.align(deep, other)  # all of it below the body
    assert len(set(placed)) == depth + 2 and sum(map(len, placed)) < 300 * depth
    assert H.align(deep, H.parse("<body><p>x")[0]) == placed
    assert [b["text"] for b in blocks] == ["end"] and blocks[0]["node"] == depth + 1


TEXT = "The whole text of the article, which is longer than what stands beside it."
WRAPPERS = ['<div class="has-sidebar">', '<div class="no-sidebar">', '<div class="page menu-open">', "<form id=aspnetForm>",
            '<div id="login"><form>', '<div role="alert"><span class="ad">', '<div class="site fixed-header">',
            '<div class="post comments-open">']


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_marked_article_below_a_hinted_wrapper(wrapper):
    def got(body):
        return H.content(f"<html><body>{body}</body></html>", "-1 #", None)
    side = "<nav>Menu</nav><div class=ad>Buy</div><aside><article>Teaser</article></aside><footer>Imprint</footer>"
    comments = '<div class="comments"><article class="comment">Nice</article><article>Nice too</article></div>'
    for article in ("<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>",
                    "<main><div class='menu-open'><article>{}</article></div></main>"):
        inner = article.format(f"<p>{TEXT}</p><form>Name</form><div class='share'>Share</div>")
        assert got(f"<div>Welcome</div>{wrapper}{side}{inner}{comments}") == [TEXT]
        assert got(f"<div>Welcome</div>{wrapper}{side}{inner}{comments}<div class=related><article>More") == [TEXT]


def test_teasers_below_hint_words_do_not_displace_the_content():
    teasers = '<div class="related"><article>One teaser</article><article>Two</article></div>'
    for page_of in ("<article>{}</article>{}", "<main>{}{}</main>", "<article>{}{}</article>", "<div class=text>{}</div>{}",
                    "<main>{}</main><aside>{}</aside>"):
        assert H.content(f"<body>{page_of.format(f'<p>{TEXT}</p>', teasers)}", "-1 #", None) == [TEXT]
    short = f"<article>Short.</article><div class=related><article>{TEXT}</article></div>"
    assert H.content(short, "-1 #", None) == ["Short."]
    assert H.content(f"<nav>Menu left open<main>{TEXT}</main>", "-1 #", None) == [TEXT]
    assert H.content(f"<div>a</div><div hidden><main>{TEXT}</main></div>", "-1 #", None) == ["a"]


def test_one_deep_page_among_others(spark):
    rng = random.Random(4)
    made = [page(rng, 3) for _ in range(6)]
    rows = [(i, "http://h.example/", src) for i, (src, _) in enumerate(made)]
    rows.append((99, "http://h.example/", "<body><article>" + "<div>" * 5_000 + "deep text"))
    got = H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: want for i, (_, want) in enumerate(made)} | {99: "deep text"}


def unmarked_page(rng, host, paragraphs):
    """A page without article, main, telling names or links in its notices: only
    what is the same on the host's pages tells template from content."""
    lines = [f"Desk {host} writes daily from the old harbour.", f"Call our office in street {host} before noon.",
             f"All prices of house {host} hold while stocks last."]
    body = [" ".join(rng.choice(WORDS[:9]) for _ in range(12)) for _ in range(paragraphs)]
    src = (f"<html><body><div class=x1><p>{lines[0]}</p></div><div class=x2><div class=x3>"
           + "".join(f"<p>{b}</p>" for b in body) + f"</div><div class=x4>{lines[1]}</div></div><p>{lines[2]}</p>")
    return src, "\n".join(body)


def f1(got, want):
    from collections import Counter
    a, b = Counter(got.split()), Counter(want.split())
    both = sum((a & b).values())
    return 2 * both / max(1, sum(a.values()) + sum(b.values()))


def test_the_wrapper_decides_on_hosts_without_marks(spark, monkeypatch):
    """Three of ten hosts carry no marks: their notices stay when no wrapper is induced."""
    rng = random.Random(21)
    rows, want = [], {}
    for host in range(10):
        for k in range(12):
            i = 100 * host + k
            n = rng.randrange(2, 6)
            src, want[i] = unmarked_page(rng, host, n) if host % 3 == 1 else page(rng, n, marked=True)
            rows.append((i, f"http://h{host}.example/{k}", src))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda: {r.page_id: r.text for r in H.extract_main_text(df).collect()}
    bare = [i for i in want if i // 100 % 3 == 1]
    score = lambda got: sum(f1(got[i], want[i]) for i in bare) / len(bare)
    on = texts()
    assert on == want and score(on) == 1.0
    monkeypatch.setattr(H, "MIN_PAGES", 10**9)  # no slot is ever template
    off = texts()
    assert all(off[i] != want[i] for i in bare) and score(off) < 0.85
    assert all(off[i] == want[i] for i in want if i not in bare)


def test_empty_table(spark):
    assert H.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
