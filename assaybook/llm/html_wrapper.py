"""Main-text extraction by wrapper induction.

Each page is parsed into text blocks and a *shape*: its tree of block
elements, where siblings with one signature (tag and class names) share a node,
so lists and paragraphs of any length give one shape. Per host the commonest
shape is the seed of the wrapper; every other distinct shape of the host is
aligned with it by simple tree matching, which gives each block the template
slot it sits in. Texts that fill their slot alike on nearly all distinct pages of the host
are template; what varies is content.

Elements whose role is known from the markup (menus, headers, footers,
sidebars, forms, scripts, adverts, notices, comments) are never content, even
where their text varies. A page that marks its article (``article``, else
``main``) has its content there; other pages have it in all varying slots that
are not lists of links.

A form, and an element that only a hint word of its names rules out, may be a
wrapper around the whole page (``menu-open``): an article or main that starts
inside is read afresh, and a main also below a menu or the like that was left
open. Below a hint word it is in doubt, as it may be a list of teasers; it is the
content where the page marks no article outside and what else would be its
content is shorter.

Only distinct shapes are aligned, and slot statistics are plain aggregations,
so a host with a third of all pages is never gathered in one task. The survey
keeps hashes of the blocks, not their texts; pages are parsed again when the
wrappers are known, which moves and stores less than carrying the texts. Template
shares count distinct pages, so copies of one page do not make it template.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaybook.llm.common import stage, table

#: Distinct pages of a host from which a slot's statistics count.
MIN_PAGES = 5
#: Share of these pages with the same text that makes it template, in marked articles and elsewhere.
ARTICLE_SHARE, PAGE_SHARE = 0.9, 0.6
#: Characters of a path below a matched node from which its hash stands for it.
LONG_SLOT = 200

# Fixed values of HTML
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
                    "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noframes template svg math object".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                      "header hr main menu nav ol p pre section table ul".split())
_SELF_CLOSING = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th",
                 "option": "option", "thead": "tr td th", "tbody": "thead tr td th", "tfoot": "tbody tr td th"}
_SCOPE = frozenset("ul ol dl table article main body section div".split())
# Roles that are not content: by tag, and by a word of class, id or role
_NOT_CONTENT = frozenset("nav footer aside form button select dialog menu head fieldset".split())
_FORMS = frozenset("form fieldset".split())
_HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav "
                   "navbar navigation breadcrumb breadcrumbs cookie cookies notice consent gdpr popup modal newsletter "
                   "subscribe signup share sharing social related recommended comment comments disqus replies respond "
                   "footer masthead toolbar pagination pager widget login search alert complementary contentinfo "
                   "teaser outbrain taboola".split())
_COMMENTS = frozenset("comment comments disqus replies respond".split())
# A name with one of these words tells what an element has or lacks, not what it is
_HAVING = frozenset("has have no not with without".split())
# One with these is of a page whose comments are open or closed
_STATE = frozenset("open closed".split())
# How far an element is ruled out: not; until an article or main starts inside; until a main does; wholly
_KEPT, _FORM, _HINTED, _ROLE, _NEVER = range(5)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class _Page:
    """Parser state of one page: open elements, nodes of the shape, blocks."""

    def __init__(self, source: str):
        self.nodes, self.index = ["-1 #"], {}  # shape lines "parent signature"
        self.blocks, self.parts, self.linked, self.chars = [], [], 0, 0
        # open elements: (tag, node, excluded, region, header, link, hinted, doubt); hinted is the node that a
        # hint last ruled out, doubt the one in which an article or main started afresh, or 0
        self.open = [("#", 0, _KEPT, 0, False, False, 0, 0)]
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if not m:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at:m.start()])
            at = m.end()
            tag = m[2] and m[2].lower()
            if not tag:
                continue
            if m[1]:
                self.end(tag)
            elif tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
                if tag in ("title", "textarea"):
                    self.flush()
            else:
                self.start(tag, m[3])
        self.flush()

    def text(self, raw: str) -> None:
        if not self.open[-1][2]:
            self.parts.append(raw)
            n = len(raw.strip())
            self.chars += n
            self.linked += n if self.open[-1][5] else 0

    def flush(self) -> None:
        if self.parts:
            _, node, _, region, header, _, _, doubt = next(x for x in reversed(self.open) if x[0] not in _INLINE)
            text = " ".join(html_lib.unescape("".join(self.parts)).split())
            if text and not header:
                self.blocks.append({"node": node, "region": region, "doubt": doubt, "links": 2 * self.linked > self.chars,
                                    "text": text})
            self.parts, self.linked, self.chars = [], 0, 0

    def start(self, tag: str, attrs: str) -> None:
        if tag in _INLINE:
            if tag == "br":
                self.parts.append(" ")
            elif tag not in _VOID and not attrs.endswith("/"):
                top = self.open[-1]
                role = self.hints(tag, attrs)[1]
                hinted = top[6] if role <= _FORM else top[1] or -1
                self.open.append((tag, top[1], max(top[2], role), top[3], top[4], top[5] or tag == "a", hinted, top[7]))
            return
        self.flush()
        if tag in _CLOSES_P:
            self.close("p")
        for other in _SELF_CLOSING.get(tag, "").split():
            self.close(other)
        if tag in _VOID:
            return
        _, parent, excluded, region, header, link, hinted, doubt = self.open[-1]
        signature, role, named_header = self.hints(tag, attrs)
        if role == _KEPT and excluded < {"article": _ROLE, "main": _NEVER}.get(tag, _KEPT):
            doubt = hinted if excluded > _FORM else doubt
            excluded, header = _KEPT, False
        elif tag == "header" or named_header:
            # a page header is not content; of an article's own header the headings are
            if region == 0:
                role = max(role, _ROLE if tag == "header" else _HINTED)
            header = True
        header = header and tag not in _HEADING
        region = max(region, 2 if tag == "article" else 1 if tag == "main" else 0)
        excluded = max(excluded, role)
        key = (parent, signature)
        node = self.index.get(key)
        if node is None:
            node = self.index[key] = len(self.nodes)
            self.nodes.append(f"{parent} {signature}")
        self.open.append((tag, node, excluded, region, header, link, hinted if role <= _FORM else node, doubt))

    @staticmethod
    def hints(tag: str, attrs: str) -> tuple[str, int, bool]:
        """Signature of an element, how far its role rules it out, and whether it is named a header."""
        words: list[str] = []
        hinted: set[str] = set()
        comment = header = False
        for _, a, b, c in _NAMES.findall(attrs) if "=" in attrs else ():
            for name in (a or b or c).lower().split():
                own = [w for w in _SPLIT.split(name) if w]
                words += own
                if not _HAVING.intersection(own):
                    hinted |= _HINTS.intersection(own)
                    comment = comment or bool(_COMMENTS.intersection(own)) and not _STATE.intersection(own)
                    header = header or "header" in own
        if tag == "article":
            comment = comment and bool(hinted & {"comment", "comments"})
            hinted.clear()
        elif tag in ("html", "body", "main"):
            hinted.clear()
            comment = False
        signature = ".".join([tag, *sorted(set(words))])
        if comment or attrs and _HIDDEN.search(attrs):
            return signature, _NEVER, header
        if tag in _NOT_CONTENT and tag not in _FORMS:
            return signature, _ROLE, header
        return signature, _HINTED if hinted else _FORM if tag in _FORMS else _KEPT, header

    def close(self, tag: str) -> None:
        """Close an open ``tag`` that no enclosing scope hides."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in _SCOPE:
                return

    def end(self, tag: str) -> None:
        if tag not in _INLINE:
            self.flush()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if tag in _INLINE and self.open[i][0] not in _INLINE:
                return


def parse(source: str) -> tuple[str, list[dict]]:
    """Shape of a page and its blocks (node of the shape, region, mostly links, text)."""
    page = _Page(source)
    return "\n".join(page.nodes), page.blocks


# ---------------------------------------------------------------- alignment
def _tree(shape: str) -> tuple[list[str], list[list[int]]]:
    names, kids = [], []
    for i, line in enumerate(shape.split("\n")):
        parent, name = line.split(" ", 1)
        names.append(name)
        kids.append([])
        if i:
            kids[int(parent)].append(i)
    return names, kids


def align(shape: str, seed: str) -> list[str]:
    """Slot of every node of ``shape``: by simple tree matching with ``seed`` the
    seed's node, or a path below the nearest matched node. No step recurses, so
    pages may nest as deep as they like."""
    a, ka = _tree(shape)
    b, kb = _tree(seed)
    # pairs of like nodes below like nodes, parents first; a pair is met once, from its parents' pair
    pairs = [(0, 0)] if a[0] == b[0] else []
    for i, j in pairs:
        pairs += [(u, v) for u in ka[i] for v in kb[j] if a[u] == b[v]]
    # size of the largest order-keeping match of the trees at each pair, children first
    size: dict[tuple[int, int], int] = {}
    table_of: dict[tuple[int, int], list[list[int]]] = {}
    for i, j in reversed(pairs):
        best = [[0] * (len(kb[j]) + 1) for _ in range(len(ka[i]) + 1)]
        for x, u in enumerate(ka[i]):
            for y, v in enumerate(kb[j]):
                best[x + 1][y + 1] = max(best[x][y + 1], best[x + 1][y], best[x][y] + size.get((u, v), 0))
        size[i, j], table_of[i, j] = best[-1][-1] + 1, best

    slots = [""] * len(a)
    todo: list[tuple[int, int | None, str]] = [(0, 0 if pairs else None, "0")]
    while todo:
        i, j, slot = todo.pop()
        slots[i] = slot
        matched = {}
        if j is not None:
            best, x, y = table_of[i, j], len(ka[i]), len(kb[j])
            while x and y:
                if best[x][y] == best[x - 1][y]:
                    x -= 1
                elif best[x][y] == best[x][y - 1]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    matched[ka[i][x]] = kb[j][y]
        if len(slot) > LONG_SLOT:  # a path of hashes, so that deep paths do not add up
            slot = f"~{xxhash.xxh3_128_hexdigest(slot.encode())}"
        for u in ka[i]:
            to = matched.get(u)
            todo.append((u, to, f"{slot}/{a[u]}" if to is None else str(to)))
    return slots


# ---------------------------------------------------------------- operator
_MARKS = "array<struct<node:int,marked:boolean,text:long>>"
_MARKS_ARROW = pa.list_(pa.struct([("node", pa.int32()), ("marked", pa.bool_()), ("text", pa.int64())]))


def _mark(text: str) -> int:
    """64-bit hash of a block's text, signed."""
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _survey_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            shapes, blocks = zip(*(parse(x) for x in part.column("_html").to_pylist()), strict=True)
            marks = [[{"node": x["node"], "marked": x["region"] > 0, "text": _mark(x["text"])} for x in p] for p in blocks]
            yield pa.RecordBatch.from_arrays(
                [part.column("_host"), part.column("_digest"), pa.array(shapes, pa.string()),
                 pa.array(marks, _MARKS_ARROW)], ["_host", "_digest", "_shape", "_marks"])


def _align_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slots = [align(s, t) for s, t in zip(b.column("_shape").to_pylist(), b.column("_seed").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("_host"), b.column("_shape_id"), pa.array(slots, pa.list_(pa.string()))],
                                         ["_host", "_shape_id", "_slots"])


def content(source: str, seed: str, template: list[str] | None, slots_of: dict | None = None) -> list[str]:
    """Blocks of a page that are content under a host's wrapper: its seed shape
    and template, entries "slot text-hash". ``slots_of`` remembers alignments."""
    shape, blocks = parse(source)
    if template:
        slots_of = {} if slots_of is None else slots_of
        slots = slots_of.get((shape, seed)) or slots_of.setdefault((shape, seed), align(shape, seed))
        fixed = set(template)
        blocks_left = [b for b in blocks if f"{slots[b['node']]} {_mark(b['text'])}" not in fixed]
    else:
        blocks_left = blocks
    best: list[str] = []
    for doubt in sorted({0, *(b["doubt"] for b in blocks)}, key=abs):
        top = max((b["region"] for b in blocks if b["doubt"] == doubt), default=0)
        own = [b["text"] for b in blocks_left
               if b["doubt"] == doubt and b["region"] == top and (top or not b["links"])]
        if sum(map(len, own)) > sum(map(len, best)):
            best = own
        if top == 2 and not doubt:
            break
    return best


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slots_of: dict = {}
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            cols = (part.column(c).to_pylist() for c in ("_html", "_seed", "_template"))
            kept = [content(h, s, t, slots_of) for h, s, t in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_url"), pa.array(kept, pa.list_(pa.string()))],
                                             ["_id", "_url", "blocks"])


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: _host, _seed (shape) and _template ("slot text-hash" of
    what is template), from rows (_host, _html, _digest)."""
    seen = stage(pages.mapInArrow(_survey_batches, f"_host string, _digest long, _shape string, _marks {_MARKS}"),
                 "page-marks").withColumn("_shape_id", F.xxhash64("_shape"))
    shapes = stage(seen.groupBy("_host", "_shape_id").agg(F.first("_shape").alias("_shape"),
                                                          F.approx_count_distinct("_digest").alias("_pages")), "page-shapes")
    seeds = shapes.groupBy("_host").agg(F.max_by("_shape", F.struct("_pages", "_shape_id")).alias("_seed"))
    slots = stage(shapes.join(seeds, "_host").mapInArrow(
        _align_batches, "_host string, _shape_id long, _slots array<string>"), "page-slots")
    filled = (seen.select("_host", "_shape_id", "_digest", F.explode("_marks").alias("_b"))
              .join(slots, ["_host", "_shape_id"])
              .select("_host", "_digest", F.element_at("_slots", F.col("_b.node") + 1).alias("_slot"),
                      F.col("_b.marked").alias("_marked"), F.col("_b.text").alias("_text")).distinct())
    counts = filled.groupBy("_host", "_slot", "_marked", "_text").agg(F.count_distinct("_digest").alias("_n"))
    pages_of = filled.groupBy("_host", "_slot", "_marked").agg(F.count_distinct("_digest").alias("_of"))
    share = F.when(F.col("_marked"), ARTICLE_SHARE).otherwise(PAGE_SHARE)
    # at most 1/share texts of each slot of a host
    template = (counts.where(F.col("_n") >= MIN_PAGES * PAGE_SHARE).join(pages_of, ["_host", "_slot", "_marked"])
                .where((F.col("_of") >= MIN_PAGES) & (F.col("_n") >= share * F.col("_of")))
                .groupBy("_host").agg(F.collect_set(F.concat_ws(" ", "_slot", "_text")).alias("_template")))
    return stage(seeds.join(template, "_host", "left"), "wrappers")


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, blocks (the texts kept, in page
    order), text (the blocks joined by a line break) and n_chars.

    Null html counts as empty and gives an empty text; pages with a null url, or
    one without a host, form one host. Repeated rows each get their row and count
    as one page of the template. An empty table gives an empty result; other
    columns of ``pages`` are not read.
    """
    html = F.coalesce(html_col, F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    p = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("_host"), html.alias("_html"))
    wrappers = induce_wrappers(p.select("_host", "_html", F.xxhash64("_html").alias("_digest")))
    # a written table: the planner sends it to every task, or shuffles the pages, by its true size
    schema = T.StructType([p.schema["_id"], p.schema["_url"], T.StructField("blocks", T.ArrayType(T.StringType()))])
    return (p.join(wrappers, "_host").mapInArrow(_extract_batches, schema)
            .withColumn("text", F.array_join("blocks", "\n"))
            .select(F.col("_id").alias("page_id"), F.col("_url").alias("url"), "blocks", "text",
                    F.length("text").cast("long").alias("n_chars")))


# ---------------------------------------------------------------- query
def op2_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).drop("blocks")


QUERIES = {"op2_html_wrapper": op2_html_wrapper}
ORACLE: dict[str, str] = {}
