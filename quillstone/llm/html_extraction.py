"""Main text of web pages by removal of site templates.

Each page is parsed into element subtrees. Subtrees are hashed and counted per host
in Spark, each distinct article counting once, so that copies of a page are not taken
for a template; subtrees that recur across many pages of their host are deleted.
What remains outside the article, or is marked in its tag, role, class or id as a
menu, header, footer, sidebar, notice, advert, form or comment, goes too, so that
hosts with a page or two lose theirs as well.

Inside an article only containers can be a template (paragraphs and headings that
many articles share are text), and only where half of the host's articles have them.
Only pairs of host and hash are shuffled, pre-aggregated; a page's text goes from
the scan to the result, and is shuffled only if the templates of all hosts are too
large to be sent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise, meet

#: Distinct articles of a host that share a subtree: outside articles this many, and one in OUTSIDE_SHARE of the host's.
OUTSIDE, OUTSIDE_SHARE = 3, 200
#: The same inside articles.
INSIDE, INSIDE_SHARE = 10, 2

# Elements of HTML and words of class and id names.
_RAW = "script style textarea title xmp iframe noembed noframes noscript"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav aside footer form script style noscript template iframe svg math button select textarea title object canvas dialog menu audio video map datalist noembed noframes xmp".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status log".split())
_BLOCKS = frozenset(
    "html body head main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption"
    " form fieldset address details summary hgroup center dir menu dialog search legend optgroup option noscript template svg math button select object canvas audio video map datalist".split()
)
_CELLS = frozenset(("td", "th"))
_CLOSES_P = _BLOCKS - frozenset("html body head li dt dd thead tbody tfoot tr caption noscript template svg math button select object canvas audio video map datalist option optgroup legend".split()) | {"hr"}
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}
_CONTAINERS = frozenset("div section aside nav header footer ul ol dl table figure form details address center menu fieldset".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_WORDS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promoted promotion banner sidebar nav navbar navigation navigate menu submenu breadcrumb breadcrumbs"
    " masthead footer colophon copyright cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended"
    " recommendations comment comments commentlist disqus respond reply replies pagination pager paywall widget skip toolbar".split()
)
_PAIRS = frozenset(("site header", "page header", "top header", "header bar", "header site", "user comments", "reader comments", "read more", "see also", "side bar"))

_TOKEN = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|/(?=[^a-zA-Z])[^>]*+(?:>|\Z)|([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in _RAW.split()}


class Node:
    __slots__ = ("tag", "up", "start", "end", "first", "last", "marked", "core")

    def __init__(self, tag: str, up: int, start: int, first: int, marked: bool, core: bool):
        self.tag, self.up, self.start, self.end, self.first, self.last, self.marked, self.core = tag, up, start, -1, first, -1, marked, core


def _judge(tag: str, raw: str) -> tuple[bool, bool]:
    """Whether an element is marked as something else than the article, and whether as the article."""
    marked, core = tag in _DROPPED, tag in ("article", "main")
    if raw and "=" in raw or "hidden" in raw:
        words: list[str] = []
        for name, a, b, c in _ATTRIBUTE.findall(raw):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                words += [w.lower() for w in _NAME_PARTS.findall(value)]
            elif name == "role":
                marked |= value.strip().lower() in _ROLES
                core |= value.strip().lower() in ("main", "article")
            elif name == "itemprop":
                core |= value.strip().lower() == "articlebody"
                marked |= value.strip().lower() == "comment"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                marked = True
            elif name == "style":
                marked |= re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
        if words and tag not in ("html", "body", "main"):
            joined = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
            found = not _WORDS.isdisjoint(words) or not _PAIRS.isdisjoint(joined)
            marked |= found and (not core or not {"comment", "comments", "reply", "related", "promo", "sponsored", "ad", "advert"}.isdisjoint(words))
    return marked, core


class Page:
    """The elements of a page in page order, and its blocks of text.

    pieces: (element, text) of each run of text. Inline elements only matter where
    they are marked. An element that is never closed ends with the one around it.
    """

    def __init__(self, html: str):
        self.html, self.nodes, self.pieces = html, [Node("", -1, 0, 0, False, False)], []
        self.breaks: list[int] = []  # pieces before which a new block starts
        nodes, pieces, breaks = self.nodes, self.pieces, self.breaks
        stack = [0]
        at, n = 0, len(html)
        opened: dict[str, int] = {}  # open elements of each kind: what closes none is not searched for

        def close(upto: int, where: int) -> None:
            """Close all elements of the stack from place upto on."""
            for k in stack[upto:]:
                nodes[k].end, nodes[k].last = where, len(pieces)
                opened[nodes[k].tag] = opened.get(nodes[k].tag, 0) - 1
                if nodes[k].tag in _BLOCKS:
                    breaks.append(len(pieces))
            del stack[upto:]

        search = _TOKEN.search
        while at < n:
            m = search(html, at)
            if m is None:
                pieces.append((stack[-1], html[at:]))
                break
            if m.start() > at:
                pieces.append((stack[-1], html[at : m.start()]))
            at = m.end()
            closing, opening, raw = m.groups()
            if closing:
                tag = closing.lower()
                if tag == "p" or tag in _BLOCKS or tag in _CELLS:
                    if tag == "p":
                        breaks.append(len(pieces))
                    for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                        k = nodes[stack[i]].tag
                        if k == tag:
                            close(i, at)
                            break
                        if tag not in ("table", "body", "html", "article", "main") and k in ("table", "td", "th", "article", "main") or k in ("article", "main") and tag not in ("body", "html", "article", "main"):
                            break  # it closes nothing of what stands around that
                elif tag == "br":
                    pieces.append((stack[-1], " "))
                elif opened.get(tag):
                    for i in range(len(stack) - 1, 0, -1):
                        k = nodes[stack[i]].tag
                        if k == tag:
                            close(i, at)
                            break
                        if k in _BLOCKS or k in _CELLS:
                            break
                continue
            if not opening:
                continue  # comments and declarations
            if html[at - 1] != ">":
                break  # cut off inside a tag
            tag = opening.lower()
            if tag in _RAW_END:
                end = _RAW_END[tag].search(html, at)
                at = end.start() if end else n
                if end:
                    stop = html.find(">", at)
                    at = n if stop < 0 else stop + 1
                continue
            if tag in _VOID:
                if tag == "br":
                    pieces.append((stack[-1], " "))
                elif tag == "hr":
                    breaks.append(len(pieces))
                continue
            block = tag in _BLOCKS
            if block or tag in _CELLS:
                if tag in _CLOSES_P and opened.get("p"):
                    for i in range(len(stack) - 1, 0, -1):
                        k = nodes[stack[i]].tag
                        if k == "p":
                            close(i, m.start())
                            break
                        if k in _BLOCKS or k in _CELLS:
                            break
                if tag in _SIBLINGS:
                    same, around = _SIBLINGS[tag]
                    for i in range(len(stack) - 1, 0, -1) if any(opened.get(t) for t in same) else ():
                        k = nodes[stack[i]].tag
                        if k in same:
                            close(i, m.start())
                            break
                        if k in around or k in ("article", "main"):
                            break
                if block:
                    breaks.append(len(pieces))
                else:
                    pieces.append((stack[-1], " "))
            marked, core = _judge(tag, raw) if raw else (tag in _DROPPED, tag in ("article", "main"))
            if tag == "header" and not any(nodes[k].core for k in stack):
                marked = True
            if not block and tag not in _CELLS and not marked:
                continue
            if raw and raw.endswith("/") and tag in ("svg", "math", "path"):
                continue
            nodes.append(Node(tag, stack[-1], m.start(), len(pieces), marked, core))
            stack.append(len(nodes) - 1)
            opened[tag] = opened.get(tag, 0) + 1
        close(0, n)
        self._sizes = [0, *accumulate(len(t) for _, t in pieces)]
        self._choose()

    def size(self, i: int) -> int:
        """Characters of an element's text."""
        return self._sizes[self.nodes[i].last] - self._sizes[self.nodes[i].first]

    def _choose(self) -> None:
        """The regions of the main text: articles that are in nothing marked, else articles, else what is marked as main, else the page."""
        nodes = self.nodes
        total = self._sizes[-1]
        inside = [False] * len(nodes)  # within something marked
        holds = [False] * len(nodes)  # has an article or main in it that is not marked itself
        for i in range(len(nodes) - 1, 0, -1):
            if holds[i] or nodes[i].core and not nodes[i].marked:
                holds[nodes[i].up] = True
        any_core = any(holds)
        for i, node in enumerate(nodes):
            if i == 0:
                continue
            if node.marked and node.tag not in _DROPPED and not node.core and (holds[i] or not any_core and 2 * self.size(i) > total):
                node.marked = False  # a name of the layout, not of the part
            inside[i] = inside[node.up] or node.marked
        clear = [i for i in range(1, len(nodes)) if nodes[i].core and not inside[i]]
        held = [i for i in range(1, len(nodes)) if nodes[i].core and not nodes[i].marked and inside[i]]
        chosen = clear or held
        articles = [i for i in chosen if nodes[i].tag == "article"]
        chosen = articles or chosen
        under, some = [False] * len(nodes), set(chosen)
        for i in range(1, len(nodes)):
            under[i] = under[nodes[i].up] or nodes[i].up in some
        outer = [i for i in chosen if not under[i]]
        self.regions = outer or [0]
        if held and not clear:
            for i in outer:
                k = nodes[i].up
                while k > 0:
                    nodes[k].marked = False
                    k = nodes[k].up

    def _in_region(self) -> list[bool]:
        out = [False] * len(self.nodes)
        chosen = set(self.regions)
        for i, node in enumerate(self.nodes):
            out[i] = i in chosen or i > 0 and out[node.up]
        return out

    def article_hash(self) -> int:
        """Of the regions' text without markup: equal for copies of a page."""
        h = blake2b(digest_size=8)
        for r in self.regions:
            for _, t in self.pieces[self.nodes[r].first : self.nodes[r].last]:
                h.update(t.encode("utf-8", "surrogatepass"))
        return int.from_bytes(h.digest(), "little", signed=True)

    def subtrees(self) -> list[tuple[int, int, bool]]:
        """(element, hash of its subtree, whether inside a region) of every element that may be a template."""
        inside = self._in_region()
        regions = {i for r in self.regions for i in self._around(r)}
        nodes = self.nodes
        of = [0] * len(nodes)  # the nearest candidate from an element upward
        parts: dict[int, list[int]] = {}
        for i, node in enumerate(nodes):
            of[i] = of[node.up] if i else 0
            if i and i not in regions and (node.tag in _CONTAINERS or not inside[i] and node.tag in _PROSE):
                parts.setdefault(of[i], []).append(i)
                parts[i], of[i] = [], i
        hashes: dict[int, bytes] = {}
        for i in sorted(parts.keys() - {0}, reverse=True):  # a subtree's hash is of its own markup and its parts' hashes
            h, at = blake2b(digest_size=8), nodes[i].start
            for k in parts[i]:
                h.update(self.html[at : nodes[k].start].encode("utf-8", "surrogatepass") + b"\0" + hashes[k])
                at = nodes[k].end
            h.update(self.html[at : nodes[i].end].rstrip().encode("utf-8", "surrogatepass"))
            hashes[i] = h.digest()
        return [(i, int.from_bytes(hashes[i], "little", signed=True), inside[i]) for i in sorted(hashes)]

    def _around(self, i: int) -> Iterator[int]:
        while i >= 0:
            yield i
            i = self.nodes[i].up

    def main_text(self, outside: frozenset, within: frozenset) -> tuple[str, int, int]:
        """The regions' blocks without marked elements and templates; how many subtrees went as templates, and how many by their marks alone."""
        nodes = self.nodes
        gone = [False] * len(nodes)
        template = {i: True for i, h, inner in self.subtrees() if h in (within if inner else outside)} if outside or within else {}
        n_template = n_marked = 0
        region_text = sum(self.size(r) for r in self.regions)
        inside = self._in_region()
        for i, node in enumerate(nodes):
            if i == 0:
                continue
            if gone[node.up]:
                gone[i] = True
            elif i in template and not (inside[i] and 2 * self.size(i) > region_text):
                gone[i] = True
                n_template += 1
            elif node.marked:
                gone[i] = True
                n_marked += 1
        blocks = []
        edges = set(self.breaks)
        for r in self.regions:
            run: list[str] = []
            for k in range(nodes[r].first, nodes[r].last):
                if k in edges and run:
                    blocks.append("".join(run))
                    run = []
                i, t = self.pieces[k]
                if not gone[i]:
                    run.append(unescape(t) if "&" in t else t)
            if run:
                blocks.append("".join(run))
        return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b), n_template, n_marked


_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _host(url):
    """The host in lower case; an empty text where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def _hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """host, subtree, inside, article: one row for each distinct one of the batch; subtree null: the page itself."""
    seen = set()
    for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        page = Page(html or "")
        article = page.article_hash()
        seen.add((host, None, False, article))
        seen.update((host, h, inside, article) for _, h, inside in page.subtrees())
    columns = list(zip(*sorted(seen, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])), strict=True))
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "subtree", "inside", "article"])


def templates(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """host, outside, within: hashes of the subtrees that recur across the host's distinct articles.

    Outside articles OUTSIDE articles and one in OUTSIDE_SHARE of the host's have to
    share one, so a host's list is bounded by its average page times that share.
    """
    own = pages.select(_host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    seen = arrow_map(own, _hashed, "host string, subtree bigint, inside boolean, article bigint").distinct()
    counted = materialise(seen.groupBy("host", "subtree", "inside").agg(F.count(F.lit(1)).alias("n")), "subtrees")
    hosts = counted.where("subtree IS NULL").select("host", F.col("n").alias("articles"))
    often = counted.where(F.col("subtree").isNotNull() & (F.col("n") >= OUTSIDE)).join(hosts, "host")
    enough = F.when(F.col("inside"), (F.col("n") >= INSIDE) & (F.col("n") * INSIDE_SHARE >= F.col("articles"))).otherwise(F.col("n") * OUTSIDE_SHARE >= F.col("articles"))
    # collect_list passes over nulls
    lists = [F.collect_list(F.when(F.col("inside") == inside, F.col("subtree"))).alias(name) for inside, name in ((False, "outside"), (True, "within"))]
    return often.where(enough).groupBy("host").agg(*lists)


def _extracted(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, counts = [], []
    sets: dict[str, tuple[frozenset, frozenset]] = {}
    hosts = batch.column(2).to_pylist()
    for k, html in enumerate(batch.column(3).to_pylist()):
        if hosts[k] not in sets:
            sets[hosts[k]] = tuple(frozenset(batch.column(c)[k].as_py() or ()) for c in (4, 5))
        text, *n = Page(html or "").main_text(*sets[hosts[k]])
        texts.append(text)
        counts.append((len(text), *n))
    columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *columns], names=["page_id", "url", "text", "n_chars", "n_template", "n_marked"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_template and n_marked (subtrees deleted as templates of the host, and by their marks alone) of each page.

    text: blocks of the article joined by a blank line, character references
    decoded, white space inside a block as one space. A page without an article
    gives all that is neither template nor marked. Null and empty html give an empty
    text; a null url is a host of its own. Rows may repeat, ids may be null; each row
    gets its own result. Malformed and cut-off pages are read as browsers do, as far
    as blocks go.
    """
    found = materialise(templates(pages, html, url), "templates")
    own = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), _host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    renamed = found.select(F.col("host").alias("__host"), "outside", "within")
    both = meet(own, renamed, [("host", "__host")], F.xxhash64("page_id", "url"), F.size("outside") + F.size("within") + 4)
    schema = "page_id {}, url {}, text string, n_chars bigint, n_template bigint, n_marked bigint".format(*(own.schema[c].dataType.simpleString() for c in ("page_id", "url")))
    return arrow_map(both.select("page_id", "url", "host", "html", "outside", "within"), _extracted, schema)
