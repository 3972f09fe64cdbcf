"""HTML extraction with site template removal.

A page is read once into a tree of elements and a row of text blocks. Every block-level element gets the hash of its
subtree (its tag, its text, the hashes of the elements in it, in order), combined from the inside out. Spark counts
the subtrees per host, once for each article they stand beside (of a page without a main element, all its text is
the article), so copies of one page teach nothing; what recurs beside ``min_pages`` articles of a host is that
site's template, and is deleted, whatever its share of a page. Only of a page that would have no text left the
longest such subtree stays.

What HTML or a name marks as no main text (menus, scripts, forms, reader comments, ...) is deleted as well: reader
comments, and adverts that change from page to page, recur nowhere. If a page has an article or main element, only its
text is taken, and in it only what holds other elements (a list, a section, ...) can be template: its paragraphs and
headings are the article's own. All work on a page is linear in its length, however its elements are nested.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, slices, utf8, written
from .urlfilter import host_of

#: Elements by what they mean for the main text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
NO_TEXT = {"script", "style", "head", "title", "template"}
DROP = NO_TEXT | {"nav", "aside", "noscript", "iframe", "object", "embed", "svg", "math", "canvas", "button", "select", "textarea", "input", "menu", "dialog", "noembed", "noframes", "xmp", "audio", "video", "map"}
FRAME = {"header", "footer"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: What can be template inside a main element.
HOLDERS = {"div", "section", "ul", "ol", "dl", "table", "nav", "aside", "header", "footer", "form", "address", "center", "figure", "details"}
#: An opening tag of the left ends the innermost open elements of the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ITEMS, LISTS = {"li", "dt", "dd", "tr", "td", "th", "option"}, {"ul", "ol", "dl", "table", "select"}
STOPS = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "html", "td", "th", "main", "form", "center"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Class and id names of what is beside an article, of elements that hold others. A name of several words
#: (by - or _) counts if one of WORDS is among them, or as a whole. TALK never names a wrapper of the page.
TALK = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "comment", "comments", "commentlist", "disqus", "newsletter"}
WORDS = TALK | {"sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "popup", "modal", "pagination", "pager", "toolbar", "widget"}
WHOLE_TALK = {"related", "related-posts", "related-articles", "related-links", "related-stories", "recommended", "replies", "respond", "subscribe", "share", "sharing", "share-buttons", "social", "social-share"}
WHOLE = WHOLE_TALK | {"notice", "notices", "site-notice", "banner", "promo", "side-bar", "pop-up", "overlay", "site-header", "page-header", "skip-link", "login", "signup"}
NAMED = {"div", "section", "ul", "ol", "dl", "table", "center", "figure", "details", "span", "fieldset", "address", "p"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A tag with nothing odd in it; it gives nothing back, so a failed match costs no more than the tag's length.
_FAST = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'=<]*+)((?:[^<>\"']|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATOR = re.compile(r"[\x1c-\x1f]")
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}

#: A wrapper is the page's layout if the text outside it is at most this part of that inside.
BESIDE = 0.1
SLICE_BYTES = 1 << 20


class _Tags:
    """Where tags end: at the first ``>`` outside quotes. In a page with a tag that never ends so, at the first ``>``."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.quotes, self.unclosed = True, set()

    def end(self, at: int) -> int:
        """The place after the tag whose attributes begin at ``at``; -1 if none ends it."""
        if at > self.last:
            return -1
        i = at
        while self.quotes:
            i = _PLAIN.match(self.source, i).end()
            if i >= len(self.source):
                self.quotes = False
                break
            sign = self.source[i]
            if sign == ">":
                return i + 1
            close = -1 if sign in self.unclosed else self.source.find(sign, i + 1)
            if close < 0:
                self.unclosed.add(sign)
            i = max(i, close) + 1
        return self.source.find(">", at) + 1


class _Node:
    """An open or closed element. near: the innermost block-level element at or above it, by whose hash it is known."""

    __slots__ = ("tag", "up", "block", "hard", "soft", "main", "inside", "holds", "near", "hasher", "hash", "bound", "p", "item", "dropped", "size", "main_size", "sure", "place")

    def __init__(self, tag: str, up: _Node | None, block: bool):
        self.tag, self.up, self.block = tag, up, block
        self.hard = self.soft = self.main = self.inside = self.holds = self.dropped = self.sure = False
        self.hasher, self.hash, self.place = (xxhash.xxh3_64(tag) if block else None), None, None
        self.near = self if block else up and up.near
        self.bound = self.p = self.item = -1
        self.size = self.main_size = 0


def _named(tag: str, attrs: dict[str, str]) -> tuple[bool, bool]:
    """Whether class or id say that the element is beside the article, and whether it can never be a wrapper."""
    if tag not in NAMED:
        return False, False
    beside = never = False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        if tag == "p" and name not in TALK:
            continue
        parts = set(re.split("[-_]", name))
        beside = beside or name in WHOLE or bool(parts & WORDS)
        never = never or name in WHOLE_TALK or bool(parts & TALK)
    return beside, never


def _read(source: str, markup: bool) -> tuple[list[_Node], list[tuple[str, _Node]]]:
    """All elements in the order they open, and (text, element around it) of all blocks.

    Tags that never end run to the end of what holds them; a cut-off tag at the end of a page is no text.
    """
    tags = _Tags(source)
    root = _Node("", None, True)
    nodes, stack, blocks, words = [root], [root], [], []
    open_at: dict[str, list[int]] = {}

    def flush() -> None:
        if not words:
            return
        text = html.unescape("".join(words))
        # Python splits at four more characters than those of white space.
        text = _SPACE.sub(" ", text).strip() if _SEPARATOR.search(text) else " ".join(text.split())
        words.clear()
        if text:
            stack[-1].near.hasher.update(b"\0" + text.encode("utf-8", "replace"))
            blocks.append((text, stack[-1]))

    def close(to: int) -> None:
        while len(stack) > to:
            node = stack.pop()
            open_at[node.tag].pop()
            if node.block:
                digest = node.hasher.digest()
                node.hash = int.from_bytes(digest, "big", signed=True)
                node.up.near.hasher.update(b"\1" + digest)

    at = 0
    while True:
        found = source.find("<", at)
        if found < 0:
            words.append(source[at:])
            break
        if found > at:
            words.append(source[at:found])
        whole = _FAST.match(source, found)
        if whole:
            shut, tag, body = whole[1], whole[2].lower(), whole[3]
            at = whole.end()
        else:
            sign = source[found + 1 : found + 2]
            if not (sign in ("/", "!", "?") or (sign.isascii() and sign.isalpha())):
                words.append("<")
                at = found + 1
                continue
            if sign in ("!", "?"):
                mark = "-->" if source.startswith("<!--", found) else ">"
                stop = source.find(mark, found + (4 if mark == "-->" else 2))
                if stop < 0:
                    break
                at = stop + len(mark)
                continue
            named = _NAME.match(source, found + (2 if sign == "/" else 1))
            at = tags.end(named.end() if named else found + 1)
            if at <= 0:
                break
            if named is None:
                continue
            shut, tag, body = sign == "/", named[0].lower(), source[named.end() : at - 1]
        if shut:
            places = open_at.get(tag)
            if places and (places[-1] > stack[-1].bound or tag in ("article", "main", "body", "html") or places[-1] == stack[-1].bound):
                if stack[places[-1]].block:
                    flush()
                close(places[-1])
            continue
        if tag in ("br", "img", "wbr"):
            if tag != "wbr":
                words.append(" ")
            continue
        attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(body)} if body.strip() else {}
        up = stack[-1]
        inside = up.inside or up.main
        role = attrs.get("role", "").lower()
        main = tag in ("article", "main") or role in ("main", "article")
        form = tag == "form" or role == "form"
        beside, never = (False, False) if main or tag in ("html", "body") else _named(tag, attrs)
        hard = tag in DROP or (role in ASIDE_ROLES and role != "form") or "hidden" in attrs or (tag in FRAME and not (tag == "header" and inside)) or (beside and never)
        block = tag in BLOCK or tag in DROP or hard or form or beside or main
        if block:
            flush()
        if tag in BLOCK and up.p > 0:
            close(up.p)
        if tag in ENDS:
            place = stack[-1].item
            if tag == "tr":
                while place > 0 and stack[place].tag != "tr" and stack[place - 1].item > 0:
                    place = stack[place - 1].item
            if place > 0 and stack[place].tag in ENDS[tag]:
                close(place)
        if tag in VOID:
            continue
        up = stack[-1]
        node = _Node(tag, up, block)
        place = len(stack)
        node.hard, node.main, node.inside = (hard if markup else tag in NO_TEXT), main, up.inside or up.main
        # Some wrap the whole page, which is seen when it has been read.
        node.soft = markup and not hard and (form or beside)
        node.bound = place if tag in ("article", "main", "body") else up.bound
        node.p = place if tag == "p" else -1 if tag in STOPS else up.p
        node.item = place if tag in ITEMS else -1 if tag in LISTS else up.item
        if main:
            above = up
            while above is not None and not above.holds:
                above.holds, above = True, above.up
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.start() if end else len(source)
        open_at.setdefault(tag, []).append(place)
        nodes.append(node)
        stack.append(node)
    flush()
    close(1)
    return nodes, blocks


def _unwrap(nodes: list[_Node], blocks: list[tuple[str, _Node]]) -> None:
    """Let forms and named elements be no longer dropped if they wrap the page.

    They do if they hold the main element, and next to none stands outside them. An article there may also be a
    teaser, so the text they hold must then outweigh the text outside. Without a main element below them, they do if
    they hold next to all the text; so a page that is one form keeps its text. The largest are judged first, what
    holds others before them, each once.
    """
    soft = [n for n in nodes if n.soft]
    if not soft:
        return
    for node in nodes[1:]:
        node.dropped = node.hard or node.up.dropped
    for text, node in blocks:
        if not node.dropped:
            node.size += len(text)
            node.main_size += len(text) if node.main or node.inside else 0
    for node in reversed(nodes[1:]):
        node.up.size += node.size
        node.up.main_size += node.main_size
        node.up.sure = node.up.sure or node.sure or (node.main and node.tag != "article" and not node.dropped)
    below: dict[int, list[_Node]] = {}
    outer: dict[int, _Node | None] = {id(nodes[0]): None}
    for node in nodes[1:]:
        outer[id(node)] = node if node.soft else outer[id(node.up)]
        if node.soft:
            above = outer[id(node.up)]
            below.setdefault(id(above) if above else 0, []).append(node)
    ready = below.get(0, [])
    text = nodes[0].size - sum(n.size for n in ready)
    main = nodes[0].main_size - sum(n.main_size for n in ready)
    heap = [(-n.size, i, n) for i, n in enumerate(ready)]
    heapq.heapify(heap)
    count = len(heap)
    while heap:
        _, _, node = heapq.heappop(heap)
        held_main = 0 if node.inside else node.main_size
        if held_main:
            wraps = main <= BESIDE * held_main and (node.sure or text < node.size)
        else:
            wraps = (main if node.inside else text) <= BESIDE * node.size
        if wraps:
            node.soft = False
            inner = below.get(id(node), [])
            text += node.size - sum(n.size for n in inner)
            main += node.main_size - sum(n.main_size for n in inner)
            for n in inner:
                heapq.heappush(heap, (-n.size, count, n))
                count += 1


class Page:
    """blocks: (text, element) of the main text. What may be template: ``countable``."""

    def __init__(self, source: str, markup: bool = True):
        self.nodes, self.found = _read(source, markup)
        _unwrap(self.nodes, self.found)
        for node in self.nodes[1:]:
            node.dropped = node.hard or node.soft or node.up.dropped
        left = [b for b in self.found if not b[1].dropped]
        self.has_main = markup and any(n.main or n.inside for _, n in left)
        self.blocks = [b for b in left if b[1].main or b[1].inside] if self.has_main else left

    def countable(self, node: _Node) -> bool:
        """Not what holds a main element, and in one only what can hold others."""
        if not node.block or node.up is None or node.tag in ("html", "body", "head", "script", "style", "title"):
            return False
        return not self.has_main or not (node.holds or node.main) and (not node.inside or node.tag in HOLDERS)

    def article(self) -> int:
        return xxhash.xxh3_64_intdigest("\n".join(t for t, _ in self.blocks).encode("utf-8", "replace")) - (1 << 63)

    def subtrees(self) -> list[int]:
        """The hashes of all that may be template and has text, each once."""
        some, out = {id(n) for _, n in self.found}, {}
        for node in reversed(self.nodes[1:]):
            if id(node) in some:
                some.add(id(node.up))
                if self.countable(node):
                    out[node.hash] = True
        return list(out)

    def compact(self) -> tuple[list[str], list[int], list[int], list[int]]:
        """Texts, the place of the innermost countable element of each (-1: none), and of these what is above and their hashes."""
        up, hashes = [], []

        def place(node: _Node) -> int:
            chain = []
            while node.up is not None and node.place is None:
                chain.append(node)
                node = node.up
            last = -1 if node.up is None else node.place
            for node in reversed(chain):
                if self.countable(node):
                    up.append(last)
                    hashes.append(node.hash)
                    last = len(up) - 1
                node.place = last
            return last

        at = [place(n) for _, n in self.blocks]
        return [t for t, _ in self.blocks], at, up, hashes


def main_text(source: str) -> list[str]:
    """The blocks of the main text of one page, as far as the page alone tells."""
    return [t for t, _ in Page(source).blocks]


def kept_texts(texts: list[str], at: list[int], up: list[int], hashes: list[int], template: set[int]) -> list[str]:
    """The texts outside template; if none is, those of the longest subtree that is."""
    top: list[int] = []
    for i, hashed in enumerate(hashes):
        above = top[up[i]] if up[i] >= 0 else -1
        top.append(above if above >= 0 else i if hashed in template else -1)
    held = [top[a] if a >= 0 else -1 for a in at]
    if -1 not in held and texts:
        sizes: dict[int, int] = {}
        for text, h in zip(texts, held, strict=True):
            sizes[h] = sizes.get(h, 0) + len(text)
        largest = max(sizes, key=lambda h: (sizes[h], -h))
        held = [-1 if h == largest else h for h in held]
    return [t for t, h in zip(texts, held, strict=True) if h < 0]


def _pages(batches: Iterable[pa.RecordBatch], markup: bool) -> Iterator[tuple[pa.RecordBatch, list[Page]]]:
    """Runs of a MB of pages, read from the last column."""
    for batch in batches:
        raw = utf8(batch.column(batch.num_columns - 1))
        for begin, end in slices(raw, SLICE_BYTES):
            yield batch.slice(begin, end - begin), [Page(t.decode("utf-8", "replace"), markup) for t in raw[begin:end]]


def page_subtrees(pages: DataFrame, markup: bool = True) -> DataFrame:
    """page, article, subtree of pages (key, host, html): a row per subtree; host goes into the subtree's hash."""

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _pages(batches, markup):
            hosts = part.column(1).to_pylist()
            rows = [(i, page.article(), s) for i, page in enumerate(found) for s in page.subtrees()]
            at, articles, subtrees = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array([hosts[i] for i in at], pa.string()), pa.array(articles, pa.int64()), pa.array(subtrees, pa.int64())], ["page", "host", "article", "subtree"])

    return pages.mapInArrow(hashes, "page long, host string, article long, subtree long").select("page", "article", F.xxhash64("host", "subtree").alias("site_subtree"), "subtree")


def _parsed(pages: DataFrame, id_type: str, markup: bool) -> DataFrame:
    ints = pa.list_(pa.int32())

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _pages(batches, markup):
            texts, at, up, hashes = zip(*(p.compact() for p in found), strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(texts, pa.list_(pa.string())), pa.array(at, ints), pa.array(up, ints), pa.array(hashes, pa.list_(pa.int64()))], ["page", "id", "url", "texts", "at", "up", "hashes"])

    return pages.mapInArrow(parse, f"page long, id {id_type}, url string, texts array<string>, at array<int>, up array<int>, hashes array<long>")


def _stripped(rows: DataFrame, id_type: str) -> DataFrame:
    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 7)]
            out = ["\n".join(kept_texts(t, a, u, h, set(x)) if x else t) for t, a, u, h, x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x or ()) for x in columns[4]], pa.int64())], ["id", "url", "text", "n_template"])

    return rows.select("id", "url", "texts", "at", "up", "hashes", "template").mapInArrow(strip, f"id {id_type}, url string, text string, n_template long")


def extract_text(pages: DataFrame, min_pages: int = 5, markup: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text (blocks joined by line ends), n_chars, n_template (subtrees that recur).

    Null and empty pages have the empty text. A null url has the empty host, a site like any other. Rows that
    repeat get equal rows. An empty table gives no rows. ``markup`` false: names, roles and main elements say
    nothing, and template removal alone decides.
    """
    id_type = pages.schema[id_col].dataType.simpleString()
    page = F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col)).alias("page")
    # Read twice below; a few numbers of each page. Texts are parsed again rather than stored.
    once = written(page_subtrees(pages.select(page, host_of(F.col(url_col)).alias("host"), html_col), markup), "subtrees")
    articles = once.select("site_subtree", "article").distinct().groupBy("site_subtree").agg(F.count(F.lit(1)).alias("pages"))
    recurring = written(articles.filter(F.col("pages") >= min_pages), "template")
    marked = join_heavy(once.select("page", "site_subtree", "subtree"), recurring, ["site_subtree"], "pages").groupBy("page").agg(F.collect_set("subtree").alias("template"))
    rows = _parsed(pages.select(page, F.col(id_col).alias("id"), F.col(url_col).alias("url"), html_col), id_type, markup).join(marked, "page", "left")
    return _stripped(rows, id_type).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_template")
