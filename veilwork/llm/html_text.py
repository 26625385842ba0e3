"""Main text of web pages: site templates are subtrees that recur across a host's pages.

Each page is read once to an element tree by a tolerant tag scanner. In a first pass every element subtree outside
running text is hashed (tag, class, text and children) and Spark counts the pages of each host that hold it. Subtrees
on at least ``min_pages`` pages are the host's template, however many pages it has (a caller may also ask for a ``share`` of
the host's pages). Pages of a host with equal text are one page under several urls and count once. Pages are read in blocks, and a block gets just those of its subtrees that are template. The second pass deletes
them, together with elements that are no content by their tag, role or class, and writes the blocks that stay.

Words of class or id don't delete an element that holds the page's main text (see ``holders``). Within the main text they
are read narrowly (see ``_narrow``): ids there are mostly anchors of headings. A state (hidden), a role or a tag deletes the
element with all it holds.

Running text is protected: a paragraph, heading, quote, list item or cell in ``article`` or ``main`` never counts as
template, nor does an element that holds such a one or the main element. So a passage or an article that many pages
share stays. In a page without these elements the element with most text in paragraphs of its own stands for them, if that
is at least DENSE characters.

``pages`` must give the same rows in the same partitions each time it is run, as a table scan does; extracting fails if not.

White space is what Unicode calls so. Blocks are what block elements and line breaks part.

Defined cases: a null html is empty; a null or unreadable url is the host ''. Unclosed and stray tags are tolerated, an
unclosed script or comment runs to the end. Repeated rows each get a row and count as one page. An empty table gives
no rows. Other columns are ignored. A page under many urls keeps its text.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import mapped, stage

# Element names of HTML, and the words that mark what is no content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "noembed"}
NOT_CONTENT = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "input",
               "label", "fieldset", "datalist", "canvas", "audio", "video", "map", "search"} | RAW
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr", "img", "picture", "source"}
FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "figcaption",
        "article", "main", "body", "html"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1",
            "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table",
            "ul", "figcaption", "details"}
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
                  "th": {"table", "tr"}, "option": {"select"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert",
         "menu", "menubar", "toolbar", "tablist"}
MARKS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "adbox",
         "banner", "sponsor", "sponsored", "promo", "promotion", "promoted", "cookie", "cookies", "consent", "gdpr",
         "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
         "subscription", "paywall", "signup", "login", "sidebar", "sidebars", "aside", "menu", "menus", "nav",
         "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "footer", "foot",
         "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "share",
         "sharing", "social", "related", "recommended", "recommendations", "widget", "widgets", "toolbar",
         "pagination", "pager", "search", "searchform", "form", "skip", "hidden"}
# Words that say nothing of their own beside those.
PLAIN = {"area", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "cards", "col",
         "column", "container", "content", "count", "entry", "group", "holder", "icon", "icons", "id", "inner", "item",
         "items", "label", "left", "link", "links", "list", "media", "module", "outer", "page", "panel", "post", "posts",
         "right", "row", "section", "site", "slot", "space", "stories", "text", "thread", "title", "top", "unit", "wrap",
         "wrapper"}
# Of the words above those that are no title of a section.
NO_TITLE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "adbox", "sponsored",
            "sponsor", "cookie", "cookies", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "signup",
            "login", "sidebar", "sidebars", "nav", "navbar", "breadcrumb", "breadcrumbs", "masthead", "topbar", "footer",
            "comments", "commentlist", "disqus", "replies", "respond", "sharing", "pagination", "pager", "searchform"}
#: Characters in an element's own paragraphs that make it the main text of a page without article and main.
DENSE = 200

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
                 re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "marks", "parts", "parent", "skip", "depth_main", "by_word")

    def __init__(self, tag, marks, skip, parent, in_main, by_word=False):
        self.tag, self.marks, self.skip, self.parent, self.depth_main = tag, marks, skip, parent, in_main
        self.by_word = by_word  # a word of class or id says that it is no content
        self.parts: list = []  # texts and nodes in page order


def _judge(tag: str, attributes: str, parent: Node) -> tuple[str, bool, bool]:
    """The element's class words, and whether tag, role or state, and whether its words say that it is no content."""
    skip = tag in NOT_CONTENT or tag == "header" and not parent.depth_main
    if not attributes.strip(" \t\r\n/"):
        return "", skip, False
    found = {k.lower(): htmllib.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)}
    marks = f"{found.get('class', '')} {found.get('id', '')}".strip()
    by_word = False
    if not skip and tag not in ("html", "body", "article", "main"):
        skip = ("hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES
                or "display:none" in found.get("style", "").replace(" ", "").lower())
        by_word = (_narrow(tag, found.get("class", ""), found.get("id", "")) if parent.depth_main else
                   any(w.lower() in MARKS for w in TOKEN.findall(marks)))
    return marks, skip, by_word


def _narrow(tag: str, classes: str, id_: str) -> bool:
    """Whether words say that an element within the main text is none of it.

    A class must be made of such words wholly, so that related-work and notice-board are content. An id must, too, and must
    hold a word that titles no section; one of a heading or paragraph says nothing.
    """
    def marked(name: str, words: set[str]) -> bool:
        own = [w.lower() for w in TOKEN.findall(name)]
        return not words.isdisjoint(own) and all(w in MARKS or w in PLAIN for w in own)

    return any(marked(c, MARKS) for c in classes.split()) or tag not in FLOW and marked(id_, NO_TITLE)


def tree(html: str) -> Node:
    """The element tree of a page. Tags that close nothing are left out; p, li and the like close as browsers do."""
    root = now = Node("html", "", False, None, False)
    at, begin, end = 0, 0, len(html)
    while True:
        begin = html.find("<", begin)
        if begin < 0:
            now.parts.append(html[at:])
            break
        m = TAG.match(html, begin)
        if m is None:  # a plain less-than sign
            begin += 1
            continue
        if begin > at:
            now.parts.append(html[at:begin])
        at = begin = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:  # an end tag
            node = now
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                now = node.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            node = now
            while node.tag in INLINE and node.parent is not None:
                node = node.parent
            if node.tag == "p":
                now = node.parent
        if tag in CLOSED_BY_SAME:
            node = now
            while node.parent is not None and node.tag not in CLOSED_BY_SAME[tag]:
                if node.tag == tag or {node.tag, tag} <= {"dt", "dd"} or {node.tag, tag} <= {"td", "th"}:
                    now = node.parent
                    break
                node = node.parent
        marks, skip, by_word = _judge(tag, m[3], now)
        node = Node(tag, marks, skip, now, now.depth_main or tag in ("article", "main"), by_word)
        now.parts.append(node)
        if tag in RAW:
            close = re.compile(f"</{tag}[^>]*>?", re.I).search(html, at)
            if close is None and tag == "title":
                continue
            node.parts.append(html[at:close.start() if close else end])
            at = begin = close.end() if close else end
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            now = node
    return root


def _order(root: Node) -> list[Node]:
    """Children before parents, without recursion: markup may be nested deeply."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in node.parts if isinstance(x, Node))
    return out[::-1]


def dense(order: list[Node]) -> Node | None:
    """The element with most text in its own paragraphs, in a page without article and main that hold text."""
    own: dict[int, int] = {}
    size: dict[int, int] = {}
    best = None
    for node in order:  # children first
        size[id(node)] = 0 if node.skip else sum(
            size[id(x)] if isinstance(x, Node) else len(x.strip()) for x in node.parts)
        if node.tag in ("article", "main") and size[id(node)]:
            return None
        if node.tag == "p" and node.parent is not None:
            own[id(node.parent)] = own.get(id(node.parent), 0) + size[id(node)]
    for node in order:
        if not node.skip and own.get(id(node), 0) >= DENSE and (best is None or own[id(node)] > own[id(best)]):
            best = node
    while best is not None and best.parent is not None and (best.tag in FLOW or best.tag in INLINE):
        best = best.parent
    return best


def holders(root: Node) -> set[int]:
    """Ids of the nodes that hold main text, which words of class or id don't delete.

    Main text are the main element, the articles within the fewest elements with such words (a related article in a
    sidebar or a comment is in more of them than the page's own), and any article with most of the articles' text.
    """
    size: dict[int, int] = {}
    order = _order(root)
    worded = {id(root): 0}
    for node in reversed(order):  # parents first
        if node.parent is not None:
            worded[id(node)] = worded[id(node.parent)] + node.by_word
    hidden = set()
    for node in reversed(order):
        if node.skip or node.parent is not None and id(node.parent) in hidden:
            hidden.add(id(node))
    for node in order:
        size[id(node)] = 0 if id(node) in hidden else sum(
            size[id(x)] if isinstance(x, Node) else len(x.strip()) for x in node.parts)
    found = [n for n in order if n.tag in ("article", "main") and size[id(n)]]
    if not found and (body := dense(order)) is not None and body.parent is not None:
        found = [body]
    outer = [n for n in found if not n.parent.depth_main]
    least = min((worded[id(n)] for n in found), default=0)
    total = sum(size[id(n)] for n in outer)
    held: set[int] = set()
    for node in found:
        if node.tag != "article" or worded[id(node)] == least or 2 * size[id(node)] > total:
            while node is not None and id(node) not in held:
                held.add(id(node))
                node = node.parent
    return held


def subtree_hashes(root: Node) -> dict[int, int]:
    """Hash by id of the nodes that may be template: they neither are nor hold running text of the main element."""
    hashes: dict[int, int] = {}
    flow: set[int] = set()
    sums: dict[int, bytes] = {}
    order = _order(root)
    body = dense(order)
    inside = set() if body is None else {id(n) for n in _order(body)}
    for node in order:
        h = hashlib.blake2b(f"{node.tag}\x00{node.marks}".encode("utf-8", "surrogatepass"), digest_size=8)
        text = False
        for x in node.parts:
            if isinstance(x, Node):
                h.update(sums[id(x)])
                text |= id(x) in flow
            else:
                h.update(" ".join(x.split()).encode("utf-8", "surrogatepass"))
        main = node.depth_main or id(node) in inside
        if text or node.parent is None or node is body or node.tag in ("article", "main") or main and node.tag in FLOW:
            flow.add(id(node))
        sums[id(node)] = h.digest()
        if id(node) not in flow and node.tag not in INLINE and node.tag not in VOID and node.parts:
            hashes[id(node)] = int.from_bytes(sums[id(node)], "little", signed=True)
    return hashes


def page_text(html: str | None, template: set[int] | frozenset = frozenset()) -> str:
    """The text that stays: references decoded, a blank between blocks and for any run of white space."""
    root = tree(html or "")
    return text_of(root, template, subtree_hashes(root) if template else {})


def text_of(root: Node, template: set[int] | frozenset, drop: dict[int, int]) -> str:
    main: set[int] | None = None
    out: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(htmllib.unescape(x) if "&" in x else x)
        elif not x.skip and drop.get(id(x)) not in template:
            if x.by_word:
                main = holders(root) if main is None else main
                if id(x) not in main:
                    continue
            if x.tag not in INLINE:
                out.append("\n")
                todo.append("\n")
            todo.extend(x.parts[::-1])
    return " ".join("".join(out).split())


def host_of(url):
    """The url's host in lower case, without port and user; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _blocks(of, size: int):
    """(block, row) with blocks of about ``size`` characters of a partition's rows, html last, in their order."""
    block, held = TaskContext.get().partitionId() << 32, 0
    for row in of:
        n = len(row[-1] or "")
        if held and held + n > size:
            block, held = block + 1, 0
        held += n
        yield block, row


def subtrees(pages: DataFrame, size: int, min_pages: int) -> DataFrame:
    """``(block, host, h, pages, texts)``: each block's subtrees, on how many of its pages they are, and hashes of the
    texts of those pages: the ``min_pages`` least, which tell whether there are as many different ones.

    A null h counts the pages of a host, and a null host has the block's characters.
    """
    def rows(of):
        now, seen, texts, held = None, Counter(), {}, 0

        def whole():
            for (host, h), c in seen.items():
                yield now, host, h, c, texts.get((host, h))
            yield now, None, None, held, None

        for block, (host, html) in _blocks(of, size):
            if block != now and now is not None:
                yield from whole()
                seen, texts, held = Counter(), {}, 0
            now = block
            held += len(html or "") + 1
            root = tree(html or "")
            hashes = subtree_hashes(root)
            text = hashlib.blake2b(text_of(root, frozenset(), {}).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            content = int.from_bytes(text, "little", signed=True)
            seen[host, None] += 1
            for h in set(hashes.values()):
                seen[host, h] += 1
                least = texts.setdefault((host, h), [])
                if content not in least:
                    if len(least) < min_pages:
                        least.append(content)
                    elif content < max(least):
                        least[least.index(max(least))] = content
        if now is not None:
            yield from whole()

    return mapped(pages.select(host_of(F.col("url")), F.col("html").cast("string")), rows,
                  pa.schema([("block", pa.int64()), ("host", pa.string()), ("h", pa.int64()), ("pages", pa.int64()),
                             ("texts", pa.list_(pa.int64()))]),
                  "block bigint, host string, h bigint, pages bigint, texts array<bigint>")


def templates(found: DataFrame, min_pages: int = 5, share: float = 0.0) -> DataFrame:
    """``(host, h)``: the subtrees on at least min_pages pages of different text, and on that share of the host's pages.

    Hashes of texts are made distinct within blocks and tasks before they are shuffled, so a host with most of the pages
    is no hot key; a subtree has at most min_pages of them a block.
    """
    texts = found.where("h is not null").select("host", "h", F.explode("texts").alias("t")).distinct()
    often = texts.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).drop("n")
    if share > 0:
        of_host = found.where("h is null and host is not null").groupBy("host").agg(F.sum("pages").alias("of"))
        on = found.where("h is not null").groupBy("host", "h").agg(F.sum("pages").alias("n"))
        often = often.join(on, ["host", "h"]).join(of_host, "host").where(F.col("n") >= share * F.col("of"))
    return often.select("host", "h")


def extract(pages: DataFrame, min_pages: int = 5, share: float = 0.0, block: int = 8_000_000) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per page.

    A template is joined once for a block that holds it, so no host's templates are gathered in one row.
    """
    found = stage(subtrees(pages, block, min_pages), "subtrees")
    known = found.join(templates(found, min_pages, share), ["host", "h"]).select("block", "host", "h", F.lit(0).alias("held"))
    known = known.unionByName(found.where("host is null").select("block", "host", "h", F.col("pages").alias("held")))
    src = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), host_of(F.col("url")),
                       F.col("html").cast("string"))
    texts = mapped(src, lambda of: ((b, *row) for b, row in _blocks(of, block)),
                   pa.schema([("block", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()),
                              ("html", pa.string())]), "block bigint, page_id bigint, url string, host string, html string", 500)

    def extracted(left: pa.Table, right: pa.Table) -> pa.Table:
        of: dict[str, set[int]] = {}
        for host, h in zip(right.column("host").to_pylist(), right.column("h").to_pylist()):
            if host is not None:
                of.setdefault(host, set()).add(h)
        html = left.column("html").to_pylist()
        if sum(len(x or "") + 1 for x in html) != sum(right.column("held").to_pylist()):
            raise RuntimeError("a block has other pages than before: the input isn't the same each time")
        out = [page_text(x, of.get(host, frozenset())) for x, host in zip(html, left.column("host").to_pylist())]
        return pa.table([left.column("page_id"), left.column("url"), pa.array(out, pa.string()),
                         pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        extracted, "page_id bigint, url string, text string, n_chars bigint")
