"""Main text of web pages by tree scoring.

The page becomes a tree (implied end tags are applied, raw-text elements skipped);
elements that are boilerplate by tag, role, hiding or a whole class name or id are cut
out. A boilerplate word that is only part of a name counts by the share of the page's
unlinked text that it marks: little text is cut, more weighs less in the score, nearly
all of the page is left alone; where the whole names leave little text, they count like parts.
Every block of text passes points for its length and commas to its ancestors (full to the parent,
half to the grandparent, less above), discounted by the share of its text that is
link text. The container with the best score and its content siblings are kept, and
their blocks are returned in page order.

Defined cases: null or empty html, or a page without text, gives an empty text;
unclosed tags, comments and truncated references are read as a browser reads them;
page length is not limited; repeated rows give repeated results.
"""
from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from netwarden.llm.common import map_batches

RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div",
         "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
         "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p",
         "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
#: Elements whose start tag ends an open paragraph.
ENDS_P = BLOCK - {"html", "head", "body", "caption", "tbody", "thead", "tfoot", "tr", "option", "optgroup", "legend"}
SCOPE = {"table", "td", "th", "caption", "button", "object", "html", "body"}
#: start tag -> open elements it ends, up to the given boundaries
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
JUNK_TAGS = {"nav", "footer", "aside", "form", "button", "select", "input", "svg", "canvas", "object", "embed",
             "dialog", "menu", "head", "label", "search", "audio", "video", "map"}
JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog",
              "menu", "menubar", "toolbar", "form", "status", "tablist"}
JUNK_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "adbox",
    "sponsor", "sponsored", "sponsors", "promo", "promotion", "promoted", "banner", "sidebar", "sidenav", "nav",
    "navbar", "navigation", "navi", "menu", "menus", "submenu", "breadcrumb", "breadcrumbs", "footer", "header",
    "masthead", "topbar", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "reactions",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "notifications", "alert", "popup",
    "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social",
    "related", "recommended", "recommendations", "widget", "widgets", "toolbar", "pager", "pagination", "skip",
    "copyright", "disclaimer", "paywall", "outbrain", "taboola", "hidden"}
#: Whole names that stay cut where others count as parts.
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "reactions"}
#: Words that articles also use for their own paragraphs.
WEAK = {"widget", "widgets", "related", "recommended", "recommendations", "notice", "notices", "notification",
        "notifications", "alert", "banner", "header", "overlay", "promotion", "copyright", "disclaimer", "consent",
        "subscription", "navigation"}
#: Shares of the page's unlinked text: below the first an element is cut by part of a name, below the second it
#: has LIGHT weight (LIGHT of it again for comments); a word that more than HALF lies under in elements below HALF says
#: nothing; whole names that leave less than LEFT, and fewer than FEW characters, count as parts.
SMALL, MOST, HALF, LIGHT, LEFT, FEW = 0.2, 0.9, 0.5, 0.25, 0.25, 250
#: Unlinked characters of a paragraph.
PROSE = 40
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Attributes that can mark boilerplate.
_SAYS = re.compile(r"class|id|hidden|style|role", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "attrs", "score", "chars", "links", "weight")

    def __init__(self, tag, parent, attrs=""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children, self.score, self.chars, self.links, self.weight = [], 0.0, 0, 0, 1.0


class Mark:
    """An element with boilerplate words in its names: the words, whether a whole name says so, where it
    begins and ends, and its characters in and out of links."""
    __slots__ = ("node", "words", "whole", "weak", "first", "last", "free", "links")

    def __init__(self, node, words, whole, weak):
        self.node, self.words, self.whole, self.weak = node, words, whole, weak


def parse(page: str) -> Node:
    root = cur = Node("html", None)
    counts: dict[str, int] = {}          # open elements by tag
    at, end = 0, len(page)

    def close_to(node):
        nonlocal cur
        while cur is not node:
            counts[cur.tag] -= 1
            cur = cur.parent

    def find(tags, stops):
        if not any(counts.get(t) for t in tags):
            return None
        n = cur
        while n is not root:
            if n.tag in tags:
                return n
            if n.tag in stops:
                return None
            n = n.parent
        return None

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            cur.children.append(unescape(page[at:lt]))
        if lt >= end:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 2)
            at = end if stop < 0 else stop + 3
            continue
        m = _NAME.match(page, lt)
        if not m:
            if page[lt + 1:lt + 2] in ("!", "?", "/"):
                stop = page.find(">", lt)
                at = end if stop < 0 else stop + 1
            else:
                cur.children.append("<")
                at = lt + 1
            continue
        rest = _REST.match(page, m.end())
        if not rest:                     # the page ends inside a tag
            break
        at, tag = rest.end(), m.group(1).lower()
        if page[lt + 1] == "/":
            inline = tag not in BLOCK and tag not in ("td", "th")
            node = find({tag}, (SCOPE | BLOCK) - {tag} if inline else ({"table"} if tag != "table" else set()))
            if node is not None:
                close_to(node.parent)
            elif tag == "br":
                cur.children.append(" ")
            continue
        attrs = rest.group(0)[:-1]
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end if stop is None else stop.start()
            if stop is not None:
                close = page.find(">", at)
                at = end if close < 0 else close + 1
            continue
        if tag in ENDS_P:
            node = find({"p"}, SCOPE)
            if node is not None:
                close_to(node.parent)
        if tag in HEADINGS and cur.tag in HEADINGS:
            close_to(cur.parent)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            node = find(ends, stops)
            if node is not None:
                close_to(node.parent)
        node = Node(tag, cur, attrs)
        cur.children.append(node)
        if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
            cur = node
            counts[tag] = counts.get(tag, 0) + 1
    return root


def _attrs(node: Node) -> dict:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(node.attrs)}


def boilerplate(node: Node, in_article: bool) -> bool:
    if node.tag in JUNK_TAGS or (node.tag == "header" and not in_article):
        return True
    if not node.attrs or not _SAYS.search(node.attrs):
        return False
    attrs = _attrs(node)
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    return attrs.get("role", "").lower() in JUNK_ROLES


def mark(node: Node, in_article: bool) -> Mark | None:
    """The boilerplate words in class and id."""
    if not node.attrs or not _SAYS.search(node.attrs):
        return None
    attrs, words, whole = _attrs(node), set(), False
    for key in ("class", "id"):
        for name in attrs.get(key, "").split():
            parts = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()) if x]
            if {"with", "has", "no"} & set(parts):
                continue
            if junk := {re.sub(r"\d+$", "", x) for x in parts} & JUNK_WORDS:
                if node.tag in ("article", "main") and not {"comment", "comments", "reply"} & set(parts):
                    continue
                if {"header"} & set(parts) and in_article:
                    continue
                words |= junk
                whole |= len(parts) == 1 and not (in_article and junk <= WEAK)
    return Mark(node, words, whole, in_article and words <= WEAK) if words else None


def blocks(root: Node, marks: list[Mark] | None = None, cut=frozenset(), light=None) -> list[tuple[Node, str, int]]:
    """(element, text, characters of links in it) of each block outside boilerplate and ``cut``, in
    page order; the element is the nearest block element. Elements with junk names are added to
    ``marks``; those in ``light`` get LIGHT weight."""
    out: list[tuple[Node, str, int]] = []
    buf: list[tuple[str, bool]] = []
    light = light or {}
    seen = [0, 0]                        # characters so far, out of links and in them

    def flush(owner):
        if buf:
            text = " ".join("".join(s for s, _ in buf).split())
            if text:
                out.append((owner, text, sum(len("".join(s.split())) for s, k in buf if k)))
            buf.clear()

    todo: list[tuple] = [("in", root, root, False, False)]
    while todo:
        kind, node, owner, link, art = todo.pop()
        if kind == "text":
            buf.append((node, link))
            if marks is not None:
                seen[link] += len("".join(node.split()))
            continue
        if kind == "out":
            flush(node)
            continue
        if kind == "end":
            node.free, node.links, node.last = seen[0] - node.free, seen[1] - node.links, sum(seen)
            continue
        if node is not root and (node in cut or boilerplate(node, art)):
            if node.tag in BLOCK:
                flush(owner)
            continue
        if marks is not None and (m := mark(node, art)):
            m.free, m.links, m.first = *seen, sum(seen)
            marks.append(m)
            todo.append(("end", m, owner, link, art))
        if node.tag in ("br", "td", "th", "img"):
            buf.append((" ", False))
        is_block = node.tag in BLOCK
        if is_block:
            flush(owner)
            node.weight = owner.weight
            if node in light:
                node.weight *= LIGHT * LIGHT if light[node] & COMMENTS else LIGHT
            todo.append(("out", node, owner, link, art))
        link, art = link or node.tag == "a", art or node.tag in ("article", "main")
        inner = node if is_block else owner
        for child in reversed(node.children):
            todo.append(("text", child, inner, link, art) if isinstance(child, str)
                        else ("in", child, inner, link, art))
    return out


def free(found: list[tuple[Node, str, int]]) -> int:
    """Characters out of links."""
    return sum(len("".join(text.split())) - links for _, text, links in found)


def within(node: Node | None, tags: tuple) -> bool:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node is not None


def content(root: Node) -> tuple[list[tuple[Node, str, int]], dict[Node, set]]:
    """The blocks that the names leave, and the words of the elements of LIGHT weight."""
    marks: list[Mark] = []
    found = blocks(root, marks)
    if not marks:
        return found, {}
    every = free(found)
    left, light = _names(root, marks, every)
    rest = every - _outer(m for m in marks if m.whole and m.words & COMMENTS)
    if free(left) < min(FEW, LEFT * rest) and not any(
            node.tag not in HEADINGS and within(node, ("article", "main")) for node, _, _ in left):
        for m in marks:
            m.whole = m.whole and bool(m.words & COMMENTS)
        left, light = _names(root, marks, every)
    return (left, light) if left else (blocks(root), {})


def _outer(marks) -> int:
    """Characters out of links in the outermost of some marked elements (in page order)."""
    n, end = 0, -1
    for m in marks:
        if m.first >= end:
            n, end = n + m.free, m.last
    return n


def _names(root: Node, marks: list[Mark], every: int) -> tuple[list[tuple[Node, str, int]], dict[Node, set]]:
    cut = {m.node for m in marks if m.whole}
    total = every - _outer(m for m in marks if m.whole)
    part, end = [], -1
    for m in marks:                      # in page order; what lies in an element that goes does not count
        if m.whole:
            end = max(end, m.last)
        elif m.first >= end and m.free < MOST * total:
            part.append(m)
    # a word that marks much of the page in many small elements tells nothing on it
    words = set().union(*(m.words for m in part)) - COMMENTS
    plain = {w for w in words if _outer(m for m in part if w in m.words and m.free < HALF * total) > HALF * total}
    light = {}
    for m in part:
        if m.words <= plain or (m.weak and m.free >= PROSE and m.links < 0.3 * (m.free + m.links)):
            continue
        if m.free < SMALL * total:
            cut.add(m.node)
        else:
            light[m.node] = m.words
    return blocks(root, cut=cut, light=light), light


def extract(page: str | None) -> str:
    if not page:
        return ""
    found, light = content(parse(page.replace("\x00", "")))
    if not found:
        return ""
    seen: dict[int, Node] = {}
    for node, text, links in found:
        chars = sum(map(len, text.split()))
        density = min(1.0, links / chars)
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - density) * node.weight
        holder = node if node.tag not in ("p", "pre", "blockquote", "li", *HEADINGS) or node.parent is None else node.parent
        if node.tag in HEADINGS:
            points *= 0.25
        level, up = 0, holder
        while up is not None:
            seen.setdefault(id(up), up)
            if level < 12:
                up.score += points / (1, 2)[level] if level < 2 else points / (3 * level)
            up.chars += chars
            up.links += links
            level, up = level + 1, up.parent
        if holder is not node:
            node.chars, node.links = node.chars + chars, node.links + links
            seen.setdefault(id(node), node)
    rank = lambda n: n.score * (1 - min(1.0, n.links / max(1, n.chars)))
    best = max(seen.values(), key=rank)
    up = best
    while up is not None:                # the whole article, where the page marks one
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    keep = {id(best)}
    if best.parent is not None:
        for sib in best.parent.children:
            if isinstance(sib, Node) and id(sib) in seen and sib.chars and \
                    light.get(sib, set()) <= light.get(best, set()):
                density = sib.links / sib.chars
                if density < 0.3 or (rank(sib) >= 0.2 * rank(best) and density < 0.5):
                    keep.add(id(sib))
    out = []
    for node, text, _ in found:
        up = node
        while up is not None and id(up) not in keep:
            up = up.parent
        if up is not None:
            out.append(text)
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""

    def run(t: pa.Table) -> pa.Table:
        text = [extract(h) for h in t.column("html").to_pylist()]
        return pa.table({"page_id": t.column("page_id"), "url": t.column("url"),
                         "text": pa.array(text, pa.string()), "n_chars": pa.array(map(len, text), pa.int64())})

    return map_batches(pages.select("page_id", "url", "html"), run,
                       "page_id bigint, url string, text string, n_chars bigint")
