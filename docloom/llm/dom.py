"""A tolerant reader of HTML: the tree of block elements and runs of text, and features of its nodes."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter

import numpy as np

#: What a reader does not see as text of the page, wherever it stands: code (script, style, template), form controls, the head and its title, and what browsers show only in place of
#: scripts or media that they can not show (noscript, iframe, object, canvas, audio, video).
NEVER_TEXT = frozenset("script style noscript template title textarea select option button iframe object canvas audio video head datalist".split())
RAW = {tag: re.compile(rf"</{tag}\b", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw elements whose content is markup or plain text: where nothing closes them, that is read as the page's. Of code it is not.
NOT_CODE = {"title": re.compile("<"), "textarea": re.compile("<"), "noscript": re.compile(""), "template": re.compile(""), "iframe": re.compile(""), "xmp": re.compile("")}
#: Drawings and formulas: only their elements are closed by a slash at the end of the tag.
FOREIGN = ("svg", "math")
BLOCKS = frozenset(
    "html body article section main aside nav header footer div p ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend h1 h2 h3 h4 h5 h6 "
    "blockquote pre figure figcaption address details summary hgroup center dialog menu".split()
)
#: Elements that end when another of the group begins in the same parent.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table body html article section div".split())
#: Elements that a block which begins may end, or may not go beyond.
MARKS = SCOPE | {"p"}.union(*ENDS.values())
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: The end of a tag, or a quoted value within it.
END = re.compile(r"""=\s*(["'])|>""")
#: A tag that never ends: its name and values.
UNFINISHED = re.compile(r"""</?[^\s<]*(?:\s+[^\s=<]+=(?:"[^"<]*"?|'[^'<]*'?|[^\s<]*))*\s*""")
NAME_PART = re.compile(r"[a-z]+")
TAGS = [
    "#text", "p", "div", "li", "ul", "ol", "h1", "h2", "h3", "td", "tr", "table", "article", "section", "main", "aside", "nav", "header", "footer", "form", "blockquote", "pre", "figure", "body", "html",
]
#: Hashed columns of words in class, id and role of the node, and of the nodes above it.
HASHED = 48
LOCAL_FEATURES = 22


class Node:
    __slots__ = ("tag", "names", "parent", "children", "text", "raw", "hidden", "depth", "length", "link", "tags", "leaves", "words", "punctuation", "label")

    def __init__(self, tag: str, parent: Node | None, names: tuple[str, ...] = (), hidden: bool = False):
        self.tag, self.parent, self.names, self.hidden = tag, parent, names, hidden
        self.children: list[Node] = []
        self.raw: list[str] = []
        self.text = ""
        self.depth = parent.depth + 1 if parent else 0
        self.link = 0
        self.tags = 1
        self.label = parent.label if parent else ""
        if parent:
            parent.children.append(self)


class Tags:
    """Ends of the tags of a page. A quoted value may hold the sign that ends a tag; a quote that nothing closes is a sign like others."""

    def __init__(self, page: str):
        self.page, self.quoted = page, True
        self.last = page.rfind(">")
        self.last_quote = {q: page.rfind(q) for q in "\"'"}

    def end(self, start: int) -> int:
        """Where the tag that begins at ``start`` ends; -1 if it does not."""
        if start > self.last:
            return -1
        at = start
        while self.quoted and (m := END.search(self.page, at)):
            if m[0] == ">":
                return m.start()
            at = m.end()
            if self.last_quote[m[1]] >= at:
                at = self.page.index(m[1], at) + 1
        # quotes run to the end of the page: they are none from here on, so that no page is read over and over
        self.quoted = False
        return self.page.find(">", start)


def parse(page: str) -> Node:
    """The tree. Inline elements leave only their text in it; scripts, styles, form controls, comments, hidden elements and what stands in for media
    nothing. A slash at the end of a tag means nothing, but in drawings and formulas. A title, or another raw element that is no code, that nothing closes ends at the next
    tag, or at once. Of a tag that never ends, its name and values are left out and the rest is text. The time is linear in the page, whatever is left open."""
    root = Node("html", None)
    node = root
    run: Node | None = None
    stack: list[tuple[str, Node | None]] = []  # open elements; the node of a block, or none
    marks: list[int] = []  # places in it of what a block that begins may end
    open_: Counter[str] = Counter()
    links = skipped = 0
    at, n = 0, len(page)
    tags = Tags(page)

    def text(part: str) -> None:
        nonlocal run
        if skipped or not part:
            return
        if run is None:
            if part.isspace():
                return
            run = Node("#text", node)
        run.raw.append(part)
        if links:
            run.link += len(part)

    closings: dict[str, int] = {}

    def last_close(tag: str) -> int:
        """Where a raw element is closed last: none that begins later is searched for its end."""
        if tag not in closings:
            closings[tag] = max((m.start() for m in RAW[tag].finditer(page)), default=-1)
        return closings[tag]

    def close(depth: int) -> None:
        nonlocal node, run, links, skipped
        while len(stack) > depth:
            tag, block = stack.pop()
            open_[tag] -= 1
            if marks and marks[-1] == len(stack):
                marks.pop()
            if block is not None:
                node, run = block.parent or root, None
            if tag == "a":
                links -= 1
            if tag in NEVER_TEXT or (block is not None and block.hidden):
                skipped -= 1

    while at < n:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        text(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        follows = page[start + 1 : start + 2]
        if not (follows.isalpha() or follows in ("/", "!", "?") and follows):
            text("<")
            at = start + 1
            continue
        end = tags.end(start) if follows not in "!?" else page.find(">", start) if start <= tags.last else -1
        if end < 0:
            at = UNFINISHED.match(page, start).end()
            continue
        inner, at = page[start + 1 : end], end + 1
        if follows in "!?":
            continue
        if follows == "/":
            tag = inner[1:].strip().lower()
            if open_[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))  # all that is passed over is closed
            continue
        found = re.match(r"[^\s/]+", inner)
        tag = found[0].lower()
        if tag in VOID:
            if tag in ("br", "hr", "img", "input"):
                text(" ")
            continue
        names, hidden, label = (), False, ""
        if len(inner) > len(tag) + 1 and tag != "a":
            parts = []
            for name, a, b, c in ATTRIBUTE.findall(inner[len(found[0]) :]):
                name, value = name.lower(), (a or b or c).lower()
                if name in ("class", "id", "role"):
                    parts += NAME_PART.findall(value)
                elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
                    hidden = True
                elif name == "data-truth":
                    label = value
            names = tuple(parts)
        if tag in BLOCKS:
            for i in reversed(marks):
                if stack[i][0] == "p" or stack[i][0] in ENDS.get(tag, ()):
                    close(i)
                    break
                if stack[i][0] in SCOPE:
                    break
            block = Node(tag, node, names, hidden)
            block.label = label or block.label
            node, run = block, None
            if tag in MARKS:
                marks.append(len(stack))
            stack.append((tag, block))
            open_[tag] += 1
            skipped += hidden
        else:
            if inner.endswith("/") and (tag in FOREIGN or any(open_[f] for f in FOREIGN)):
                continue
            stack.append((tag, None))
            open_[tag] += 1
            links += tag == "a"
            node.tags += 1
        if tag in NEVER_TEXT:
            skipped += 1
            if tag in RAW:
                closing = RAW[tag].search(page, at) if at <= last_close(tag) else None
                if closing is None and tag in NOT_CODE:  # up to the next tag, or not at all
                    found = NOT_CODE[tag].search(page, at)
                    at = found.start() if found else n
                    close(len(stack) - 1)
                else:
                    at = closing.start() if closing else n
    return root


def order(root: Node) -> list[Node]:
    """All nodes with text below them, parents before children, in page order; texts cleaned and totals filled in."""
    nodes, stack = [], [root]
    while stack:
        v = stack.pop()
        nodes.append(v)
        stack.extend(reversed(v.children))
    for v in reversed(nodes):
        if v.tag == "#text":
            raw = "".join(v.raw)
            v.text = " ".join(entities.unescape(raw).split() if "&" in raw else raw.split())
            v.length, v.leaves = len(v.text), int(bool(v.text))
            v.words, v.punctuation = v.text.count(" ") + v.leaves, v.text.count(".") + v.text.count(",")
        else:
            v.children = [c for c in v.children if c.leaves]
            v.length, v.leaves, v.words, v.punctuation = (sum(getattr(c, k) for c in v.children) for k in ("length", "leaves", "words", "punctuation"))
            v.link, v.tags = sum(c.link for c in v.children), v.tags + sum(c.tags for c in v.children)
    return [v for v in nodes if v.leaves]


_columns: dict[str, int] = {}


def column(name: str) -> int:
    if name not in _columns:
        if len(_columns) > 50_000:
            _columns.clear()
        _columns[name] = zlib.crc32(name.encode()) % HASHED
    return _columns[name]


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node of one page (as ``order`` gives them)."""
    whole = max(1, nodes[0].length) if nodes else 1
    out = np.zeros((len(nodes), LOCAL_FEATURES + 2 * len(TAGS) + 2 * HASHED), np.float32)
    index = {id(v): i for i, v in enumerate(nodes)}
    before = 0
    near: dict[int, tuple[int, int, int, int]] = {}
    for v in nodes:
        for k, c in enumerate(v.children):
            near[id(c)] = (k, len(v.children), v.children[k - 1].length if k else 0, v.children[k + 1].length if k + 1 < len(v.children) else 0)
    for i, v in enumerate(nodes):
        p = v.parent
        k, among, left, right = near.get(id(v), (0, 1, 0, 0))
        row = out[i]
        row[:LOCAL_FEATURES] = (
            v.length, v.words, v.length / v.tags, v.link / max(1, v.length), v.punctuation / max(1, v.words), v.leaves, v.length / v.leaves, v.tags, v.depth, k, among, k / among, left, right,
            v.length / whole, before / whole, p.length if p else 0, p.link / max(1, p.length) if p else 0, p.length / max(1, p.leaves) if p else 0, len(v.children), v.length / max(1, p.length if p else v.length), len(v.names),
        )
        if v.tag == "#text":
            before += v.length
        at = LOCAL_FEATURES
        if v.tag in TAGS:
            row[at + TAGS.index(v.tag)] = 1
        if p and p.tag in TAGS:
            row[at + len(TAGS) + TAGS.index(p.tag)] = 1
        at += 2 * len(TAGS)
        for name in v.names:
            row[at + column(name)] = 1
        if p:  # names and tags above, as the parent has gathered them
            j = index[id(p)]
            above = at + HASHED
            np.maximum(out[j, at:above], out[j, above:], out=row[above:])
            row[above + column("<" + p.tag)] = 1
    return out
