"""A forgiving reader of HTML: block elements as a tree, text runs as leaves, and features of every node."""

from __future__ import annotations

import html
import re
from collections import Counter

INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter
nobr picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Never text of a page: code, metadata, controls.
SKIPPED = frozenset("""script style noscript template iframe svg math object canvas audio video head title textarea
select button""".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul""".split())
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
                "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
                "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr"}, {"table"})}
SCOPE = frozenset("td th caption table article section aside nav footer header main body html".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-label)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# Groups of attribute tokens, each one feature.
GROUPS = {
    "content": "article content post entry main body story text page blog news read hentry",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs topbar tabs pager pagination skip toc links",
    "head": "header masthead banner logo brand top hero toolbar",
    "foot": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside widget related recommended rail popular trending more secondary sidenav",
    "ads": "ad ads advert adverts advertisement sponsor sponsored promo promoted promotion adsbygoogle dfp affiliate",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner privacy warning message newsletter",
    "comment": "comment comments commentlist respond reply replies disqus discussion reader thread",
    "form": "form search login signup subscribe subscription contact input register",
    "social": "share sharing social tweet facebook follow like meta tags byline",
}
GROUP_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(GROUPS.values()):
    for _w in _words.split():
        GROUP_OF.setdefault(_w, []).append(_i)
TAGS = """p div article section main td li ul ol h1 h2 h3 nav footer header aside form table blockquote pre figure
figcaption dd #text""".split()
ABOVE = "article main nav footer header aside form ul table section li".split()
PLAIN = 26                          # number of plain features below
WIDTH = PLAIN + len(TAGS) + len(ABOVE) + 2 * len(GROUPS)


class Node:
    __slots__ = ("tag", "parent", "items", "groups", "hidden", "depth", "text", "chars", "linked", "marks", "nodes",
                 "anchors", "paragraphs", "leaves", "place", "label", "kids")

    def __init__(self, tag, parent, groups=(), hidden=False):
        self.tag, self.parent, self.groups, self.hidden = tag, parent, groups, hidden
        self.depth = parent.depth + 1 if parent else 0
        self.items: list = []
        self.label = None


def attributes(text: str) -> tuple[tuple[int, ...], bool]:
    """Groups named by class, id, role and label; and whether the element is hidden."""
    groups, hidden = set(), False
    for name, value in ATTRIBUTE.findall(text):
        name = name.lower()
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= "none" in value.lower() and "display" in value.lower()
        else:
            for part in PART.findall(value):
                groups.update(GROUP_OF.get(part.lower(), ()))
    return tuple(sorted(groups)), hidden


def parse(page: str) -> Node:
    """Tree of block elements; items are child nodes and (text, linked characters, links) runs in page order."""
    root = Node("html", None)
    top = root
    link = False
    skipped = 0
    skip_tag = ""
    at = 0

    def add(raw: str) -> None:
        if raw:
            items = top.items
            if items and isinstance(items[-1], list):
                items[-1].append((raw, link))
            elif not raw.isspace():
                items.append([(raw, link)])

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            if not skipped:
                add(html.unescape(page[at:]))
            break
        if m.start() > at and not skipped:
            add(html.unescape(page[at:m.start()]))
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            if m.group().startswith("<![CDATA[") and not skipped:
                add(m.group()[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        closing = bool(m.group(1) or m.group(4))
        if skipped:
            if name == skip_tag:
                skipped += -1 if closing else 1
            elif skip_tag == "head" and name in ("body", "article", "main", "div", "p") and not closing:
                skipped = 0                     # an unclosed head ends where the body begins
            if skipped:
                if name in RAW and not closing and name != skip_tag:
                    end = re.compile("</" + name, re.I).search(page, at)
                    at = end.start() if end else size
                continue
            if closing:
                continue
        attrs = m.group(3) or m.group(6) or ""
        if not closing and name in SKIPPED and not attrs.endswith("/"):
            if name in RAW:
                end = re.compile("</" + name + r"[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            else:
                skipped, skip_tag = 1, name
            if name not in ("button", "svg", "math"):
                link = False
            continue
        if name in INLINE:
            if name == "a":
                link = not closing
                if not closing and top.items and isinstance(top.items[-1], list):
                    top.items[-1].append(("", True))
            elif name in ("br", "wbr") and top.items and isinstance(top.items[-1], list):
                top.items[-1].append((" " if name == "br" else "", False))
            continue
        if closing:
            node = top
            while node is not None and node.tag != name:
                node = node.parent
            if node is not None and node.parent is not None:
                top, link = node.parent, False
            continue
        if name in ("html", "body"):
            continue
        link = False
        if name in CLOSES_P:
            node = top
            while node is not None and node.tag != "p" and node.tag not in SCOPE:
                node = node.parent
            if node is not None and node.tag == "p":
                top = node.parent
        if name in SELF_CLOSING:
            ends, scope = SELF_CLOSING[name]
            node, close = top, None
            while node is not None and node.tag not in scope:
                if node.tag in ends:
                    close = node
                node = node.parent
            if close is not None and close.parent is not None:
                top = close.parent
        if name in VOID:
            continue
        groups, hidden = attributes(attrs) if attrs else ((), False)
        node = Node(name, top, groups, hidden)
        top.items.append(node)
        if not attrs.endswith("/"):
            top = node
    return root


def finish(root: Node) -> list[Node]:
    """Text runs become leaves (or the text of a node without children); counts of every subtree; page order."""
    order: list[Node] = []
    stack = [root]
    while stack:                                # parents before children, children in page order
        node = stack.pop()
        order.append(node)
        if node.tag == "#text":
            continue
        kids = [i for i in node.items if isinstance(i, Node)]
        runs = [i for i in node.items if not isinstance(i, Node)]
        if kids:
            node.text, node.kids = None, []
            for item in node.items:
                if isinstance(item, Node):
                    node.kids.append(item)
                else:
                    leaf = Node("#text", node)
                    leaf.kids, leaf.items = [], []
                    _set_text(leaf, item)
                    if leaf.text:
                        node.kids.append(leaf)
            stack.extend(reversed(node.kids))
        else:
            node.kids = []
            _set_text(node, [p for r in runs for p in r])
    before = 0
    for node in order:
        node.place = before
        if node.text:
            before += len(node.text)
    for node in reversed(order):
        own = len(node.text) if node.text else 0
        if not node.kids:
            node.chars, node.nodes, node.leaves = own, 1, int(own > 0)
            node.paragraphs = int(node.tag in ("p", "#text") and own > 80)
        else:
            node.chars = sum(k.chars for k in node.kids)
            node.linked = sum(k.linked for k in node.kids)
            node.marks = sum(k.marks for k in node.kids)
            node.anchors = sum(k.anchors for k in node.kids)
            node.nodes = 1 + sum(k.nodes for k in node.kids)
            node.leaves = sum(k.leaves for k in node.kids)
            node.paragraphs = sum(k.paragraphs for k in node.kids)
    return order


def _set_text(node: Node, parts: list) -> None:
    node.text = " ".join("".join(p for p, _ in parts).split())
    node.linked = sum(len(p.strip()) for p, linked in parts if linked)
    node.anchors = sum(1 for p, linked in parts if linked and not p)
    node.marks = sum(node.text.count(c) for c in ".,;!?")


def features(order: list[Node]) -> list[list[float]]:
    """One row of WIDTH numbers for each node of a finished tree, parents first."""
    total = max(1, order[0].chars)
    rows = []
    above: dict[int, tuple] = {}
    places: dict[int, int] = {}
    tags: dict[int, Counter] = {}
    for node in order:
        up = node.parent
        flags, marked = above.get(id(up), ((0,) * len(ABOVE), (0,) * len(GROUPS)))
        kids = up.kids if up else [node]
        place = places.get(id(node), 0)
        left = kids[place - 1].chars if place else 0
        right = kids[place + 1].chars if place + 1 < len(kids) else 0
        alike = tags[id(up)][node.tag] if up else 1
        siblings = up.chars - node.chars if up else 0
        peers = up.paragraphs if up else 0
        chars = node.chars
        row = [node.depth, chars, node.nodes, node.leaves, node.anchors, node.paragraphs, node.marks,
               chars / node.nodes, chars / max(1, node.leaves), node.linked / max(1, chars),
               node.marks / max(1, chars) * 100, node.anchors / node.nodes, chars / total, node.place / total,
               (node.place + chars) / total, len(kids), place, alike, left, right, siblings / max(1, len(kids) - 1),
               up.linked / max(1, up.chars) if up else 0.0, peers, up.chars / total if up else 1.0,
               up.nodes if up else 0, float(node.hidden)]
        row += [float(node.tag == t) for t in TAGS]
        row += flags
        row += [float(g in node.groups) for g in range(len(GROUPS))]
        row += marked
        rows.append(row)
        if node.kids:
            places.update((id(k), i) for i, k in enumerate(node.kids))
            tags[id(node)] = Counter(k.tag for k in node.kids)
            above[id(node)] = (tuple(int(f or node.tag == t) for f, t in zip(flags, ABOVE)),
                               tuple(int(f or g in node.groups) for g, f in enumerate(marked)))
    return rows


def kept_text(order: list[Node], log_yes: list[float], log_no: list[float]) -> str:
    """Best labelling in which nothing below a dropped node is kept; the text of the kept leaves.

    Bottom-up, each node knows the best sum of log-probabilities with itself dropped (then all below is
    dropped) and kept (then each child takes its better choice); top-down the choices are read off.
    """
    index = {id(n): i for i, n in enumerate(order)}
    keep, drop = list(log_yes), list(log_no)
    for i in range(len(order) - 1, -1, -1):
        for k in order[i].kids:
            j = index[id(k)]
            drop[i] += drop[j]
            keep[i] += max(keep[j], drop[j])
    out, chosen = [], [False] * len(order)
    for i, node in enumerate(order):
        chosen[i] = i == 0 or (chosen[index[id(node.parent)]] and keep[i] > drop[i])
        if chosen[i] and node.text:
            out.append(node.text)
    return " ".join(out)
