"""Main text of web pages: boosted trees over DOM nodes, decoded so that the choices fit the hierarchy.

A node is kept if some article text is in its subtree. The model is trained here on labelled pages that a
generator lays out in many ways (semantic tags or plain ``div``s, tables, unclosed paragraphs; menus, headers,
sidebars, notices, adverts, forms, comments, footers, with and without telling attributes). Their number is a
parameter, so the model and the broadcast have a fixed size.

Cases: NULL and empty pages, and pages without article text, give an empty text; broken and unfinished markup
is read as far as it goes; repeated rows get equal answers; a page of any length is read whole; other columns
are not read. Character references are decoded once. White space inside a block, including no-break spaces,
becomes one space.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame

from attestra.llm import boosting, dom
from attestra.llm.common import per_text

SYLLABLES = ("the and ing ther on er ti en re sh nt de la que ou eau ch ver zu sch lich ei los os ci ra ña mi co "
             "be ha st or es a in of tion").split()


class PageMaker:
    """Random labelled pages. Text made for the article carries a mark, so that labels follow from parsing."""

    MARK = ""                 # private-use character, removed again before features are computed

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        w = "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))
        return w + self.noise

    def prose(self, low: int, high: int, mark: bool = False) -> str:
        n = self.r.randint(low, high)
        out = []
        for i in range(n):
            w = self.word()
            if i == 0 or out[-1].endswith("."):
                w = w.capitalize()
            out.append(w + ("." if i == n - 1 or self.r.random() < 0.08 else "," if self.r.random() < 0.06 else ""))
        text = " ".join(out)
        return (self.MARK if mark else "") + text

    def attr(self, words: str, always: bool = False) -> str:
        if not always and self.r.random() < (0.65 if self.bare else 0.12):
            return ""
        token = self.r.choice(words.split())
        extra = self.r.choice(["", "", "-box", "-inner", "_1", "Wrap", " col-3", " clearfix"])
        return f' {self.r.choice(["class", "class", "id"])}="{token}{extra}"'

    def links(self, n: int) -> list[str]:
        return [f'<a href="/{i}">{self.prose(1, 3)[:-1]}</a>' for i in range(n)]

    def menu(self) -> str:
        items = self.links(self.r.randint(2, 9))
        listed = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        kind = self.r.randrange(4)
        if kind < 2:
            return f"<nav{self.attr('nav menu navbar main-nav')}>{listed}</nav>"
        if kind == 2:
            return f"<div{self.attr('nav menu navigation topbar breadcrumb', True)}>{self.r.choice([listed, ' | '.join(items)])}</div>"
        return f"<ul{self.attr('nav menu links tabs')}>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"

    def head(self) -> str:
        inside = self.prose(1, 6) + self.r.choice(["", self.menu(), f"<p>{self.prose(2, 12)}</p>", self.form()])
        return self.r.choice([f"<header>{inside}</header>",
                              f"<div{self.attr('header masthead topbar hero', True)}>{inside}</div>"])

    def foot(self) -> str:
        inside = self.r.choice(["&copy; ", "Copyright 2020 "]) + self.prose(1, 12) + self.r.choice(["", " &middot; "]) \
            + " ".join(self.links(self.r.randint(0, 4))) + self.r.choice(["", f"<p>{self.prose(3, 30)}</p>"])
        return self.r.choice([f"<footer>{inside}</footer>", f"<footer{self.attr('footer bottom')}>{inside}</footer>",
                              f"<div{self.attr('footer copyright legal bottom', True)}>{inside}</div>"])

    def advert(self) -> str:
        words = "ad ads advert advertisement sponsored promo promoted ad-slot"
        inside = self.r.choice([self.prose(2, 30), f"<p>{self.prose(5, 40)}</p>", " ".join(self.links(2))])
        return f"<{(t := self.r.choice(['div', 'div', 'aside', 'section']))}{self.attr(words, True)}>{inside}</{t}>"

    def notice(self) -> str:
        words = "cookie cookie-notice consent gdpr notice alert banner popup modal newsletter"
        inside = self.r.choice([self.prose(5, 35), f"<p>{self.prose(5, 35)}</p>"]) + self.r.choice(
            ["", "<button>OK</button>", *self.links(1)])
        return f"<{(t := self.r.choice(['div', 'div', 'section', 'aside']))}{self.attr(words, True)}>{inside}</{t}>"

    def form(self) -> str:
        return (f"<form{self.attr('search login subscribe contact signup')}><label>{self.prose(1, 5)}</label><input name=q>"
                + self.r.choice(["", f"<p>{self.prose(3, 20)}</p>", "<select><option>a<option>b</select>"])
                + "<button>Go</button></form>")

    def side(self) -> str:
        parts = [self.r.choice([f"<h3>{self.prose(1, 4)}</h3>", ""]) + self.r.choice(
            ["<ul>" + "".join(f"<li>{i}</li>" for i in self.links(self.r.randint(2, 7))) + "</ul>",
             f"<p>{self.prose(5, 30)}</p>", self.form(), f"<div>{self.prose(3, 25)}</div>"])
            for _ in range(self.r.randint(1, 3))]
        tag = self.r.choice(["aside", "aside", "div"])
        return f"<{tag}{self.attr('sidebar side widget related popular secondary', tag == 'div')}>{''.join(parts)}</{tag}>"

    def comments(self) -> str:
        tag = self.r.choice(["div", "li", "article", "p"])
        each = []
        for _ in range(self.r.randint(1, 6)):
            body = self.r.choice([self.prose(3, 60), f"<p>{self.prose(3, 60)}</p>"]) if tag != "p" else self.prose(3, 60)
            each.append(f"<{tag}{self.attr('comment reply comment-body')}>{self.r.choice(['', '<b>' + self.word() + '</b> '])}{body}</{tag}>")
        outer = self.r.choice(["div", "section"]) if tag != "li" else "ol"
        title = "" if outer == "ol" else self.r.choice(["", f"<h2>{self.prose(1, 3)}</h2>", f"<h3>{self.prose(1, 2)}</h3>"])
        return f"<{outer}{self.attr('comments commentlist respond discussion replies', True)}>{title}{''.join(each)}</{outer}>"

    def social(self) -> str:
        return f"<div{self.attr('share social sharing tags', True)}>{' '.join(self.links(self.r.randint(2, 5)))}</div>"

    def paragraph(self) -> str:
        kind = self.r.random()
        short = self.r.random() < 0.3
        text = self.prose(1, 8, True) if short else self.prose(10, 120, True)
        if kind < 0.1:
            return f"<p><b>{text}<br><p>{self.prose(5, 60, True)}</p>"
        if kind < 0.2:
            return f"<p>{text} {self.links(1)[0]} {self.prose(1, 20)}</p>"
        if kind < 0.26:
            return f"<p>{text}"
        if kind < 0.32:
            return "<ul>" + "".join(f"<li>{self.prose(2, 25, True)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if kind < 0.37:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.42:
            return f"<h2>{self.prose(1, 7, True)}</h2><p>{text}</p>"
        if kind < 0.45:
            return "<table>" + "".join(f"<tr><td>{self.prose(1, 4, True)}</td><td>{self.prose(1, 6, True)}</td></tr>"
                                       for _ in range(self.r.randint(2, 4))) + "</table>"
        if kind < 0.48:
            return f"<figure><img src=a.png><figcaption>{self.prose(3, 15, True)}</figcaption></figure>"
        if kind < 0.51:
            return f"<pre>{self.prose(3, 20, True)}</pre>"
        if kind < 0.54:
            return f"<div>{text}</div>"
        return f"<p>{text}</p>"

    def article(self) -> str:
        n = self.r.choice([1, 1, 2, 3, 5, 8, 13, 20, 40])
        body = [self.paragraph() for _ in range(n)]
        if self.r.random() < 0.15:              # repeated and very short blocks are article text as well
            again = [f"<p>{self.prose(1, 6, True)}</p>" for _ in range(2)]
            body += [self.r.choice(again) for _ in range(self.r.randint(3, 40))]
        title = f"<h1>{self.prose(1, 10, True)}</h1>" if self.r.random() < 0.85 else ""
        if title and self.r.random() < 0.15:
            title = f"<header>{title}</header>"
        for extra, p in ((self.advert, 0.25), (self.social, 0.15), (self.notice, 0.06), (self.form, 0.06)):
            if self.r.random() < p:
                body.insert(self.r.randint(0, len(body)), extra())
        text = title + "".join(body)
        if self.r.random() < 0.12:
            text = text + self.comments()
        kind = self.r.random()
        if kind < 0.4:
            out = f"<article{self.attr('post entry article')}>{text}</article>"
        elif kind < 0.55:
            out = f"<main{self.attr('main content')}>{text}</main>"
        elif kind < 0.6:
            out = f"<table><tr><td>{self.menu()}</td><td>{text}</td></tr></table>"
        elif kind < 0.65:
            out = text
        else:
            out = f"<div{self.attr('content post-content entry article-body story main page')}>{text}</div>"
        for _ in range(self.r.choice([0, 0, 1, 2])):
            out = f"<{(t := self.r.choice(['div', 'div', 'section', 'main']))}{self.attr('wrapper container main page content row')}>{out}</{t}>"
        return out

    def page(self) -> str:
        self.bare = self.r.random() < 0.3
        self.noise = self.r.choice(["", "", "", "", "***", "!!", "%%%", "&amp;"])
        def some(*makers):
            return "".join(m() for m, p in makers if self.r.random() < p)
        before = some((self.notice, 0.2), (self.head, 0.4), (self.menu, 0.7), (self.advert, 0.4), (self.form, 0.1),
                      (self.side, 0.15))
        after = some((self.social, 0.15), (self.comments, 0.35), (self.side, 0.3), (self.advert, 0.25),
                     (self.form, 0.15), (self.notice, 0.12), (self.menu, 0.1), (self.foot, 0.8))
        article = self.article() if self.r.random() > 0.02 else ""
        if self.r.random() < 0.12:              # a page that is little more than its article
            before, after = self.r.choice([("", ""), (before, ""), ("", after)])
        if self.r.random() < 0.05:
            article = f"<form>{article}</form>"
        inside = before + article + after
        if self.r.random() < 0.25:
            inside = f"<div{self.attr('wrapper page container site')}>{inside}</div>"
        return (f"<!DOCTYPE html><html><head><title>{self.prose(1, 8)}</title><style>p{{}}</style></head><body>{inside}"
                + self.r.choice(["</body></html>", ""]))


def labelled_nodes(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all nodes of generated pages."""
    maker, x, y = PageMaker(seed), [], []
    for _ in range(pages):
        order = dom.finish(dom.parse(maker.page()))
        for node in order:
            node.label = bool(node.text) and maker.MARK in node.text
            if node.text:
                node.text = node.text.replace(maker.MARK, "")
        for node in reversed(order):
            if node.kids:
                node.label = any(k.label for k in node.kids)
        x += dom.features(order)
        y += [n.label for n in order]
    return np.array(x, dtype=np.float32), np.array(y, dtype=float)


def train(pages: int = 700, seed: int = 5, trees: int = 50, depth: int = 5) -> boosting.Trees:
    x, y = labelled_nodes(pages, seed)
    return boosting.fit(x, y, trees=trees, depth=depth)


def extract(pages: list[str | None], model: boosting.Trees) -> list[str]:
    """Main texts of some pages, scored in one go."""
    orders = [dom.finish(dom.parse(p)) if p else [] for p in pages]
    x = [row for order in orders if order for row in dom.features(order)]
    if not x:
        return [""] * len(pages)
    p = np.clip(boosting.predict(model, np.array(x, dtype=np.float32)), 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    out, at = [], 0
    for order in orders:
        out.append(dom.kept_text(order, yes[at:at + len(order)], no[at:at + len(order)]) if order else "")
        at += len(order)
    return out


def main_text(pages: DataFrame, html: str = "html", carry: list[str] | None = None,
              model: boosting.Trees | None = None) -> DataFrame:
    """Every page row (carried columns as struct ``doc``) with its main ``text``."""
    shared = pages.sparkSession.sparkContext.broadcast(tuple(model or train()))

    def answer(texts):
        out, trees = [], boosting.Trees(*shared.value)
        for i in range(0, len(texts), 64):
            out += extract(texts[i:i + 64], trees)
        return [(t,) for t in out]

    return per_text(pages, html, carry or ["page_id", "url"], answer, "text string")
