"""A small labelled set of web pages: the table that the main-text tree is grown from, drawn by rule from a seed.

A page is a run of parts in a usual order: site header, menu, notices, article, related links, comments, sidebar, footer. Each block says
whether it is article text. Parts around the article have a telling tag or name in some pages only; in the others they can be told from
the article by their own and their neighbours' words and links alone.
"""

from __future__ import annotations

import numpy as np

#: Class names that pages give to the parts around an article
NAMES = {
    "header": ("site-header", "masthead", "topbar"), "menu": ("nav", "menu", "navbar"), "notice": ("cookie-banner", "notice", "gdpr"), "ad": ("ad", "advert", "promo"), "share": ("share", "social", "toolbar"),
    "related": ("related", "teaser", "promo-list"), "comments": ("comments", "replies", "comment-list"), "sidebar": ("sidebar", "widget", "menu-side"), "footer": ("footer", "copyright", "foot"),
}
TAGS = {"header": "header", "menu": "nav", "sidebar": "aside", "footer": "footer"}
#: Every syllable with every other, so that words have two to six letters
VOCABULARY = [a + b for a in ("a", "be", "di", "gol", "mur") for b in ("n", "to", "ris", "lem")]
PAGES = 240
NAMED = 0.65  # share of the parts around an article that have a telling tag or name


class Page:
    """Markup and labelled blocks of one page."""

    def __init__(self, rng: np.random.Generator, named: float = NAMED):
        self.rng, self.named = rng, named
        self.html: list[str] = []
        self.blocks: list[tuple[str, int]] = []  # text, 1 if of the article

    def words(self, low: int, high: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high + 1))))
        return " ".join(VOCABULARY[k] for k in self.rng.integers(0, len(VOCABULARY), max(low, min(n, high))))

    def block(self, label: int, tag: str, text: str, link: str = "", after: str = "") -> None:
        """One block: text, then linked text, then more text."""
        shown = " ".join(x for x in (text, link, after) if x)
        self.html.append(f"<{tag}>{text} {f'<a href="/x">{link}</a>' if link else ''} {after}</{tag}>")
        self.blocks.append((shown, label))

    def part(self, kind: str, fill) -> None:
        """What ``fill`` writes, in an element with or without a telling tag or name."""
        told = self.rng.random() < self.named
        tag = TAGS.get(kind, "div") if told and self.rng.random() < 0.6 else "div"
        name = f' class="{self.rng.choice(NAMES[kind])}"' if told and (tag == "div" or self.rng.random() < 0.5) else ' class="box"'
        self.html.append(f"<{tag}{name}>")
        fill()
        self.html.append(f"</{tag}>")

    def links(self, low: int, high: int, most_words: int) -> None:
        for _ in range(self.rng.integers(low, high + 1)):
            self.block(0, "li", "", self.words(1, most_words))

    def maybe(self, p: float, kind: str, fill) -> None:
        if self.rng.random() < p:
            self.part(kind, fill)

    def article(self) -> None:
        rng = self.rng
        tag = str(rng.choice(["article", "main", "div"], p=[0.5, 0.2, 0.3]))
        self.html.append(f"<{tag}>")
        if rng.random() < 0.9:
            self.block(1, "h1", self.words(1, 16))
        self.maybe(0.25, "share", lambda: self.links(2, 5, 2))
        for _ in range(1 + rng.geometric(0.16)):
            kind = rng.random()
            if kind < 0.1:
                self.block(1, "h2", self.words(1, 9))
            elif kind < 0.2:
                for _ in range(rng.integers(2, 6)):
                    self.block(1, "li", self.words(1, 25))
            elif kind < 0.4:
                self.block(1, "p", self.words(8, 60), self.words(1, 6), self.words(3, 50))
            elif kind < 0.5:
                self.block(1, "p", self.words(1, 8))
            elif kind < 0.54 and tag != "div":
                self.block(1, "p", self.words(1, 5), self.words(2, 10))
            else:
                self.block(1, "p", self.words(12, 160))
            if rng.random() < 0.04:  # an advert in the text always has its name: nothing else tells it
                self.html.append(f'<div class="{rng.choice(NAMES["ad"])}">')
                self.block(0, "p", self.words(3, 30))
                self.html.append("</div>")
        self.maybe(0.2, "related", lambda: self.links(2, 5, 9))
        self.html.append(f"</{tag}>")

    def comments(self) -> None:
        self.block(0, "h3", self.words(1, 3))
        for _ in range(self.rng.integers(1, 6)):
            self.block(0, "div", "", self.words(1, 2), self.words(1, 3))
            self.block(0, "p", self.words(3, 70))
            self.block(0, "div", "", self.words(1, 1))

    def sidebar(self) -> None:
        for _ in range(self.rng.integers(1, 4)):
            self.block(0, "h3", self.words(1, 3))
            self.links(2, 6, 8)
            if self.rng.random() < 0.4:
                self.block(0, "p", self.words(4, 14), self.words(1, 3))

    def footer(self) -> None:
        if self.rng.random() < 0.5:
            self.links(2, 6, 2)
        self.block(0, "div", self.words(2, 20))

    def drawn(self) -> Page:
        self.maybe(0.4, "header", lambda: self.block(0, "div", "", self.words(1, 3)))
        self.maybe(0.85, "menu", lambda: self.links(2, 10, 3))
        self.maybe(0.3, "notice", lambda: (self.block(0, "p", self.words(6, 30)), self.block(0, "span", "", self.words(1, 2))))
        self.maybe(0.25, "sidebar", self.sidebar)
        if self.rng.random() < 0.4:
            self.html.append(f'<div class="{self.rng.choice(NAMES["ad"])}">')
            self.block(0, "p", self.words(2, 25))
            self.html.append("</div>")
        self.article()
        self.maybe(0.3, "related", lambda: (self.block(0, "h3", self.words(1, 3)), self.links(2, 6, 10)))
        self.maybe(0.4, "comments", self.comments)
        self.maybe(0.25, "sidebar", self.sidebar)
        self.maybe(0.8, "footer", self.footer)
        return self


def labelled_pages(pages: int = PAGES, seed: int = 1, named: float = NAMED) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(text, 1 if of the article)]) of each page."""
    rng = np.random.default_rng(seed)
    made = [Page(rng, named).drawn() for _ in range(pages)]
    return [(f"<!DOCTYPE html><html><head><title>t</title></head><body>{''.join(p.html)}</body></html>", p.blocks) for p in made]
