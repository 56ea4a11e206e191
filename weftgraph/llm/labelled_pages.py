"""Labelled pages to train the extractor on: page layouts with a label for each leaf block.

Pages are composed at random (with a seed) from the usual parts of web pages, in semantic tags or in
``div`` elements with the usual class names, well formed or with end tags left out.  The words are
meaningless, so that only structure and shape can be learned.
"""

from __future__ import annotations

import random

#: Class names in common use for each part of a page.
NAMES = {
    "header": ["header", "site-header", "masthead", "top-bar", "branding", "page-header"],
    "nav": ["nav", "navbar", "menu", "main-menu", "navigation", "breadcrumbs", "breadcrumb", "toc-links", "pagination", "tabs"],
    "notice": ["notice", "cookie-notice", "cookie-banner", "alert", "consent", "gdpr", "paywall", "newsletter", "subscribe", "warning-bar", "modal", "popup"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "adsbox", "sponsor"],
    "aside": ["sidebar", "side", "widget", "related", "right-rail", "related-posts", "recommended", "trending", "more-stories"],
    "social": ["share", "social", "share-buttons", "tags", "author-box"],
    "comments": ["comments", "comment-list", "responses", "discussion", "disqus_thread", "reader-comments", "replies", "comment-section"],
    "footer": ["footer", "site-footer", "bottom", "colophon", "copyright", "legal"],
    "article": ["content", "article", "post", "entry", "entry-content", "article-body", "story", "main-content", "post-content", "body-text", "article-text"],
    "plain": ["wrap", "container", "row", "col", "inner", "page", "layout", "box", "x1", "grid"],
}

Block = tuple[str, int]  # white space-normalised text and 1 for the article's text


class Page:
    def __init__(self, seed: int):
        self.r, self.html, self.blocks = random.Random(seed), [], []
        self.tidy = self.r.random() < 0.7

    def word(self) -> str:
        return "".join(self.r.choice(["ka", "lo", "mi", "ten", "ru", "vas", "el", "or", "sti", "é", "ün"]) for _ in range(self.r.randint(1, 4)))

    def sentence(self, least: int, most: int) -> str:
        w = [self.word() for _ in range(self.r.randint(least, most))]
        return " ".join(w).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""])

    def text(self, least: int = 6, most: int = 60) -> str:
        return " ".join(self.sentence(3, 20) for _ in range(max(1, self.r.randint(least, most) // 12)))

    def leaf(self, tag: str, text: str, label: int, link: bool = False, attrs: str = "", end: bool = True) -> None:
        inner = f'<a href="/{self.word()}">{text}</a>' if link else text
        if not link and self.r.random() < 0.2 and " " in text:
            a, b = text.split(" ", 1)
            inner = f"<b>{a}</b> {b}" if self.r.random() < 0.7 else f'<a href="#">{a}</a> {b}'
        self.html.append(f"<{tag}{attrs}>{inner}" + (f"</{tag}>" if end else ""))
        self.blocks.append((text, label))

    def open(self, part: str, tag: str) -> str:
        names = self.r.sample(NAMES[part], 1) + (self.r.sample(NAMES["plain"], 1) if self.r.random() < 0.3 else [])
        if tag == "div" or self.r.random() < 0.4:
            self.html.append(f'<{tag} {self.r.choice(["class", "class", "id"])}="{" ".join(names)}">')
        else:
            self.html.append(f"<{tag}>")
        return f"</{tag}>"

    def links(self, part: str, tag: str) -> None:
        end = self.open(part, tag)
        listed = self.r.random() < 0.7
        self.html.append("<ul>" if listed else "")
        for _ in range(self.r.randint(2, 8)):
            self.leaf("li" if listed else self.r.choice(["div", "p"]), self.sentence(1, 4).rstrip(".!?"), 0, link=True, end=self.tidy)
        self.html.append(("</ul>" if listed else "") + end)

    def boxed(self, part: str, tag: str, most: int = 3) -> None:
        end = self.open(part, tag)
        if self.r.random() < 0.5:
            self.leaf(self.r.choice(["h3", "h4", "div", "p"]), self.sentence(1, 5), 0)
        for _ in range(self.r.randint(1, most)):
            self.leaf(self.r.choice(["p", "div", "p"]), self.text(3, 40), 0, link=self.r.random() < 0.25)
        self.html.append(end)

    def bare(self, part: str, tag: str = "div") -> None:
        """A part that is itself the leaf block."""
        self.leaf(tag, self.text(3, 30), 0, attrs=f' class="{self.r.choice(NAMES[part])}"')

    def form(self) -> None:
        self.html.append("<form>")
        for _ in range(self.r.randint(1, 3)):
            self.leaf(self.r.choice(["p", "div", "label"]), self.sentence(1, 6), 0)
        self.html.append('<input type="text"></form>')

    def comments(self) -> None:
        end = self.open("comments", self.r.choice(["div", "section", "div"]) if self.r.random() < 0.85 else "ol")
        self.html[-1] = self.html[-1] if "=" in self.html[-1] else self.html[-1][:-1] + f' class="{self.r.choice(NAMES["comments"])}">'
        if self.r.random() < 0.6:
            self.leaf(self.r.choice(["h2", "h3"]), self.sentence(1, 3), 0)
        for _ in range(self.r.randint(1, 5)):
            tag = self.r.choice(["div", "article", "li"])
            self.html.append(f'<{tag} class="{self.r.choice(["comment", "reply", "comment-body"])}">')
            for _ in range(self.r.randint(1, 2)):
                self.leaf("p", self.text(4, 50), 0)
            self.html.append(f"</{tag}>")
        self.html.append(end)

    def article(self) -> None:
        r, tag = self.r, self.r.choice(["article", "article", "main", "div", "section"])
        if tag in ("article", "main") and r.random() < 0.6:
            self.html.append(f"<{tag}>")
        else:
            self.html.append(f'<{tag} {r.choice(["class", "id"])}="{r.choice(NAMES["article"])}">')
        if r.random() < 0.85:
            head = r.random() < 0.15
            self.html.append("<header>" if head else "")
            self.leaf("h1", self.sentence(2, 14).rstrip("."), 1)
            self.html.append("</header>" if head else "")
        for _ in range(r.randint(2, 14)):
            kind = r.random()
            if kind < 0.66:
                self.leaf("p", self.text(1, 120), 1, end=self.tidy)
            elif kind < 0.76:
                self.leaf(r.choice(["h2", "h3"]), self.sentence(1, 8).rstrip("."), 1)
            elif kind < 0.82:
                self.html.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.leaf("li", self.sentence(2, 20), 1, end=self.tidy)
                self.html.append("</ul>")
            elif kind < 0.87:
                self.leaf(r.choice(["blockquote", "pre", "figcaption", "td", "dd"]) if self.tidy else "blockquote", self.text(4, 40), 1)
            elif kind < 0.9:
                self.leaf("p", self.sentence(1, 3), 1)
            elif kind < 0.94:
                self.bare("ad")
            elif kind < 0.96:
                self.boxed("aside", "aside")
            elif kind < 0.98:
                self.form()
            else:
                self.bare("social")
        if r.random() < 0.2:
            self.comments()
        self.html.append(f"</{tag}>")

    def build(self) -> tuple[str, list[Block]]:
        r = self.r
        self.html.append(f"<!DOCTYPE html><html><head><title>{self.sentence(2, 8)}</title><style>p{{margin:0}}</style><script>var t='<p>x</p>';</script></head><body>")
        some = lambda p: r.random() < p
        if some(0.2):
            self.boxed("notice", "div")
        if some(0.6):
            self.boxed("header", r.choice(["header", "div"]), 1)
        if some(0.8):
            self.links("nav", r.choice(["nav", "nav", "div"]))
        if some(0.5):
            self.bare("ad")
        if some(0.25):
            self.boxed("notice", r.choice(["div", "section"]))
        if some(0.3):
            self.html.append(f'<div class="{r.choice(NAMES["plain"])}">')
        if some(0.2):
            self.boxed("aside", r.choice(["aside", "div"]))
        self.article()
        if some(0.3):
            self.comments()
        for part, tag, p in (("social", "div", 0.2), ("aside", "aside", 0.3), ("aside", "div", 0.3), ("ad", "div", 0.3)):
            if some(p):
                (self.boxed if some(0.6) else self.links)(part, tag)
        if some(0.15):
            self.form()
        if some(0.8):
            if some(0.5):
                self.leaf("footer", "© " + self.text(2, 20), 0)
            else:
                self.boxed("footer", r.choice(["footer", "div"]))
        if self.tidy:
            self.html.append("</body></html>")
        return "".join(self.html), self.blocks


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, list[Block]]]:
    return [Page(seed * 1_000_003 + i).build() for i in range(n)]
