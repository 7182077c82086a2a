"""Labelled pages for training the extractor: layouts drawn at random, each part marked as article or not."""

from __future__ import annotations

import random

PARTS = "an be co di en fo ga hi in jo ka lo me ni or pe qua re so ti un ver wo xi ya zu ing tion ment ble est".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(PARTS, k=self.r.choice((1, 1, 2, 2, 3))))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        words = [self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + self.r.choice("....!?")

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def link(self, words: int = 2) -> str:
        return f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randint(1, words)))}</a>'

    def pick(self, *names: str) -> str:
        return self.r.choice(names)

    def named(self, *names: str) -> str:
        """An attribute with one of the names, as class or id, alone or among others."""
        name = self.pick(*names)
        extra = self.pick("", "", "", " clear", " wide", f" c{self.r.randint(1, 9)}", " box")
        return f' {self.pick("class", "class", "id")}="{name}{extra}"'

    def links(self, tag: str = "ul") -> str:
        close = "</li>" if self.r.random() < 0.8 else ""
        return f"<{tag}>" + "".join(f"<li>{self.link()}{close}" for _ in range(self.r.randint(3, 9))) + f"</{tag}>"

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for tag in ("b", "em", "a href='/x'", "strong", "i", "span"):
            if self.r.random() < 0.15:
                i = self.r.randrange(len(words))
                words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
        return " ".join(words)

    def paragraphs(self, n: int) -> str:
        """Article blocks, some with tags left open."""
        out = []
        for _ in range(n):
            kind = self.r.random()
            if kind < 0.68:
                out.append(f"<p>{self.inline(self.prose())}{self.pick('</p>', '</p>', '</p>', '')}")
            elif kind < 0.74:
                out.append(f"<p>{self.sentence(1, 4)}</p>")
            elif kind < 0.80:
                tag = self.pick("h2", "h3", "h2", "h4")
                out.append(f"<{tag}>{self.sentence(2, 6)}</{tag}>")
            elif kind < 0.85:
                out.append(f"<{self.pick('ul', 'ol')}>" + "".join(f"<li>{self.sentence(3, 14)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>")
            elif kind < 0.89:
                out.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
            elif kind < 0.92:
                out.append(f"<p><b>{self.sentence()}<br><p>{self.prose()}</p>")
            elif kind < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.word()} {self.r.randint(1, 99)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 5))) + "</table>")
            elif kind < 0.96:
                out.append(f"<pre>{self.prose(1, 2)}</pre>")
            elif kind < 0.98:
                out.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            else:
                out.append(f"<div>{self.prose()}</div>")
        return "".join(out)

    def out(self, tag: str, body: str, attributes: str = "") -> str:
        return f'<{tag}{attributes} data-truth="out">{body}</{tag}>'

    def menu(self) -> str:
        return self.pick(self.out("nav", self.links()), self.out("nav", self.links(), self.named("nav", "menu")), self.out("div", self.links(), self.named("menu", "navbar", "nav", "navigation", "topbar", "main-nav")), self.out("ul", "".join(f"<li>{self.link()}</li>" for _ in range(6)), self.named("menu", "nav", "nav-links", "breadcrumb")))

    def header(self) -> str:
        body = f"<{self.pick('h1', 'div', 'h2', 'p')}>{self.sentence(1, 5)}</x>" + (self.links() if self.r.random() < 0.5 else "") + (f"<p>{self.sentence()}</p>" if self.r.random() < 0.5 else "")
        return self.pick(self.out("header", body), self.out("div", body, self.named("header", "masthead", "site-header", "banner-top", "page-header", "branding")))

    def footer(self) -> str:
        body = self.pick(f"&copy; {self.word()}.example.com &middot; {self.sentence()}", f"<p>{self.prose(1, 3)}</p>", self.links(), f"<p>&copy; {self.r.randint(1990, 2030)} {self.word()}</p>" + self.links())
        return self.pick(self.out("footer", body), self.out("footer", body), self.out("div", body, self.named("footer", "site-footer", "bottom", "copyright", "foot")))

    def ad(self) -> str:
        body = self.pick(self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f"{self.link(4)}", f"<p>{self.sentence()}</p>{self.link()}")
        return self.out(self.pick("div", "div", "div", "aside", "section", "p"), body, self.named("ad", "ads", "advert", "ad-banner", "advertisement", "sponsored", "promo", "ad-slot", "promotion", "sponsor"))

    def notice(self) -> str:
        body = self.pick(f"<p>{self.prose(1, 2)}</p>{self.link()}", self.prose(1, 2), f"<p>{self.prose(1, 2)}</p><button>{self.word()}</button>")
        return self.out(self.pick("div", "div", "section", "aside"), body, self.pick(self.named("cookie", "notice", "cookie-notice", "consent", "alert", "banner", "gdpr", "newsletter", "subscribe", "popup", "modal", "overlay", "warning", "cookies"), ' role="alert"', ' role="dialog"'))

    def form(self) -> str:
        fields = "".join(f"<{self.pick('p', 'div')}><label>{self.word()} {self.word()}</label><input name=x></p>" for _ in range(self.r.randint(1, 4)))
        return self.out("form", f"{self.pick('', f'<p>{self.sentence()}</p>', f'<h3>{self.sentence(2, 4)}</h3>')}{fields}<button>{self.word()}</button>", self.pick("", self.named("search", "login", "signup", "contact", "subscribe")))

    def sidebar(self) -> str:
        body = self.pick(self.links(), f"<h3>{self.sentence(1, 4)}</h3>" + self.links(), f"<p>{self.prose(1, 4)}</p>", f"<h4>{self.sentence(1, 3)}</h4><p>{self.prose(1, 3)}</p>" + self.links())
        return self.pick(self.out("aside", body), self.out("aside", body, self.named("sidebar", "related")), self.out("div", body, self.named("sidebar", "side", "related", "widget", "rail", "right-col", "left-column", "recommended", "trending", "popular", "share", "social", "tags", "author-box")))

    def comments(self) -> str:
        one = lambda: self.pick(f"<p>{self.prose(1, 4)}</p>", f"<b>{self.word()}</b><p>{self.prose(1, 3)}</p>", self.prose(1, 3))
        n = self.r.randint(1, 6)
        if self.r.random() < 0.4:
            body = "<ol>" + "".join(f"<li{self.pick('', self.named('comment'))}>{one()}</li>" for _ in range(n)) + "</ol>"
        else:
            body = "".join(f"<{(t := self.pick('div', 'article', 'div'))}{self.named('comment', 'comment-body', 'reply', 'user-comment')}>{one()}</{t}>" for _ in range(n))
        return self.out(self.pick("div", "section", "section"), self.pick("", f"<h3>{self.sentence(1, 4)}</h3>") + body, self.named("comments", "comment-list", "discussion", "responses", "disqus", "replies", "reader-comments"))

    def article(self) -> str:
        head = f"<h1>{self.sentence(2, 9)}</h1>" if self.r.random() < 0.8 else ""
        blocks = [self.paragraphs(self.r.choice((1, 2, 2, 3))) for _ in range(self.r.choice((1, 2, 4, 8)))]
        body = []
        for b in blocks:
            body.append(b)
            if self.r.random() < 0.12:
                body.append(self.r.choice((self.ad, self.sidebar, self.form, self.notice, self.ad))())
        inner = head + "".join(body)
        if self.r.random() < 0.15:
            inner += self.comments()
        tag, attributes = self.pick(("article", ""), ("article", ""), ("article", self.named("post", "entry", "story")), ("main", ""), ("div", self.named("content", "article", "post", "entry-content", "main", "story", "post-body", "text", "main-content", "article-body")), ("section", self.named("content", "article", "post")), ("div", ""))
        return f'<{tag}{attributes} data-truth="in">{inner}</{tag}>'

    def page(self) -> str:
        wrap = lambda x: self.pick(x, x, f"<div{self.pick('', self.named('wrapper', 'container', 'page', 'layout', 'row', 'site'))}>{x}</div>")
        maybe = lambda f, p: f() if self.r.random() < p else ""
        above = [maybe(self.notice, 0.3), maybe(self.header, 0.5), maybe(self.menu, 0.8), maybe(self.ad, 0.4), maybe(self.form, 0.15)]
        below = [maybe(self.comments, 0.35), maybe(self.sidebar, 0.4), maybe(self.ad, 0.3), maybe(self.form, 0.2), maybe(self.notice, 0.15)]
        self.r.shuffle(below)
        middle = wrap("".join([maybe(self.sidebar, 0.2), wrap(self.article()), *below]))
        head = f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{margin:0}}</style></head>"
        return f'{head}<body data-truth="out">{wrap("".join([*above, middle, maybe(self.footer, 0.85)]))}{self.pick("</body></html>", "")}'
