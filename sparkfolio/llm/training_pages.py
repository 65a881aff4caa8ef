"""Labelled pages for HTML extraction: generated from a grammar of page parts, each element labelled.

Text is invented, so that nothing depends on a language; names of classes are those that sites commonly
use for the parts. Pages are seeded: the same number gives the same pages.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

#: Names that sites use for parts beside the article, by part, and for the article.
BESIDE = {
    "menu": "nav navbar navigation menu main-menu topnav nav-links breadcrumb breadcrumbs toolbar tabs language-switcher sub-nav mega-menu pagination pager prev-next skip-link toc-nav",
    "head": "header site-header masthead top-bar topbar branding logo hero-banner site-title tagline page-header",
    "foot": "footer site-footer copyright legal colophon bottom-bar credits page-footer disclaimer imprint",
    "side": "sidebar side-bar widget widget-area aside related related-posts recommended more-stories trending popular latest-news see-also teaser-list tag-cloud archives blogroll right-rail secondary read-more",
    "ad": "ad ads advert advertisement ad-slot banner banner-ad sponsored sponsor promo promotion ad-container adsbygoogle affiliate commercial dfp-ad partner-offer",
    "notice": "cookie cookie-notice cookie-banner cookies-consent consent gdpr notice alert warning-banner announcement popup modal overlay paywall privacy-notice subscribe-prompt message toast site-notice info-bar",
    "form": "form newsletter newsletter-signup subscribe subscription signup login search search-box contact-form feedback poll survey register",
    "talk": "comments comment-list commentlist comment reader-comments discussion responses replies reply disqus user-comments comment-body comment-text reactions feedback-list guestbook reviews",
    "share": "share social social-share share-buttons follow-us sharing tags tag-list post-meta-links print-tools addthis like-box author-links",
}
ARTICLE = "content main article post entry article-body post-content entry-content story story-body main-content page-content text body-text article-text blog-post news-article single rich-text document post-body hentry prose"
PLAIN = "wrapper container row col col-md-8 inner clearfix block box section layout grid page wrap outer group css-1k2j region"
INSIDE = "lead intro summary caption highlight quote pullquote note paragraph dropcap first figure chapter"


@dataclass
class Part:
    tag: str
    content: bool
    inner: list["Part | str"] = field(default_factory=list)
    attributes: str = ""


class Grammar:
    def __init__(self, seed: int) -> None:
        self.rnd = random.Random(seed)
        self.sounds = [self.rnd.choice("bcdfghjklmnprstvwz") + self.rnd.choice(["a", "e", "i", "o", "u", "ei", "ou", "é", "ä"]) + self.rnd.choice(["", "n", "r", "s", "l", "nt"]) for _ in range(60)]

    def some(self, a: int, b: int) -> range:
        return range(self.rnd.randint(a, b))

    def maybe(self, p: float) -> bool:
        return self.rnd.random() < p

    def words(self, a: int, b: int) -> str:
        return " ".join("".join(self.rnd.choice(self.sounds) for _ in self.some(1, 3)) for _ in self.some(a, b))

    def prose(self, a: int, b: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.rnd.choice([".", ".", ".", "!", "?", ","]) for _ in self.some(a, b))

    def link(self, content: bool = False) -> str:
        return f'<a href="/{self.rnd.randint(1, 999)}">{self.words(1, 3)}</a>'

    def named(self, names: str, p: float = 1.0) -> str:
        if not self.maybe(p):
            return f' class="{self.rnd.choice(PLAIN.split())}"' if self.maybe(0.3) else ""
        chosen = self.rnd.sample(names.split(), 2 if self.maybe(0.25) else 1) + ([self.rnd.choice(PLAIN.split())] if self.maybe(0.2) else [])
        key = "id" if self.maybe(0.25) else "class"
        return f' {key}="{" ".join(chosen)}"'

    def inline(self, text: str) -> list[Part | str]:
        """Running text, at times with a link, an emphasis or a named span in it."""
        if self.maybe(0.6):
            return [text]
        kind = self.rnd.choice(["link", "b", "em", "code", "span", "open", "br"])
        more = self.prose(1, 2)
        if kind == "link":
            return [f"{text} {self.link()} {more}"]
        if kind == "span":
            return [text + " ", Part("span", True, [self.words(1, 4)], self.named(INSIDE)), " " + more]
        if kind == "open":
            return [f"<b>{text} {more}"]
        return [f"{text}<br>{more}"] if kind == "br" else [f"{text} <{kind}>{self.words(1, 3)}</{kind}> {more}"]

    def items(self, content: bool, links: bool) -> Part:
        inner = [Part("li", content, [self.link() if links else self.prose(1, 2) if self.maybe(0.7) else self.words(1, 6)]) for _ in self.some(2, 8)]
        return Part(self.rnd.choice(["ul", "ul", "ol"]), content, list(inner))

    def table(self) -> Part:
        cells = lambda tag: [Part(tag, True, [self.words(1, 4)]) for _ in range(3)]
        return Part("table", True, [Part("tr", True, list(cells("th")))] + [Part("tr", True, list(cells("td"))) for _ in self.some(2, 5)])

    def paragraph(self) -> Part:
        kind = self.rnd.random()
        text = self.prose(1, 7) if kind < 0.8 else self.words(1, 4) + "." if kind < 0.95 else self.words(60, 300)
        return Part("p", True, self.inline(text), self.named(INSIDE) if self.maybe(0.15) else "")

    def body(self) -> list[Part | str]:
        """What an article has: mostly paragraphs, and parts beside it that stand in it."""
        out: list[Part | str] = []
        if self.maybe(0.85):
            title = Part("h1", True, [self.words(3, 10)], self.named("title headline entry-title post-title", 0.3))
            out.append(title if self.maybe(0.75) else Part(*(("header", True, [title]) if self.maybe(0.7) else ("div", True, [title], ' class="article-header"'))))
        short = self.maybe(0.1)  # a dialogue or a poem
        for _ in self.some(5, 60) if short else self.some(1, 9):
            x = self.rnd.random()
            if short:
                out.append(Part("p", True, [self.words(1, 4) + "."]))
            elif x < 0.7:
                out.append(self.paragraph())
            elif x < 0.76:
                out.append(Part(self.rnd.choice(["h2", "h3"]), True, [self.words(2, 8)]))
            elif x < 0.81:
                out.append(self.items(True, False))
            elif x < 0.84:
                out.append(Part("blockquote", True, [self.paragraph()] if self.maybe(0.6) else [self.prose(1, 3)]))
            elif x < 0.86:
                out.append(Part("figure", True, ["<img src='x.png' alt='y'>", Part("figcaption", True, [self.prose(1, 1)])]))
            elif x < 0.88:
                out.append(self.table())
            elif x < 0.9:
                out.append(Part("pre", True, [f"<code>{self.words(4, 20)}</code>"]))
            elif x < 0.93:
                out.append(Part(self.rnd.choice(["div", "section"]), True, [self.paragraph(), self.paragraph()], self.named(PLAIN, 0.4)))
            elif x < 0.94:
                out.append(Part("div", True, [self.prose(2, 6)]))
            elif x < 0.95:
                out.append(Part(self.rnd.choice(["noscript", "object", "canvas"]), True, [self.paragraph() if self.maybe(0.6) else self.prose(1, 3)]))
            else:
                out.append(self.beside(self.rnd.choice(["ad", "ad", "share", "side", "notice", "form", "menu"])))
        if self.maybe(0.12):
            out.append(Part("footer", False, [self.words(2, 6), " ", self.link()]))
        if self.maybe(0.12):
            out.append(self.beside("talk"))
        return out

    def article(self) -> list[Part | str]:
        kind = self.rnd.random()
        inner = self.body()
        if kind < 0.35:
            one = Part("article", True, inner, self.named(ARTICLE, 0.3))
            return [one if self.maybe(0.7) else Part("main", True, [one])]
        if kind < 0.5:
            return [Part("main", True, inner, self.named(ARTICLE, 0.3))]
        if kind < 0.85:
            one = Part("div", True, inner, self.named(ARTICLE))
            return [one if self.maybe(0.6) else Part(self.rnd.choice(["div", "section", "main"]), True, [one], self.named(ARTICLE, 0.5))]
        if kind < 0.93:
            return [Part("div", True, inner, self.named(PLAIN, 0.5))]
        return [x for x in inner if isinstance(x, str) or x.tag not in ("header", "footer")]

    def beside(self, kind: str) -> Part:
        names = BESIDE[kind]
        no = lambda tag, *inner, attributes="": Part(tag, False, list(inner), attributes)
        box = lambda tag, p, *inner: Part(tag, False, list(inner), self.named(names, p))
        if kind == "menu":
            tag = self.rnd.choice(["nav", "nav", "div", "ul", "p"])
            if tag in ("ul", "p"):
                return box(tag, 1, *([no("li", self.link()) for _ in self.some(2, 8)] if tag == "ul" else [" | ".join(self.link() for _ in self.some(2, 6))]))
            return box(tag, 0.4 if tag == "nav" else 0.9, self.items(False, True) if self.maybe(0.8) else " ".join(self.link() for _ in self.some(2, 8)))
        if kind == "head":
            tag = self.rnd.choice(["header", "header", "div"])
            inner: list[Part | str] = [no(self.rnd.choice(["h1", "h2", "p", "div"]), self.words(1, 4) if self.maybe(0.6) else self.link())]
            if self.maybe(0.5):
                inner.append(no("p", self.prose(1, 1) if self.maybe(0.5) else self.words(2, 8)))
            if self.maybe(0.5):
                inner.append(self.beside("menu"))
            return box(tag, 0.4 if tag == "header" else 1, *inner)
        if kind == "foot":
            tag = self.rnd.choice(["footer", "footer", "div"])
            text = self.rnd.choice(["&copy; ", "© ", "", ""]) + self.words(1, 5) + " &middot; " + self.prose(0, 2)
            return box(tag, 0.4 if tag == "footer" else 1, *([text] if self.maybe(0.4) else [no("p", text), *([self.items(False, True)] if self.maybe(0.5) else [])]))
        if kind == "side":
            tag = self.rnd.choice(["aside", "aside", "div", "section"])
            inner = [no(self.rnd.choice(["h2", "h3", "h4"]), self.words(1, 4))] if self.maybe(0.7) else []
            inner += [self.items(False, self.maybe(0.7)) if self.maybe(0.6) else no("p", self.prose(1, 4)) for _ in self.some(1, 3)]
            return box(tag, 0.4 if tag == "aside" else 1, *inner)
        if kind in ("ad", "notice"):
            tag = self.rnd.choice(["div", "div", "section", "p", "aside", "span"] if kind == "ad" else ["div", "div", "section", "p", "dialog", "noscript"])
            text = self.prose(1, 4) if self.maybe(0.8) else self.words(1, 6)
            if tag in ("p", "span"):
                return box(tag, 1, text)
            return box(tag, 0.3 if tag == "aside" else 1, *([text] if self.maybe(0.5) else [no("p", text), *([f"<a href='#'>{self.words(1, 2)}</a>"] if self.maybe(0.4) else [no("button", self.words(1, 2))] if self.maybe(0.5) else [])]))
        if kind == "form":
            inner = [no("p", self.prose(1, 2))] if self.maybe(0.5) else [no("h3", self.words(2, 5))] if self.maybe(0.4) else []
            inner += [f"<label>{self.words(1, 3)}</label><input name='x'>" for _ in self.some(1, 4)] + [no("button", self.words(1, 2))]
            form = no("form", *inner, attributes=self.named(names, 0.4))
            return form if self.maybe(0.6) else box("div", 1, form)
        if kind == "share":
            return box(self.rnd.choice(["div", "ul", "p"]), 1, *(self.link() + " " for _ in self.some(2, 5))) if self.maybe(0.8) else box("div", 1, self.words(1, 3))
        item = lambda: self.rnd.choice(
            [lambda: box("div", 1, no("p", self.prose(1, 5))), lambda: no("article", no("p", self.prose(1, 4)), attributes=' class="comment"'), lambda: box("li", 1, no("p", self.prose(1, 3))), lambda: no("p", self.prose(1, 4)), lambda: box("div", 1, no("span", self.words(1, 2), attributes=' class="author"'), no("p", self.prose(1, 5)))]
        )()
        inner = [no(self.rnd.choice(["h2", "h3"]), self.words(1, 3))] if self.maybe(0.7) else []
        inner += [item() for _ in self.some(1, 6)] + ([self.beside("form")] if self.maybe(0.2) else [])
        return box(self.rnd.choice(["div", "section", "ol", "ul", "aside"]), 1, *inner)

    def page(self) -> list[Part | str]:
        """A page's parts in order."""
        body: list[Part | str] = []
        put = lambda p, kind: body.append(self.beside(kind)) if self.maybe(p) else None
        if self.maybe(0.06):  # no parts beside the article
            body += self.article() if self.maybe(0.5) else [self.prose(2, 9)]
        else:
            put(0.25, "notice"), put(0.5, "head"), put(0.7, "menu"), put(0.45, "ad"), put(0.1, "side")
            body += self.article()
            put(0.25, "share"), put(0.3, "talk"), put(0.35, "side"), put(0.2, "form"), put(0.2, "ad"), put(0.15, "menu"), put(0.7, "foot"), put(0.15, "notice")
            if self.maybe(0.25):
                body = [Part("div", True, body, self.named(PLAIN, 1))]
        if self.maybe(0.05):
            return body
        head = Part("head", False, [f"<meta charset='utf-8'><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';f(1);</script>"])
        return ["<!DOCTYPE html>", Part("html", True, [head, Part("body", True, body)], ' lang="xx"')]


def render(parts: list[Part | str], rnd: random.Random, labels: list[bool], tail: bool = True) -> str:
    """The parts as HTML, some end tags left out where they may be; labels gets that of each element."""
    out = []
    for x in parts:
        if isinstance(x, str):
            out.append(x)
            continue
        labels.append(x.content)
        inner = render(x.inner, rnd, labels)
        out.append(f"<{x.tag}{x.attributes}>{inner}" + ("" if x.tag == "li" and rnd.random() < 0.2 else f"</{x.tag}>") + rnd.choice(["", "", "\n", "<!-- x -->"]))
    return "".join(out)


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, list[bool]]]:
    """n pages, each with whether its elements are content, in the order of their start tags, the page itself first."""
    out = []
    for k in range(n):
        g = Grammar(seed * 1_000_003 + k)
        labels = [True]
        out.append((render(g.page(), g.rnd, labels), labels))
    return out
