"""Made-up pages with known main text, to learn what main text looks like.

Every element carries data-main, 1 where it is part of the main text. Layouts, tags,
names and texts vary at random from a fixed seed.
"""

from __future__ import annotations

import random

_SYLLABLES = "an en er re th on in st le ou ra mi do ko sch ung keit é ción ñ ü ta pe lo vi".split()
# Names as they are common in the markup of public pages.
NAMES = {
    "main": "article content main post entry story text body page-content post-content entry-content article-body main-content".split(),
    "menu": "nav menu navbar breadcrumb breadcrumbs navigation main-menu site-nav toc tabs pagination pager".split(),
    "head": "header masthead site-header top-bar logo banner branding".split(),
    "foot": "footer site-footer bottom copyright colophon legal".split(),
    "side": "sidebar side aside widget widgets related recommended popular trending archive read-more".split(),
    "notice": "cookie cookies consent notice alert gdpr popup modal newsletter subscribe paywall warning message".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo adsbygoogle ad-slot".split(),
    "comments": "comments comment comment-list reply replies discussion respond disqus".split(),
    "share": "share social share-buttons social-links tools actions rating".split(),
    "neutral": "container wrapper row col inner grid section block layout outer box x1 c2 clearfix".split(),
}


class _Maker:
    def __init__(self, rng: random.Random):
        self.r = rng
        self.style = rng.choice(("plain", "plain", "plain", "loud", "marks", "bars", "short"))

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, least: int, most: int) -> str:
        out = " ".join(self.word() for _ in range(self.r.randint(least, most)))
        return out[:1].upper() + out[1:]

    def prose(self) -> str:
        if self.style == "short" or self.r.random() < 0.12:
            return self.words(1, 4) + self.r.choice((".", "", "!"))
        text = ". ".join(self.words(3, 14) for _ in range(self.r.randint(1, 6))) + "."
        if self.style == "loud":
            return text.upper().replace(" ", "!! ")
        if self.style == "marks":
            return text.replace(" ", self.r.choice(("### ", "&amp;&amp; ", "$$$ ")))
        return text.replace(" ", " | ") if self.style == "bars" else text

    def tag(self, name: str, inner: str, main: int, names: str | None = None, likely: float = 0.85) -> str:
        attrs = ""
        if names and self.r.random() < likely:
            chosen = self.r.choice(NAMES[names])
            if self.r.random() < 0.25:
                chosen += " " + self.r.choice(NAMES["neutral"])
            attrs = f' {self.r.choice(("class", "class", "id"))}="{chosen}"'
        return f'<{name}{attrs} data-main="{main}">{inner}</{name}>'

    def links(self, least: int, most: int) -> str:
        item = lambda: f'<a href="/{self.word()}">{self.words(1, 3)}</a>'
        if self.r.random() < 0.7:
            return self.tag("ul", "".join(self.tag("li", item(), 0) for _ in range(self.r.randint(least, most))), 0)
        return self.r.choice((" ", " | ", " &middot; ")).join(item() for _ in range(self.r.randint(least, most)))

    def off(self, kind: str) -> str:
        """One block that is not main text."""
        r = self.r
        own = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "comments": "section"}.get(kind, "div")
        clear = own != "div" and r.random() < 0.6
        name = own if clear else r.choice(("div", "section", "div"))
        likely = 0.5 if clear and own != "section" else 1.0
        if kind == "menu":
            inner = self.links(2, 9)
        elif kind == "head":
            inner = self.tag("div", self.words(1, 4), 0) + (self.links(2, 6) if r.random() < 0.5 else "")
            inner += self.tag("p", self.words(2, 8), 0) if r.random() < 0.3 else ""
        elif kind == "foot":
            inner = f"&copy; {self.word()}.example.com &middot; {self.prose()}" if r.random() < 0.6 else self.tag("p", "&copy; " + self.words(2, 8), 0) + self.links(2, 5)
        elif kind == "side":
            inner = self.tag(r.choice(("h2", "h3", "h4")), self.words(1, 3), 0) + (self.links(3, 8) if r.random() < 0.6 else "".join(self.tag("p", self.prose(), 0) for _ in range(r.randint(1, 3))))
        elif kind == "comments":
            each = lambda: self.tag(r.choice(("div", "li", "article")), self.tag("p", self.words(1, 2), 0) + self.tag("p", self.prose(), 0), 0, "comments", 0.7)
            inner = self.tag("h3", self.words(1, 3), 0) + "".join(each() for _ in range(r.randint(1, 5)))
            inner += self.tag("form", self.tag("p", self.words(1, 4), 0) + "<textarea></textarea>", 0) if r.random() < 0.4 else ""
        elif kind == "form":
            inner = self.tag("form", self.tag("p", "<label>" + self.words(1, 5) + "</label><input>", 0) + (self.tag("div", self.prose(), 0) if r.random() < 0.4 else ""), 0)
            return inner if r.random() < 0.5 else self.tag("div", inner, 0)
        elif kind == "share":
            inner = self.links(2, 5)
        else:
            inner = self.prose() if r.random() < 0.5 else "".join(self.tag("p", self.prose(), 0) for _ in range(r.randint(1, 2)))
        return self.tag(name, inner, 0, kind, likely)

    def body(self) -> list[str]:
        """The blocks of the main text, now and then with something foreign among them."""
        r = self.r
        out = [self.tag("h1", self.words(2, 9), 1)] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12))):
            x = r.random()
            if x < 0.68:
                out.append(self.tag("p", self.prose(), 1))
            elif x < 0.76:
                out.append(self.tag(r.choice(("h2", "h3")), self.words(1, 6), 1))
            elif x < 0.83:
                out.append(self.tag(r.choice(("ul", "ol")), "".join(self.tag("li", self.prose(), 1) for _ in range(r.randint(1, 5))), 1))
            elif x < 0.87:
                out.append(self.tag("blockquote", self.tag("p", self.prose(), 1), 1))
            elif x < 0.90:
                cells = lambda: "".join(self.tag("td", self.words(1, 4), 1) for _ in range(3))
                out.append(self.tag("table", "".join(self.tag("tr", cells(), 1) for _ in range(r.randint(1, 4))), 1))
            elif x < 0.93:
                out.append(self.tag("figure", self.tag("figcaption", self.words(2, 9), 1), 1))
            elif x < 0.96:
                out.append(self.tag(r.choice(("section", "div")), self.tag("p", self.prose(), 1), 1, "neutral", 0.4))
            else:
                out.append(self.off(r.choice(("advert", "share", "side", "notice", "menu", "form"))))
        return out

    def page(self) -> str:
        r = self.r
        inner = "".join(self.body())
        if r.random() < 0.2:
            inner += self.off("comments")
        x = r.random()
        if x < 0.45:
            main = self.tag("article", inner, 1, "main", 0.3)
        elif x < 0.6:
            main = self.tag("main", inner if r.random() < 0.5 else self.tag("article", inner, 1), 1, "main", 0.3)
        elif x < 0.92:
            main = self.tag("div", inner, 1, "main", 1.0)
        else:
            main = inner
        before = [self.off(k) for k in ("notice", "head", "menu", "advert", "share") if r.random() < 0.5]
        after = [self.off(k) for k in ("side", "comments", "advert", "share", "form", "foot", "notice") if r.random() < 0.45]
        if r.random() < 0.25:
            before.append(after.pop(0) if after else "")
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            main = self.tag(r.choice(("div", "section", "div")), main, 0, "neutral", 0.8) if r.random() < 0.6 else self.tag("div", "".join(before) + main + "".join(after), 0, "neutral", 0.8)
            if "".join(before) and "".join(before) in main:
                before, after = [], []
        return f'<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body data-main="0">{"".join(before)}{main}{"".join(after)}</body></html>'


def made_pages(n: int, seed: int = 1) -> list[str]:
    """n pages from a fixed seed."""
    rng = random.Random(seed)
    return [_Maker(rng).page() for _ in range(n)]
