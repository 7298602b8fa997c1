"""Pages with known main text, from a rule: layouts, names and invented words by a seed.

They teach the block labeller what surrounds articles. No page of any table is learnt from.
"""

from __future__ import annotations

import random

#: Names that pages give to their parts.
MAIN = "article main content post entry story body text article-body post-content entry-content story-body main-content page-content blog-post single wiki markdown prose".split()
SIDES = {
    "nav": "nav navbar menu topnav main-menu navigation breadcrumb breadcrumbs pagination pager tabs toc skip-links submenu".split(),
    "header": "header masthead site-header topbar banner page-header branding logo brand hero-bar".split(),
    "footer": "footer site-footer bottom copyright legal colophon page-footer credits foot".split(),
    "aside": "sidebar side widget related aside rail right-col recommended popular trending read-more tags social share author-box newsletter more-stories".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsbygoogle promoted ad-slot affiliate".split(),
    "notice": "cookie cookies notice consent alert gdpr banner popup modal overlay disclaimer paywall cookie-banner notification toast".split(),
    "form": "search login form signup subscribe contact newsletter-form search-form comment-form".split(),
    "comment": "comments comment comment-list replies discussion disqus responses reader-comments thread reply feedback".split(),
}
ELEMENTS = {"nav": "nav ul div", "header": "header div", "footer": "footer div", "aside": "aside div section", "ad": "div div ins section aside", "notice": "div section dialog", "form": "form", "comment": "div section ol"}


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice("bcdfghjklmnprstvw") + self.r.choice("aeiouéüñ") for _ in range(self.r.choice((1, 1, 2)))) for _ in range(60)]

    def words(self, low: int, high: int) -> str:
        r = self.r
        w = ["".join(r.choice(self.syllables) for _ in range(r.choice((1, 1, 2, 2, 3)))) for _ in range(r.randint(low, high))]
        return " ".join(x + ("." if r.random() < 0.08 else "," if r.random() < 0.05 else "") for x in w).capitalize()

    def attrs(self, kind: str) -> str:
        r = self.r
        name = r.choice(SIDES[kind] if kind in SIDES else MAIN)
        if r.random() < 0.25:
            name += "-" + r.choice(("wrap", "inner", "box", "container", "block", "1", "area"))
        roll = r.random()
        return "" if kind == "plain" else f' class="{name}"' if roll < 0.65 else f' id="{name}"' if roll < 0.85 else f' class="{r.choice(("c1", "box", "row", "col"))} {name}"'

    def side(self, kind: str) -> str:
        """One part of a page that is not its article."""
        r = self.r
        tag = r.choice(ELEMENTS[kind].split())
        plain = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5
        attrs = "" if plain else self.attrs(kind)
        inner = ""
        for _ in range(r.choice((1, 1, 2, 3))):
            roll = r.random()
            if kind == "nav" or roll < 0.25 and kind in ("footer", "header", "aside"):
                links = "".join(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></li>' for _ in range(r.randint(2, 9)))
                inner += links if tag in ("ul", "ol") else f"<ul>{links}</ul>" if r.random() < 0.8 else links.replace("<li>", "").replace("</li>", " | ")
            elif kind == "form":
                inner += f"<label>{self.words(1, 4)}</label><input><p>{self.words(2, 14)}</p><button>{self.words(1, 2)}</button>"
            elif kind == "comment":
                name = r.choice(("div", "li", "article"))
                inner += f'<h3>{self.words(1, 3)}</h3>' * (r.random() < 0.3) + "".join(f'<{name} class="{r.choice(SIDES["comment"])}"><b>{self.words(1, 2)}</b><p>{self.words(4, 60)}</p></{name}>' for _ in range(r.randint(1, 4)))
            else:
                text = self.words(2, 30)
                inner += r.choice((text, f"<p>{text}</p>", f"<div>{text}</div>", f"<h4>{self.words(1, 4)}</h4><p>{text}</p>", f'<a href="#">{text}</a>', f"<span>&copy; {text}</span>"))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def article(self) -> tuple[str, str]:
        """The markup of an article; its own blocks are marked by a private-use letter."""
        r, out = self.r, ""
        m = ""
        if r.random() < 0.8:
            head = f"<h{r.choice('1112')}>{m}{self.words(3, 12)}</h1>"
            out += f"<header>{head}</header>" if r.random() < 0.15 else head
        if r.random() < 0.25:
            out += f'<{r.choice(("div", "p", "span"))} class="{r.choice(("byline", "meta", "date", "author", "post-meta", "timestamp"))}">{self.words(2, 6)}</{r.choice(("div", "p"))}>'
        for _ in range(r.randint(1, 12) if r.random() < 0.85 else r.randint(13, 40)):
            roll = r.random()
            text = m + self.words(*r.choice(((2, 9), (10, 60), (40, 160))))
            if roll < 0.7:
                body = r.choice((text, f"<b>{text}<br>", f"{text} <a href='/x'>{self.words(1, 3)}</a> {self.words(1, 9)}", f"<i>{text}</i>"))
                out += f"<p>{body}" + "</p>" * (r.random() < 0.8)
            elif roll < 0.78:
                out += f"<h{r.choice('234')}>{m}{self.words(2, 7)}</h2>"
            elif roll < 0.84:
                out += "<ul>" + "".join(f"<li>{m}{self.words(3, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            elif roll < 0.88:
                out += f"<blockquote><p>{text}</p></blockquote>"
            elif roll < 0.90:
                out += f"<pre>{text}</pre>"
            elif roll < 0.92:
                out += "<table>" + "".join(f"<tr><td>{m}{self.words(1, 3)}</td><td>{m}{self.words(1, 5)}</td></tr>" for _ in range(3)) + "</table>"
            elif roll < 0.95:
                out += f"<div>{text}</div>"
            else:
                out += self.side(r.choice(("ad", "aside", "notice", "ad")))
        return out, m

    def page(self) -> str:
        r = self.r
        body, _ = self.article()
        kind = r.random()
        tag = "article" if kind < 0.5 else "main" if kind < 0.65 else "div"
        attrs = "" if tag != "div" and r.random() < 0.6 else self.attrs("main")
        tail = self.side("comment") if r.random() < 0.35 else ""
        inside = tail if r.random() < 0.5 else ""
        core = f"<{tag}{attrs}>{body}{inside}</{tag}>" + ("" if inside else tail)
        if r.random() < 0.3:
            core = f'<div{r.choice(("", self.attrs("main"), " class=\"container\""))}>{core}{self.side("aside") if r.random() < 0.5 else ""}</div>'
        before = [self.side(k) for k in r.sample(["header", "nav", "notice", "ad", "form", "nav", "aside"], r.randint(0, 4))]
        after = [self.side(k) for k in r.sample(["footer", "aside", "ad", "form", "notice", "nav", "footer"], r.randint(0, 4))]
        return "<html><head><title>x</title></head><body>" + "".join(before) + core + "".join(after) + "</body></html>"


def pages(n: int, seed: int = 5) -> list[str]:
    """n pages; blocks of the article start with the letter U+E000."""
    w = [Writer(seed + i) for i in range(8)]
    return [w[i % 8].page() for i in range(n)]
