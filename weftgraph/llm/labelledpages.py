"""Labelled pages for training and testing the extractor: invented pages whose blocks are marked as they are written.

A page is a sequence of regions in a random layout. The words are random and the same inside and outside the article, so
that a model has to learn structure and shape, not vocabulary. Names of classes come from the lists below.
"""

from __future__ import annotations

import random

# Names that sites give to their regions.
BODY_NAMES = ("content", "post", "entry", "article-body", "story", "main-content", "post-content", "entry-content", "text", "body")
AD_NAMES = ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "ad-slot")
NOTICE_NAMES = ("cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "disclaimer", "paywall")
SIDE_NAMES = ("sidebar", "side", "widget", "related", "recommended", "more", "trending", "popular", "toc")
COMMENT_NAMES = ("comments", "comment-list", "respond", "replies", "discussion", "comment")
MENU_NAMES = ("menu", "nav", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "tags", "share", "social")
FOOT_NAMES = ("footer", "copyright", "legal", "site-footer", "bottom")
HEAD_NAMES = ("header", "masthead", "site-header", "logo", "top", "branding")
FORM_NAMES = ("newsletter", "subscribe", "signup", "search", "login", "form")
SYLLABLES = "ba ke li mo nu ra se ti vo za che dor fen gal hin jor kal lem mir nos".split()


class Writer:
    """Writes one page and its blocks as (text, label)."""

    def __init__(self, rnd: random.Random):
        self.rnd, self.html, self.blocks = rnd, [], []

    def words(self, n: int) -> str:
        return " ".join("".join(self.rnd.choice(SYLLABLES) for _ in range(self.rnd.randint(1, 3))) for _ in range(n))

    def sentence(self) -> str:
        return self.words(self.rnd.randint(3, 18)).capitalize() + self.rnd.choice(("." * 8) + "!?")

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rnd.choice((1, 1, 2, 3, 5, 8))))

    def put(self, text: str, label: int, before: str = "", after: str = "") -> None:
        self.html.append(f"{before}{text}{after}")
        self.blocks.append((text, label))

    def open(self, tag: str, names: tuple[str, ...] = ()) -> None:
        if names and self.rnd.random() < 0.85:
            self.html.append(f'<{tag} {self.rnd.choice(("class", "class", "id"))}="{self.rnd.choice(names)}">')
        else:
            self.html.append(f"<{tag}>")

    def close(self, tag: str) -> None:
        self.html.append(f"</{tag}>")

    # Regions that are not the article.

    def links(self, n: int) -> None:
        self.open("ul")
        for _ in range(n):
            self.put(self.words(self.rnd.randint(1, 4)), 0, '<li><a href="/x">', "</a></li>")
        self.close("ul")

    def menu(self) -> None:
        tag = self.rnd.choice(("nav", "nav", "div"))
        self.open(tag, MENU_NAMES if tag == "div" else MENU_NAMES[:3] if self.rnd.random() < 0.4 else ())
        self.links(self.rnd.randint(2, 8))
        self.close(tag)

    def boxed(self, tags: tuple[str, ...], names: tuple[str, ...], most: int = 2) -> None:
        tag = self.rnd.choice(tags)
        if tag == "div":
            self.html.append(f'<div class="{self.rnd.choice(names)}">')
        else:
            self.open(tag, names)
        for _ in range(self.rnd.randint(1, most)):
            bare = self.rnd.random() < 0.4
            self.put(self.prose(), 0, "" if bare else "<p>", "" if bare else "</p>")
            if bare:
                break
        if self.rnd.random() < 0.3:
            self.links(self.rnd.randint(1, 4))
        self.close(tag)

    def ad(self) -> None:
        self.boxed(("div", "div", "aside"), AD_NAMES)

    def notice(self) -> None:
        self.boxed(("div",), NOTICE_NAMES)

    def side(self) -> None:
        self.boxed(("aside", "div"), SIDE_NAMES, 4)

    def foot(self) -> None:
        tag = self.rnd.choice(("footer", "footer", "div"))
        self.html.append(f'<div class="{self.rnd.choice(FOOT_NAMES)}">' if tag == "div" else "<footer>")
        self.put("© " + self.rnd.choice((self.words(2), self.words(3) + " · " + self.prose())), 0, *(("<p>", "</p>") if self.rnd.random() < 0.5 else ("", "")))
        if self.rnd.random() < 0.4:
            self.links(3)
        self.close(tag)

    def head(self) -> None:
        tag = self.rnd.choice(("header", "header", "div"))
        self.html.append(f'<div class="{self.rnd.choice(HEAD_NAMES)}">' if tag == "div" else "<header>")
        self.put(self.words(2).title(), 0, *self.rnd.choice((("<div>", "</div>"), ("<p>", "</p>"), ("<h1>", "</h1>"), ('<a href="/">', "</a>"))))
        if self.rnd.random() < 0.5:
            self.menu()
        self.close(tag)

    def form(self) -> None:
        self.open("form", FORM_NAMES)
        self.put(self.rnd.choice((self.words(4), self.sentence())), 0, *self.rnd.choice((("<p>", "</p>"), ("<label>", "</label><br>"), ("<h3>", "</h3>"))))
        self.html.append('<div><input name="q"></div>')
        self.put(self.words(1), 0, "<button>", "</button>")
        self.close("form")

    def comments(self) -> None:
        tag = self.rnd.choice(("div", "section", "ol"))
        self.html.append(f'<{tag} {self.rnd.choice(("class", "id"))}="{self.rnd.choice(COMMENT_NAMES)}">')
        if self.rnd.random() < 0.6:
            self.put(self.words(2), 0, "<h3>", "</h3>")
        inner = "li" if tag == "ol" else self.rnd.choice(("div", "article", "div"))
        for _ in range(self.rnd.randint(1, 5)):
            self.html.append(f'<{inner} class="comment">' if self.rnd.random() < 0.7 else f"<{inner}>")
            if self.rnd.random() < 0.5:
                self.put(self.words(2), 0, "<div>", "</div>")
            self.put(self.prose(), 0, *self.rnd.choice((("<p>", "</p>"), ("<div>", "</div>"))))
            self.close(inner)
        self.close(tag)

    # The article.

    def part(self) -> None:
        kind = self.rnd.random()
        if kind < 0.62:
            style = self.rnd.random()
            self.put(self.prose(), 1, *(("<p>", "</p>") if style < 0.7 else ("<p>", "") if style < 0.8 else ("<p><b>", "<br>") if style < 0.9 else ("<div>", "</div>")))
        elif kind < 0.75:
            h = self.rnd.choice(("h2", "h3", "h4"))
            self.put(self.words(self.rnd.randint(1, 7)), 1, f"<{h}>", f"</{h}>")
        elif kind < 0.83:
            tag = self.rnd.choice(("ul", "ol"))
            self.open(tag)
            for _ in range(self.rnd.randint(2, 5)):
                self.put(self.rnd.choice((self.words(4), self.sentence())), 1, "<li>", self.rnd.choice(("</li>", "")))
            self.close(tag)
        elif kind < 0.88:
            self.put(self.prose(), 1, "<blockquote><p>", "</p></blockquote>")
        elif kind < 0.92:
            self.put(self.words(8), 1, "<pre>", "</pre>")
        elif kind < 0.96:
            self.html.append("<table>")
            for _ in range(2):
                self.html.append("<tr>")
                for _ in range(2):
                    self.put(self.words(2), 1, "<td>", "</td>")
                self.html.append("</tr>")
            self.html.append("</table>")
        else:
            self.put(self.sentence(), 1, '<figure><img src="x"><figcaption>', "</figcaption></figure>")

    def article(self) -> None:
        tag = self.rnd.choice(("article", "article", "article", "main", "div", "section"))
        outer = self.rnd.random() < 0.25
        if outer:
            self.open("main")
        self.html.append(f"<{tag}>" if tag in ("article", "main") and self.rnd.random() < 0.6 else f'<{tag} {self.rnd.choice(("class", "id"))}="{self.rnd.choice(BODY_NAMES)}">')
        if self.rnd.random() < 0.85:
            title = self.rnd.choice((self.words(self.rnd.randint(1, 9)), self.sentence()))
            self.put(title, 1, *self.rnd.choice((("<h1>", "</h1>"), ("<h1>", "</h1>"), ("<header><h1>", "</h1></header>"), ("<h2>", "</h2>"))))
        for _ in range(self.rnd.randint(1, 12)):
            self.part()
            if self.rnd.random() < 0.08:
                self.rnd.choice((self.ad, self.side, self.form, self.notice, self.menu))()
        if self.rnd.random() < 0.15:
            self.rnd.choice((self.comments, self.menu, self.form, self.foot))()
        self.close(tag)
        if self.rnd.random() < 0.15:
            self.comments()
        if outer:
            self.close("main")

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        r = self.rnd
        self.html.append(f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>")
        before = [f for f, p in ((self.notice, 0.2), (self.head, 0.5), (self.menu, 0.7), (self.ad, 0.5), (self.form, 0.15), (self.side, 0.15)) if r.random() < p]
        after = [f for f, p in ((self.side, 0.35), (self.comments, 0.35), (self.ad, 0.3), (self.form, 0.2), (self.menu, 0.2), (self.notice, 0.15), (self.foot, 0.8)) if r.random() < p]
        r.shuffle(before)
        wrap = r.random() < 0.4
        if wrap:
            self.open("div", ("wrapper", "container", "page", "row", "site"))
        for f in before:
            f()
        self.article()
        for f in after:
            f()
        if wrap:
            self.close("div")
        self.html.append("</body></html>")
        page = "".join(self.html)
        return (page[: r.randint(len(page) * 3 // 4, len(page))] if r.random() < 0.03 else page), self.blocks


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[tuple[str, int]]]]:
    """n pages with their blocks as (text, 1 if of the article); the same for the same seed."""
    rnd = random.Random(seed)
    return [Writer(rnd).page() for _ in range(n)]
