"""Labelled pages made by rule: common page layouts with marks on the elements that hold the main text."""

from __future__ import annotations

from random import Random

# ---- fixed values: names that page authors give to parts of a page ------------------------------
MENU = ["menu", "nav", "navbar", "navigation", "main-menu", "top-nav", "site-nav", "tabs", "toolbar"]
HEADER = ["header", "masthead", "site-header", "topbar", "branding", "logo", "page-header-bar"]
FOOTER = ["footer", "site-footer", "foot", "bottom", "copyright", "legal", "colophon", "page-footer"]
SIDEBAR = ["sidebar", "side", "aside", "rail", "right-column", "widget", "widget-area", "secondary", "left-col"]
NOTICE = ["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "banner", "popup", "modal", "overlay", "message", "warning", "paywall", "announcement"]
ADVERT = ["ad", "ads", "advert", "advertisement", "adsbox", "ad-slot", "sponsor", "sponsored", "promo", "promotion", "banner-ad"]
FORM = ["newsletter", "subscribe", "signup", "login", "search", "search-form", "contact-form", "register", "feedback"]
COMMENTS = ["comments", "comment", "comment-list", "commentlist", "disqus", "discussion", "responses", "replies", "reader-comments", "reviews"]
RELATED = ["related", "related-posts", "recommended", "more-stories", "read-next", "trending", "popular", "latest", "see-also"]
SHARE = ["share", "social", "sharing", "follow", "share-buttons", "tools"]
CRUMBS = ["breadcrumb", "breadcrumbs", "pagination", "pager", "paging", "tags", "tag-list", "categories"]
MAIN = ["content", "article", "post", "entry", "entry-content", "post-content", "article-body", "story", "story-body", "main", "main-content", "text", "body-text", "page-content", "post-body"]
WRAP = ["wrapper", "container", "page", "site", "row", "inner", "layout", "col", "wrap", "grid"]
# ------------------------------------------------------------------------------------------------
MARK, UNMARK = "data-main", "data-rest"


class _Page:
    """One page drawn at random."""

    def __init__(self, seed: int):
        self.r = Random(seed)
        letters = self.r.choice(["etaoinshrdlu", "eaéèirtnsluçm", "eänrschiütdß", "аеионтслвр", "aeiosrnñdló"])
        self.words = ["".join(self.r.choices(letters, k=self.r.randint(1, 9))) for _ in range(60)]

    def sentence(self, low: int, high: int) -> str:
        words = self.r.choices(self.words, k=self.r.randint(low, high))
        if len(words) > 6 and self.r.random() < 0.5:
            words[3] += ","
        return " ".join(words).capitalize() + self.r.choice(["."] * 6 + ["?", "!", ""])

    def text(self, sentences: int) -> str:
        out = " ".join(self.sentence(2, 16) for _ in range(sentences))
        if self.r.random() < 0.1:
            out += " &copy; &amp; &quot;"
        return out

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def tag(self, names: list[str], kinds: list[str], always: bool = False) -> tuple[str, str]:
        """Opening and closing tag of a part: an element of a telling kind, or one with a telling name, or both."""
        kind = self.r.choice(kinds)
        telling = kind not in ("div", "section", "ul", "p")
        name = self.r.choice(names)
        if self.chance(0.3):
            name = self.r.choice([f"{name}-{self.r.randint(1, 9)}", f"{self.r.choice(self.words)} {name}", f"{name}Box", f"site_{name}", name.upper()])
        where = self.r.choice(["class", "class", "id"])
        attribute = f' {where}="{name}"' if always or not telling or self.chance(0.4) else ""
        return f"<{kind}{attribute}>", f"</{kind}>"

    def wrap(self, inner: str, p: float = 0.4) -> str:
        while self.chance(p):
            inner = f'<div class="{self.r.choice(WRAP)}">{inner}</div>' if self.chance(0.7) else f"<div>{inner}</div>"
        return inner

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.sentence(1, 3)}</a>' for i in range(n)]
        form = self.r.randint(0, 3)
        if form == 0:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        if form == 1:
            return "<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>"
        return " | ".join(items) if form == 2 else "".join(f"<p>{i}</p>" for i in items)

    def part(self, names: list[str], kinds: list[str], inner: str) -> str:
        start, end = self.tag(names, kinds)
        return self.wrap(start + self.wrap(inner, 0.3) + end, 0.2)

    def paragraphs(self, low: int, high: int) -> str:
        return "".join(f"<p>{self.text(self.r.randint(1, 4))}</p>" for _ in range(self.r.randint(low, high)))

    def advert(self) -> str:
        inner = self.r.choice([self.text(1), f"<p>{self.text(self.r.randint(1, 3))}</p>", f'<a href="/x">{self.text(1)}</a>'])
        return self.part(ADVERT, ["div", "div", "section", "aside"], inner)

    def notice(self) -> str:
        inner = self.r.choice([self.text(2), f"<p>{self.text(self.r.randint(1, 3))}</p><button>{self.sentence(1, 2)}</button>", f"<h3>{self.sentence(1, 4)}</h3><p>{self.text(2)}</p>"])
        return self.part(NOTICE, ["div", "div", "section", "dialog"], inner)

    def form(self) -> str:
        fields = f"<label>{self.sentence(1, 3)}</label><input name=q><button>{self.sentence(1, 2)}</button>"
        inner = self.r.choice([fields, f"<p>{self.text(1)}</p>{fields}", f"<h3>{self.sentence(1, 4)}</h3><p>{self.text(2)}</p>{fields}", f"<div>{fields}</div>"])
        return self.part(FORM, ["form", "form", "div"], inner if self.chance(0.6) else f"<form>{inner}</form>")

    def related(self) -> str:
        return self.part(RELATED, ["div", "section", "aside"], f"<h3>{self.sentence(1, 3)}</h3>{self.links(self.r.randint(2, 6))}")

    def comments(self) -> str:
        def one() -> str:
            body = self.paragraphs(1, 3) if self.chance(0.7) else self.text(self.r.randint(1, 4))
            who = self.r.choice(["", f"<b>{self.sentence(1, 2)}</b>", f"<p><a href=u>{self.sentence(1, 2)}</a></p>", f"<h4>{self.sentence(1, 2)}</h4>"])
            return who + body

        n, form = self.r.randint(1, 8), self.r.randint(0, 3)
        if form == 0:
            inner = "<ol>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ol>"
        elif form == 1:
            inner = "".join(f'<div class="{self.r.choice(["comment", "reply", "comment-body", "response"])}">{one()}</div>' for _ in range(n))
        elif form == 2:
            inner = "".join(f"<article{self.r.choice(['', ' class=comment'])}>{one()}</article>" for _ in range(n))
        else:
            inner = "".join(f"<p>{self.text(self.r.randint(1, 4))}</p>" for _ in range(n))
        title = f"<{self.r.choice(['h2', 'h3'])}>{self.sentence(1, 3)}</h2>" if self.chance(0.7) else ""
        return self.part(COMMENTS, ["div", "section", "section", "ol" if form == 0 else "div"], title + inner + (self.form() if self.chance(0.3) else ""))

    def sidebar(self) -> str:
        def box() -> str:
            return f"<h3>{self.sentence(1, 3)}</h3>" * self.chance(0.7) + self.r.choice([self.links(4), self.paragraphs(1, 2), self.text(2), self.form()])

        return self.part(SIDEBAR, ["div", "aside", "aside"], "".join(box() for _ in range(self.r.randint(1, 3))))

    def header(self) -> str:
        title = self.r.choice(["h1", "h2", "div", "p"])
        inner = f"<{title}>{self.sentence(1, 4)}</{title}>" + f"<p>{self.sentence(2, 9)}</p>" * self.chance(0.5)
        return self.part(HEADER, ["header", "div"], inner + (self.menu() if self.chance(0.4) else ""))

    def menu(self) -> str:
        return self.part(MENU, ["nav", "nav", "div", "ul"], self.links(self.r.randint(2, 9)))

    def footer(self) -> str:
        inner = self.r.choice(
            [f"&copy; {self.sentence(1, 4)} &middot; {self.text(self.r.randint(1, 3))}", self.paragraphs(1, 2), self.links(5), self.links(4) + f"<p>{self.text(2)}</p>", f"<small>{self.text(1)}</small>"]
        )
        return self.part(FOOTER, ["footer", "footer", "div"], inner)

    def small(self) -> str:
        return self.part(*self.r.choice([(SHARE, ["div", "ul"]), (CRUMBS, ["div", "nav", "ul"])]), self.links(self.r.randint(2, 4)))

    def rest(self, inner: str) -> str:
        """A part that is not main text, inside the main element."""
        return inner.replace(">", f" {UNMARK}>", 1)

    def paragraph(self) -> str:
        text = self.text(self.r.choice([1, 1, 2, 3, 4, 6]))
        if self.chance(0.2):
            text = self.sentence(1, self.r.choice([1, 2, 4]))
        if self.chance(0.2):
            text += f' <a href="/y">{self.sentence(1, 4)}</a> {self.sentence(2, 9)}'
        if self.chance(0.2):
            text = self.r.choice([f"<b>{text}<br>", f"<em>{text}</em>", f"{text}<br>{self.text(1)}", f"<span>{text}</span>"])
        return text

    def body(self) -> str:
        style = self.r.choice(["p"] * 6 + ["open"] * 2 + ["div", "mixed"])
        out = []
        if self.chance(0.85):
            h = self.r.choice(["h1"] * 4 + ["h2"])
            title = f"<{h}>{self.sentence(2, 12)}</{h}>"
            out.append(f"<header>{title}</header>" if self.chance(0.1) else title)
        for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = self.r.random()
            if kind < 0.75:
                text = self.paragraph()
                out.append(f"<div>{text}</div>" if style == "div" else f"<p>{text}" + "</p>" * (style == "p" or style == "mixed" and self.chance(0.5)))
            elif kind < 0.81:
                out.append(f"<{(h := self.r.choice(['h2', 'h3', 'h4']))}>{self.sentence(1, 7)}</{h}>")
            elif kind < 0.87:
                lst = self.r.choice(["ul", "ol"])
                out.append(f"<{lst}>" + "".join(f"<li>{self.paragraph()}</li>" for _ in range(self.r.randint(2, 6))) + f"</{lst}>")
            elif kind < 0.91:
                out.append(f"<blockquote>{self.paragraph() if self.chance(0.5) else self.paragraphs(1, 2)}</blockquote>")
            elif kind < 0.94:
                rows = "".join("<tr>" + "".join(f"<td>{self.sentence(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(1, 4)))
                out.append(f"<table>{rows}</table>")
            elif kind < 0.97:
                out.append(f"<pre>{self.sentence(2, 9)}\n {self.sentence(1, 9)}</pre>")
            else:
                out.append(f"<figure><img src=x><figcaption>{self.sentence(2, 12)}</figcaption></figure>")
            if self.chance(0.1):
                out.append(self.rest(self.r.choice([self.advert, self.related, self.form, self.small, self.notice, self.sidebar])()))
        if self.chance(0.15):
            out.append(self.rest(self.r.choice([self.comments, self.related, self.small, self.form])()))
        return "".join(out)

    def main(self) -> str:
        kind = self.r.choice(["article"] * 5 + ["main"] * 2 + ["div"] * 5 + ["section", "td"])
        attribute = f' {self.r.choice(["class", "id"])}="{self.r.choice(MAIN)}"' if kind in ("div", "section") or self.chance(0.3) else ""
        if kind == "div" and self.chance(0.15):
            attribute = self.r.choice(["", ' role="main"', ' itemprop="articleBody"'])
        inner = self.body()
        if self.chance(0.25):
            inner = f'<div class="{self.r.choice(MAIN + WRAP)}">{inner}</div>'
        if kind == "td":
            return f"<table><tr><td {UNMARK}>{self.links(5)}</td><td {MARK}>{inner}</td></tr></table>"
        out = f"<{kind}{attribute} {MARK}>{inner}</{kind}>"
        return f"<main>{out}</main>" if kind in ("article", "div") and self.chance(0.25) else out

    def html(self) -> str:
        before = [self.header] * self.chance(0.5) + [self.menu] * self.chance(0.8) + [self.small] * self.chance(0.2)
        before += [self.notice] * self.chance(0.35) + [self.advert] * self.chance(0.5) + [self.form] * self.chance(0.2) + [self.sidebar] * self.chance(0.15)
        after = [self.advert] * self.chance(0.25) + [self.comments] * self.chance(0.4) + [self.related] * self.chance(0.3) + [self.sidebar] * self.chance(0.35)
        after += [self.form] * self.chance(0.2) + [self.small] * self.chance(0.2) + [self.menu] * self.chance(0.1)
        tail = [self.footer] * self.chance(0.85) + [self.notice] * self.chance(0.15)
        middle = [] if self.chance(0.04) else [self.main]
        inner = "".join(f() for f in [*before, *middle])
        # what follows the main text may stand beside it, in one more element
        inner = self.wrap(inner + "".join(f() for f in after), 0.25) + "".join(f() for f in tail)
        head = f"<head><title>{self.sentence(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{inner}" + "</body></html>" * self.chance(0.9)


def labelled_pages(n: int = 1000, seed: int = 1) -> list[str]:
    """`n` pages; text below an element marked `data-main` is main text, unless below a nearer `data-rest`."""
    return [_Page(seed * 1_000_003 + i).html() for i in range(n)]
