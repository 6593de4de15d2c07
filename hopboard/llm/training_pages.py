"""Web pages with known main text, put together at random to teach extraction.

Every page is a sequence of parts: menus, headers, notices, adverts, an article or none, comments, related links and
footers. A part picks a tag and attribute names that are usual for its kind, or none; texts are runs of given words.
"""

from __future__ import annotations

from html import escape
from random import Random

# Starts each text of the article; a private character that no page has.
MARK = "\ue000"

# Names that pages usually give to their parts, and tags these are in.
_NAMES = {
    "article": "article post entry content post-content entry-content article-body article__body story story-body text main-content mainContent "
    "page-content body-text hentry blog-post postBody news-article prose main",
    "menu": "nav navbar menu main-menu topnav breadcrumbs breadcrumb navigation site-nav mainMenu nav-links tabs pagination pager toc language-switch",
    "header": "header site-header masthead top top-bar branding logo page-header banner",
    "footer": "footer site-footer copyright bottom colophon footer-links legal credits page-footer imprint",
    "side": "sidebar side aside widget widgets related related-posts recommended popular trending tags share social social-share author-box "
    "read-more teaser promo-list most-read more-stories blogroll",
    "advert": "ad ads advert advertisement sponsored sponsor promo banner-ad adsbox ad-slot google-ads commercial partner-offer dfp promotion",
    "notice": "cookie cookie-banner cookie-notice consent gdpr notice alert popup modal newsletter subscribe paywall privacy-notice overlay "
    "toast disclaimer site-message",
    "form": "search search-form login login-form contact contact-form subscribe-form signup registration feedback poll",
    "comments": "comments comment-list comment-section discussion responses replies disqus comments-area user-comments reactions thread",
    "comment": "comment comment-body reply response comment-item user-comment message",
}
_TAGS = {
    "article": "article main section div div div td",
    "menu": "nav nav div ul div",
    "header": "header header div",
    "footer": "footer footer div",
    "side": "aside aside div section ul",
    "advert": "div div aside section p ins",
    "notice": "div div section aside dialog p",
    "form": "form form div",
    "comments": "section div div ol ul",
    "comment": "div div li article",
}
_ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "side": "complementary", "notice": "alert", "form": "search", "article": "main"}


class _Writer:
    def __init__(self, words: list[str], random: Random):
        self.words = words or _invented(random)
        self.random = random
        self.unclosed = random.random() < 0.3
        self.bare = random.random() < 0.15

    def one_of(self, values: str) -> str:
        return self.random.choice(values.split())

    def chance(self, p: float) -> bool:
        return self.random.random() < p

    def length(self, most: int) -> int:
        """Spread evenly over orders of size."""
        return max(1, round(most ** self.random.random()))

    def text(self, n: int) -> str:
        """A run of words, beginning anywhere in those given; escaped."""
        at = self.random.randrange(len(self.words))
        run = self.words[at : at + n]
        while len(run) < n:
            run += self.words[: n - len(run)]
        return escape(" ".join(run), quote=False)

    def part(self, kind: str, inside: str) -> str:
        """An element of a kind around what is inside; its tag, its attributes or both tell the kind, or neither does."""
        tag = self.one_of(_TAGS[kind])
        wrapped = self.wrapped(tag, kind, inside)
        return f"<table><tr>{wrapped}</tr></table>" if tag == "td" else wrapped

    def wrapped(self, tag: str, kind: str, inside: str) -> str:
        attributes = ""
        if not self.bare and (tag in ("div", "section", "p", "ul", "ol", "li", "td", "ins") or self.chance(0.4)):
            if self.chance(0.9):
                names = " ".join(self.random.sample(_NAMES[kind].split(), 2 if self.chance(0.3) else 1))
                attributes = f' {self.one_of("class class class id")}="{names}"'
            if kind in _ROLES and self.chance(0.1):
                attributes += f' role="{_ROLES[kind]}"'
        end = "" if tag in ("p", "li", "td") and self.unclosed else f"</{tag}>"
        return f"<{tag}{attributes}>{inside}{end}"

    def links(self, n: int, words: int) -> list[str]:
        return [f'<a href="/{i}">{self.text(self.length(words))}</a>' for i in range(n)]

    def list_of(self, items: list[str]) -> str:
        end = "" if self.unclosed else "</li>"
        return "<ul>" + "".join(f"<li>{item}{end}" for item in items) + "</ul>"

    def menu(self) -> str:
        links = self.links(self.random.randint(2, 12), 3)
        inside = self.list_of(links) if self.chance(0.7) else self.one_of("| · > »").join(links) if self.chance(0.5) else " ".join(links)
        return self.part("menu", inside)

    def header(self) -> str:
        title = self.text(self.length(4))
        inside = self.random.choice([f"<h1>{title}</h1>", f"<div>{title}</div>", f'<a href="/">{title}</a>', f"<p>{title}</p><p>{self.text(6)}</p>"])
        return self.part("header", inside + (self.menu() if self.chance(0.4) else ""))

    def footer(self) -> str:
        owner = f"{self.one_of('&copy; © &#169; Copyright')} {self.text(self.length(8))}"
        if self.chance(0.4):
            owner += f" {self.one_of('&middot; | · -')} {self.text(self.length(20))}"
        inside = owner if self.chance(0.6) else f"<p>{owner}</p>"
        return self.part("footer", inside + (self.list_of(self.links(4, 3)) if self.chance(0.4) else ""))

    def side(self) -> str:
        head = f"<h3>{self.text(self.length(4))}</h3>" if self.chance(0.6) else ""
        if self.chance(0.6):
            return self.part("side", head + self.list_of(self.links(self.random.randint(2, 8), 10)))
        return self.part("side", head + "".join(f"<p>{self.text(self.length(40))}</p>" for _ in range(self.random.randint(1, 4))))

    def advert(self) -> str:
        text = self.text(self.length(40))
        inside = self.random.choice([text, f'<a href="/x">{text}</a>', f"<p>{text}</p>", f"<h4>{self.text(3)}</h4><p>{text}</p>"])
        return ("<!-- ad -->" if self.chance(0.3) else "") + self.part("advert", inside)

    def notice(self) -> str:
        text = self.text(self.length(60))
        button = f"<button>{self.text(1)}</button>" if self.chance(0.5) else ""
        return self.part("notice", (text if self.chance(0.4) else f"<p>{text}</p>") + button)

    def form(self) -> str:
        fields = "".join(f'<label>{self.text(self.length(3))}</label><input name="f">' for _ in range(self.random.randint(1, 4)))
        if self.chance(0.5):
            fields = f"<p>{self.text(self.length(15))}</p>{fields}"
        return self.part("form", fields + f"<button>{self.text(1)}</button>")

    def comments(self) -> str:
        def comment() -> str:
            tag = self.one_of("b div h4 span")
            author = f"<{tag}>{self.text(self.length(3))}</{tag}>"
            texts = "".join(f"<p>{self.text(self.length(80))}</p>" for _ in range(self.random.randint(1, 2)))
            return self.part("comment", author + texts + (f'<a href="#">{self.text(1)}</a>' if self.chance(0.4) else ""))

        head = f"<h3>{self.text(self.length(4))}</h3>" if self.chance(0.6) else ""
        return self.part("comments", head + "".join(comment() for _ in range(self.random.randint(1, 6))))

    def content(self, n: int) -> str:
        text = self.text(n)
        words = text.split(" ")
        if len(words) > 8 and self.chance(0.2):
            at = self.random.randrange(len(words) - 4)
            tag = self.one_of("a b em span")
            words[at : at + 3] = [f'<{tag} href="/y">{" ".join(words[at : at + 3])}</{tag}>']
        return MARK + " ".join(words)

    def article(self) -> str:
        blocks = [f"<h1>{self.content(self.length(14))}</h1>"] if self.chance(0.8) else []
        end = "" if self.unclosed else "</p>"
        for _ in range(self.length(25) if self.chance(0.9) else 1):
            kind = self.random.random()
            if kind < 0.72:
                blocks.append(f"<p>{self.content(self.length(200))}{end}")
            elif kind < 0.78:
                blocks.append(f"<p><b>{self.content(self.length(25))}<br>{end}")
            elif kind < 0.86:
                tag = self.one_of("h2 h3")
                blocks.append(f"<{tag}>{self.content(self.length(8))}</{tag}>")
            elif kind < 0.92:
                blocks.append(self.list_of([self.content(self.length(25)) for _ in range(self.random.randint(2, 6))]))
            elif kind < 0.95:
                blocks.append(f"<blockquote><p>{self.content(self.length(60))}</blockquote>")
            elif kind < 0.97:
                cells = "".join(f"<td>{self.content(self.length(6))}</td>" for _ in range(3))
                blocks.append(f"<table><tr>{cells}</tr></table>")
            else:
                blocks.append(f"<figure><img src=x><figcaption>{self.content(self.length(15))}</figcaption></figure>")
        for extra in (self.advert, self.side, self.notice):
            if len(blocks) > 1 and self.chance(0.08):
                blocks.insert(self.random.randrange(1, len(blocks)), extra())
        if self.chance(0.04):
            return "".join(blocks)
        inside = self.part("article", "".join(blocks))
        return f"<main>{inside}</main>" if self.chance(0.15) else f"<div>{inside}</div>" if self.chance(0.15) else inside

    def page(self) -> str:
        parts = [part() for part, p in ((self.notice, 0.15), (self.header, 0.4), (self.menu, 0.8), (self.form, 0.15), (self.advert, 0.45), (self.side, 0.2)) if self.chance(p)]
        if self.chance(0.3):
            self.random.shuffle(parts)
        middle = [self.article()] if self.chance(0.95) else []
        if self.chance(0.3):
            middle.insert(self.random.randint(0, len(middle)), self.side())
        inside = "".join(middle)
        if self.chance(0.25):
            inside = f'<div{"" if self.chance(0.4) else self.random.choice([" id=wrapper", " class=container", " id=page", " class=row", " class=layout"])}>{inside}</div>'
        after = [part() for part, p in ((self.comments, 0.3), (self.side, 0.25), (self.advert, 0.2), (self.form, 0.1), (self.notice, 0.1), (self.footer, 0.8)) if self.chance(p)]
        ends = "</body></html>" if self.chance(0.8) else ""
        head = f"<head><title>{self.text(5)}</title><style>p{{margin:0}}</style></head>" if self.chance(0.9) else ""
        return f"<!DOCTYPE html><html>{head}<body>{''.join(parts)}{inside}{''.join(after)}{ends}"


def _invented(random: Random) -> list[str]:
    """Words for pages where there are none to take: sentences of consonants and vowels."""
    word = lambda: "".join(random.choice("bdfgklmnprst") + random.choice("aeiou") for _ in range(random.randint(1, 4)))
    words = [word() for _ in range(5000)]
    for at in range(0, len(words), 9):
        words[at] = words[at].capitalize()
        words[at - 1] += "."
    return words


def training_pages(words: list[str], n: int, random: Random) -> list[str]:
    """`n` pages of runs of the words, the texts of whose articles start with MARK."""
    return [_Writer(words, random).page() for _ in range(n)]
