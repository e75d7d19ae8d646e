"""Made-up pages whose main text is known, to train the extractor on: no labelled pages are installed.

A page is drawn from its number alone. Its parts (article, menus, headers, footers, sidebars, notices, adverts, forms, comments) take their
elements and attribute words from the lists below, are nested in wrappers, and come in varied order; texts are drawn from syllables, so nothing
depends on a language. ``data-y`` says what a part is: 1 main text, 2 what is cut, 0 what holds both.
"""

from __future__ import annotations

import random

LABEL = "data-y"
# Attribute words of page parts.
ARTICLE = "article content post entry story body main text page hentry blog news single detail read document prose copy".split()
ROOT = "page wrapper container site app root layout outer inner row col grid wrap columns viewport center shell".split()
PROSE = "lead intro para paragraph headline title byline caption quote highlight dropcap first".split()
MENU = "nav navbar navigation menu topnav mainmenu breadcrumb breadcrumbs tabs pager pagination links toolbar sitenav toc skip dropdown".split()
HEADER = "header masthead branding logo topbar sitehead banner top tagline".split()
FOOTER = "footer bottom copyright colophon legal foot imprint credits".split()
SIDE = "sidebar aside widget rail related recommended popular trending tags archive categories side secondary promo latest teaser".split()
NOTICE = "cookie consent gdpr notice alert popup modal overlay subscribe newsletter paywall warning message toast announcement disclaimer privacy signup".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promotion dfp adsense adslot partner commercial outbrain taboola".split()
FORM = "form search login register contact poll survey feedback".split()
COMMENTS = "comments comment respond replies reply disqus discussion thread responses commentlist reactions".split()
SHARE = "share social sharing follow buttons tools like".split()

SYLLABLES = "an ber ca de el fi go hi in ja ko la mer no or pe qua re st ta un vo we xi ya zo th er ing ion ment lich keit eau que los ado ción ß é ü".split()


class Maker:
    def __init__(self, number: int):
        self.r = random.Random(number * 7919 + 17)
        self.bare = self.r.random() < 0.15  # without attributes, where the element tells enough
        self.loose = self.r.random() < 0.3  # paragraphs are not closed
        self.style = self.r.choice(("",) * 8 + ("shout", "bars", "numbers", "unmarked", "addresses", "signs"))  # how the main text is written

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def sentence(self, low: int = 4, high: int = 24) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        text = " ".join(w + "," if self.r.random() < 0.08 else w for w in words)
        return text.capitalize().rstrip(",") + self.r.choice((".", ".", ".", "!", "?"))

    def styled(self, text: str) -> str:
        """Main text in the page's style: all kinds of writing are main text, if they stand where it does."""
        r, words = self.r, text.split(" ")
        if self.style == "shout":
            return "!! ".join(words).upper() + "!!"
        if self.style == "bars":
            return " | ".join(words)
        if self.style == "numbers":
            return " ".join(str(r.randint(1, 99999)) if r.random() < 0.5 else w for w in words)
        if self.style == "unmarked":
            return text.replace(".", "").replace(",", "").lower()
        if self.style == "addresses":
            return " ".join(f"{self.word()}.{r.randint(1, 99)}@mail.example.com" if r.random() < 0.2 else f"https://{self.word()}.example.org/{w}" if r.random() < 0.1 else w for w in words)
        if self.style == "signs":
            return " ".join(r.choice("#*$%{}=+-~^_") * r.randint(1, 4) if r.random() < 0.4 else w for w in words)
        return text

    def prose(self, most: int = 8, plain: bool = True) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(1, most)))
        out = out if plain else self.styled(out)
        if self.r.random() < 0.25:
            out = out.replace(" ", f" <{(t := self.r.choice(('b', 'i', 'em', 'strong', 'code')))}>", 1) + f"</{t}>"
        if self.r.random() < 0.2:
            out += f' <a href="/{self.word()}">{self.title(1, 4)}</a>'
        if self.r.random() < 0.1:
            out += f' <span class="{self.r.choice(PROSE)}">{self.title(1, 5)}</span>'
        return out + self.r.choice(("", "", "", "<br>", "&amp; " + self.word()))

    def title(self, low: int = 2, high: int = 10) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def named(self, words: list[str], own: float = 0.85) -> str:
        r = self.r
        if self.bare and own < 1 or r.random() > own:
            return f' class="{self.word()}{r.randint(1, 99)}"' if r.random() < 0.3 else ""
        first, second = r.choice(words), r.choice(words)
        extra = r.choice(("box", "block", "area", "section", "wrap", "inner", "list", "item", "module", "panel", "site", "global", "left", "right", "primary"))
        text = r.choice((first, first, f"{first}-{second}", f"{first}_{extra}", f"{first}-{extra}", f"{extra}-{first}", f"{first} {extra}", first.capitalize() + extra.capitalize(), first + extra))
        return f' {r.choice(("class", "class", "class", "id"))}="{text}"'

    def part(self, tags: tuple[str, ...], words: list[str], body: str, label: int | None = 2, own: float = 0.85) -> str:
        tag = self.r.choice(tags)
        if tag == "div" and label == 2:
            own = 1.0
        mark = f' {LABEL}="{label}"' if label is not None else ""
        return f"<{tag}{self.named(words, own)}{mark}>{body}</{tag}>"

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.title(1, 3)}</a>'

    def links(self, low: int = 2, high: int = 9) -> str:
        many = [self.link() for _ in range(self.r.randint(low, high))]
        kind = self.r.random()
        if kind < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" if self.r.random() < 0.9 else f"<li>{x}" for x in many) + "</ul>"
        return self.r.choice((" | ", " ", " &raquo; ", " &middot; ")).join(many)

    def menu(self) -> str:
        return self.part(("nav", "nav", "div", "ul" if self.r.random() < 0.2 else "div"), MENU, self.links())

    def controls(self) -> str:
        many = "".join(f"<label>{self.title(1, 2)}</label><input name={self.word()}>" for _ in range(self.r.randint(1, 4)))
        return many + (f"<select><option>{self.word()}<option>{self.word()}</select>" if self.r.random() < 0.3 else "") + f"<button>{self.title(1, 2)}</button>"

    def form(self) -> str:
        lead = f"<p>{self.sentence()}</p>" if self.r.random() < 0.4 else ""
        return self.part(("form",), FORM, lead + self.controls())

    def header(self) -> str:
        body = self.r.choice((f"<h1>{self.title(1, 4)}</h1>", f'<a href="/">{self.title(1, 3)}</a>', f"<p>{self.title(1, 4)}</p>", f"<div>{self.title(1, 4)}</div>", self.title(1, 4)))
        body += f"<p>{self.sentence(3, 9)}</p>" if self.r.random() < 0.4 else ""
        body += self.menu() if self.r.random() < 0.4 else ""
        return self.part(("header", "header", "div"), HEADER, body + (self.form() if self.r.random() < 0.2 else ""))

    def footer(self) -> str:
        sign = f"{self.r.choice(('&copy;', '&#169;', '(c)', '©'))} {self.r.randint(1999, 2026)} {self.title(1, 3)}"
        kind = self.r.random()
        host = f"&copy; {self.word()}.{self.word()}.com &middot; {self.sentence(4, 14)}"
        body = host if kind < 0.25 else f"<p>{sign}</p>" if kind < 0.6 else f"<p>{sign} {self.sentence()}</p>{self.links()}" if kind < 0.8 else sign + self.sentence()
        return self.part(("footer", "footer", "div"), FOOTER, body)

    def side(self) -> str:
        def widget() -> str:
            body = self.r.choice((self.links(), f"<p>{self.prose(2)}</p>", "".join(f"<div>{self.link()}<p>{self.sentence()}</p></div>" for _ in range(self.r.randint(1, 4)))))
            return f"<h3>{self.title(1, 4)}</h3>{body}" if self.r.random() < 0.7 else body

        many = [widget() for _ in range(self.r.randint(1, 4))]
        body = "".join(f"<div{self.named(SIDE, 0.5)}>{x}</div>" for x in many) if self.r.random() < 0.5 else "".join(many)
        return self.part(("aside", "aside", "div", "section"), SIDE, body, own=1.0)

    def notice(self) -> str:
        body = self.r.choice((f"<p>{self.sentence()}</p>", self.sentence(), f"<h4>{self.title(1, 4)}</h4><p>{self.prose(2)}</p>"))
        body += self.r.choice(("", f"<button>{self.title(1, 2)}</button>", self.link()))
        return self.part(("div", "div", "section", "dialog", "aside", "p"), NOTICE, body, own=1.0)

    def advert(self) -> str:
        body = self.r.choice((self.sentence(), f"<p>{self.prose(2)}</p>", f"{self.link()} {self.sentence()}", f"<h4>{self.title()}</h4>{self.sentence()}", f"<img src=x>{self.title()}"))
        return self.part(("div", "div", "aside", "section", "ins", "p", "span"), ADVERT, body, own=1.0)

    def share(self) -> str:
        return self.part(("div", "ul"), SHARE, self.links(2, 5), own=1.0)

    def related(self) -> str:
        return self.part(("section", "div", "aside"), SIDE, f"<h3>{self.title(1, 3)}</h3>" + self.links(), own=1.0)

    def comments(self) -> str:
        def one() -> str:
            who = self.r.choice((f"<b>{self.title(1, 2)}</b> ", f"<span>{self.title(1, 2)}</span> ", f"<h4>{self.title(1, 3)}</h4>", ""))
            said = f"<p>{self.prose(4)}</p>" if self.r.random() < 0.7 else self.prose(3)
            return who + said

        tag = self.r.choice(("div", "li", "article", "p"))
        many = "".join(f"<{tag}{self.named(COMMENTS, 0.6)}>{one()}</{tag}>" for _ in range(self.r.randint(1, 6)))
        many = f"<ol>{many}</ol>" if tag == "li" else many
        lead = f"<h3>{self.r.randint(1, 40)} {self.title(1, 2)}</h3>" if self.r.random() < 0.6 else ""
        return self.part(("section", "div", "div", "aside"), COMMENTS, lead + many + (self.form() if self.r.random() < 0.4 else ""), own=1.0)

    def junk(self) -> str:
        return self.r.choice((self.menu, self.side, self.notice, self.advert, self.form, self.share, self.related, self.advert))()

    def blocks(self) -> list[str]:
        """The article's own blocks."""
        r = self.r

        def one() -> str:
            kind = r.random()
            if kind < 0.68:
                p = f"<p{self.named(PROSE, 0.05)}>{self.prose(plain=False)}"
                return p if self.loose else p + "</p>"
            if kind < 0.76:
                return f"<h{(h := r.randint(2, 4))}>{self.title()}</h{h}>"
            if kind < 0.82:
                t = r.choice(("ul", "ol"))
                return f"<{t}>" + "".join(f"<li>{self.sentence(2, 14)}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>"
            if kind < 0.86:
                return f"<blockquote>{self.prose(3, plain=False)}</blockquote>"
            if kind < 0.89:
                return f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"
            if kind < 0.92:
                return "<table>" + "".join("<tr>" + "".join(f"<td>{self.title(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 5))) + "</table>"
            if kind < 0.94:
                return f"<pre>{self.title(3, 20)}</pre>"
            return f"<div{self.named(PROSE, 0.3)}>{self.prose(plain=False)}</div>"

        n = r.choice((0, 1, 1, 2, 3, 4, 6, 9, 14, 25))
        out = [one() for _ in range(n)]
        if r.random() < 0.8 or not out:
            title = f"<h1{self.named(PROSE, 0.2)}>{self.styled(self.title(1, 14))}</h1>"
            out.insert(0, f"<header>{title}</header>" if r.random() < 0.12 else title)
        if r.random() < 0.1:
            out = [f"{self.prose(plain=False)}<br><br>" for _ in range(r.randint(1, 5))]
        return out

    def article(self) -> str:
        r = self.r
        blocks = self.blocks()
        for _ in range(r.choice((0, 0, 0, 0, 1, 1, 2))):
            blocks.insert(r.randint(0, len(blocks)), self.junk())
        body = "".join(blocks)
        if r.random() < 0.25:
            body = f"<div{self.named(ARTICLE, 0.7)}>{body}</div>"
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        words = ARTICLE
        if r.random() < 0.06:
            return f'<table><tr><td {LABEL}="1">{body}</td><td {LABEL}="2">{self.links()}</td></tr></table>'
        return self.part((tag,), words, body, label=1, own=0.35 if tag in ("article", "main") else 0.9)

    def page(self) -> str:
        r = self.r
        core = self.article()
        after = [x() for x in (self.share, self.related, self.comments, self.comments) if r.random() < 0.22]
        if r.random() < 0.35:  # comments and such may stand within the element that holds the article
            tag = r.choice(("main", "div", "section"))
            core = f"<{tag}{self.named([*ARTICLE, *ROOT], 0.8)} {LABEL}=0>{core}{''.join(after)}</{tag}>"
            after = []
        parts = [core, *after]
        if r.random() < 0.4:
            parts.insert(r.choice((0, len(parts))), self.side())
        if r.random() < 0.1:
            parts = [f"<div{self.named(ROOT)} {LABEL}=0>{''.join(parts)}</div>"]
        top = [x() for x, p in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.6), (self.advert, 0.35), (self.form, 0.1), (self.menu, 0.1)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(top)
        end = [x() for x, p in ((self.advert, 0.12), (self.menu, 0.1), (self.footer, 0.8), (self.notice, 0.1)) if r.random() < p]
        parts = [*top, *parts, *end]
        if r.random() < 0.04:  # nothing but text
            return f'<body {LABEL}="1">' + "".join(self.blocks())
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            parts = [f"<div{self.named(ROOT)} {LABEL}=0>{''.join(parts)}</div>"]
        if r.random() < 0.03:
            parts = [f"<form {LABEL}=0>{''.join(parts)}</form>"]
        script = "<script>var t='<p>';</script>" if r.random() < 0.4 else ""
        return f"<!DOCTYPE html><html><head><title>{self.title()}</title>{script}</head><body>{''.join(parts)}" + r.choice(("</body></html>", ""))


def page(number: int) -> str:
    return Maker(number).page()
