"""Labelled pages of drawn layouts, to train the block labeller on.

Words are drawn at random for article and rest alike, so that a labeller has to go by structure,
by lengths and links, and by the few words that such parts of pages really share.
"""

from __future__ import annotations

import random

#: Begins each text that belongs to the article; a character that pages do not use.
MARK = ""

# Words that names of page parts use, in markup and in text.
ARTICLE_NAMES = "article content post entry story main body text post-content entry-content article-body".split()
ASIDE_NAMES = "sidebar side widget related promo aside right-col recommended popular trending".split()
AD_NAMES = "ad ads advert advertisement sponsor sponsored banner ad-slot promo-box adsbox".split()
NAV_NAMES = "nav menu navigation breadcrumb breadcrumbs topnav navbar links pagination tags".split()
NOTICE_NAMES = "cookie cookie-notice notice consent alert banner gdpr popup modal overlay".split()
COMMENT_NAMES = "comments comment comment-list replies discussion responses disqus".split()
FOOTER_NAMES = "footer foot copyright legal bottom site-footer".split()
HEADER_NAMES = "header masthead top site-header branding logo".split()
FORM_NAMES = "form search newsletter subscribe login signup contact".split()
REST_WORDS = (
    "menu home login search subscribe cookie cookies accept privacy policy copyright rights reserved "
    "advertisement sponsored share tweet comments reply related read more contact about terms "
    "accueil recherche connexion commentaires suite startseite suche anmelden kommentare mehr "
    "datenschutz inicio buscar comentarios aceptar contacto"
).split()

_PARTS = "an ber ci da en fo gu hi in ja ko le mi no os pe qui ra st ti un ver wo xa yo zu é ü ñ ch th ing".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.bare = rng.random() < 0.15

    def word(self) -> str:
        return "".join(self.rng.choice(_PARTS) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        out = [self.word() for _ in range(n)]
        out[0] = out[0].capitalize()
        if self.rng.random() < 0.1:
            out = [w + self.rng.choice(["###", "$$$", "&amp;&amp;", "%%%"]) for w in out]
        return " ".join(out) + self.rng.choice([".", ".", ".", "", "?", "!"])

    def rest(self, low: int, high: int) -> str:
        if self.rng.random() < 0.5:
            return " ".join(self.rng.choice(REST_WORDS) for _ in range(self.rng.randint(1, 3)))
        return self.words(low, high)

    def name(self, names: list[str]) -> str:
        if self.bare or self.rng.random() < 0.25:
            return ""
        return f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(names)}"'

    def box(self, inner: str, names: list[str], tags: str = "div div section") -> str:
        tag = self.rng.choice(tags.split())
        return f"<{tag}{self.name(names) if tag in ('div', 'section', 'td', 'table', 'ul', 'p') else ''}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        made = [f'<a href="/{self.word()}">{self.rest(1, 4)}</a>' for _ in range(self.rng.randint(low, high))]
        kind = self.rng.random()
        if kind < 0.7:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in made) + "</ul>"
        return " | ".join(made) if kind < 0.85 else "".join(f"<div>{a}</div>" for a in made)

    def some_length(self) -> tuple[int, int]:
        return self.rng.choice([(1, 2), (1, 6), (5, 30), (10, 60), (30, 120)])

    def text(self) -> str:
        words = self.words(*self.some_length())
        if self.rng.random() < 0.15:
            words = f"{words} <a href='/{self.word()}'>{self.word()}</a> {self.words(2, 8)}"
        return f"{MARK}{words}"

    def paragraph(self) -> str:
        kind = self.rng.random()
        if kind < 0.62:
            return f"<p>{self.text()}</p>"
        if kind < 0.74:
            return f"<p><b>{self.text()}<br><p>{self.text()}</p>"
        if kind < 0.80:
            return f"<h{(n := self.rng.randint(2, 4))}>{MARK}{self.words(1, 8)}</h{n}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{self.text()}</li>" for _ in range(self.rng.randint(1, 5))) + "</ul>"
        if kind < 0.90:
            return f"<blockquote>{self.text()}</blockquote>"
        if kind < 0.93:
            cells = "".join(f"<tr><td>{MARK}{self.words(1, 3)}</td><td>{MARK}{self.words(1, 3)}</td></tr>" for _ in range(3))
            return f"<table>{cells}</table>"
        if kind < 0.96:
            return f"<pre>{self.text()}</pre>"
        return f"<div>{self.text()}</div>"

    def aside(self) -> str:
        kind = self.rng.random()
        if kind < 0.4:
            return f"<aside{self.name(ASIDE_NAMES)}><h3>{self.rest(1, 4)}</h3>{self.links(2, 6)}</aside>"
        if kind < 0.7:
            return f'<div class="{self.rng.choice(ASIDE_NAMES)}"><h3>{self.rest(1, 4)}</h3><p>{self.words(3, 40)}</p></div>'
        return f'<div class="{self.rng.choice(ASIDE_NAMES)}">{self.links(2, 6)}</div>'

    def advert(self) -> str:
        inner = self.words(*self.some_length())
        inner = inner if self.rng.random() < 0.6 else f'<a href="/x">{inner}</a>'
        tag = self.rng.choice(["div", "div", "div", "aside", "section", "p"])
        return f'<{tag} {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(AD_NAMES)}">{inner}</{tag}>'

    def notice(self) -> str:
        return f'<div class="{self.rng.choice(NOTICE_NAMES)}"><p>{self.words(4, 40)}</p><button>{self.rest(1, 2)}</button></div>'

    def form(self) -> str:
        return f"<form{self.name(FORM_NAMES)}><p>{self.rest(2, 12)}</p><label>{self.rest(1, 3)}</label><input type=text></form>"

    def comments(self) -> str:
        one = [
            f'<li class="comment"><b>{self.word()}</b><p>{self.words(2, 60)}</p></li>'
            if self.rng.random() < 0.5
            else f'<div class="comment"><span>{self.word()}</span><p>{self.words(2, 60)}</p></div>'
            for _ in range(self.rng.randint(1, 6))
        ]
        tag = self.rng.choice(["div", "section", "ol"])
        return f'<{tag} {self.rng.choice(["class", "id"])}="{self.rng.choice(COMMENT_NAMES)}"><h3>{self.rest(1, 3)}</h3>{"".join(one)}</{tag}>'

    def article(self) -> str:
        parts = [f"<h1>{MARK}{self.words(1, 14)}</h1>"] if self.rng.random() < 0.85 else []
        for _ in range(self.rng.choice([1, 2, 4, 8, 14, 25])):
            parts.append(self.paragraph())
            chance = self.rng.random()
            if chance < 0.03:
                parts.append(self.advert())
            elif chance < 0.05:
                parts.append(self.aside())
            elif chance < 0.06:
                parts.append(self.form())
        inner = "".join(parts)
        kind = self.rng.random()
        if kind < 0.55:
            return f"<article{self.name(ARTICLE_NAMES)}>{inner}</article>"
        if kind < 0.7:
            return f"<main>{inner}</main>"
        if kind < 0.93:
            return f'<div {self.rng.choice(["class", "id"])}="{self.rng.choice(ARTICLE_NAMES)}">{inner}</div>'
        return inner

    def html(self) -> str:
        maybe = lambda chance, part: part if self.rng.random() < chance else ""
        title = self.words(2, 8)
        head = f"<head><meta charset=utf-8><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        nav = f"<nav{self.name(NAV_NAMES)}>{self.links(3, 9)}</nav>"
        if self.rng.random() < 0.3:
            nav = f'<div class="{self.rng.choice(NAV_NAMES)}">{self.links(3, 9)}</div>'
        header = f"<header{self.name(HEADER_NAMES)}><h1>{self.words(1, 4)}</h1><p>{self.words(2, 10)}</p>{maybe(0.5, nav)}</header>"
        if self.rng.random() < 0.3:
            header = f'<div class="{self.rng.choice(HEADER_NAMES)}"><p>{self.words(1, 8)}</p></div>'
        foot = f"&copy; {self.word()}.example &middot; {self.rest(1, 12)}"
        foot = foot if self.rng.random() < 0.5 else f"<p>{foot}</p>{self.links(1, 5)}"
        footer = f"<footer{self.name(FOOTER_NAMES)}>{foot}</footer>"
        if self.rng.random() < 0.25:
            footer = f'<div class="{self.rng.choice(FOOTER_NAMES)}">{foot}</div>'
        body = [
            maybe(0.2, self.notice()),
            maybe(0.3, header),
            maybe(0.85, nav),
            maybe(0.5, f"<!-- {self.word()} -->"),
            maybe(0.6, self.advert()),
            maybe(0.15, self.aside()),
            self.article(),
            maybe(0.2, self.form()),
            maybe(0.3, self.comments()),
            maybe(0.3, self.aside()),
            maybe(0.25, self.advert()),
            maybe(0.85, footer),
            maybe(0.08, self.notice()),
        ]
        end = "</body></html>" if self.rng.random() < 0.6 else ""
        return f'<!DOCTYPE html><html lang="en">{head}<body>{"".join(body)}{end}'


def draw_pages(pages: int, seed: int) -> list[str]:
    """Html of drawn pages, with MARK before each text of the article."""
    return [_Page(random.Random(f"{seed}-{k}")).html() for k in range(pages)]
