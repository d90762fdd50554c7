"""Made-up pages of many layouts, whose main text is known, to train the block labeller on."""

from __future__ import annotations

import random

import numpy as np

from .html_blocks import Block, split_blocks

#: Stands in front of main text in a made-up page, and is taken out again.
SIGN = "⁣"

# Names that sites give to their parts.
MAIN = "content post entry story article-body post-content main-content entry-content article text body-text article__body single page-content"
PARTS = {
    "nav": "menu nav navbar main-menu navigation breadcrumb breadcrumbs toc topnav site-nav links tabs pagination skip-link",
    "header": "header site-header masthead top banner branding logo topbar page-header",
    "footer": "footer site-footer bottom colophon copyright legal credits footer-links page-footer",
    "sidebar": "sidebar side widget widget-area aside rail right-column left-column secondary related recommended popular trending most-read see-also",
    "ad": "ad ads advert advertisement sponsored promo banner-ad ad-slot adsense dfp commercial teaser",
    "notice": "cookie cookie-notice consent notice alert gdpr privacy-banner announcement popup modal overlay toast warning disclaimer message",
    "form": "form search search-form newsletter signup subscribe login contact-form comment-form register",
    "comments": "comments comment-list comment discussion respond replies reader-comments thread disqus user-comments reply feedback",
    "share": "share social sharing share-buttons follow tags meta byline-links tools print",
}


class PageMaker:
    def __init__(self, seed: int):
        self.draw = random.Random(seed)
        letters = "aeiouäéóünrtslmdkpbgvfh"
        self.syllables = ["".join(self.draw.choices(letters, k=self.number(1, 3))) for _ in range(300)]

    def number(self, low: int, high: int) -> int:
        return self.draw.randint(low, high)

    def chance(self, p: float) -> bool:
        return self.draw.random() < p

    def pick(self, names: str) -> str:
        return self.draw.choice(names.split())

    def words(self, low: int, high: int) -> str:
        found = ["".join(self.draw.choices(self.syllables, k=self.number(1, 3))) for _ in range(self.number(low, high))]
        joint = " | " if self.chance(0.05) else self.draw.choice(["*** ", "!! "]) if self.chance(0.05) else " "
        return joint.join(found)

    def sentence(self, low: int = 3, high: int = 30) -> str:
        text = self.words(low, high).capitalize()
        return text + ("" if self.chance(0.15) else self.draw.choice(list("..!?")))

    def passage(self) -> str:
        return " ".join(self.sentence() for _ in range(self.number(1, 5)))

    def named(self, tag: str, names: str, plain: float = 0.15) -> str:
        """An opening tag with a class, an id or neither."""
        if self.chance(plain):
            return f"<{tag}>"
        name = self.pick(names)
        if self.chance(0.2):
            name += " " + self.pick(names)
        key = "id" if self.chance(0.3) else "class"
        quote = '"' if self.chance(0.9) else "'"
        return f"<{tag} {key}={quote}{name}{quote}>"

    def links(self, n: int) -> str:
        inner = [f'<a href="/{k}">{self.words(1, 3).capitalize()}</a>' for k in range(n)]
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{x}</li>" for x in inner) + "</ul>"
        return " ".join(inner) if self.chance(0.5) else "".join(f"<div>{x}</div>" for x in inner)

    def text_in(self, tag: str, main: bool, text: str) -> str:
        sign = SIGN if main else ""
        if self.chance(0.2):
            first, _, rest = text.partition(" ")
            text = f"<b>{first}</b> {rest}" if self.chance(0.6) else f"<b>{first} {rest}"
        elif main and self.chance(0.15):
            first, _, rest = text.partition(" ")
            text = f'<a href="/x">{first}</a> {rest}'
        end = "" if tag == "p" and self.chance(0.1) else f"</{tag}>"
        return f"<{tag}>{sign}{text}{'<br>' if self.chance(0.1) else ''}{end}"

    def part(self, kind: str) -> str:
        names = PARTS[kind]
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        tag = semantic if semantic and self.chance(0.7) else str(self.draw.choice(["div", "div", "section", "ul" if kind == "nav" else "div"]))
        opening = self.named(tag, names, plain=0.5 if tag == semantic else 0.0)
        if kind == "nav" and self.chance(0.2):
            opening = '<div role="navigation">'
            tag = "div"
        if kind == "nav":
            inner = self.links(self.number(2, 9))
            if tag == "ul":
                inner = "".join(f'<li><a href="/">{self.words(1, 2)}</a></li>' for _ in range(self.number(2, 7)))
        elif kind == "header":
            inner = self.text_in(self.draw.choice(["div", "h1", "p", "span"]), False, self.words(1, 5).capitalize())
            inner += self.part("nav") if self.chance(0.5) else self.words(2, 8)
        elif kind == "footer":
            inner = f"&copy; {self.words(1, 2)} &middot; {self.sentence()}" if self.chance(0.6) else self.text_in("p", False, self.sentence())
            inner += self.links(self.number(1, 5)) if self.chance(0.5) else ""
        elif kind == "sidebar":
            inner = self.text_in(self.draw.choice(["h2", "h3", "h4"]), False, self.words(1, 4)) if self.chance(0.7) else ""
            inner += self.links(self.number(2, 6)) if self.chance(0.6) else self.text_in("p", False, self.passage())
        elif kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input type=text>" if self.chance(0.7) else self.text_in("p", False, self.sentence())
            inner += f"<button>{self.words(1, 2)}</button>"
            if self.chance(0.3):
                inner += "<select>" + "".join(f"<option>{self.words(1, 2)}" for _ in range(3)) + "</select>"
            if tag != "form":
                inner = f"<form>{inner}</form>"
        elif kind == "comments":
            inner = self.text_in("h3", False, self.words(1, 3)) if self.chance(0.6) else ""
            for _ in range(self.number(1, 5)):
                one = self.text_in("p", False, self.passage()) if self.chance(0.7) else self.passage()
                who = f"<b>{self.words(1, 2)}</b>" if self.chance(0.5) else ""
                box = str(self.draw.choice(["div", "li", "article"]))
                inner += f"{self.named(box, 'comment comment-body reply', 0.5)}{who}{one}</{box}>"
            inner += self.part("form") if self.chance(0.3) else ""
        else:  # ad, notice, share
            inner = self.passage() if self.chance(0.4) else self.sentence(2, 12)
            if self.chance(0.3):
                inner = self.text_in("p", False, inner)
            inner += f' <a href="/">{self.words(1, 3)}</a>' if self.chance(0.3) else ""
            inner += f"<button>{self.words(1, 2)}</button>" if kind == "notice" and self.chance(0.3) else ""
        return f"{opening}{inner}</{tag}>"

    def article(self) -> str:
        inner = self.text_in(self.draw.choice(["h1", "h1", "h2"]), True, self.words(2, 12).capitalize()) if self.chance(0.85) else ""
        if inner and self.chance(0.15):
            inner = f"<header>{inner}</header>"
        for _ in range(self.number(1, 13)):
            roll = self.draw.random()
            if roll < 0.78:
                inner += self.text_in("p", True, self.passage() if self.chance(0.85) else self.words(1, 4))
            elif roll < 0.84:
                inner += self.text_in(self.draw.choice(["h2", "h3"]), True, self.words(1, 8).capitalize())
            elif roll < 0.88:
                items = "".join(self.text_in("li", True, self.words(1, 15)) for _ in range(self.number(2, 5)))
                inner += f"<ul>{items}</ul>" if self.chance(0.6) else f"<ol>{items}</ol>"
            elif roll < 0.91:
                inner += self.text_in(self.draw.choice(["blockquote", "pre", "figcaption"]), True, self.sentence())
            elif roll < 0.93:
                cells = "".join(self.text_in("td", True, self.words(1, 3)) for _ in range(4))
                inner += f"<table><tr>{cells}</tr></table>"
            else:
                inner += self.part(self.draw.choice(["ad", "ad", "sidebar", "share", "form", "notice"]))
        roll = self.draw.random()
        tag = "article" if roll < 0.5 else "main" if roll < 0.62 else str(self.draw.choice(["div", "section", "td", "div"]))
        opening = f"<{tag}>" if tag in ("article", "main") and self.chance(0.6) else self.named(tag, MAIN, 0.25)
        if self.chance(0.12):
            inner += self.part("comments")
        out = f"{opening}{inner}</{tag}>"
        if tag == "td":
            out = f"<table><tr>{out}</tr></table>"
        return f"<main>{out}</main>" if tag != "main" and self.chance(0.15) else out

    def page(self) -> str:
        before = [k for k in ("notice", "header", "nav", "ad", "form", "sidebar", "share") if self.chance(0.4)]
        after = [k for k in ("share", "sidebar", "comments", "ad", "form", "nav", "notice") if self.chance(0.35)]
        after += ["footer"] if self.chance(0.85) else []
        body = "".join(map(self.part, before)) + self.article() + "".join(map(self.part, after))
        if self.chance(0.25):
            body = f'{self.named("div", "wrapper container page site layout row grid", 0.2)}{body}</div>'
        end = "" if self.chance(0.1) else "</body></html>"
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}{end}"


def training_pages(count: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks of made-up pages, and whether each is main text."""
    maker, pages = PageMaker(seed), []
    for _ in range(count):
        blocks = split_blocks(maker.page())
        main = np.array([SIGN in b.text for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace(SIGN, "") or "x"
        if blocks:
            pages.append((blocks, main))
    return pages
