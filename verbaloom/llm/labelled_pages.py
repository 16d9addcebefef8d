"""Labelled pages for the extraction model: pages put together from parts whose role is known.

No given table says which part of a page is its main text, so the labels come from here.  Each
part is a piece of markup of one role; its names, nesting, order and text vary by a seeded
draw.  A page comes with the texts of its main blocks.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

SYLLABLES = "ba den lo mi ra su ten vor el an gri po que sil tur wen ou ch ax ny".split()
# Names that sites give to parts, by role.
MAIN = ["<article>", '<main>', '<div class="post-content">', '<div id="content">', '<div class="entry">',
        '<section class="article-body">', '<div class="story">', '<main class="page"><article class="post">', "<div>"]
NAV = ['<nav>', '<nav class="menu">', '<div class="menu">', '<ul id="navigation">', '<div class="navbar">',
       '<div class="breadcrumbs">', '<div id="top-menu">', '<div class="pagination">', '<header><nav>']
HEADER = ['<header>', '<div id="header">', '<div class="masthead">', '<header class="site-header">', '<div class="site-title">']
FOOTER = ['<footer>', '<div id="footer">', '<footer class="site-footer">', '<div class="copyright">', '<div class="bottom">']
SIDE = ['<aside>', '<div class="sidebar">', '<div id="side">', '<aside class="widget">', '<div class="related">',
        '<div class="social share">', '<section class="recommended">', '<div class="tags">']
ADS = ['<div class="ad">', '<div class="advert">', '<div class="ads banner">', '<div class="sponsored">', '<aside class="promo">',
       '<div id="advertisement">', '<ins class="ad-slot">', '<div class="promotion">']
NOTICES = ['<div class="cookie-notice">', '<div class="notice">', '<div id="consent">', '<div class="alert">',
           '<div class="gdpr banner">', '<div role="alert">', '<div class="popup modal">', '<div class="subscribe newsletter">']
FORMS = ['<form>', '<form class="search">', '<div class="login"><form>', '<form id="newsletter">', '<form class="contact">']
COMMENTS = ['<section class="comments">', '<div id="comments">', '<div class="comment-list">', '<ol class="commentlist">',
            '<section id="discussion">', '<div class="replies">', '<aside class="comments">']


def _closing(opening: str) -> str:
    names = [part.split()[0].strip("<>") for part in opening.replace("><", ">|<").split("|")]
    return "".join(f"</{n}>" for n in reversed(names))


class _Draw:
    def __init__(self, seed: int):
        self.pick = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        words = ["".join(self.pick.choices(SYLLABLES, k=self.pick.randint(1, 4))) for _ in range(self.pick.randint(low, high))]
        return " ".join(words)

    def sentences(self, low: int, high: int) -> str:
        text = self.words(low, high).capitalize()
        end = self.pick.choice([".", ".", ".", "!", "?", "", "###", " &amp;&amp;&amp;"])
        return text + end

    def wrap(self, options: list[str], body: str) -> str:
        opening = self.pick.choice(options)
        return opening + body + _closing(opening)

    def links(self) -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(self.pick.randint(2, 8))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.pick.random() < 0.7 else " ".join(items)

    def prose(self) -> str:
        """Text as it also stands in parts that are not the main text."""
        return self.pick.choice(["{}", "<p>{}</p>", "<p>{}</p>", "<span>{}</span>"]).format(self.sentences(1, 40))

    def boilerplate(self) -> list[str]:
        p = self.pick
        parts = [
            (0.8, lambda: self.wrap(NAV, self.links())),
            (0.4, lambda: self.wrap(HEADER, p.choice(["<h1>{}</h1>", "<p>{}</p>", "{}"]).format(self.words(1, 6)))),
            (0.6, lambda: self.wrap(ADS, self.prose())),
            (0.4, lambda: self.wrap(NOTICES, self.prose())),
            (0.3, lambda: self.wrap(SIDE, p.choice([self.links, self.prose])())),
            (0.3, lambda: self.wrap(FORMS, f'<label>{self.words(1, 4)}</label><input name="q"><p>{self.words(1, 9)}</p><button>{self.words(1, 2)}</button>')),
        ]
        return [make() for chance, make in parts if p.random() < chance]

    def comments(self) -> str:
        items = [f'<{tag}{name}><p>{self.sentences(1, 60)}</p></{tag}>' for tag, name in
                 self.pick.choices([("div", ' class="comment"'), ("li", ""), ("article", ' class="comment"')], k=self.pick.randint(1, 4))]
        return self.wrap(COMMENTS, f"<h3>{self.words(1, 3)}</h3>" + "".join(items))

    def main(self, inner: bool) -> tuple[str, list[str]]:
        p, texts, body = self.pick, [], []
        title = self.words(1, 12).capitalize()
        if p.random() < 0.85:
            body.append(p.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>"]).format(title))
            texts.append(title)
        for _ in range(p.randint(1, 14)):
            text = self.sentences(1, p.choice([3, 20, 80]))
            form = p.choice(["<p>{}</p>"] * 6 + ["<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>",
                                                 "<ul><li>{}</li></ul>", "<div>{}</div>", "<section><p>{}</p></section>", "<pre>{}</pre>"])
            body.append(form.format(text))
            texts.append(text)
            if inner and p.random() < 0.12:
                body.append(p.choice([lambda: self.wrap(ADS, self.prose()), lambda: self.wrap(NOTICES, self.prose()),
                                      lambda: self.wrap(SIDE, self.links())])())
        if inner and p.random() < 0.25:
            body.append(self.comments())
        options = MAIN if p.random() < 0.5 else MAIN[:2]
        return self.wrap(options, "".join(body)), texts


def labelled_pages(count: int, seed: int = 7) -> Iterator[tuple[str, list[str]]]:
    """``count`` pairs of a page and the texts of its main blocks, character references undecoded."""
    for i in range(count):
        draw = _Draw(seed * 100_003 + i)
        main, texts = draw.main(inner=i % 3 == 0)
        before, after = draw.boilerplate(), draw.boilerplate()
        if draw.pick.random() < 0.35:
            after.insert(0, draw.comments())
        if draw.pick.random() < 0.8:
            after.append(draw.wrap(FOOTER, draw.prose()))
        head = f"<head><title>{draw.words(1, 8)}</title><style>p{{margin:0}}</style></head>"
        end = draw.pick.choice(["</body></html>", "</body></html>", ""])
        yield f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{main}{''.join(after)}{end}", texts
