"""Labelled pages for the extraction model: page layouts as people write them,
filled with invented words, with ``MARK`` at each content block.

A layout picks one form each for the frame, head, menu, notice, advert, main
part, sidebar, comments and foot. The same number gives the same pages.
"""

from __future__ import annotations

import random

MARK = "\ue000"  # a private-use character; it never reaches a feature


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ung", "ei", "ción", "que", "é", "ou", "ß"]

    def word(self) -> str:
        return "".join(self.rng.choice(self.parts) for _ in range(self.rng.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(a, b)))

    def sentence(self) -> str:
        s = self.words(3, 14).capitalize()
        if self.rng.random() < 0.4:
            s += ", " + self.words(2, 8)
        return s + "."

    def prose(self, a: int, b: int) -> str:
        text = " ".join(self.sentence() for _ in range(self.rng.randint(a, b)))
        style = self.rng.random()
        if style < 0.08:  # shouted, marked and listed texts are content too
            return text.upper().replace(" ", "!! ")
        if style < 0.16:
            return " ".join(w + self.rng.choice(["###", "***", "$$$", "%%%"]) for w in text.split())
        if style < 0.22:
            return text.replace(" ", " | ")
        return text

    def link(self, a: int = 1, b: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(a, b)}</a>'

    def links(self, a: int, b: int) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.rng.randint(a, b))) + "</ul>"


def _menu(w, r):
    return r.choice([
        lambda: f"<nav>{w.links(3, 8)}</nav>", lambda: f'<div class="menu">{w.links(3, 8)}</div>',
        lambda: f'<div id="navbar">{" | ".join(w.link() for _ in range(5))}</div>',
        lambda: f'<ul class="nav">{"".join(f"<li>{w.link()}" for _ in range(5))}</ul>',
        lambda: f'<div role="navigation">{w.links(3, 6)}</div>', lambda: f"<nav>{w.link()} {w.link()} {w.link()}</nav>",
    ])()


def _head(w, r):
    inner = r.choice([w.words(1, 4), f"<h2>{w.words(1, 3)}</h2>", f"<p>{w.sentence()}</p>", w.link(),
                      f"<h1>{w.words(1, 2)}</h1><p>{w.words(2, 6)}</p>"])
    return r.choice(["", f"<header>{inner}</header>", f'<div class="header">{inner}</div>', f'<div id="masthead">{inner}</div>',
                     f'<div class="site-header banner"><div class="logo">{inner}</div></div>',
                     f"<header>{inner}{_menu(w, r)}</header>"])


def _notice(w, r):
    text = w.prose(1, 2)
    return r.choice(["", "", f'<div class="cookie-notice"><p>{text}</p></div>', f'<div id="consent">{text} {w.link()}</div>',
                     f'<aside class="notice">{text}</aside>', f'<div class="alert">{text}</div>',
                     f'<div role="dialog"><p>{text}</p></div>', f'<div class="popup newsletter"><p>{text}</p><form>{w.words(1, 3)}</form></div>'])


def _advert(w, r):
    text = w.prose(1, 4)
    return r.choice([f'<div class="ad">{text}</div>', f'<div class="ad">{text}</div>', f'<div class="advert"><p>{text}</p></div>',
                     f'<aside class="sponsor">{text}</aside>', f'<div id="ads">{w.link(2, 6)}</div>',
                     f'<div class="promo-box"><h3>{w.words(1, 4)}</h3><p>{text}</p></div>', f'<div class="advertisement">{w.words(2, 5)}</div>'])


def _paragraph(w, r):
    text = MARK + (w.prose(1, 6) if r.random() < 0.85 else w.words(1, 5) + ".")
    if r.random() < 0.3:
        text = text.replace(" ", f" {w.link()} ", 1)
    return r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text.replace(' ', ' <em>', 1)}</em></p>"])


def _extra(w, r):
    return r.choice([
        lambda: f"<h2>{MARK}{w.words(1, 6)}</h2>", lambda: f"<h3>{MARK}{w.words(1, 4)}</h3>",
        lambda: "<ul>" + "".join(f"<li>{MARK}{w.words(1, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
        lambda: f"<blockquote><p>{MARK}{w.prose(1, 3)}</p></blockquote>", lambda: f"<pre>{MARK}{w.words(3, 20)}</pre>",
        lambda: f"<figure><img src='x'><figcaption>{MARK}{w.sentence()}</figcaption></figure>",
        lambda: "<table>" + "".join(f"<tr><td>{MARK}{w.words(1, 3)}<td>{MARK}{w.words(1, 3)}" for _ in range(3)) + "</table>",
        lambda: f"<div>{_paragraph(w, r)}</div>", lambda: f"<section>{_paragraph(w, r)}{_paragraph(w, r)}</section>",
    ])()


def _aside(w, r):
    return r.choice([
        lambda: _advert(w, r), lambda: f'<div class="share social">{w.link()} {w.link()}</div>',
        lambda: f'<div class="related"><h3>{w.words(1, 3)}</h3>{w.links(2, 5)}</div>',
        lambda: f'<form class="newsletter"><p>{w.sentence()}</p><input name="x"><label>{w.words(1, 2)}</label></form>',
        lambda: f'<div class="breadcrumbs">{w.link()} › {w.link()}</div>', lambda: f"<nav>{w.link()} {w.link()}</nav>",
        lambda: f"<aside><p>{w.prose(1, 2)}</p></aside>", lambda: f"<form><p>{w.words(2, 6)}</p></form>",
    ])()


def _body(w, r):
    blocks = [_paragraph(w, r) for _ in range(r.choice([1, 2, 3, 6, 12]))]
    if r.random() < 0.2:  # verse, word lists, logs: many short lines
        same = f"{w.words(1, 3).capitalize()}, {w.word()}."
        line = r.choice([lambda: w.words(1, 4) + r.choice(["", ".", ",", " |"]), w.sentence, lambda: same])
        blocks = [f"<p>{MARK}{line()}</p>" for _ in range(r.choice([2, 5, 30, 120]))]
    for _ in range(r.choice([0, 0, 1, 3])):
        blocks.insert(r.randint(0, len(blocks)), _extra(w, r))
    for _ in range(r.choice([0, 0, 0, 1, 2])):
        blocks.insert(r.randint(0, len(blocks)), _aside(w, r))
    title = f"<h1>{MARK}{w.words(1, 9)}</h1>"
    title = r.choice([title, title, title, "", f"<header>{title}</header>", f'<div class="entry-header">{title}</div>'])
    inner = title + "".join(blocks)
    return r.choice([
        f"<article>{inner}</article>", f"<article>{inner}</article>", f'<article class="post">{inner}</article>',
        f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f'<div class="content">{inner}</div>',
        f'<div id="main-content">{inner}</div>', f'<div class="post"><div class="entry-content">{inner}</div></div>',
        f'<section class="story">{inner}</section>', f'<div role="main">{inner}</div>', f'<div class="article-body">{inner}</div>',
        f"<div>{inner}</div>", f'<div class="text">{inner}</div>',
    ])


def _sidebar(w, r):
    inner = r.choice([w.links(3, 8), f"<h3>{w.words(1, 3)}</h3>{w.links(2, 6)}", f"<p>{w.prose(1, 3)}</p>", f"<h4>{w.words(1, 3)}</h4><p>{w.sentence()}</p>"])
    return r.choice(["", "", f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>', f'<div id="right-side"><div class="widget">{inner}</div></div>',
                     f'<div role="complementary">{inner}</div>'])


def _comments(w, r):
    one = [f"{w.prose(1, 4)}" for _ in range(r.randint(1, 6))]
    return r.choice([
        "", "", f'<section class="comments"><h2>{w.words(1, 2)}</h2>{"".join(f"<p>{x}</p>" for x in one)}</section>',
        f'<div id="comments"><ol>{"".join(f"<li><b>{w.word()}</b><p>{x}</p></li>" for x in one)}</ol></div>',
        f'<div class="reader-comments">{"".join(f"<div class=comment>{x}</div>" for x in one)}</div>',
        f'<div class="discussion">{"".join(f"<article class=comment><p>{x}</p></article>" for x in one)}</div>',
        f'<ul class="comment-list">{"".join(f"<li>{x}</li>" for x in one)}</ul>',
        f'<div id="respond"><form><p>{w.words(2, 6)}</p></form></div>',
    ])


def _foot(w, r):
    text = r.choice([f"&copy; {w.word()}.example.com &middot; {w.prose(1, 2)}", w.prose(1, 2), f"&copy; {w.words(1, 4)}", w.links(2, 5)])
    return r.choice([f"<footer>{text}</footer>", f"<footer><p>{text}</p></footer>", f'<div class="footer">{text}</div>',
                     f'<div id="copyright">{text}</div>', f'<div role="contentinfo">{text}</div>', ""])


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    """``n`` pages; every content block holds ``MARK``."""
    out = []
    for k in range(n):
        rng = random.Random(seed * 100_003 + k)
        w = _Writer(rng)
        top = [f(w, rng) for f in rng.sample([_head, _menu, _notice, _advert], 4)]
        rest = [f(w, rng) for f in rng.sample([_sidebar, _comments], 2)] + [_foot(w, rng)]
        main = _body(w, rng)
        if rng.random() < 0.15:  # comments inside the main part
            main = main[:main.rindex("</")] + _comments(w, rng) + main[main.rindex("</"):]
        inner = "".join([*top, main, *rest])
        frame = rng.choice(["{}", "{}", '<div id="page">{}</div>', '<div class="wrapper"><div class="container">{}</div></div>'])
        end = rng.choice(["</body></html>", "</body></html>", ""])
        out.append(f"<!DOCTYPE html><html><head><title>{w.words(1, 5)}</title><style>p{{}}</style></head><body>"
                   + frame.format(inner) + f'<script>var t="</p>";</script>{end}')
    return out
