"""Labelled pages for training, composed by rule.

No page of a corpus carries labels, so pages are put together from the parts that pages have,
each part written in the several ways that sites use: menus, mastheads, notices, adverts,
sidebars, comments, forms and footers around an article. Whoever builds a page knows which of
its blocks belong to the article. Words are invented, so nothing can be learned from them.
"""

from __future__ import annotations

import random

PAGES = 400
_SYLLABLES = "an ba ce do el fi ga ho in ju ka lo mi no or pe qu ra si ta un ve wo xi ya zu th ing".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(low, high)))


def _prose(r: random.Random, low: int, high: int) -> str:
    s = _words(r, low, high).capitalize()
    if r.random() < 0.1:
        s = s.upper() + "!!"
    return s + r.choice([".", ".", ".", "", "!", "?"])


class _Page:
    def __init__(self, r: random.Random) -> None:
        self.r, self.html, self.labels = r, [], []

    def raw(self, html: str) -> None:
        self.html.append(html)

    def block(self, tag: str, text: str, main: bool, close: bool = True) -> None:
        self.html.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if close else ""))
        self.labels.append(main)

    def open(self, choices: list[tuple[str, str]]) -> str:
        tag, attrs = self.r.choice(choices)
        self.html.append(f"<{tag}{' ' + attrs if attrs else ''}>")
        return f"</{tag}>"


def _links(p: _Page, n: int) -> None:
    p.raw("<ul>")
    for _ in range(n):
        p.block("li", f'<a href="/{_word(p.r)}">{_words(p.r, 1, 4)}</a>', False)
    p.raw("</ul>")


def _menu(p: _Page) -> None:
    end = p.open([("nav", ""), ("div", 'class="menu"'), ("div", 'id="nav"'), ("nav", 'class="breadcrumb"'), ("div", 'role="navigation"')])
    _links(p, p.r.randint(2, 9))
    p.raw(end)


def _masthead(p: _Page) -> None:
    end = p.open([("header", ""), ("div", 'class="header"'), ("header", 'class="site-header"'), ("div", 'id="masthead"')])
    p.block(p.r.choice(["div", "p", "h1", "h2"]), _words(p.r, 1, 5), False)
    if p.r.random() < 0.5:
        p.block("p", _prose(p.r, 3, 9), False)
    if p.r.random() < 0.4:
        _menu(p)
    p.raw(end)


def _notice(p: _Page) -> None:
    end = p.open([("div", 'class="cookie-notice"'), ("div", 'id="consent"'), ("div", 'class="alert" role="alert"'), ("section", 'class="newsletter"'), ("div", 'class="popup"'), ("aside", 'class="notice"')])
    p.block("p", _prose(p.r, 4, 30), False)
    if p.r.random() < 0.5:
        p.block("button", _words(p.r, 1, 2), False)
    p.raw(end)


def _advert(p: _Page) -> None:
    if p.r.random() < 0.5:
        tag = p.r.choice(['div class="ad"', 'div class="ads"', 'div id="banner"', 'p class="sponsored"', 'div class="advert"'])
        p.block(tag, _prose(p.r, 3, 25), False)
    else:
        end = p.open([("div", 'class="ad"'), ("aside", 'class="promo"'), ("div", 'class="advertisement"')])
        p.block("p", _prose(p.r, 3, 25), False)
        p.raw(end)


def _aside(p: _Page) -> None:
    end = p.open([("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="related"'), ("section", 'class="widget"'), ("div", 'class="recommended"')])
    p.block(p.r.choice(["h2", "h3", "h4"]), _words(p.r, 1, 4), False)
    if p.r.random() < 0.6:
        _links(p, p.r.randint(2, 6))
    else:
        for _ in range(p.r.randint(1, 3)):
            p.block("p", _prose(p.r, 4, 40), False)
    p.raw(end)


def _comments(p: _Page) -> None:
    end = p.open([("section", 'id="comments"'), ("div", 'class="comments"'), ("ol", 'class="commentlist"'), ("div", 'class="discussion"')])
    p.block(p.r.choice(["h2", "h3"]), _words(p.r, 1, 3), False)
    for _ in range(p.r.randint(1, 5)):
        inner = p.open([("div", 'class="comment"'), ("li", ""), ("article", 'class="comment"')])
        if p.r.random() < 0.5:
            p.block("div", _words(p.r, 1, 3), False)
        for _ in range(p.r.randint(1, 2)):
            p.block("p", _prose(p.r, 3, 60), False)
        p.raw(inner)
    p.raw(end)


def _form(p: _Page) -> None:
    end = p.open([("form", ""), ("form", 'class="search"'), ("form", 'id="login"')])
    if p.r.random() < 0.5:
        p.block("p", _prose(p.r, 2, 20), False)
    p.block("label", _words(p.r, 1, 4), False)
    p.raw('<input name="q">')
    p.block("button", _words(p.r, 1, 2), False)
    p.raw(end)


def _footer(p: _Page) -> None:
    end = p.open([("footer", ""), ("div", 'class="footer"'), ("div", 'id="footer"'), ("footer", 'class="legal"')])
    if p.r.random() < 0.4:
        _links(p, p.r.randint(2, 5))
    text = _prose(p.r, 2, 30)
    mark = p.r.choice(["&copy; ", "", "Copyright "])
    if p.r.random() < 0.5:
        p.raw(mark + text)
        p.labels.append(False)
    else:
        p.block("p", mark + text, False)
    p.raw(end)


def _paragraph(p: _Page) -> None:
    r, kind = p.r, p.r.random()
    if kind < 0.70:
        p.block("p", _prose(r, 1, 120), True)
    elif kind < 0.76:
        p.block("p", f"<b>{_prose(r, 1, 20)}<br>", True, close=False)
    elif kind < 0.84:
        p.block(r.choice(["h2", "h3", "h4"]), _words(r, 1, 8), True)
    elif kind < 0.90:
        p.raw("<ul>" if r.random() < 0.7 else "<ol>")
        for _ in range(r.randint(2, 6)):
            p.block("li", _prose(r, 1, 25), True)
        p.raw("</ul>")
    elif kind < 0.94:
        p.raw("<blockquote>")
        p.block("p", _prose(r, 5, 50), True)
        p.raw("</blockquote>")
    elif kind < 0.97:
        p.block("pre", _words(r, 5, 40), True)
    else:
        p.raw("<table>")
        for _ in range(r.randint(1, 4)):
            p.raw("<tr>")
            for _ in range(2):
                p.block("td", _words(r, 1, 6), True)
            p.raw("</tr>")
        p.raw("</table>")


def _article(p: _Page) -> None:
    r = p.r
    end = p.open([
        ("article", ""), ("article", ""), ("article", ""), ("main", ""), ("div", 'class="post-content"'),
        ("div", 'id="content"'), ("div", 'class="article-body"'), ("section", 'class="story"'), ("div", 'class="entry"'),
        ("div", ""), ("section", ""),
    ])
    if r.random() < 0.9:
        head = r.random() < 0.15
        p.raw("<header>" if head else "")
        p.block("h1", _words(r, 2, 12), True)
        p.raw("</header>" if head else "")
    for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20])):
        _paragraph(p)
        if r.random() < 0.04:
            r.choice([_advert, _aside, _notice, _form])(p)
    if r.random() < 0.1:
        _comments(p)
    p.raw(end)


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """``(html, whether each block is part of the article)``."""
    made = []
    for i in range(n):
        r = random.Random(seed * 1_000_003 + i)
        p = _Page(r)
        p.raw(f"<!DOCTYPE html><html><head><title>{_words(r, 2, 8)}</title><style>p{{}}</style></head><body>")
        for part, chance in ((_notice, 0.2), (_masthead, 0.4), (_menu, 0.7), (_advert, 0.5), (_form, 0.15), (_aside, 0.15)):
            if r.random() < chance:
                part(p)
        _article(p)
        for part, chance in ((_advert, 0.2), (_comments, 0.35), (_aside, 0.3), (_form, 0.2), (_menu, 0.15), (_notice, 0.15), (_footer, 0.8)):
            if r.random() < chance:
                part(p)
        if r.random() < 0.8:
            p.raw("</body></html>")
        made.append(("".join(p.html), p.labels))
    return made
