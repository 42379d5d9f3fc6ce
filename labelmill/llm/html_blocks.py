"""Pages as sequences of leaf blocks: text, the elements around it, and features of both.

A block is a run of text that no block-level element starts or ends in. Character references
are decoded, white space becomes one space, and what is never shown (head, scripts, styles,
comments) is no block. Unclosed and wrongly nested elements are closed as browsers do for the
common cases: a new paragraph, list item or cell ends the one before, a head ends at the first
tag or text that cannot stand in it, and a drawing at the first tag that cannot stand in one.
Comments, declarations and tags that never end run to the end of the page. An element that would
hide its content but has no end (an unclosed object or template, say) hides nothing: the page is
read once more without it. Work is linear in the page however deep its elements are nested.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

_BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "iframe label legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
_UNSEEN = frozenset("head noscript object script style svg template title textarea".split())
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# An opening tag ends an open element of its own group, up to the element that bounds the group.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_HOLDS_P = frozenset("article aside blockquote body button div dd dt fieldset figure footer form header li main nav section table td th".split())

# Words in class, id and role attributes, by what they tell about a block.
_HINTS = {
    "ad": "ad ads adv advert advertisement adverts banner promo promoted promotion sponsor sponsored teaser",
    "menu": "breadcrumb breadcrumbs menu nav navbar navigation pager pagination toc tabs toolbar skip",
    "top": "header masthead topbar head logo branding site-header",
    "bottom": "bottom colophon copyright footer legal imprint",
    "side": "aside complementary related recommended recommendations sidebar side rail widget widgets popular trending more",
    "notice": "alert consent cookie cookies dialog gdpr modal newsletter notice notification overlay popup subscribe subscription toast warning",
    "comments": "comment comments commentlist discussion disqus replies reply respond responses",
    "share": "follow share sharing social tags tag byline meta author date print",
    "form": "contact form input login search searchform signup register",
    "main": "article articlebody body content entry main maincontent post story text prose",
}
_HINT_OF = {word: name for name, words in _HINTS.items() for word in words.split()}
_ANCESTORS = (
    "nav header footer aside article main section form ul ol table blockquote figure figcaption button "
    "address dialog details menu select label fieldset li pre".split()
)
_OWN = "h1 h2 h3 h4 h5 h6 p li td th div pre dt dd figcaption button label option body section article".split()
_WORD = re.compile(r"[a-z]+")
_CALLS = re.compile(r"cookie|consent|subscribe|newsletter|advert|sponsor|sign up|log in|copyright|©|all rights", re.I)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    tag: str
    around: frozenset[str]
    hints: frozenset[str]
    hidden: bool = False


_SEEN_AROUND = frozenset(_ANCESTORS)
# Tags that cannot stand in a drawing and end it; inside the last three HTML may stand again.
_ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
    "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_HTML_IN_SVG = frozenset("desc foreignobject title".split())
_RAW = ("script", "style")
_COMMENT_END = re.compile(r"--!?>")
_LONG_REFERENCE = re.compile(r"&#([0-9]{1000,})")  # Python reads no number of more than some thousand digits


def _less(counts: Counter[str], name: str) -> None:
    counts[name] -= 1
    if not counts[name]:
        del counts[name]


@dataclass
class _Open:
    tag: str
    hints: frozenset[str]
    hidden: bool


class _Blocks(HTMLParser):
    """``shown`` names, by their order in the page, hiding elements whose content counts as text."""

    def __init__(self, shown: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements, by tag
        self.block_places: list[int] = []
        self.p_holders: list[int] = []  # of those that a paragraph does not reach out of
        self.around: Counter[str] = Counter()
        self.hints: Counter[str] = Counter()
        self.hidden = 0
        self.unseen: list[tuple[str, int]] = []
        self.unseen_tags: Counter[str] = Counter()
        self.shown, self.hiding = shown, 0
        self.in_tag = False
        self.parts: list[str] = []
        self.linked = 0

    # --- what never ends runs to the end of the page ---

    def parse_comment(self, i: int, report: bool = True) -> int:
        for empty in (">", "->"):
            if self.rawdata.startswith(empty, i + 4):
                return i + 4 + len(empty)
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def _to_bracket(self, i: int) -> int:
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self._to_bracket(i)

    def parse_pi(self, i: int) -> int:
        return self._to_bracket(i)

    def parse_starttag(self, i: int) -> int:
        self.in_tag = True  # what the parser takes for text in here is a broken tag
        end = super().parse_starttag(i)
        self.in_tag = False
        return end if end >= 0 else self._to_bracket(i)

    def parse_endtag(self, i: int) -> int:
        end = super().parse_endtag(i)
        return end if end >= 0 else self._to_bracket(i)

    def set_cdata_mode(self, elem: str) -> None:
        if not (self.unseen and self.unseen[-1][0] == "svg"):
            super().set_cdata_mode(elem)

    # --- the open elements ---

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            own = self.open[self.block_places[-1]].tag if self.block_places else "body"
            self.blocks.append(Block(text, self.linked, own, frozenset(self.around), frozenset(self.hints), self.hidden > 0))
        self.parts, self.linked = [], 0

    def _push(self, element: _Open) -> None:
        at = len(self.open)
        self.open.append(element)
        self.places[element.tag].append(at)
        if element.tag in _BLOCK_TAGS:
            self.block_places.append(at)
        if element.tag in _HOLDS_P:
            self.p_holders.append(at)
        if element.tag in _SEEN_AROUND:
            self.around[element.tag] += 1
        for hint in element.hints:
            self.hints[hint] += 1
        self.hidden += element.hidden

    def _pop_to(self, at: int) -> None:
        while len(self.open) > at:
            gone = self.open.pop()
            self.places[gone.tag].pop()
            if gone.tag in _BLOCK_TAGS:
                self.block_places.pop()
            if gone.tag in _HOLDS_P:
                self.p_holders.pop()
            if gone.tag in _SEEN_AROUND:
                _less(self.around, gone.tag)
            for hint in gone.hints:
                _less(self.hints, hint)
            self.hidden -= gone.hidden

    def _last(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close_implied(self, tag: str) -> None:
        if tag in _ENDS:
            ended, bound = _ENDS[tag]
            at, held = self._last(ended), self._last(bound)
        elif tag in _BLOCK_TAGS and self.places.get("p"):
            at, held = self.places["p"][-1], self.p_holders[-1] if self.p_holders else -1
        else:
            return
        if at >= 0 and at >= held:
            self._pop_to(at)

    # --- hiding elements ---

    def _hide(self, tag: str) -> None:
        if self.hiding not in self.shown:
            self.unseen.append((tag, self.hiding))
            self.unseen_tags[tag] += 1
        self.hiding += 1

    def _unhide(self) -> str:
        tag = self.unseen.pop()[0]
        self.unseen_tags[tag] -= 1
        return tag

    def _only_head(self) -> bool:
        return len(self.unseen) == 1 and self.unseen[0][0] == "head"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._only_head():
            if tag not in _IN_HEAD:
                self._unhide()
            elif tag == "noframes":
                self._hide(tag)
        if self.unseen and self.unseen[-1][0] == "svg":
            if tag in _ENDS_SVG:
                self._unhide()
            elif tag in _HTML_IN_SVG or tag == "svg":
                self._hide(tag)
                return
            else:
                return
        if self.unseen:
            if tag in _UNSEEN and tag != "head":
                self._hide(tag)
            return
        if tag in _UNSEEN:
            self._hide(tag)
            return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in _BLOCK_TAGS:
            self.flush()
            self._close_implied(tag)
        if tag in _VOID:
            return
        hints, hidden = set(), False
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                hints.update(_HINT_OF[w] for w in _WORD.findall(value.lower()) if w in _HINT_OF)
            elif name == "hidden" or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
                hidden = True
        self._push(_Open(tag, frozenset(hints), hidden))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        before = self.hiding
        self.handle_starttag(tag, attrs)
        if self.hiding > before:
            if self.unseen and self.unseen[-1][1] == before:
                self._unhide()
        elif tag not in _VOID and self.open and self.open[-1].tag == tag and not self.unseen:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if self.unseen_tags[tag] > 0:
                while self._unhide() != tag:
                    pass
            return
        if tag in _BLOCK_TAGS:
            self.flush()
        at = self.places[tag][-1] if self.places.get(tag) else -1
        # An inline element does not close the block around it.
        if at >= 0 and (tag in _BLOCK_TAGS or not self.block_places or at > self.block_places[-1]):
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if self.in_tag:
            return
        if self._only_head() and data.strip():
            self._unhide()
        if not self.unseen:
            self.parts.append(data)
            if self.places.get("a"):
                self.linked += len(data.strip())


def _read(html: str, shown: frozenset[int] = frozenset()) -> _Blocks:
    parser = _Blocks(shown)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in page order."""
    if not html:
        return []
    # Eight digits without leading zeros are beyond every character already, as is what they begin.
    html = _LONG_REFERENCE.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), html)
    page = _read(html)
    endless = frozenset(at for tag, at in page.unseen if tag not in ("head", *_RAW))
    return _read(html, endless).blocks if endless else page.blocks


def _step(name: str, value: float, cuts: tuple) -> str:
    return f"{name}{sum(value >= c for c in cuts)}"


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold, for every block of a page."""
    found, seen_h1 = [], False
    for i, b in enumerate(page):
        inside = bool({"article", "main"} & b.around) or "main" in b.hints
        n = len(b.text)
        f = ["bias", f"own:{b.tag if b.tag in _OWN else 'other'}", "inside" if inside else "outside"]
        f += [f"in:{t}" for t in _ANCESTORS if t in b.around]
        f += [f"hint:{h}" for h in b.hints]
        if "header" in b.around or "top" in b.hints:
            f.append("header:inside" if inside else "header:outside")
        f.append(_step("length", n, (15, 40, 80, 160, 320)))
        f.append(_step("linked", b.linked / n, (0.05, 0.3, 0.7)))
        f.append(_step("place", i / len(page), (0.1, 0.3, 0.7, 0.9)))
        f.append("ends:stop" if b.text[-1] in ".!?:;…。\"”»" else "ends:open")
        if i == 0 or i == len(page) - 1:
            f.append("first" if i == 0 else "last")
        if n < 400 and _CALLS.search(b.text):
            f.append("calls")
        if b.hidden:
            f.append("hidden")
        seen_h1 = seen_h1 or b.tag == "h1"
        f.append("after:h1" if seen_h1 else "before:h1")
        found.append(f)
    return found
