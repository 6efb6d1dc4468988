"""Leaf blocks of HTML pages with their tag paths, and generated pages with labelled blocks."""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Fixed values of the format: elements that break text into blocks, that hold no content, and whose content is no text of the page.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th
thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe".split())
CONTROL = frozenset("button label select textarea".split())  # their words are part of a form, not of the text
#: An opening tag of the first closes an open one of the second.
CLOSES = {"p": "p", "li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
CLOSES_P = BLOCK - {"html", "head", "body", "title", "option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}

BOUNDS = BLOCK - {"p", "li", "dt", "dd", "td", "th", "tr", "option"}  # no element outside is closed from within

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


PATH = 192


class Element(NamedTuple):
    """An open element: the one around it, its depth and its signs."""

    outer: Element | None
    depth: int
    signs: tuple[tuple[int, int], ...]


class Block(NamedTuple):
    tags: tuple[str, ...]  # of the last two open elements, the innermost last
    inner: Element | None  # the innermost open element
    text: str
    linked: float  # share of the characters inside links

    @property
    def path(self) -> bytes:
        """Sums of the hashed signs of all open elements' tags and marks."""
        sums = PathSums()
        sums.move(self.inner)
        return sums.now.tobytes()


class PathSums:
    """The sums of one element's path, moved from element to element over those that were opened or closed between."""

    def __init__(self):
        self.at: Element | None = None
        self.now = np.zeros(PATH, np.float32)

    def move(self, to: Element | None) -> None:
        here, opened = self.at, []
        self.at = to
        while to is not here:
            if here is None or (to is not None and to.depth > here.depth):
                opened.append(to)
                to = to.outer
            else:
                for cell, s in here.signs:
                    self.now[cell] -= s
                here = here.outer
        for e in opened:
            for cell, s in e.signs:
                self.now[cell] += s


@lru_cache(1 << 16)
def _short_sign(token: str, cells: int) -> tuple[int, int]:
    h = zlib.crc32(token.encode())
    return h % cells, 1 if h & 0x10000 else -1


def sign(token: str, cells: int) -> tuple[int, int]:
    """A cell and a sign for a token; only short ones are remembered, so the memory of a worker is bounded."""
    return (_short_sign if len(token) <= 64 else _short_sign.__wrapped__)(token, cells)


def _signs(tag: str, attributes: str) -> tuple[tuple[int, int], ...]:
    """Cells of an element's tag and of the distinct words of its class, id and role."""
    return (_short_signs if len(attributes) <= 256 else _short_signs.__wrapped__)(tag, attributes)


@lru_cache(1 << 15)
def _short_signs(tag: str, attributes: str) -> tuple[tuple[int, int], ...]:
    if tag in ("html", "body"):
        return ()
    marks = {w.lower() for _, value in _ATTRIBUTE.findall(attributes) for w in _PART.findall(value)} if attributes.strip() else ()
    return tuple(sign(t, PATH) for t in (tag, *sorted(f".{m}" for m in marks)))


class _Tags:
    """The tags, comments and declarations of a page in order, as (start, end, name, closing, attributes), in linear time.

    Quoted attribute values may hold ``>``. Where a quote is still open at the end of the page, that tag and all later
    ones end at the next ``>`` instead; without one the rest is text.
    """

    def __init__(self, page: str):
        self.page, self.broken = page, False

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), "", False, ""
            if page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at)
                return (at, end + 1, "", False, "") if end >= 0 else None
            if not (m := _NAME.match(page, at + 1)):
                at += 1
                continue
            end = m.end() if self.broken else _ATTRIBUTES.match(page, m.end()).end()
            if page[end : end + 1] != ">":
                self.broken = True
                if (end := page.find(">", m.end())) < 0:
                    return None
            return at, end + 1, m[2].lower(), bool(m[1]), page[m.end() : end]
        return None


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order: references decoded, white space collapsed, empty blocks left out.

    Block elements end a block, ``br`` is white space, and other elements run on inside it. Comments, declarations and
    the contents of scripts, styles, templates, inline frames and form controls are no text; all other text is. Unclosed elements end
    with their parents, an unclosed script, style, template or frame with the page. Time is linear in the page's length,
    whatever its markup.
    """
    out: list[Block] = []
    stack: list[tuple[str, Element]] = []
    where: dict[str, list[int]] = {}  # of each tag, its places in the stack
    bounds: list[int] = []  # places of elements in BOUNDS
    held: list[str] = []
    place: tuple = ((), None)
    linked, blank, controls = 0, True, 0
    known: dict[tuple, tuple] = {}  # equal pairs of tags are one object

    def text(raw: str) -> None:
        nonlocal linked, place, blank
        if raw and not controls:
            if blank and not raw.isspace():
                tags = tuple(t for t, _ in stack[-2:])
                place, blank = (known.setdefault(tags, tags), stack[-1][1] if stack else None), False
            held.append(raw)
            if where.get("a"):
                linked += len(raw)

    def flush() -> None:
        nonlocal linked, blank
        if not blank:
            raw = "".join(held)
            if whole := _SPACE.sub(" ", html.unescape(raw)).strip():
                out.append(Block(*place, whole, min(1.0, linked / max(1, len(raw)))))
        held.clear()
        linked, blank = 0, True

    def close(depth: int) -> None:
        nonlocal controls
        while len(stack) > depth:
            tag = stack.pop()[0]
            where[tag].pop()
            controls -= tag in CONTROL
            if tag in BOUNDS:
                bounds.pop()

    at, tags = 0, _Tags(page)
    while found := tags.next(at):
        start, end, name, closing, attributes = found
        text(page[at:start])
        at = end
        if not name:
            continue
        if name in BLOCK and not (controls and name in ("option", "optgroup")):
            flush()
        elif name == "br":
            held.append(" ") if held else None
        if closing:
            if where.get(name):
                close(where[name][-1])
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", stop.end()) + 1 if stop else 0
            at = at or len(page)
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        ends = [where[t][-1] for t in {CLOSES.get(name), "p" if name in CLOSES_P else None} if where.get(t)]
        if ends and max(ends) > (bounds[-1] if bounds else -1):
            close(max(ends))
        signs = _signs(name, attributes)
        where.setdefault(name, []).append(len(stack))
        if name in BOUNDS:
            bounds.append(len(stack))
        controls += name in CONTROL
        stack.append((name, Element(stack[-1][1] if stack else None, len(stack), signs)))
    text(page[at:])
    flush()
    return out


#: Words of classes and ids, by the kind of block they mark in the generated pages.
MARKS = {
    "menu": "nav menu navbar topnav main-nav breadcrumb breadcrumbs navigation site-menu tabs pagination pager links toc skip",
    "header": "header site-header masthead top topbar logo branding tagline hero-bar page-header",
    "footer": "footer site-footer bottom copyright legal colophon credits imprint foot",
    "sidebar": "sidebar side aside widget related trending popular tags archive recommended more-stories rail secondary recent",
    "notice": "notice alert cookie-notice cookie banner gdpr consent announcement warning message popup modal overlay toast disclaimer cookies privacy",
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion banner-ad adsbygoogle ad-slot commercial partner dfp",
    "form": "form newsletter subscribe signup search search-form login contact register feedback",
    "share": "share social sharing follow buttons toolbar share-bar",
    "comments": "comments comment comment-list commentlist discussion responses replies reply disqus thread respond user-comment",
    "main": "content post article article-body entry entry-content story text main main-content page-content body-text post-body blog-post news-body prose",
    "plain": "wrapper container row col inner box clearfix grid block section wrap outer x1 u-full module",
}
_TAGS = {"menu": ("nav", "div", "ul", "section"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "aside", "p"), "advert": ("div", "aside", "section"), "form": ("form", "div"), "share": ("div", "ul"), "comments": ("section", "div", "ol", "aside")}
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ch schl ung keit ein ié ção ñ ü ß é la que ment eau ción ado".split()


class _Maker:
    """Random pages: the structure varies, the words are invented, and the texts of the article are recorded."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.kept = rng, set()

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        style = self.rng.random()
        out = []
        for _ in range(int(self.rng.integers(low, high + 1))):
            w = "".join(self.pick(_SYLLABLES) for _ in range(int(self.rng.integers(1, 5))))
            out.append(w.upper() + "!!" if style < 0.05 else w + self.pick(["###", "***", "%%%", "&amp;&amp;"]) if style < 0.1 else w.capitalize() if self.chance(0.1) else w)
        return " ".join(out) + self.pick([".", ".", "", "?", "!"])

    def own(self, low: int, high: int) -> str:
        """Text of the article."""
        text = self.words(low, min(high, 5) if self.chance(0.3) else high)
        self.kept.add(_SPACE.sub(" ", html.unescape(text)).strip())
        return text

    def inline(self, text: str) -> str:
        parts = text.split(" ")
        if len(parts) > 3 and self.chance(0.3):
            k = int(self.rng.integers(len(parts) - 1))
            tag = self.pick(["b", "em", "a href='/x'", "strong", "span", "i"])
            parts[k] = f"<{tag}>{parts[k]}</{tag.split()[0]}>"
        return " ".join(parts)

    def mark(self, kind: str, bare: float = 0.25) -> str:
        if self.chance(bare):
            return f' class="{self.pick(MARKS["plain"].split())}"' if self.chance(0.3) else ""
        name = self.pick(MARKS[kind].split())
        if self.chance(0.2):
            name += self.pick([" ", "-", "_"]) + self.pick(MARKS["plain"].split())
        return f' {self.pick(["class", "class", "id"])}="{name}"'

    def items(self, low: int, high: int, link: float) -> str:
        out = []
        for _ in range(int(self.rng.integers(low, high + 1))):
            t = self.words(1, 4)
            out.append(f"<li><a href='/{len(out)}'>{t}</a></li>" if self.chance(link) else f"<li>{t}</li>")
        return "<ul>" + "".join(out) + "</ul>"

    def clutter(self, kind: str) -> str:
        tag = self.pick(_TAGS[kind])
        semantic = tag in ("nav", "header", "footer", "aside", "form")
        head = f"<{tag}{self.mark(kind, 0.6 if semantic else 0.0)}>"
        if kind == "menu":
            body = self.items(2, 9, 0.95) if self.chance(0.8) else " ".join(f"<a href='/{k}'>{self.words(1, 2)}</a>" for k in range(4))
        elif kind == "form":
            body = f"<label>{self.words(1, 4)}</label><input name=q>" + (f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>" if self.chance(0.3) else "") + f"<p>{self.words(2, 14)}</p><button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            body = "".join(f"<{self.pick(['div', 'li', 'article'])}{self.mark('comments', 0.3)}><b>{self.words(1, 2)}</b><p>{self.words(1, 60)}</p>" + ("</div>" if self.chance(0.0) else "") for _ in range(int(self.rng.integers(1, 6))))
            body = re.sub(r"<(div|li|article)([^>]*)>(.*?</p>)", r"<\1\2>\3</\1>", body)
            body = (f"<h3>{self.words(1, 3)}</h3>" if self.chance(0.6) else "") + body
        elif kind == "sidebar":
            body = f"<h3>{self.words(1, 4)}</h3>" * self.chance(0.6) + (self.items(2, 7, 0.8) if self.chance(0.6) else f"<p>{self.words(3, 40)}</p>")
        elif kind == "footer":
            body = f"<p>&copy; {self.words(2, 9)}</p>" if self.chance(0.5) else f"&copy; {self.words(2, 14)} &middot; {self.words(1, 9)}"
            body += self.items(1, 4, 0.9) if self.chance(0.3) else ""
        else:
            body = self.words(1, 30)
            body = f"<p>{body}</p>" if self.chance(0.5) else f"<{self.pick(['span', 'a', 'div', 'h2'])}>{body}" if self.chance(0.3) else body
        return head + body + f"</{tag}>"

    def part(self) -> str:
        k = self.rng.random()
        if k < 0.68:
            return f"<p>{self.inline(self.own(1, 90))}</p>" if self.chance(0.8) else f"<p><b>{self.own(1, 60)}{self.pick(['<br>', '</b></p>', '<br></p>'])}"
        if k < 0.74:
            return f"<{(h := self.pick(['h2', 'h3', 'h4']))}>{self.own(1, 9)}</{h}>"
        if k < 0.80:
            return f"<{(u := self.pick(['ul', 'ol']))}>" + "".join(f"<li>{self.inline(self.own(1, 20))}</li>" for _ in range(int(self.rng.integers(1, 5)))) + f"</{u}>"
        if k < 0.84:
            return f"<blockquote><p>{self.own(2, 40)}</p></blockquote>" if self.chance(0.6) else f"<pre>{self.own(2, 20)}</pre>"
        if k < 0.87:
            return "<table>" + "".join(f"<tr><td>{self.own(1, 5)}</td><td>{self.own(1, 5)}</td></tr>" for _ in range(2)) + "</table>"
        if k < 0.90:
            return f"<figure><img src=x><figcaption>{self.own(2, 12)}</figcaption></figure>"
        if k < 0.94:
            return f"<div>{self.own(2, 60)}</div>"
        return self.clutter(self.pick(["advert", "advert", "share", "form", "notice", "sidebar"]))

    def page(self) -> str:
        title = self.own(1, 12)
        head = f"<title>{self.words(1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script>"
        before = "".join(self.clutter(k) for k in ("header", "menu", "notice", "advert", "form", "share", "sidebar") if self.chance(0.35))
        after = "".join(self.clutter(k) for k in ("share", "sidebar", "comments", "advert", "form", "menu", "notice") if self.chance(0.35))
        after += self.clutter("footer") if self.chance(0.75) else ""
        body = "".join(self.part() for _ in range(int(self.rng.integers(0, 14))))
        body = (f"<header><h1>{title}</h1></header>" if self.chance(0.1) else f"<h1>{title}</h1>") + body
        k = self.rng.random()
        if k < 0.5:
            body = f"<article{self.mark('main', 0.7)}>{body}</article>"
        elif k < 0.6:
            body = f"<main{self.mark('main', 0.6)}>{body}</main>"
        else:
            body = f"<{(t := self.pick(['div', 'section']))}{self.mark('main', 0.05)}>{body}</{t}>"
        if self.chance(0.25):
            body = f"<main>{body}</main>" if "<main" not in body else body
        if self.chance(0.3):
            body, before = f"<div{self.mark('plain', 0.0)}>{before}{body}", ""
            after = after + "</div>"
        return f"<!DOCTYPE html><html><head>{head}</head><body>{before}{body}{after}</body></html>"


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[bool]]]:
    """Generated pages, each with the label of every block: whether it belongs to the article."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(count):
        maker = _Maker(rng)
        page = maker.page()
        found = blocks(page)
        out.append((page, [b.text in maker.kept and b.tags[-1:] != ("title",) for b in found]))
    return out
