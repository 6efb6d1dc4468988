"""Allow-list sanitising of HTML: a linear tokenizer, a stack of open elements, escaped output.

Nothing of the input is passed on as markup: the output is built anew from allowed tags and attributes, with text and
values escaped, so it cannot hold a tag that the lists do not name, however the input is broken.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tags, attributes and schemes that user content may have.
TAGS = frozenset("""a abbr b blockquote br code dd del dl dt em h1 h2 h3 h4 h5 h6 hr i img ins li ol p pre s strong sub sup table tbody
td th thead tr ul""".split())
ATTRIBUTES = {"a": {"href", "title"}, "img": {"src", "alt", "title", "width", "height"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan"}}
SCHEMES = frozenset({"http", "https", "mailto"})

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text: it goes with them where they are not allowed.
DROPPED = frozenset({"script", "style"})
#: Elements whose content a browser reads without tags.
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"})
URLS = frozenset({"href", "src", "cite", "action", "formaction", "poster", "data", "background", "longdesc"})
#: A new one of these ends an open one of the second kind.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}}

_NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
_ATTRIBUTE = re.compile(r"[^\s/>=][^\s/>=]*")
_SPACE = re.compile(r"[\s/]*")
_SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.\-]*):")
_IGNORED = dict.fromkeys([*range(0x21), 0x7F, 0xA0, 0xAD, *range(0x200B, 0x2010), *range(0x2028, 0x202F), 0x2060, 0xFEFF])


class Rules(NamedTuple):
    tags: frozenset[str] = TAGS
    attributes: dict[str, set[str]] = ATTRIBUTES
    schemes: frozenset[str] = SCHEMES
    rel: str = "noopener noreferrer"  # of links; empty for none


class Tag(NamedTuple):
    name: str
    closing: bool
    attributes: list[tuple[str, str]]


def tokens(text: str) -> Iterator[str | Tag]:
    """Text (references decoded) and tags of a page, in linear time; comments, declarations and instructions are left out.

    What opens but never ends (a tag, a comment) is dropped to the end of the text, as browsers do.
    """
    at, n = 0, len(text)
    raw = ""
    while at < n:
        if raw:
            found = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(text, at) if raw != "plaintext" else None
            stop = found.start() if found else n
            if stop > at:
                yield text[at:stop] if raw not in ("textarea", "title") else html.unescape(text[at:stop])
            at, raw = stop, ""
            continue
        stop = text.find("<", at)
        if stop < 0:
            yield html.unescape(text[at:])
            return
        if stop > at:
            yield html.unescape(text[at:stop])
        at = stop
        if text.startswith("<!--", at):
            end = min((e for e in (text.find("-->", at + 2), text.find("--!>", at + 4)) if e >= 0), default=-1)
            if text.startswith(("<!-->", "<!--->"), at):
                at = text.find(">", at) + 1
                continue
            if end < 0:
                return
            at = text.find(">", end) + 1
            continue
        if text.startswith(("<!", "<?"), at):
            end = text.find(">", at)
            if end < 0:
                return
            at = end + 1
            continue
        closing = text.startswith("</", at)
        name = _NAME.match(text, at + 1 + closing)
        if not name:
            if closing:  # a bogus comment
                end = text.find(">", at)
                if end < 0:
                    return
                at = end + 1
            else:
                yield "<"
                at += 1
            continue
        tag, at = _tag(text, name, closing)
        if tag is None:
            return
        yield tag
        if tag.name in RAW and not closing:
            raw = tag.name


def _tag(text: str, name: re.Match, closing: bool) -> tuple[Tag | None, int]:
    at, found, known = name.end(), [], set()
    while True:
        at = _SPACE.match(text, at).end()
        if at >= len(text):
            return None, at
        if text[at] == ">":
            return Tag(name[0].lower(), closing, found), at + 1
        own = _ATTRIBUTE.match(text, at) or re.compile("=[^\\s/>=]*").match(text, at)
        at = own.end()
        key, value = own[0].lower(), ""
        after = re.compile(r"\s*=\s*").match(text, at)
        if after:
            at = after.end()
            if at < len(text) and text[at] in "\"'":
                stop = text.find(text[at], at + 1)
                if stop < 0:
                    return None, len(text)
                value, at = text[at + 1 : stop], stop + 1
            else:
                plain = re.compile(r"[^\s>]*").match(text, at)
                value, at = plain[0], plain.end()
        if key not in known:
            known.add(key)
            found.append((key, html.unescape(value)))


def safe_url(value: str, schemes: frozenset[str]) -> bool:
    """True for a relative address and for an allowed scheme, read as a browser reads it, without controls and blanks."""
    clean = value.translate(_IGNORED)
    if clean.startswith(("//", "\\\\", "/\\", "\\/")):
        return True
    scheme = _SCHEME.match(clean)
    if scheme:
        return scheme[1].lower() in schemes
    return ":" not in re.split(r"[/?#]", clean, maxsplit=1)[0]


def escape(text: str, quote: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\xa0", "&nbsp;")
    return text.replace('"', "&quot;") if quote else text


def sanitize(text: str | None, rules: Rules = Rules()) -> str | None:
    """The text with allowed markup only; null for null.

    Tags that are not allowed go, their content stays, but for scripts and styles; comments go. Attributes go unless the
    tag's list names them; an address goes with its attribute unless relative or of an allowed scheme. Elements left open
    are closed, end tags without a start go. The result of a result is itself.
    """
    if not text:
        return text
    out: list[str] = []
    stack: list[str] = []
    open_now: Counter[str] = Counter()
    skip = ""

    def close(upto: int) -> None:
        while len(stack) > upto:
            name = stack.pop()
            open_now[name] -= 1
            out.append(f"</{name}>")

    for token in tokens(text):
        if isinstance(token, str):
            if not skip:
                out.append(escape(token))
            continue
        name = token.name
        if name in DROPPED and name not in rules.tags:
            skip = "" if token.closing else name
            continue
        if name not in rules.tags:
            continue
        if token.closing:
            if open_now[name]:
                close(len(stack) - 1 - stack[::-1].index(name))
            continue
        if any(open_now[c] for c in CLOSES.get(name, ())):
            for place in range(len(stack) - 1, -1, -1):
                if stack[place] in WALLS[name]:
                    break
                if stack[place] in CLOSES[name]:
                    close(place)
        allowed = rules.attributes.get(name, ())
        kept = [(k, v) for k, v in token.attributes if k in allowed and (k not in URLS or safe_url(v, rules.schemes))]
        if name == "a":
            if open_now["a"]:
                close(len(stack) - 1 - stack[::-1].index("a"))
            kept += [("rel", rules.rel)] if rules.rel else []
        out.append(f"<{name}" + "".join(f' {k}="{escape(v, True)}"' for k, v in kept) + ">")
        if name not in VOID:
            stack.append(name)
            open_now[name] += 1
    close(0)
    return "".join(out)


def plain(text: str | None) -> str | None:
    """The text without any markup, references decoded; null for null. Decoded text may look like markup again: it is plain text."""
    return html.unescape(sanitize(text, Rules(frozenset()))) if text else text


def sanitized(text: Column, rules: Rules = Rules()) -> Column:
    """A column of ``sanitize``, by Arrow batches."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: sanitize(v, rules), na_action="ignore")

    return run(text)


def plain_text(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(plain, na_action="ignore")

    return run(text)
