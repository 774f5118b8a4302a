"""Text blocks of HTML pages: one pass over the tags, tolerant of unclosed and cut-off markup."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

_tag = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*)>""")
_attr = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_names = re.compile(r"[a-z]+")

#: Left out with all that they hold; the first ones hold no markup.
RAW = {"script", "style", "textarea", "title", "xmp"}
GONE = {"head", "nav", "aside", "footer", "form", "button", "select", "dialog", "menu", "template", "noscript", "iframe", "object", "svg", "math", "canvas", "audio", "video", "map"}
MAIN = {"article", "main"}
#: Elements that are followed on the stack; others only separate or join text.
HELD = GONE | MAIN | {"header", "div", "section", "ul", "ol", "dl", "table", "figure", "fieldset", "details", "blockquote", "center", "body", "html"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Words of class, id and role that mark menus, adverts, notices and the like.
CHROME = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "contentinfo", "colophon", "sidebar", "complementary", "ad", "ads", "advert", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "masthead", "search", "pagination", "pager"}
COMMENTS = {"comment", "comments", "disqus", "replies", "respond"}
CONTENT = {"content", "main", "article", "body", "story"}


class Block(NamedTuple):
    """White space in ``text`` is single spaces; ``part`` is main, rest or chrome."""

    part: str
    text: str


def _role(tag: str, attrs: str, inside: str) -> str:
    """The part that an element opens, within ``inside``."""
    if tag in GONE:
        return "chrome"
    if tag == "header" and inside != "main":
        return "chrome"
    if attrs.strip():
        marks: set[str] = set()
        for name, *values in _attr.findall(attrs):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id", "role"):
                marks.update(_names.findall(value))
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "chrome"
        if marks & COMMENTS:
            return "chrome"
        if tag not in MAIN and tag not in ("body", "html"):
            if marks & CHROME and not marks & CONTENT or "header" in marks and inside != "main":
                return "chrome"
            if "main" in marks and tag in ("div", "section"):
                return "main"
    return "main" if tag in MAIN else inside


def blocks(html: str | None) -> list[Block]:
    """All blocks of a page in its order, chrome included."""
    out: list[Block] = []
    if not html:
        return out
    stack: list[tuple[str, str]] = []
    part, text = "rest", []
    at, end = 0, len(html)

    def close() -> None:
        if text:
            if words := "".join(text).split():
                out.append(Block(part, " ".join(words)))
            text.clear()

    while at < end:
        open_ = html.find("<", at)
        if open_ < 0:
            text.append(unescape(html[at:]))
            break
        if open_ > at:
            text.append(unescape(html[at:open_]))
        nxt = html[open_ + 1 : open_ + 2]
        if nxt == "!" or nxt == "?":
            if html.startswith("<!--", open_):
                z = html.find("-->", open_ + 4)
                at = end if z < 0 else z + 3
            else:
                z = html.find(">", open_)
                at = end if z < 0 else z + 1
            continue
        if nxt != "/" and not ("a" <= nxt.lower() <= "z"):
            if nxt:
                text.append("<")
            at = open_ + 1
            continue
        m = _tag.match(html, open_)
        if not m:
            z = html.find(">", open_)  # an odd end tag such as </>; without an end, what is cut off goes
            at = end if z < 0 else z + 1
            continue
        at = m.end()
        ends, tag = m.group(1), m.group(2).lower()
        if tag in INLINE:
            if tag == "img" or not m.group(3):
                continue
            if ends or _role(tag, m.group(3), part) == part:
                continue
            z = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            if z:
                at = z.end()
            continue
        close()
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    part = stack[k][1]
                    del stack[k:]
                    break
                if stack[k][0] in MAIN and tag in ("div", "section", "ul", "ol", "table"):
                    break  # a stray end tag doesn't end the article
        elif tag in RAW:
            z = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = z.end() if z else end
        elif tag == "body":
            stack, part = [("body", "rest")], "rest"
            part = _role(tag, m.group(3), "rest")
        elif tag in HELD:
            if m.group(3).rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            stack.append((tag, part))
            if part != "chrome":
                part = _role(tag, m.group(3), part)
        elif m.group(3) and part != "chrome" and _role(tag, m.group(3), part) == "chrome":
            stack.append((tag, part))
            part = "chrome"
    close()
    return out


def stream(found: list[Block]) -> tuple[list[Block], bool]:
    """The blocks that may be the page's text, and whether its markup settles which are: with an article, those of the article."""
    main = [b for b in found if b.part == "main"]
    return (main, True) if main else ([b for b in found if b.part == "rest"], False)
