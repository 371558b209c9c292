"""A small reader of HTML to block trees, for wrapper induction."""

from __future__ import annotations

import html as _html
import re

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|object|select|canvas|audio|video)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DEEPEST = 200
#: What a start tag closes when it is open, up to the nearest of the second set.
_BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
} | {t: (frozenset(["p"]), frozenset(["table", "td", "th", "li", "div", "article", "section", "body", "blockquote"])) for t in _BLOCK}


class Node:
    """A block element, or (tag '#text') a run of text with its inline elements. hidden: it isn't shown."""

    __slots__ = ("tag", "names", "label", "children", "text", "link_chars", "hidden")

    def __init__(self, tag: str, names: frozenset = frozenset(), text: str = "", link_chars: int = 0, hidden: bool = False):
        self.tag, self.names, self.children, self.text, self.link_chars, self.hidden = tag, names, [], text, link_chars, hidden
        self.label = f"{tag}.{'.'.join(sorted(names))}" if names else tag


def parse(page: str | None) -> Node:
    """The page's block tree. Comments, scripts, styles and the like are left out, character references decoded, white
    space in a run of text made one space. Missing end tags and stray ones are met as browsers do, in the main."""
    page, root = page or "", Node("html")
    stack, text, in_link, links, at = [root], [], 0, 0, 0

    def flush() -> None:
        nonlocal links
        if text:
            run = " ".join(_html.unescape("".join(text)).split())
            if run:
                stack[-1].children.append(Node("#text", text=run, link_chars=min(links, len(run))))
            text.clear()
        links = 0

    def close(depth: int) -> None:
        flush()
        del stack[depth:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            links += len(piece) if in_link else 0
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, ending = tag.lower(), m[2] or m[5]
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ending else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if ending:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    in_link = 0
                    break
            else:
                flush()
            continue
        if tag in ("html", "head", "body") and tag != "head":
            flush()
            continue
        flush()
        if tag in VOID:
            continue
        if tag in _CLOSES:
            closes, until = _CLOSES[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in closes:
                    close(depth)
                elif stack[depth].tag in until:
                    break
        names, hidden, rest = set(), False, m[4] or m[7] or ""
        for a in _ATTRIBUTE.finditer(rest) if rest else ():
            name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if name in ("class", "id", "role"):
                names.update(x.lower() for x in _NAME.findall(value))
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                hidden = True
        node = Node(tag, frozenset(names), hidden=hidden)
        if len(stack) < DEEPEST:
            stack[-1].children.append(node)
            stack.append(node)
        else:  # as browsers do: what is nested deeper stands beside, and keeps its own names
            stack[-1:] = [node]
            stack[-2].children.append(node)
    if at < len(page):
        text.append(page[at:])
        links += len(page) - at if in_link else 0
    flush()
    return root
