"""HTML to a sequence of leaf blocks, each with its text and the path of elements around it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: A comment, a section of character data, a declaration, or a tag; one with a quote that is never closed ends at ">".
TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*(?=>|\Z)|[^>]*)>?""", re.S)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is not text: those that hold no markup and those that do. Fixed values.
RAW = {"script", "style", "textarea", "title"}
HIDDEN = {"template", "iframe", "object", "select", "canvas", "audio", "video"}
#: Elements inside a line of text, and those without content. Fixed values.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Formulas and drawings: elements inside them are part of the line of text around them. Fixed values.
FOREIGN = {"math", "svg"}
#: Elements that end a formula or drawing which was not closed. Fixed values.
BREAKS = {"p", "div", "ul", "ol", "li", "dl", "dt", "dd", "table", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "body", "html"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An open element of these is ended by the start of one of those. Fixed values.
ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}


#: The end tags of elements without markup, whatever stands behind the name.
RAW_END = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?(?:>|\Z)", re.I) for name in RAW}


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: int
    """Code points of the text inside links, before white space is joined."""


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order. Character references are decoded; white space is one space and trimmed.

    Text in hidden elements, comments and declarations is left out. Elements that are not closed end with the one
    around them; a hidden one that has no end tag anywhere behind it ends before the next paragraph, list, table or
    the like. A script or style that is not closed hides the rest of the page, as browsers have it; a title or text
    field that is not closed hides what comes up to the next such element. Text that goes on behind a hidden
    element stays one line. A tag that the page's end cuts off is markup. Text of formulas and drawings belongs to the line that
    holds them; their titles are hidden.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked, links, at, size, foreign = 0, 0, 0, len(page), ""
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}
    shade, last_end = -1, {}

    def ends_later(name: str) -> bool:
        """Whether an end tag of that name comes behind this place."""
        if name not in last_end:
            last_end[name] = max((m.start() for m in re.finditer(rf"</{name}(?=[\s/>])", page, re.I)), default=-1)
        return last_end[name] >= at

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                path = tuple(x for x, _ in stack)
                out.append(Block(joined, paths.setdefault(path, path), linked))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and shade < 0:
            raw = html.unescape(raw) if "&" in raw else raw
            text.append(raw)
            linked += len(raw) if links else 0

    while at < size:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            if shade < 0 and page.startswith("<![CDATA[", m.start()):
                text.append(page[m.start() + 9 : at].removesuffix("]]>"))
            continue
        name = name.lower()
        closed = m[3].rstrip().endswith("/")
        if name in BREAKS or m[1] and name == foreign:
            foreign, was = "", foreign
            if name == was:
                continue
        if foreign and name not in RAW:
            continue
        if name in FOREIGN and not m[1]:
            foreign = "" if closed else name
            continue
        if m[1]:
            if name == "a" and shade < 0:
                links = max(0, links - 1)
            if name in INLINE or name in EMPTY:
                continue
            open_ = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == name), -1)
            if shade >= 0 and not 0 <= open_ < shade:  # inside what is hidden, or its own end
                if open_ >= 0:
                    del stack[open_:]
                    shade = shade if open_ > shade else -1
                continue
            if name in HIDDEN:
                continue
            shade = -1
            flush()
            if open_ >= 0:
                del stack[open_:]
            links = 0
            continue
        if name in RAW:
            if not closed:
                end = RAW_END[name].search(page, at)
                if end is None and name in ("title", "textarea"):
                    end = next((t for t in TAG.finditer(page, at) if t[2] and t[2].lower() in BREAKS), None)
                    at = end.start() if end else size
                else:
                    at = end.end() if end else size
            continue
        if shade >= 0 and name in BREAKS and not ends_later(stack[shade][1]):
            del stack[shade:]
            shade = -1
        if name in HIDDEN and not closed:
            shade = len(stack) if shade < 0 else shade
            stack.append((name, name))
            continue
        if shade >= 0:
            if name not in INLINE and name not in EMPTY:
                stack.append((name, name))
            continue
        if name in HIDDEN:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in INLINE:
            links += name == "a"
            continue
        flush()
        links = 0
        if stack and (stack[-1][1] == "p" or name in (ENDS.get(stack[-1][1]) or ())):
            stack.pop()
            while stack and name in (ENDS.get(stack[-1][1]) or ()):
                stack.pop()
        if name in EMPTY:
            continue
        named = " ".join(x for groups in NAMES.findall(m[3]) for x in groups if x) if m[3] else ""
        stack.append((f"{name} {named}".rstrip().lower(), name))
    flush()
    return out
