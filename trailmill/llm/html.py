"""A tolerant HTML reader: elements, text blocks, links."""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|</?[a-zA-Z][^>]*\Z|(?P<text>[^<]+|<)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("br caption option td th tr tbody thead tfoot html head body".split())
ENDS_BEFORE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
P_SCOPES = set("button table td th #root".split()) | (BLOCK - {"p"})
SCOPES = set("ul ol dl table body html div section article main td th select".split())


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)

    def words(self) -> list[str]:
        """Words of class and id."""
        found = f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}"
        return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", found).lower()) if w]

    def walk(self) -> Iterator[Element]:
        """This element and all below, in page order."""
        stack = [self]
        while stack:
            at = stack.pop()
            yield at
            stack += [c for c in reversed(at.children) if isinstance(c, Element)]

    def text(self) -> str:
        """All text below."""
        stack, found = [self], []
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                found.append(at)
            else:
                stack += reversed(at.children)
        return "".join(found)


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag; the first of equal names counts."""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), entities.unescape(a or b or c))
    return found


def parse(page: str) -> Element:
    """The element tree of a page, of any depth. Open elements are closed where HTML implies it; comments go."""
    root = Element("#root")
    stack, at, depth = [root], 0, 0
    while match := TOKEN.match(page, at):
        at = match.end()
        if (text := match["text"]) is not None:
            stack[-1].children.append(entities.unescape(text))
            continue
        tag = (match["tag"] or match["tag2"] or "").lower()
        if not tag:
            continue
        if match["close"] or match["close2"]:
            close(stack, tag)
            continue
        attrs = match["attrs"] or match["attrs2"] or ""
        if tag in CLOSES_P:
            until(stack, {"p"}, P_SCOPES)
        if tag in ENDS_BEFORE:
            until(stack, ENDS_BEFORE[tag], SCOPES - ({"td", "th"} if tag in ("tr", "td", "th") else set()))
        element = Element(tag, attributes(attrs) if attrs.strip() else {})
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            content = page[at : end.start() if end else len(page)]
            element.children.append(entities.unescape(content) if tag in ("title", "textarea") else content)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            stack.append(element)
            depth = max(depth, len(stack))
    room_for(depth)
    return root


def room_for(depth: int) -> None:
    """Let functions walk a tree of this depth; frames of Python functions lie on the heap."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * depth + 1000))


def until(stack: list[Element], tags: set[str], stops: set[str]) -> None:
    """Close the innermost open element of ``tags``, unless one of ``stops`` stands before it."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in stops:
            return


def close(stack: list[Element], tag: str) -> None:
    """Close the innermost open element of a tag; an inline one does not close blocks inside it."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            if tag in BLOCK or not any(e.tag in BLOCK for e in stack[k + 1 :]):
                del stack[k:]
            else:
                del stack[k]
            return


def blocks(element: Element, skipped) -> list[str]:
    """Text of the blocks below an element, white space as one space; ``skipped`` tells what to leave out."""
    found, now = [], []
    stack: list[Element | str | None] = [None, *reversed(element.children)]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            now.append(at)
            continue
        left_out = at is not None and skipped(at)
        if at is None or at.tag in BLOCK:  # None ends a block
            if line := " ".join("".join(now).split()):
                found.append(line)
            now.clear()
        if at is not None and not left_out:
            stack += [None] * (at.tag in BLOCK)
            stack += reversed(at.children)
    return found
