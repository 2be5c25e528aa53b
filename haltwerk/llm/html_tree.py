"""A tolerant reader of HTML: a tree of block elements with runs of text as leaves."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

MATH = frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split()
)
_SVG = frozenset(
    "g path circle rect line polyline polygon ellipse text tspan textpath defs use symbol marker mask pattern clippath lineargradient radialgradient stop filter image foreignobject desc metadata switch view".split()
)
INLINE = MATH | frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn del em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# contents are not text of the page
SILENT = frozenset("button datalist option optgroup script style noscript template title textarea iframe object svg annotation annotation-xml canvas audio video select noframes".split())
# stand inside a line of text and leave it whole, whether their own contents are text or not
_IN_LINE = INLINE | frozenset(
    "script style noscript template textarea iframe object svg canvas audio video select option optgroup button input output picture source track param embed area map meter progress datalist link meta".split()
)
_RAW = frozenset("script style title textarea noscript iframe noframes template".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody"), "option": ("option",),
}
_SCOPE = frozenset("html body div article section main nav aside header footer table ul ol dl form td th li".split())


@dataclass
class Tree:
    """Nodes in page order; every parent stands before its children."""

    tag: list[str] = field(default_factory=list)  # "" for a run of text
    parent: list[int] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)  # class, id and role of elements, lower case
    text: list[str] = field(default_factory=list)  # of runs
    linked: list[int] = field(default_factory=list)  # characters of a run that stand in links


def _marks(attributes: str) -> str:
    if "=" not in attributes:
        return " hidden" if "hidden" in attributes else ""
    found = []
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label"):
            found.append(html.unescape(value.strip("\"'")).lower())
        elif name == "hidden" or (name == "aria-hidden" and "true" in value):
            found.append("hidden")
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            found.append("hidden")
    return " ".join(found)


def parse(page: str) -> Tree:
    """Read a page.  Nothing in it makes this fail; a tag cut off by the end of the page is dropped."""
    tree = Tree()
    stack: list[tuple[str, int]] = []  # open elements: tag, node (of the nearest block)
    pieces: list[tuple[str, bool]] = []
    links, silent, foreign, node = 0, 0, 0, -1
    opened: Counter[str] = Counter()  # elements on the stack by tag

    def enter(tag: str) -> None:
        stack.append((tag, node))
        opened[tag] += 1

    def add(tag: str, marks: str, text: str, linked: int) -> int:
        tree.tag.append(tag)
        tree.parent.append(node)
        tree.marks.append(marks)
        tree.text.append(text)
        tree.linked.append(linked)
        return len(tree.tag) - 1

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                add("", "", text, min(sum(len(p) for p, inside in pieces if inside), len(text)))
            pieces.clear()

    def leave(index: int) -> None:
        """Close the open elements from ``index`` on."""
        nonlocal node, links, silent, foreign
        for tag, _ in stack[index:]:
            opened[tag] -= 1
            links -= tag == "a"
            silent -= tag in SILENT
            foreign -= tag in ("svg", "math")
        if stack[-1][1] != stack[index - 1][1]:  # a block ends
            flush()
        del stack[index:]
        node = stack[-1][1] if stack else -1

    add("#page", "", "", 0)
    node = 0
    stack.append(("#page", 0))
    at, n = 0, len(page)
    find = _TOKEN.search
    while at < n:
        m = find(page, at)
        if m is None:
            if not silent:
                rest = page[at:]
                cut = rest.rfind("<")
                if cut >= 0 and re.match(r"</?[A-Za-z][^>]*\Z", rest[cut:]):
                    rest = rest[:cut]
                pieces.append((rest, links > 0))
            break
        if m.start() > at and not silent:
            pieces.append((page[at : m.start()], links > 0))
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        if not m.group(4):
            break  # a tag that the end of the page cuts off
        tag = name.lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    leave(k)
                    break
                if tag in _IN_LINE and stack[k][0] not in _IN_LINE:
                    break
            continue
        if tag == "br":
            if not silent:
                pieces.append((" ", False))
            continue
        if (foreign or tag in ("svg", "math")) and m.group(3).endswith("/"):
            continue  # only there a closing slash ends the element
        foreign += tag in ("svg", "math")
        if tag in _RAW:  # what follows is not markup until the end tag
            if tag not in _IN_LINE and not silent:
                flush()
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag in _IN_LINE:
            if tag not in VOID:
                links += tag == "a"
                silent += tag in SILENT
                enter(tag)
            continue
        if foreign and tag in _SVG:
            enter(tag)
            continue
        # a block element: closes what it may not stand in
        for k in range(len(stack) - 1, 0, -1):
            open_tag = stack[k][0]
            if open_tag in _CLOSES.get(tag, ()) or (open_tag == "p" and tag not in SILENT):
                leave(k)
                break
            if open_tag in _SCOPE:
                break
        flush()
        if tag in VOID:
            continue
        node = add(tag, _marks(m.group(3)) if m.group(3) else "", "", 0)
        enter(tag)
        silent += tag in SILENT
    flush()
    return tree
