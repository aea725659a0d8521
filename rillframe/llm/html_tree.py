"""From html to a tree of blocks.

A forgiving reader of tags: it closes what html lets authors leave open, skips what is never shown
as text, and assigns every run of text to the block that holds it. Inline elements (links,
emphasis, formulas and the like) aren't nodes; how much of a block's text stands in links is noted.
What is skipped reaches to its end tag; without one a script or style takes the rest of the page,
of anything else only the start tag is skipped. Reading takes time in proportion to the page,
however deep its blocks are nested.
"""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|$)", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements of formulas, which are inline too.
FORMULA = frozenset("math semantics annotation mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd mpadded mphantom menclose merror".split())
#: What an opening tag closes, up to the nearest of the second set.
_CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
_SCOPE = frozenset({"table", "td", "th", "button", "object"})
#: Parts of a table: their end tags close whatever is open within the table.
_PARTS = frozenset({"table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"})


class Node:
    """A block: its parent's place in the list, its tag and names, and counts over its own text."""

    __slots__ = ("parent", "tag", "names", "depth", "chars", "linked", "stops", "all_chars", "all_linked", "mark")

    def __init__(self, parent: int, tag: str, names: list[str], depth: int, mark: str | None = None):
        self.parent, self.tag, self.names, self.depth, self.mark = parent, tag, names, depth, mark
        self.chars = self.linked = self.stops = self.all_chars = self.all_linked = 0


def _names(attributes: str) -> tuple[list[str], str | None]:
    """The words of class, id and role, and the mark of a labelled page."""
    found: list[str] = []
    mark = None
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key in ("class", "id", "role"):
            found += re.findall(r"[a-z]+", html.unescape(m[2] or m[3] or m[4] or "").lower())
        elif key == "data-mark":
            mark = m[2]
    return found, mark


def parse(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The blocks, parents first, and the runs of text in page order with the block of each."""
    nodes = [Node(-1, "#root", [], 0)]
    texts: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("#root", 0)]  # open blocks
    open_at: dict[str, list[int]] = {}  # by tag, where in the stack blocks of it are open
    endless: set[str] = set()  # skipped elements that have no further end tag
    links = 0  # open links
    run: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal run, linked
        text = " ".join("".join(run).split())
        if text:
            at = stack[-1][1]
            texts.append((at, text))
            node = nodes[at]
            node.chars += len(text)
            node.linked += min(linked, len(text))
            node.stops += sum(map(text.count, ".,;:!?"))
        run, linked = [], 0

    def close(names: frozenset[str] | set[str], scope: frozenset[str]) -> None:
        """Closes the innermost open block of the names unless one of the scope lies within it."""
        innermost = max((open_at[x][-1] for x in names if open_at.get(x)), default=0)
        if innermost and innermost >= max((open_at[x][-1] for x in scope if open_at.get(x)), default=0):
            flush()
            while len(stack) > innermost:
                open_at[stack.pop()[0]].pop()

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            shown = html.unescape(piece) if "&" in piece else piece
            run.append(shown)
            if links:
                linked += len(shown.strip())

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        if m[2] is None:  # a comment or a declaration
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                run.append(" ")
            elif tag not in INLINE and tag not in FORMULA:
                close({tag}, ({"table"} if tag in _PARTS else _SCOPE) - {tag})
            continue
        if tag in _RAW:
            if tag == "svg" and m[3].rstrip().endswith("/"):
                continue
            end = None if tag in endless else _RAW[tag].search(source, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = size
            else:
                endless.add(tag)
            continue
        if tag == "a":
            links += 1
            continue
        if tag in INLINE or tag in FORMULA:
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        close({"p"}, _SCOPE)
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        flush()
        names, mark = _names(m[3]) if m[3] else ([], None)
        nodes.append(Node(stack[-1][1], tag, names, len(stack), mark))
        links = 0
        if not m[3].endswith("/") or tag not in ("path", "rect"):
            open_at.setdefault(tag, []).append(len(stack))
            stack.append((tag, len(nodes) - 1))
    flush()
    for node in reversed(nodes):
        node.all_chars += node.chars
        node.all_linked += node.linked
        if node.parent >= 0:
            nodes[node.parent].all_chars += node.all_chars
            nodes[node.parent].all_linked += node.all_linked
    return nodes, texts
