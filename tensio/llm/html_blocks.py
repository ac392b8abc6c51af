"""Leaf text blocks of an HTML page with the path of elements each lies in.

A tolerant scan: tags may be unclosed or nested wrongly and the page may be cut off anywhere.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Fixed values of the language: elements whose content is never page text (those of the first kind
#: hold no elements and run to their end tag or the end of the page; those of the second are
#: left out only if they have their own end tag), elements that stay inside a block, and
#: elements without content.
_RAW = "script|style|title|textarea"
_CLOSED = "template|noscript|iframe|svg|canvas|object|select"
_MATH = "annotation annotation-xml maction math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics"
_INLINE = frozenset(_MATH.split()) | frozenset("a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag of the first kind ends an open element of the second.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TOKEN = re.compile(
    rf"(?P<text>[^<]+)"
    rf"|<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{_RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|<(?P<closed>{_CLOSED})(?=[\s/>])(?:(?P<inside>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)|[^>]*)>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z"
    r"|<[a-zA-Z][^>]*>"
    r"|(?P<stray><)",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")
_EDGES = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.IGNORECASE) for tag in _CLOSED.split("|")}


class Path:
    """Open elements, outermost first, each as its tag and the words of its names.

    Every path is one element behind its parent's path, so the paths of a page take as much
    room as the page has elements, however deep they nest.  Equal to a tuple of its elements.
    """

    __slots__ = ("parent", "element", "depth", "code", "marks")

    def __init__(self, parent: Path | None, element: tuple[str, ...]):
        self.parent, self.element = parent, element
        self.depth = parent.depth + 1 if parent else 1
        self.code = hash((parent.code if parent else 0, element))
        self.marks: int | None = None  # for the labeller

    def chain(self) -> list[Path]:
        """The paths of all open elements, outermost first."""
        out, at = [], self
        while at is not None:
            out.append(at)
            at = at.parent
        return out[::-1]

    def __iter__(self):
        return (p.element for p in self.chain())

    def __getitem__(self, i):
        return tuple(self)[i]

    def __len__(self) -> int:
        return self.depth

    def __hash__(self) -> int:
        return self.code

    def __eq__(self, other) -> bool:
        if isinstance(other, Path):
            a, b = self, other
            if a.code != b.code or a.depth != b.depth:
                return False
            while a is not b:
                if a.element != b.element:
                    return False
                a, b = a.parent, b.parent
            return True
        return tuple(self) == other


@dataclass
class Block:
    """A text with the elements open around it and how much of it is in links."""

    text: str
    path: Path | tuple[tuple[str, ...], ...]
    link_chars: int


def _words_of(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    values = ("".join(m) for m in _NAMED.findall(attributes))
    return tuple(p for v in values for p in _PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()))


def _own_ends(page: str, tag: str) -> dict[int, int]:
    """Where each start tag of this name that has an end tag of its own finds it."""
    out: dict[int, int] = {}
    waiting: list[int] = []
    for m in _EDGES[tag].finditer(page):
        if not m[1]:
            waiting.append(m.start())
        elif waiting:
            out[waiting.pop()] = m.start()
    return out


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order: references decoded, white space made one space, trimmed."""
    out: list[Block] = []
    stack: list[Path] = []
    opened: Counter[str] = Counter()  # tags of the stack
    parts: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1] if stack else (), links))
            parts.clear()
        links = 0

    own_ends: dict[str, dict[int, int]] = {}
    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        begin, at = at, m.end()
        if m["closed"]:
            tag = m["closed"].lower()
            if tag == "svg" and (m["inside"] or "").endswith("/"):
                continue
            if tag not in own_ends:
                own_ends[tag] = _own_ends(page, tag)
            at = max(at, own_ends[tag].get(begin, at))  # its end tag is the next token and ends nothing
            continue
        text = m["text"] or m["stray"]
        if text:
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if linked:
                links += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        # The hidden elements of a head hide themselves, and its end tag may be missing.
        if tag == "head" or tag in _EDGES:
            if tag == "head":
                flush()
            continue
        if m["end"]:
            if tag == "a":
                linked = 0
            if tag in _INLINE:
                continue
            flush()
            linked = 0
            while opened[tag]:
                top = stack.pop().element[0]
                opened[top] -= 1
                if top == tag:
                    break
            continue
        if tag == "a":
            linked = 1
        if tag == "br":
            parts.append(" ")
        if tag in _INLINE or tag == "br":
            continue
        flush()
        if tag in _CLOSES_P and stack and stack[-1].element[0] == "p":
            opened[stack.pop().element[0]] -= 1
        ends = _ENDS.get(tag)
        if ends and stack and stack[-1].element[0] in ends:
            opened[stack.pop().element[0]] -= 1
        if tag not in _VOID and not m["attributes"].endswith("/"):
            stack.append(Path(stack[-1] if stack else None, (tag, *_words_of(m["attributes"]))))
            opened[tag] += 1
    flush()
    return out
