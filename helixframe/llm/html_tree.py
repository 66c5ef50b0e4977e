"""A forgiving HTML tree: elements with text blocks, in page order.  Works in one pass and never fails."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

#: Possessive, and no tag runs over a `<` outside quotes: markup without an end costs no backtracking.
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/><]*+)((?:[^><\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/><]*+)([^><]*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label|name)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WHITE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template iframe textarea title".split())
#: Elements that are dropped with what is in them, up to their end or to a tag of _BREAKS; one without an end is no such element.
_DROPPED = frozenset(("svg", "select"))
_FORMULA = "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation annotation-xml"
INLINE = frozenset(f"{_FORMULA} a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BREAKS = {"svg": _CLOSES_P | frozenset("body br center dd dt em embed head html i img li meta p s small span strong sub sup u".split()), "select": (_CLOSES_P - {"hr"}) | frozenset("body head html input select textarea li dt dd".split())}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Node:
    __slots__ = ("tag", "words", "parent", "kids", "text", "linked", "i")

    def __init__(self, tag, words, parent):
        self.tag, self.words, self.parent, self.i = tag, words, parent, 0
        self.kids, self.text, self.linked = [], None, 0


def _attribute_words(raw: str) -> list[str]:
    if "=" not in raw:
        return []
    return [w.lower() for m in _ATTRIBUTE.finditer(raw) for w in _WORDS.findall(m[2] or m[3] or m[4] or "")]


def parse(html: str) -> Node:
    """The tree of block elements.  Text between block boundaries is a child of its own with tag '#' and `text`; `linked` counts its characters in links."""
    root = Node("#root", [], None)
    stack, inline = [root], []  # open blocks; open inline elements since the last block boundary
    opened: Counter[str] = Counter()  # how many of each these are
    places = {}  # where in the stack each tag is open
    pieces, links = [], 0

    def flush():
        nonlocal pieces, links
        if pieces:
            text = WHITE.sub(" ", unescape("".join(pieces))).strip()
            if text:
                leaf = Node("#", [], stack[-1])
                leaf.text, leaf.linked = text, min(links, len(text))
                stack[-1].kids.append(leaf)
            pieces, links = [], 0

    def innermost(names):
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def close(names, stops=()):
        i = innermost(names)
        if i and i > innermost(stops):
            flush()
            for x in stack[i:]:
                places[x.tag].pop()
            del stack[i:]

    endless = set()  # tags without an end from here on

    def end_of(tag, at):
        """Where the next end of a tag begins, or -1."""
        nonlocal low
        if tag in endless:
            return -1
        low = html.lower() if low is None else low
        if len(low) != n:  # lower-casing changed lengths: search without it
            k = re.compile(rf"</{tag}", re.IGNORECASE).search(html, at)
            k = k.start() if k else -1
        else:
            k = low.find("</" + tag, at)
        if k < 0:
            endless.add(tag)
        return k

    dropped, depth, foreign = None, 0, 0  # the element that is being dropped, and its open copies and embedded html
    at, n = 0, len(html)
    low = None
    while at < n:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else n
        if stop > at and not dropped:
            pieces.append(html[at:stop])
            if opened["a"]:
                links += stop - at
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ends, raw = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if dropped:
            if tag == dropped:
                if dropped == "svg" or ends:
                    depth += -1 if ends else not raw.endswith("/")
                    dropped = dropped if depth > 0 else None
                    continue
            elif tag == "foreignobject":
                foreign += -1 if ends else not raw.endswith("/")
            broken = places.get(tag) if ends else tag in _BREAKS[dropped]
            if foreign <= 0 and broken:
                dropped = None
            elif raw.endswith("/"):
                continue
        if tag in _RAW and not ends:
            k = end_of(tag, at)
            if k >= 0 or tag == "script":
                at = n if k < 0 else (html.find(">", k) + 1 or n)
                if not dropped:
                    flush()
                continue
        if dropped:
            continue
        if tag in _DROPPED and not ends:
            if tag == "svg" and raw.endswith("/"):
                continue
            if tag == "select":
                flush()
            if end_of(tag, at) >= 0:
                dropped, depth, foreign = tag, 1, 0
                continue
            if tag == "svg":
                continue
        if tag in INLINE:
            if tag in ("br", "wbr"):
                pieces.append(" " if tag == "br" else "")
            elif tag in _VOID:
                pass
            elif ends:
                while opened[tag]:  # each is taken off once, so a page costs its length
                    opened[last := inline.pop()] -= 1
                    if last == tag:
                        break
            else:
                inline.append(tag)
                opened[tag] += 1
            continue
        if ends:
            flush()
            close((tag,))
            inline = []
            opened.clear()
            continue
        flush()
        inline = []
        opened.clear()
        if tag in _CLOSES_P:
            close(("p",), ("td", "th", "table", "button", "article", "section", "div", "body", "li"))
        if tag in _CLOSES:
            close(_CLOSES[tag], _STOPS[tag])
        if tag in ("html", "body") and any(x.tag == tag for x in stack[:4]):
            continue
        node = Node(tag, _attribute_words(raw), stack[-1])
        stack[-1].kids.append(node)
        if tag not in _VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    flush()
    return root
