"""HTML pages as tokens: tags by their place in the page, and the texts between them."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import xxhash

# Elements without an end tag, elements whose content is no markup, and elements that stand inside
# a line of text and end no block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe|svg"
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q ruby s samp small span strike "
    "strong sub sup time tt u var".split()
)
# Elements, and words in a class, id or role, that hold no main text.
ASIDE_TAGS = set(
    "head nav header footer aside form menu button select option input dialog object audio video canvas".split()
) | set(RAW.split("|"))
ASIDE_WORDS = set(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "notice alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget footer "
    "foot header masthead topbar toolbar comment comments reply replies disqus share sharing social related "
    "recommended newsletter subscribe signup login search pagination pager copyright legal hidden contentinfo complementary".split()
)
MAIN_TAGS = {"article", "main"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Elements that group others; names of other elements are labels of a text's own part.
CONTAINERS = set("div section aside nav ul ol dl table details fieldset center".split())
# Elements whose names tell about the whole page, such as a body "with-sidebar".
_WHOLE = MAIN_TAGS | {"html", "body"}
# Elements that a new one of the same kind, or any block in the case of p, closes.
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"[-_]?\d+$")


@dataclass(slots=True, eq=False)
class Element:
    """An open or past element. ``tagged`` says that its own tag puts it beside the text, ``named`` that its own class,
    id or role does; ``hinted`` that a part of such a name would, if the template bears it out. ``beside`` is what
    comes of the tags of all elements around, ``aside`` of tags and names; ``main`` that it is or lies in an article or
    main element."""

    name: str
    path: str
    parent: Element | None
    tagged: bool
    named: bool
    hinted: bool
    main: bool
    beside: bool = False
    aside: bool = False

    def around(self) -> Iterator[Element]:
        """The elements that hold this one, from the inside out."""
        at = self.parent
        while at is not None:
            yield at
            at = at.parent


@dataclass(slots=True)
class Token:
    """A tag or a text. ``role`` is a hash of its path and its content; ``element`` is where it lies; ``ends`` that a
    block ends before it."""

    role: int
    path: int
    text: str | None
    element: Element
    ends: bool

    @property
    def aside(self) -> bool:
        return self.element.aside

    @property
    def main(self) -> bool:
        return self.element.main


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) >> 1


def _names(attributes: str) -> list[str]:
    return [a or b or c for _, a, b, c in _NAMES.findall(attributes)] if "=" in attributes else []


def page_tokens(page: str) -> list[Token]:
    """The tokens of a page in order. Scripts, styles and comments are skipped, whatever they contain. Tags that
    aren't closed end with what holds them; end tags without a start are ignored."""
    out: list[Token] = []
    stack = [Element("", "", None, False, False, False, False)]
    elements = [stack[0]]
    ends = True

    def text(piece: str) -> None:
        nonlocal ends
        if piece:
            path = stack[-1].path
            out.append(Token(_hash(path, "text", " ".join(piece.split())), _hash(path), html.unescape(piece), stack[-1], ends))
            ends = False

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        close, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            continue
        if name == "br":
            text(" ")
            continue
        ends = True
        if close:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
            continue
        shuts = {"p"} | _CLOSES.get(name, set())
        while stack[-1].name in shuts:
            stack.pop()
        around = stack[-1]
        names = _names(attributes)
        path = f"{around.path}/{name}" + "".join(f".{n}" for n in names)
        named, hinted = _named(name, attributes, around.main) if names else (False, False)
        element = Element(name, path, around, name in ASIDE_TAGS, named, hinted, around.main or name in MAIN_TAGS)
        elements.append(element)
        out.append(Token(_hash(path, "tag"), _hash(path), None, element, True))
        if name not in VOID:
            stack.append(element)
    text(page[at:])
    settle(elements)
    _untag_forms(elements, out)
    _unname_wrappers(elements, out)
    return out


def _named(name: str, attributes: str, main: bool) -> tuple[bool, bool]:
    """Whether an element's names put it beside the text, and whether they only hint at it.

    Names of headings are slugs of their words and tell nothing, as do those of the whole page's elements. A class that is an
    aside word by itself (but for a number behind it) counts for all others; an id or role, and a word that is a part of a
    name, for containers only. Inside the article a part of a name is a hint.
    """
    if name in _WHOLE or name in HEADINGS:
        return False, False
    kinds = CONTAINERS if main or name == "p" else None
    whole = part = False
    for kind, *quoted in _NAMES.findall(attributes):
        contains = kinds is None or name in kinds
        for token in "".join(quoted).lower().split():
            if _NUMBER.sub("", token) in ASIDE_WORDS:
                whole = whole or contains or kind.lower() == "class"
            elif contains and any(w in ASIDE_WORDS for w in _WORD.findall(token)):
                part = True
    return whole or (part and not main), part and main


def settle(elements: list[Element]) -> None:
    """Hand down what lies beside the text, to elements in their order on the page. A heading in the article's own
    header is a part of it."""
    for e in elements:
        up = e.parent
        if up is None:
            e.beside, e.aside = e.tagged, e.tagged or e.named
            continue
        if e.name in HEADINGS and up.beside:
            header = next(a for a in e.around() if a.tagged)
            if header.name == "header" and header.parent.main:
                up = header.parent
        e.beside = e.tagged or up.beside
        e.aside = e.beside or e.named or up.aside


def held_text(tokens: list[Token], count: Callable[[Token], bool]) -> Counter[int]:
    """Characters that each element holds, in itself and in those within, of the tokens that count; by the element's
    identity."""
    weight: Counter[int] = Counter()
    for t in tokens:
        n = len(t.text.strip()) if t.text is not None and count(t) else 0
        if n:
            for a in (t.element, *t.element.around()):
                weight[id(a)] += n
    return weight


def _untag_forms(elements: list[Element], tokens: list[Token]) -> None:
    """A form round an article, a main element or most of the page's text is a wrapper."""
    forms = [e for e in elements if e.name == "form" and not e.parent.beside]
    if not forms:
        return
    for e in forms:
        e.tagged = False
    settle(elements)
    weight = held_text(tokens, lambda t: not t.element.beside)
    holders = {id(a) for e in elements if e.name in MAIN_TAGS and not e.beside for a in e.around()}
    for e in forms:
        e.tagged = id(e) not in holders and 2 * weight[id(e)] <= weight[id(elements[0])]
    settle(elements)


def _unname_wrappers(elements: list[Element], tokens: list[Token]) -> None:
    """Names do not set aside what holds the main element or the page's own article. That is the longest one, if it
    is the only one in what is set aside, or has more text than all that is not. So lists of teasers, or comments
    that are articles, stay aside."""
    held = [e for e in elements if e.name in MAIN_TAGS and not e.beside and any(a.named for a in e.around())]
    if not held:
        return
    for e in held:
        if e.name == "main":
            for a in e.around():
                a.named = False
    settle(elements)
    weight: Counter[int] = Counter()
    free = free_main = 0
    for t in tokens:
        n = 0 if t.text is None or t.element.beside else len(t.text.strip())
        if n:
            if not t.aside:
                free += n
                free_main += n if t.main else 0
            for a in (t.element, *t.element.around()):
                if a.name == "article":
                    weight[id(a)] += n
    articles = [e for e in elements if e.name == "article" and weight[id(e)]]
    own = max(articles, key=lambda e: weight[id(e)], default=None)
    if own is None or not own.aside:
        return
    wrapper = [a for a in own.around() if a.named][-1]
    alone = sum(wrapper in e.around() and not any(a.name == "article" for a in e.around()) for e in articles) == 1
    if weight[id(own)] >= free or (alone and not free_main):
        for a in own.around():
            a.named = False
        settle(elements)
