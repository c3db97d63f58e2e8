"""Main text of web pages, by deducing the template that a host's pages share.

A token is a tag with its path or a text with its path. Over all pages of a host, tokens that occur equally often
in every page form an equivalence class. Classes that hold on several different pages are the template of these, if
their tokens keep one order; classes that lie between two tokens of another one are nested in it. What the template
leaves open are slots, and the slots of the article are the main text. A class that holds on few pages, or on some of
a host's pages only, must leave enough of a page's main text, or it is an article that was published again.

Vectors of occurrences are never gathered: two sums over the pages, of hashes times counts, stand for a token's
vector, so that a host with a third of all pages is summed up in every task.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import add_columns, raw_text
from millrace.llm.graph import written
from millrace.llm.page_tokens import MAIN_TAGS, Element, Token, held_text, page_tokens, settle

#: Different pages that a class must stand on.
FEW = 3
#: Share of a host's pages that a class must stand on. It bounds a host's classes to twenty times the tokens of a page,
#: so that they can be gathered and tried on each of its pages.
PART = 0.05
#: Different pages of a host, and the share of them that a class must stand on, to be the template of all of them.
PAGES = 8
SUPPORT = 0.9
#: How much of a page's main text a class must leave, as a share of what it takes: one that stands on so many of a
#: host's few pages; and one of some pages only, which may also be an article published several times with changes.
LEAVE_FEW, LEAVE_PART = 0.5, 1.0
#: Tokens that a class must have.
TOKENS = 3
#: Bytes of all templates, at most, for them to be sent to every task; beyond, they are joined by host.
SENT_BYTES = 64_000_000

# Elements that are parts of a text, not containers of one.
PARTS = set(
    "p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure "
    "figcaption details summary address center".split()
)

_TOKENS = "roles array<bigint>, times array<int>, places array<float>, page bigint"
_TEMPLATE = "array<struct<tokens:array<struct<role:bigint,place:double>>,leave:double>>"


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _counted():
    def tokens(pages: list[bytes]) -> list:
        out = [[], [], [], []]
        for raw in pages:
            found = page_tokens(raw.decode("utf-8", "replace"))
            places = defaultdict(list)
            for i, t in enumerate(found):
                places[t.role].append(i)
            out[0].append(list(places))
            out[1].append([len(at) for at in places.values()])
            out[2].append([at[0] / len(found) for at in places.values()])
            # Pages that differ in attributes, scripts or comments only are copies.
            out[3].append(xxhash.xxh64_intdigest(b"".join(t.role.to_bytes(8, "little") for t in found)) >> 1)
        return out

    return tokens


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The classes of every host with enough pages: ``host`` and ``template``. Pages with equal tokens count once."""
    each = add_columns(pages, {"host": _host(url_col)}, [raw_text(html_col)], _counted, _TOKENS)
    each = each.dropDuplicates(["host", "page"])
    # The page as a whole is a token as well; it tells how many pages the host has.
    whole = F.struct(F.lit(-1).cast("long").alias("roles"), F.lit(1).alias("times"), F.lit(0.0).cast("float").alias("places"))
    tokens = (
        each.select("host", "page", F.inline(F.concat(F.arrays_zip("roles", "times", "places"), F.array(whole))))
        .groupBy("host", F.col("roles").alias("role"))
        .agg(
            F.count("*").alias("support"),
            F.sum(F.col("page").bitwiseAND(F.lit(0x7FFFFFFF)) * F.col("times")).alias("v1"),
            F.sum(F.shiftright("page", 32) * F.col("times")).alias("v2"),
            F.avg("places").alias("place"),
        )
    )
    tokens = written(tokens.filter("support > 1"), "tokens")
    hosts = tokens.filter("role = -1").filter(F.col("support") >= FEW).select("host", F.col("support").alias("pages"))
    leave = F.when(F.col("support") < SUPPORT * F.col("pages"), LEAVE_PART).when(F.col("pages") < PAGES, LEAVE_FEW).otherwise(0.0)
    return (
        tokens.filter("role >= 0")
        .join(hosts, "host")
        .filter((F.col("support") >= FEW) & (F.col("support") >= PART * F.col("pages")))
        .groupBy("host", "v1", "v2", "support", "pages")
        .agg(F.array_sort(F.collect_list(F.struct("place", "role"))).alias("members"))
        .filter(F.size("members") >= TOKENS)
        .select("host", F.struct(F.transform("members", lambda m: F.struct(m["role"].alias("role"), m["place"].alias("place"))).alias("tokens"), leave.alias("leave")).alias("class"))
        .groupBy("host")
        .agg(F.collect_list("class").cast(_TEMPLATE).alias("template"))
    )


def valid_classes(tokens: list[Token], classes: list[list[int]], leaves: list[float]) -> list[tuple[float, list[int]]]:
    """The classes that are valid on a page, with their share to leave: every token there, equally often, in the
    class's order, and each class either within one gap of another or apart from it. Those of all pages come first."""
    places = defaultdict(list)
    for i, t in enumerate(tokens):
        places[t.role].append(i)
    valid: list[tuple[float, list[int]]] = []
    for leave, roles in sorted(zip(leaves, classes), key=lambda c: (c[0], -len(c[1]))):
        counts = Counter(len(places.get(r, ())) for r in roles)
        n = max(counts, default=0, key=lambda k: (counts[k], k))
        held = [r for r in roles if n and len(places.get(r, ())) == n]
        # Members out of order on this page are left out, the longest ordered run in the class's order stays.
        ordered, last = [], -1
        for r in held:
            if places[r][0] > last:
                ordered.append(r)
                last = places[r][0]
        if len(ordered) < TOKENS:
            continue
        spans = list(zip(*[places[r] for r in ordered]))
        repeats_apart = all(a[-1] < b[0] for a, b in zip(spans, spans[1:]))
        if not repeats_apart:
            continue
        valid.append((leave, ordered))
    nested: list[tuple[float, list[int]]] = []
    for leave, roles in valid:
        if all(_fits(places, roles, outer) for _, outer in nested):
            nested.append((leave, roles))
    return nested


def template_roles(found: list[tuple[float, list[int]]], amounts: Counter[int]) -> set[int]:
    """Roles of the classes that are template on a page whose main text has ``amounts`` of characters by role: of
    classes that must leave some of it, those that take least come first."""
    fixed = {r for leave, roles in found if not leave for r in roles}
    left = sum(n for r, n in amounts.items() if r not in fixed)
    taking = [(sum(amounts[r] for r in roles), leave, roles) for leave, roles in found if leave]
    for taken, leave, roles in sorted(taking):
        if left - taken >= leave * taken:
            fixed.update(roles)
            left -= taken
    return fixed


def _fits(places: dict[int, list[int]], inner: list[int], outer: list[int]) -> bool:
    """Whether each occurrence of the inner class lies in one gap of the outer, or the two are of one level."""
    if len(places[inner[0]]) == len(places[outer[0]]) == 1:
        return True
    borders = sorted(i for r in outer for i in places[r])
    for k in range(len(places[inner[0]])):
        first, last = places[inner[0]][k], places[inner[-1]][k]
        if any(first < b < last for b in borders):
            return False
    return True


def _container(blocks: list[tuple[Element, str]]) -> Element:
    """The smallest element that holds the paths with most text, and is no part of a text itself."""
    weight = Counter()
    for element, text in blocks:
        weight[element.path] += len(text)
    most = max(weight.values())
    held: list[Element] | None = None
    for element, _ in blocks:
        if 4 * weight[element.path] >= most:
            chain = [element, *element.around()][::-1]
            if held is not None:
                chain = [a for a, b in zip(held, chain) if a is b]
            held = chain
    while held[-1].name in PARTS:
        held.pop()
    return held[-1]


def _set_hinted_aside(tokens: list[Token], fixed: set[int]) -> None:
    """Set aside what a part of a name hints at inside the article, such as "share-buttons", where the element belongs
    to the template. One that holds an article or most of the main text is a wrapper."""
    elements = [t.element for t in tokens if t.text is None]
    hinted = [t.element for t in tokens if t.text is None and t.element.hinted and not t.aside and t.role in fixed]
    if not hinted:
        return
    weight = held_text(tokens, lambda t: t.main and not t.aside)
    most = max(weight.values(), default=0)
    holders = {id(a) for e in elements if e.name in MAIN_TAGS for a in e.around()}
    for e in hinted:
        e.named = id(e) not in holders and 2 * weight[id(e)] <= most
    settle(elements)


def main_text(page: str, classes: list[list[int]], leaves: list[float] | None = None) -> str:
    """The article's slots: texts that belong neither to the template nor to a part beside the article. A page
    without an article or main element gives those of the smallest container of its heaviest text. ``leaves`` has
    how much each class must leave, which is nothing if not given."""
    tokens = page_tokens(page)
    has_main = any(t.main and not t.aside for t in tokens if t.text)
    fixed: set[int] = set()
    if classes:
        amounts = Counter()
        for t in tokens:
            if t.text and not t.aside and (t.main or not has_main):
                amounts[t.role] += len(t.text.strip())
        fixed = template_roles(valid_classes(tokens, classes, leaves or [0.0] * len(classes)), amounts)
        _set_hinted_aside(tokens, fixed)
    pieces: list[list[str]] = []
    elements: list[Element] = []
    opened = False
    for t in tokens:
        opened = opened and not t.ends
        if t.text is None or t.aside or (has_main and not t.main):
            opened = False
            continue
        if t.role in fixed and t.text.strip():
            continue
        if not opened:
            pieces.append([])
            elements.append(t.element)
            opened = True
        pieces[-1].append(t.text)
    texts = [" ".join("".join(p).split()) for p in pieces]
    blocks = [(e, x) for e, x in zip(elements, texts) if x]
    if not has_main and blocks:
        box = _container(blocks)
        blocks = [(e, x) for e, x in blocks if e is box or any(a is box for a in e.around())]
    return "\n".join(x for _, x in blocks)


def _extracting():
    def extract(pages: list[bytes], found: list) -> list:
        texts = []
        for raw, template in zip(pages, found):
            classes = [[t["role"] for t in c["tokens"]] for c in template or ()]
            texts.append(main_text(raw.decode("utf-8", "replace"), classes, [c["leave"] for c in template or ()]))
        return [texts, [len(x) for x in texts]]

    return extract


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of ``pages``: its id, url, main ``text`` and ``n_chars``.

    Blocks are joined by one line break; white space within a block is one space; character references are decoded.
    A null or empty page has an empty text. A null or odd url belongs to the host "". Hosts with one or two
    different pages have no template, and lose only what markup tells to be beside the article. Repeated rows are each returned.
    Whole pages are read however long; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    known = written(templates(pages, url_col, html_col), "templates")
    held = known.agg(F.coalesce(F.sum(F.aggregate("template", F.lit(0).cast("long"), lambda n, c: n + 16 * F.size(c["tokens"]))), F.lit(0))).first()[0]
    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), raw_text(html_col).alias("raw"), _host(url_col).alias("host"))
    both = chosen.join(F.broadcast(known) if held <= SENT_BYTES else known, "host", "left")
    return add_columns(both, {id_col: F.col("id"), url_col: F.col("url")}, [F.col("raw"), F.col("template")], _extracting, "text string, n_chars bigint")
