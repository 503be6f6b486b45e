"""Main text of web pages by wrappers that are inferred from the pages of a host.

A page's token stream is read as a tree of elements and text slots. Runs of equal
siblings, and runs of equal groups of siblings, become repeated groups, so a page is a
union-free regular expression over tags and slots. Siblings of one name count as equal if
what they hold is alike, so a menu and an article in elements of the same name stay apart.
The wrapper of a host is the alignment of its pages' expressions: equal elements meet in
order and are aligned inside, an element that one side lacks becomes optional. Pages of
one template have the same expression, so a host is aligned over its distinct
expressions, in two rounds of about the square root of their number, not over its pages.

Every page is then matched against the wrapper, which gives each of its texts the slot it
fills. The host's statistics of a slot (distinct pages, characters, whether its text ever
changes) classify it: a slot whose text is the same on three distinct pages or more is
template; an optional or repeated one only if these are half of the host's distinct
pages, too. The main region are the wrapper's outermost article and main elements below
one parent, or else its smallest element that holds most of the changing text. The text
of a page is what it has in slots of the region, less template slots and elements that by
their tag, role, class or id are menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles or reader comments. A page of template slots only keeps them. A
page with nothing in the host's region gets one from its own tree.

Elements nested deeper than ``DEPTH`` become siblings at that depth, as in browsers; their
text and what they inherit as chrome stay.

Cases: null and empty pages have an empty text; text without markup is all main text; a
null or odd url is a host of its own kind, the empty one; unclosed, stray and cut-off tags
are closed, ignored and dropped; repeated rows are pages of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_groups, table, tidy, whole_groups

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp")}
_RAW_TO_END = frozenset("script style textarea title iframe xmp".split())  # without a closing tag they last to the end of the page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements of these names hold no main text (fixed list).
CHROME_TAGS = frozenset("head script style noscript template svg iframe object nav header footer aside button select textarea input menu dialog fieldset title xmp".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark chrome (fixed list).
CHROME_WORDS = frozenset(
    "nav navbar navigation navi menu menus menubar masthead topbar header footer foot bottombar sidebar sidebars rail aside widget widgets ad ads adv advert adverts "
    "advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification "
    "alert alerts popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended recommendations breadcrumb breadcrumbs "
    "pagination pager comment comments commentlist disqus reply replies respond reactions discussion form search toolbar copyright legal disclaimer skip hidden paywall".split()
)
#: Those of them that also name parts of an article; inside one they mark nothing (fixed list).
UNSURE_WORDS = frozenset("alert alerts notice notices notification notifications legal disclaimer discussion related social reactions".split())
_OWN_HEADER = frozenset("article post entry content story section".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
DEPTH = 256
MASK_BYTES = 32 << 20  # of an alignment's masks that are held, others are made again
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """An element: its key (tag, classes, id), whether it is chrome, and children (nodes and strings).

    ``likely``: 2 for forms and elements marked by a class word, 1 if only by unsure ones; ``settle`` decides.
    """

    __slots__ = ("tag", "key", "chrome", "likely", "children")

    def __init__(self, tag: str, key: str, chrome: bool, likely: int = 0):
        self.tag, self.key, self.chrome, self.likely, self.children = tag, key, chrome, likely, []


def _element(tag: str, attrs: str) -> Node:
    if not attrs or not attrs.strip(" /\n\t"):
        return Node(tag, tag, tag in CHROME_TAGS, 2 if tag == "form" else 0)
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    names = [*got.get("class", "").split(), *got.get("id", "").split()]
    key = tag + "".join(sorted("." + re.sub(r"\d+", "0", n) for n in names)) if tag in BLOCK or tag == "span" else tag
    words = {w.lower() for n in names for w in _WORDS.findall(n)} if names else set()
    marked = words & CHROME_WORDS
    if marked == {"header"} and words & _OWN_HEADER:
        marked = set()
    chrome = tag in CHROME_TAGS or got.get("role", "").lower() in CHROME_ROLES
    likely = 0 if tag in ("html", "body", "article", "main") else 2 if tag == "form" or got.get("role", "").lower() == "form" or marked - UNSURE_WORDS else 1 if marked else 0
    chrome = chrome or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
    return Node(tag, key, chrome, likely)


def settle(root: Node) -> Node:
    """Makes likely chrome chrome, unless it holds an article or main element or most of the
    page's text, or lies in an article with unsure words only: there, what the host's pages
    repeat is template, and the rest is text."""
    held: dict[int, tuple[int, bool]] = {}

    def measure(n: Node) -> tuple[int, bool]:
        size, named = 0, n.tag in ("article", "main")
        for c in n.children:
            if isinstance(c, str):
                size += len(c.strip())
            elif not c.chrome:
                more, inner = measure(c)
                size, named = size + more, named or inner
        if n.likely:
            held[id(n)] = size, named
        return size, named

    def decide(n: Node, inside: bool) -> None:
        inside = inside or n.tag in ("article", "main")
        for c in n.children:
            if isinstance(c, str) or c.chrome:
                continue
            if c.likely:
                size, named = held[id(c)]
                c.chrome = not named and 2 * size <= total and not (inside and c.likely == 1)
            if not c.chrome:
                decide(c, inside)

    total, _ = measure(root)
    if held:
        decide(root, False)
    return root


def parse(page: str | None) -> Node:
    """The tree of a page; every tag that is still open at the end is closed there."""
    root = Node("", "", False)
    stack, at, page = [root], 0, page or ""

    def add(child) -> None:
        """Below the open element, or, where that lies too deep, beside it."""
        top = stack[-1]
        if len(stack) <= DEPTH:
            top.children.append(child)
            return
        if isinstance(child, str):
            child, text = Node(top.tag, top.key, top.chrome, top.likely), child
            child.children.append(text)
        elif len(stack) > DEPTH + 1 or top.chrome:
            child.chrome, child.likely = child.chrome or top.chrome, max(child.likely, top.likely)
        stack[DEPTH - 1].children.append(child)

    unclosed: set[str] = set()  # tags of _RAW that are not closed any more
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            else:
                if tag == "br" or tag == "p":
                    add(Node(tag, tag, False))
            continue
        if tag in _CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _STOPS[tag]:
                    break
                if stack[k].tag in _CLOSES[tag]:
                    del stack[k:]
                    break
        elif tag in BLOCK and tag not in ("br", "button"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        node = _element(tag, m[3])
        add(node)
        if tag in _RAW:
            end = None if tag in unclosed or tag == "svg" and m[3].endswith("/") else _RAW[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in _RAW_TO_END:
                at = len(page)
            elif not m[3].endswith("/"):
                unclosed.add(tag)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return settle(root)


# A wrapper is a list of items [key, quantifier, children, texts]; quantifier '', '?', '+' or '*';
# key 'T' is a text slot, '(' a group of siblings. ``texts``: what of a page a slot holds, or the slot's number.


def outline(root: Node) -> tuple[list, list[tuple[str, str, bool]]]:
    """The union-free expression of a page, and its texts (path, text, chrome) block by block.

    Inline markup belongs to its slot; paths name blocks only.
    """
    found: list[tuple[str, str, bool]] = []

    def read(node: Node, path: str, chrome: bool) -> list:
        out: list = []
        buffer: list[str] = []

        def flush() -> None:
            text = "".join(buffer)
            buffer.clear()
            if text:
                found.append((path, text, chrome))
                if not text.isspace():
                    _append(out, ["T", "", [], [len(found) - 1]])

        def walk(n: Node) -> None:
            for c in n.children:
                if isinstance(c, str):
                    buffer.append(c)
                elif c.tag in BLOCK or c.chrome:
                    flush()
                    if c.tag not in ("br", "hr") and (c.children or c.tag in BLOCK):
                        _append(out, [c.key, "", read(c, f"{path}/{c.key}", chrome or c.chrome), []])
                elif c.tag not in _RAW and c.tag not in VOID:
                    walk(c)

        walk(node)
        flush()
        return _groups(out)

    return read(root, "", False), found


def slots(root: Node) -> list[tuple[str, str, bool]]:
    """(path, text, chrome) of every text of a page."""
    return outline(root)[1]


def bare(items: list) -> list:
    """An expression without the texts of its page."""
    return [[k, q, bare(inner), []] for k, q, inner, _ in items]


def expression(root: Node) -> list:
    return bare(outline(root)[0])


def _inner(item: list) -> frozenset[str]:
    """The names of what an item holds."""
    return frozenset(_name(c) for c in item[2])


def _half(x: frozenset[str], y: frozenset[str]) -> bool:
    return not x or not y or 2 * len(x & y) >= len(x | y)


def _alike(a: list, b: list) -> bool:
    """Whether what two items hold is half the same, by names."""
    return _half(_inner(a), _inner(b))


def _append(out: list, item: list) -> None:
    """Adds an item; an equal sibling just before becomes a repeated one, aligned inside."""
    if out and out[-1][0] == item[0] and (item[0] == "T" or _alike(out[-1], item)):
        last = out[-1]
        out[-1] = [last[0], "" if item[0] == "T" else _repeat(last[1]), align(last[2], item[2]), last[3] + item[3]]
    else:
        out.append(item)


def _repeat(q: str) -> str:
    return "*" if q in ("?", "*") else "+"


def _optional(q: str) -> str:
    return "*" if q in ("+", "*") else "?"


def _groups(items: list, most: int = 4) -> list:
    """Runs of equal groups of two to ``most`` siblings become one repeated group."""
    for size in range(2, most + 1):
        k = 0
        while k + 2 * size <= len(items):
            first = items[k : k + size]
            keys = [x[0] for x in first]

            def again(at: int) -> bool:
                nxt = items[at : at + size]
                return [x[0] for x in nxt] == keys and all(map(_alike, first, nxt))

            if again(k + size):
                merged, end = first, k + size
                while again(end):
                    merged = align(merged, items[end : end + size])
                    end += size
                items = [*items[:k], ["(", "+", merged, []], *items[end:]]
            k += 1
    return items


def _name(item: list) -> str:
    return "(" + ",".join(x[0] for x in item[2]) if item[0] == "(" else item[0]


def _meetings(a: list, b: list):
    """For kinds of items in ``a`` and ``b`` (a name, and the names it must be alike by, or None): a function of
    a place in ``a``; its answer has bit k set if that item equals the k-th last of ``b``."""
    places: dict[tuple, list[int]] = {}
    for k, kind in enumerate(reversed(b)):
        places.setdefault(kind, []).append(k)
    named: dict[str, list[tuple]] = {}
    for kind in places:
        named.setdefault(kind[0], []).append(kind)

    @lru_cache(max(64, MASK_BYTES // (len(b) // 8 + 64)))
    def mask(kind: tuple) -> int:
        bits = bytearray(len(b) // 8 + 1)
        for other in named.get(kind[0], ()):
            if kind[1] is None or _half(kind[1], other[1]):
                for k in places[other]:
                    bits[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(bits, "little")

    return lambda i: mask(a[i])


def longest(n: int, m: int, mask) -> list[tuple[int, int]]:
    """A longest run of pairs, in order, of places below ``n`` and ``m`` that ``mask`` (see ``_meetings``) lets meet.

    A row of the table of lengths is one number: bit k is 0 where the length grows with the k-th last place.
    About the square root of ``n`` rows are held, the others made again, so memory grows far slower than the table.
    """
    full, step = (1 << m) - 1, isqrt(n) + 1

    def above(i: int, row: int) -> int:
        hit = row & mask(i)
        return (row + hit | row - hit) & full

    held, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            held[i] = row
    out, i, j = [], 0, 0
    for first in range(0, n, step):
        last = min(first + step, n)
        rows = {last: held[last]}
        for k in range(last - 1, first - 1, -1):
            rows[k] = above(k, rows[k + 1])
        while i < last and j < m:
            k = m - 1 - j
            if mask(i) >> k & 1:
                out.append((i, j))
                i, j = i + 1, j + 1
                continue
            low = (2 << k) - 1
            if (rows[i] & low).bit_count() == (rows[i + 1] & low).bit_count():  # as long without item i
                i += 1
            else:
                j += 1
    return out


def pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Which items of two expressions meet, in order: equal names, and alike where a name occurs again.

    After equal items at both ends, as many as can meet.
    """
    na, nb = [_name(x) for x in a], [_name(x) for x in b]
    twice = {x for names in (na, nb) for x, n in Counter(names).items() if n > 1} - {"T"}

    def same(i: int, j: int) -> bool:
        return na[i] == nb[j] and (na[i] not in twice or _alike(a[i], b[j]))

    lo, n, m = 0, len(a), len(b)
    while lo < min(n, m) and same(lo, lo):
        lo += 1
    while min(n, m) > lo and same(n - 1, m - 1):
        n, m = n - 1, m - 1
    out = [(i, i) for i in range(lo)]
    if n > lo and m > lo:
        kinds = ([(name, _inner(x) if name in twice else None) for name, x in zip(*side)] for side in ((na[lo:n], a[lo:n]), (nb[lo:m], b[lo:m])))
        out += [(lo + i, lo + j) for i, j in longest(n - lo, m - lo, _meetings(*kinds))]
    return out + [(n + k, m + k) for k in range(len(a) - n)]


def align(a: list, b: list) -> list:
    """The expression that covers both: equal items meet in order, the others become optional."""
    if a == b:
        return a
    out, i, j = [], 0, 0
    for x, y in [*pairs(a, b), (len(a), len(b))]:
        out += [[k, _optional(q), inner, texts] for k, q, inner, texts in (*a[i:x], *b[j:y])]
        if x < len(a):
            q = {a[x][1], b[y][1]}
            rep, opt = q & {"+", "*"}, q & {"?", "*"}
            out.append([a[x][0], "*" if rep and opt else "+" if rep else "?" if opt else "", align(a[x][2], b[y][2]), a[x][3] + b[y][3]])
        i, j = x + 1, y + 1
    # Optional neighbours of one key, left by different pages, are one repeated item.
    flat: list = []
    for x in out:
        last = flat[-1] if flat else None
        if last and last[0] == x[0] and x[0] != "(" and "?" in (last[1], x[1]) and _alike(last, x):
            if x[0] == "T":
                flat[-1] = [*last[:3], last[3] + x[3]]
            else:
                q = "*" if last[1] in ("?", "*") and x[1] in ("?", "*") else "+"
                flat[-1] = [x[0], q, align(last[2], x[2]), last[3] + x[3]]
        else:
            flat.append(x)
    return flat


def fold(expressions: list[list]) -> list:
    out = expressions[0]
    for e in expressions[1:]:
        out = align(out, e)
    return out


def numbered(wrapper: list) -> list:
    """The wrapper with its text slots numbered from 0 in their order."""
    at = iter(range(1 << 60))

    def walk(items: list) -> list:
        return [[k, q, walk(inner), [next(at)] if k == "T" else []] for k, q, inner, _ in items]

    return walk(wrapper)


def matched(wrapper: list, page: list, texts: int) -> list[int]:
    """The slot of a numbered wrapper that each of a page's texts fills, -1 for none."""
    out = [-1] * texts

    def walk(w: list, p: list) -> None:
        for i, j in pairs(w, p):
            if w[i][0] == "T":
                for k in p[j][3]:
                    out[k] = w[i][3][0]
            else:
                walk(w[i][2], p[j][2])

    walk(wrapper, page)
    return out


def _tag(part: str) -> str:
    return part.split(".", 1)[0]


def region(weights: dict[str, float]) -> str:
    """The path of the main region: the article and main elements below the heaviest parent
    (its path and "/@", whatever their classes; outermost ones only), else the deepest
    container with most of the weight."""
    mass: dict[str, float] = {}
    named: dict[str, float] = {}
    for path, w in weights.items():
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            p = "/".join(parts[:k])
            mass[p] = mass.get(p, 0.0) + w
        first = next((k for k, x in enumerate(parts) if _tag(x) in ("article", "main")), 0)
        if first:
            parent = "/".join(parts[:first])
            named[parent] = named.get(parent, 0.0) + w
    if named:
        return max(named, key=lambda p: (named[p], -len(p))) + "/@"
    total = mass.get("", 0.0)
    best = ""
    for p, w in mass.items():
        if w >= 0.6 * total and _tag(p.rsplit("/", 1)[-1]) in ("", "html", "body", "div", "section", "td", "center") and len(p) > len(best):
            best = p
    return best


def within(path: str, main: str) -> bool:
    """Whether a path lies in a region."""
    if main.endswith("/@"):
        return path.startswith(main[:-1]) and _tag(path[len(main) - 1 :].split("/", 1)[0]) in ("article", "main")
    return path == main or path.startswith(main + "/")


def marks(wrapper: list) -> dict[int, tuple[bool, bool]]:
    """Whether each slot of a numbered wrapper is (repeated, optional)."""
    out: dict[int, tuple[bool, bool]] = {}

    def walk(items: list, repeated: bool, optional: bool) -> None:
        for key, q, inner, at in items:
            rep, opt = repeated or q in ("+", "*"), optional or q in ("?", "*")
            if key == "T":
                out[at[0]] = rep, opt
            else:
                walk(inner, rep, opt)

    walk(wrapper, False, False)
    return out


def templates(wrapper: list, stats: list[tuple[int, int, bool]], pages: int) -> list[int]:
    """The template slots. ``stats``: (slot, distinct pages, whether its text never changes);
    ``pages``: the host's distinct pages."""
    own = marks(wrapper)
    return sorted(k for k, n, same in stats if same and n >= 3 and (not any(own[k]) or 2 * n >= pages))


def main_slots(wrapper: list, weights: dict[int, float]) -> list[int]:
    """The slots of a numbered wrapper's main region, by the weights of its slots (see ``region``)."""
    total = sum(weights.values())
    named: list[tuple[float, list[int]]] = []
    best: list = [0, []]  # depth, slots

    def walk(items: list, depth: int, inside: bool) -> tuple[float, list[int]]:
        mass, own, articles = 0.0, [], (0.0, [])
        for key, _, inner, at in items:
            if key == "T":
                mass, own = mass + weights.get(at[0], 0.0), [*own, at[0]]
                continue
            article = _tag(key) in ("article", "main")
            w, below = walk(inner, depth + 1, inside or article)
            if article and not inside:
                articles = articles[0] + w, articles[1] + below
            if w >= 0.6 * total and _tag(key) in ("html", "body", "div", "section", "td", "center") and depth + 1 > best[0]:
                best[:] = depth + 1, below
            mass, own = mass + w, own + below
        if articles[0]:
            named.append(articles)
        return mass, own

    _, every = walk(wrapper, 0, False)
    if named:
        return max(named, key=lambda x: x[0])[1]
    return best[1] or every


def extract(page: str | None, wrapper: list | None, main=frozenset(), template=frozenset()) -> str:
    """The main text of a page: by its host's numbered wrapper, the slots of the main region
    and the template slots, or else by the page's own region."""
    own, found = outline(parse(page))
    if not found:
        return ""
    at = matched(wrapper, own, len(found)) if wrapper is not None else [-1] * len(found)
    inside = [k for k, (_, _, chrome) in enumerate(found) if not chrome and at[k] in main]

    def by_itself(keep) -> list[int]:
        weights: dict[str, float] = {}
        for p, t, chrome in found:
            if not chrome:
                weights[p] = weights.get(p, 0.0) + len(t.strip())
        own_region = region(weights)
        return [k for k, (p, _, chrome) in enumerate(found) if not chrome and keep(k) and within(p, own_region)]

    if not any(found[k][1].strip() for k in inside):
        inside = by_itself(lambda k: True)
    elif any(n < 0 and found[k][1].strip() and not found[k][2] for k, n in enumerate(at)):  # texts that the wrapper has no slot for
        inside = sorted({*inside, *by_itself(lambda k: at[k] < 0)})
    changing = [k for k in inside if at[k] not in template]
    if any(found[k][1].strip() for k in changing):
        inside = changing
    return " ".join(x for x in (" ".join(entities.unescape(found[k][1]).split()) for k in inside) if x)


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=7).digest(), "little")


def wrappers(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """(host, wrapper): the wrapper of every host as JSON."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"host": f["host"], "what": [json.dumps(expression(parse(page)), separators=(",", ":")) for page in f["html"].tolist()]})

    seen = scratch.cut(pages.mapInPandas(tidy(read), "host string, what string").distinct())

    def folding(keys):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f, at in whole_groups(frames, keys):
                hosts, what = f["host"].to_numpy(), f["what"].to_numpy()
                out = []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                    out.append((hosts[lo], json.dumps(fold([json.loads(x) for x in sorted(what[lo:hi])]), separators=(",", ":"))))
                yield pd.DataFrame(out, columns=["host", "what"])

        return run

    # Two rounds: a host's expressions in parts, about the square root of their number, then the parts' wrappers.
    number = seen.groupBy("host").agg(F.ceil(F.sqrt(F.count("*"))).cast("int").alias("parts"))
    parts = seen.join(number, "host").select("host", F.pmod(F.xxhash64("what"), F.col("parts")).cast("int").alias("part"), "what")
    once = by_groups(parts, ["host", "part"]).mapInPandas(tidy(folding(["host", "part"])), "host string, what string")
    whole = by_groups(once, ["host"]).mapInPandas(tidy(folding(["host"])), "host string, what string")
    return scratch.cut(whole.withColumnRenamed("what", "wrapper"))


class _Wrappers:
    """Numbered wrappers by their JSON text; those used last stay parsed."""

    def __init__(self):
        self.known: dict[str, list] = {}

    def __call__(self, text: str | None) -> list | None:
        if text is None:
            return None
        if text not in self.known:
            if len(self.known) >= 256:
                self.known.clear()
            self.known[text] = numbered(json.loads(text))
        return self.known[text]


def classified(scratch: Scratch, pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, wrapper, main, template): the wrappers with the slots of their main regions and their template slots."""

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = _Wrappers()
        for f in frames:
            out = []
            for host, page, wrapper in zip(f["host"].tolist(), f["html"].tolist(), f["wrapper"].tolist()):
                own, texts = outline(parse(page))
                filled: dict[int, list[str]] = {}
                for k, (_, t, chrome) in zip(matched(read(wrapper), own, len(texts)), texts):
                    if k >= 0 and not chrome and t.strip():
                        filled.setdefault(k, []).append(t)
                whole = {k: " ".join(" ".join(ts).split()) for k, ts in filled.items()}
                page_hash = _hashed("\n".join(whole.values()))
                out.append((host, -1, 0, 0, page_hash))
                out += [(host, k, len(text), _hashed(text), page_hash) for k, text in whole.items()]
            yield pd.DataFrame(out, columns=["host", "slot", "chars", "hash", "page"])

    # Copies of a page are one page to "distinct": what they share is not template for that.
    seen = pages.join(found, "host").mapInPandas(tidy(fill), "host string, slot int, chars long, hash long, page long")
    seen = seen.groupBy("host", "slot").agg(F.approx_count_distinct("page").alias("n"), F.sum("chars").alias("chars"), (F.min("hash") == F.max("hash")).alias("same"))
    stats = seen.groupBy("host").agg(F.collect_list(F.struct("slot", "n", "chars", "same")).alias("stats"))  # one a slot of the wrapper

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            mains, template = [], []
            for w, rows in zip(f["wrapper"], f["stats"]):
                w = numbered(json.loads(w))
                n = {r["slot"]: r["n"] for r in rows}
                chars = {r["slot"]: float(r["chars"]) for r in rows if r["slot"] >= 0}
                same = {r["slot"] for r in rows if r["same"]}
                changing = {k: c for k, c in chars.items() if not (k in same and n[k] >= 3)}
                mains.append(main_slots(w, changing if 2 * sum(changing.values()) >= sum(chars.values()) else chars))
                template.append(templates(w, [(k, n[k], k in same) for k in chars], n[-1]))
            yield pd.DataFrame({"host": f["host"], "wrapper": f["wrapper"], "main": mains, "template": template})

    return scratch.cut(found.join(stats, "host").mapInPandas(tidy(choose), "host string, wrapper string, main array<int>, template array<int>"))


def main_texts(spark: SparkSession, pages: DataFrame, *, page_id="page_id", url="url", html="html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    scratch = Scratch(spark, "html")
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    hosts = classified(scratch, pages.select("host", "html"), wrappers(scratch, pages.select("host", "html")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = _Wrappers()
        for f in frames:
            by = zip(f["html"].tolist(), f["wrapper"].tolist(), f["main"].tolist(), f["template"].tolist())
            f["text"] = [extract(h, read(w), frozenset(m if m is not None else ()), frozenset(t if t is not None else ())) for h, w, m, t in by]
            f["n_chars"] = f["text"].map(len).astype("int64")
            yield f[["page_id", "url", "text", "n_chars"]]

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.join(hosts, "host", "left").select("page_id", "url", "html", "wrapper", "main", "template").mapInPandas(tidy(run), f"page_id {kind}, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_texts(spark, table(spark, sf_dir, "pages"))
