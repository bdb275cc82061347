"""Main text of web pages, by wrappers inferred for each host.

A page's tokens (structural tags with their classes, and text) nest into a tree. A wrapper is a union-free regular
expression over such tokens, held as a tree as well: a tag with what it contains in order, where parts may be optional `( )?` or
repeated `( )+`; text is a slot `#` where it varies between pages, and a constant `=` where all pages that have it agree. Aligning a
page with a wrapper resolves each mismatch: text that differs becomes a slot, tokens that one side lacks become optional, and optional
ones that go on like what stands before them fold into a repeat. Parts of two pages meet in the order of both, so that a wrapper generates
each of its pages; a part that pages have in two orders is there twice, and what is kept of it (pages, characters, whether all agree) is put together
for reading, so that it doesn't depend on the order of aligning. Aligning two wrappers is the
same, so that Spark aligns pages within tasks, tasks within salted parts of a host, and those into the host's wrapper.

The wrapper decides: constants are template, and the main part is the subtree that holds the varying text. Element names
weigh in (nav or footer never hold it, an article that holds enough of the varying text is it); names of classes weigh a little, and never
against a part that holds most of the varying text.
"""

from __future__ import annotations

import bisect
import functools
import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.common import materialize, text_batches

#: The beginning of what isn't text; then what ends a tag: the first > outside quoted values, each of which follows a =.
MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
TAG_END = re.compile(r"(?>[^>=]++|=[ \t-\r]*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
APART = re.compile(r"[^a-z0-9]+")
# HTML element names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag ends an open element of these, unless one of the bounds lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Elements and roles that never hold the main text, elements that rarely do, and names of classes that speak against a part:
# all words of a name have to be of these lists, one of them of the first.
NEVER = frozenset("head script style nav header footer aside menu noscript template button select textarea dialog iframe svg object audio video canvas title".split())
RARELY = frozenset(["form"])
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promos promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
NEUTRAL = frozenset("area bar block body bottom box button buttons center col column container content form global group inner item items left link links list main outer page panel placeholder post posts primary right secondary section site slot small thread top unit wrap wrapper".split())
#: A part that classes speak against counts so much of its text.
WEAK = 8
#: Elements that stand for anything: without a class, what comes first in them is part of their token.
GENERIC = frozenset("div section center table tbody tr td".split())
#: Neighbours of these fold within a page; others without a class only where pages differ.
LISTED = frozenset("p li dt dd tr td th option pre blockquote figure hr".split())
HEADINGS = frozenset(["h1", "h2"])
#: Inside an article its own header holds the heading.
IN_ARTICLE = frozenset(["header"])
#: Nodes that a task holds before it hands on its wrappers.
HELD = 200_000

Node = list  # [key, optional, repeated, pages, characters, digest or None, number among the parts of its token, parts]
KEY, OPTIONAL, REPEATED, PAGES, CHARS, FIXED, NTH, PARTS = range(8)
#: Why a part is optional: other pages lack it in this place, or another turn of a repeat within a page does.
OTHER_PAGE, SAME_PAGE = 1, 2
SLOT, GROUP = "#", "()"


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _combined(digests: Iterable[int]) -> int:
    return xxhash.xxh64_intdigest(b"".join([x.to_bytes(8, "little") for x in digests]), 1) >> 1


def _plain(raw: str) -> str:
    """Text with character references decoded and white space as one space."""
    return " ".join(html.unescape(raw).split())


def _name(raw: str, figures: str) -> str:
    """A class or id in lower case, its words parted by hyphens, without figures that number things."""
    return APART.sub("-", re.sub(figures, "", re.sub(r"([a-z])([A-Z])", r"\1-\2", raw)).lower()).strip("-")


def _key(tag: str, attributes: str) -> tuple[str, bool]:
    """The token of an opening tag, with role and class names, and whether it is hidden."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    names = {_name(x, r"[0-9]{3,}") for x in found.get("class", "").split()} | {_name(x, r"[0-9]+") for x in found.get("id", "").split()}
    role = re.sub("[^a-z]+", "", found.get("role", "").lower())
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden", "").lower() == "true"
    key = tag + (f"[{role}]" if role else "") + "".join(f".{x}" for x in sorted(names - {""}))
    if found.get("itemprop", "").lower() == "articlebody":
        key += "[articlebody]"
    return key, hidden


def _parse(page: str | None) -> list[tuple]:
    """Events of a page: ("open", key, hidden), ("close",), ("text", raw). Openings and closings balance; inline tags are gone."""
    events = list(_events(page or ""))
    for k in range(len(events) - 1):
        if events[k][0] == "open" and events[k][1] in GENERIC and events[k + 1][0] == "open":
            events[k] = ("open", f"{events[k][1]}>{_tag(events[k + 1][1])}", events[k][2])
    return events


def _events(page: str) -> Iterator[tuple]:
    """In one pass: each search goes on where the last one ended. A tag or comment that never ends takes the rest of the page."""
    stack: list[str] = []
    places: dict[str, list[int]] = defaultdict(list)  # of each open tag in the stack
    at = 0

    def pop() -> str:
        tag = stack.pop()
        places[tag].pop()
        return tag

    while at < len(page):
        m = MARKUP.search(page, at)
        if not m or m.start() > at:
            yield "text", page[at : m.start() if m else len(page)]
        if not m:
            break
        tag = m[2]
        if tag is None:
            end = page.find("-->" if m[0] == "<!--" else ">", m.end())
            at = end + (3 if m[0] == "<!--" else 1) if end >= 0 else len(page)
            continue
        end = TAG_END.match(page, m.end())
        if not end:
            break
        at = end.end()
        attributes = page[m.end() : at - 1]
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                continue
            if places.get(tag):
                while pop() != tag:
                    yield ("close",)
                yield ("close",)
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            last = page.find(">", end.end()) if end else -1
            at = last + 1 if last >= 0 else len(page)
            continue
        if tag == "br":
            yield "text", " "
            continue
        if tag in INLINE or tag in VOID and tag != "hr":
            continue
        if tag in CLOSES_P and places.get("p"):
            while True:
                yield ("close",)
                if pop() == "p":
                    break
        if tag in ENDS:
            ends, bounds = ENDS[tag]
            own = max((places[x][-1] for x in ends | bounds if places.get(x)), default=-1)
            low = own
            while low > 0 and stack[low] in ends and tag == "tr" and stack[low - 1] in ends:
                low -= 1
            if own >= 0 and stack[own] in ends:
                for _ in range(len(stack) - low):
                    pop()
                    yield ("close",)
        yield "open", *_key(tag, attributes)
        if tag in VOID or attributes.endswith("/") and tag not in CLOSES_P and tag != "body":
            yield ("close",)
        else:
            places[tag].append(len(stack))
            stack.append(tag)
    for _ in stack:
        yield ("close",)


def _tag(key: str) -> str:
    return re.match(r"[a-z0-9:-]*", key)[0]


@functools.lru_cache(10_000)
def _never(key: str, inside: bool) -> bool:
    """Whether a token never holds main text; inside: within an article, whose own header holds the heading."""
    tag = _tag(key)
    if tag in ("html", "body", "") or inside and tag in IN_ARTICLE:
        return False
    role = re.search(r"\[(\w+)\]", key)
    return tag in NEVER or bool(role) and role[1] in ROLES


@functools.lru_cache(10_000)
def _marked(key: str, inside: bool) -> bool:
    """Whether a token's names, or what it is, speak against it."""
    tag = _tag(key)
    if tag in ("html", "body", ""):
        return False
    if tag in RARELY:
        return True
    for name in key.split("[articlebody]")[0].split(".")[1:]:
        own = re.sub("[0-9]+", "", name).strip("-").split("-")
        found = MARKS.intersection(own)
        if found - IN_ARTICLE if inside or tag == "article" else found:
            if all(x in MARKS or x in NEUTRAL for x in own):
                return True
    return False


@functools.lru_cache(10_000)
def _article(key: str) -> int:
    """How surely a token holds the main text: 3 an article's body, 2 an article, 1 a main part."""
    if "[articlebody]" in key:
        return 3
    return 2 if _tag(key) == "article" else int(_tag(key) == "main" or "[main]" in key)


def page_wrapper(page: str | None) -> Node:
    """A page as a wrapper of its own."""
    return _wrapper(_parse(page))


def _wrapper(events: list[tuple]) -> Node:
    root: Node = ["", 0, False, 1, 0, 0, 0, []]
    stack = [root]

    def close(node: Node) -> None:
        node[CHARS] += sum(x[CHARS] for x in node[PARTS])
        node[FIXED] = _combined([x[FIXED] for x in node[PARTS]])
        node[PARTS] = _fold(node[PARTS], lambda a, b: "." in b[KEY] or _tag(b[KEY]) in LISTED)
        seen: Counter = Counter()
        for x in node[PARTS]:
            x[NTH] = seen[x[KEY]]
            seen[x[KEY]] += 1

    for event in events:
        if event[0] == "open":
            node: Node = [event[1], 0, False, 1, 0, 0, 0, []]
            stack[-1][PARTS].append(node)
            stack.append(node)
        elif event[0] == "close":
            close(stack.pop())
        elif text := _plain(event[1]):
            parts = stack[-1][PARTS]
            if parts and parts[-1][KEY] == SLOT:
                parts[-1][CHARS] += len(text)
                parts[-1][FIXED] = _combined((parts[-1][FIXED], _digest(text)))
            else:
                parts.append([SLOT, 0, False, 1, len(text), _digest(text), 0, []])
    close(root)
    return root


def _fold(parts: list[Node], again: Callable[[Node, Node], bool]) -> list[Node]:
    """Neighbours of one token become a repeat where again says that the second goes on like the first."""
    out: list[Node] = []
    for x in parts:
        if out and out[-1][KEY] == x[KEY] != SLOT and x[KEY] != GROUP and again(out[-1], x):
            out[-1] = _merge(out[-1], x, same_page=True)
            out[-1][REPEATED] = True
        else:
            out.append(x)
    return out


def _fold_groups(parts: list[Node]) -> list[Node]:
    """Runs of two to four tokens that come again, where pages differ in how often, become a repeated group."""
    for width in (2, 3, 4):
        i = 0
        while i + 2 * width <= len(parts):
            j = i + width
            run = parts[i:j]
            while GROUP not in (keys := [x[KEY] for x in run]) and [x[KEY] for x in parts[j : j + width]] == keys and all(x[OPTIONAL] for x in parts[j : j + width]):
                run = [_merge(a, b, same_page=True) for a, b in zip(run, parts[j : j + width], strict=True)]
                j += width
            if j > i + width:
                fixed = None if any(x[FIXED] is None for x in run) else _combined([x[FIXED] for x in run])
                parts[i:j] = [[GROUP, all(x[OPTIONAL] for x in run), True, max(x[PAGES] for x in run), sum(x[CHARS] for x in run), fixed, 0, run]]
            i += 1
    return parts


def _below(node: Node) -> list[Node]:
    """The nodes of a tree, each before what it contains: backwards, each after. Trees are as deep as pages are; nothing here recurses."""
    out, open_ = [], [node]
    while open_:
        out.append(x := open_.pop())
        open_ += x[PARTS]
    return out


def resolve(node: Node) -> Node:
    """The wrapper with its mismatches resolved: optional tokens that go on like their neighbours are repeats. Within a page of its own, any do."""
    done: dict[int, Node] = {}
    for x in reversed(_below(node)):
        alone = x[PAGES] == 1
        parts = _fold([done[id(y)] for y in x[PARTS]], lambda a, b, alone=alone: alone or b[OPTIONAL] or a[REPEATED])
        done[id(x)] = [*x[:PARTS], _fold_groups(parts)]
    return done[id(node)]


def _chain(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of pairs (i, j, weight) in order of i and falling j, those that rise in both and weigh most together."""
    at = {j: k + 1 for k, j in enumerate(sorted({j for _, j, _ in pairs}))}
    best: list[tuple[int, int]] = [(0, -1)] * (len(at) + 1)  # by a binary indexed tree: weight of a chain, and its last pair
    before: list[int] = []
    for n, (_, j, weight) in enumerate(pairs):
        k, top = at[j] - 1, (0, -1)
        while k:
            top = max(top, best[k])
            k &= k - 1
        before.append(top[1])
        k, own = at[j], (top[0] + weight, n)
        while k < len(best):
            best[k] = max(best[k], own)
            k += k & -k
    k, top = len(at), (0, -1)
    while k:
        top = max(top, best[k])
        k &= k - 1
    out, n = [], top[1]
    while n >= 0:
        out.append(pairs[n][:2])
        n = before[n]
    return out[::-1]


def _align(a: list[Node], b: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Parts of one token meet in the order of both sides, so that the wrapper generates both; what one side lacks is paired with None, in its place.

    The nth part of a token meets the nth of the other side. Where pages have them in several orders, a side has such a part in several places:
    they are paired from the front and from the end; of all pairs the chain with most text is taken, and between its pairs what else
    meets in order. This takes n log n steps.
    """
    if len(a) == len(b) and all(x[KEY] == y[KEY] and x[NTH] == y[NTH] for x, y in zip(a, b, strict=True)):
        return list(zip(a, b, strict=True))
    places: dict[tuple[str, int], tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for side, parts in enumerate((a, b)):
        for i, x in enumerate(parts):
            places[x[KEY], x[NTH]][side].append(i)
    candidates = {p for own, other in places.values() for p in (*zip(own, other, strict=False), *zip(own[::-1], other[::-1], strict=False))}
    chain = _chain([(i, j, 1 + a[i][CHARS] + b[j][CHARS]) for i, j in sorted(candidates, key=lambda p: (p[0], -p[1]))])
    out: list[tuple[Node | None, Node | None]] = []
    i = j = 0
    for end_a, end_b in [*chain, (len(a), len(b))]:
        for k in range(i, end_a):
            later = places[a[k][KEY], a[k][NTH]][1]
            n = bisect.bisect_left(later, j)
            if n < len(later) and later[n] < end_b:
                out += [(None, y) for y in b[j : later[n]]]
                out.append((a[k], b[later[n]]))
                j = later[n] + 1
            else:
                out.append((a[k], None))
        out += [(None, y) for y in b[j:end_b]]
        if end_a < len(a):
            out.append((a[end_a], b[end_b]))
        i, j = end_a + 1, end_b + 1
    return out


def _merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """The least general wrapper of two with the same first token."""

    def both(a: Node, b: Node) -> Node:
        pages = max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES]
        fixed = a[FIXED] if a[FIXED] == b[FIXED] and not same_page else None
        if same_page and a[FIXED] is not None and b[FIXED] is not None:
            fixed = _combined((a[FIXED], b[FIXED]))
        return [a[KEY], a[OPTIONAL] | b[OPTIONAL], a[REPEATED] or b[REPEATED], pages, a[CHARS] + b[CHARS], fixed, a[NTH], []]

    root = both(a, b)
    open_ = [(a, b, root)]
    while open_:
        a, b, out = open_.pop()
        for x, y in _align(a[PARTS], b[PARTS]):
            if x and y:
                out[PARTS].append(both(x, y))
                open_.append((x, y, out[PARTS][-1]))
            else:
                one = x or y
                out[PARTS].append([one[KEY], one[OPTIONAL] | (SAME_PAGE if same_page else OTHER_PAGE), *one[REPEATED:]])
    return root


def _count(node: Node) -> int:
    return len(_below(node))


def flat(node: Node) -> list:
    """A wrapper as one list: each node's fields and how many parts it has, before those of its parts."""
    out, open_ = [], [node]
    while open_:
        x = open_.pop()
        out.append([*x[:PARTS], len(x[PARTS])])
        open_ += reversed(x[PARTS])
    return out


def from_flat(rows: list) -> Node:
    root: Node = [*rows[0][:PARTS], []]
    open_ = [(root, rows[0][PARTS])]
    for row in rows[1:]:
        while not open_[-1][1]:
            open_.pop()
        parent, left = open_.pop()
        node: Node = [*row[:PARTS], []]
        parent[PARTS].append(node)
        open_ += [(parent, left - 1), (node, row[PARTS])]
    return root


def align(a: Node, b: Node) -> Node:
    """Align two wrappers of a host."""
    return _merge(a, b)


class _Wrappers:
    """Wrappers of one host that are added one by one, and digests of the blocks that all its pages have.

    Wrappers of like size are aligned first, so that a large one isn't copied for each page.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[int, Node]] = []
        self.common: frozenset[int] | None = None

    def add(self, own: Node, common: frozenset[int] | None) -> int:
        """Returns by how many nodes what is held has grown. common: digests of the blocks of a page, or of all of several; None without text."""
        if common is not None:
            self.common = common if self.common is None else self.common & common
        nodes = grown = _count(own)
        while self.stack and self.stack[-1][0] <= 2 * nodes:
            n, last = self.stack.pop()
            own = align(last, own)
            grown += (both := _count(own)) - n - nodes
            nodes = both
        self.stack.append((nodes, own))
        return grown

    def add_page(self, page: str | None) -> int:
        events = _parse(page)
        blocks = _blocks(events)[0]
        return self.add(_main_only(_wrapper(events)), frozenset(_digest(text) for _, text in blocks) if blocks else None)

    def add_json(self, text: str) -> None:
        own = json.loads(text)
        self.add(from_flat(own["wrapper"]), None if own["common"] is None else frozenset(own["common"]))

    def to_json(self) -> str:
        own = self.stack[-1][1]
        for _, x in self.stack[-2::-1]:
            own = align(x, own)
        return json.dumps({"wrapper": flat(own), "common": None if self.common is None else sorted(self.common)})


def _main_only(node: Node) -> Node:
    """Without parts that never hold main text."""
    root: Node = [*node[:PARTS], []]
    open_ = [(node, root, False)]
    while open_:
        x, out, inside = open_.pop()
        inside = inside or _article(x[KEY]) > 0
        for y in x[PARTS]:
            if y[KEY] in (GROUP, SLOT) or not _never(y[KEY], inside):
                out[PARTS].append([*y[:PARTS], []])
                open_.append((y, out[PARTS][-1], inside))
    return root


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tokens."""
    out: list[str] = []
    open_: list[Node | str] = [node]
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        mark = "*" if x[OPTIONAL] and x[REPEATED] else "?" if x[OPTIONAL] else "+" if x[REPEATED] else ""
        tag = x[KEY] not in ("", GROUP, SLOT)
        out.append("(" * bool(mark) + (f"<{x[KEY]}>" if tag else ""))
        open_.append("</>" * tag + (f"){mark}" if mark else ""))
        if x[KEY] == SLOT:
            out.append("=" if _constant(x) else "#")
        else:
            open_ += reversed(x[PARTS])
    return "".join(out)


def _constant(node: Node) -> bool:
    """Whether pages agree on a part's text: two at least have it, and all that have it have the same."""
    return node[FIXED] is not None and node[PAGES] > 1


class _Varying:
    """Characters of varying text in each part of a wrapper; every: constants count too. What never holds main text has none, marked parts an eighth.

    A part is asked for as it counts inside an article, and outside of one: both are added up from below, once for the whole wrapper.
    """

    def __init__(self, wrapper: Node, every: bool, marks: bool = True) -> None:
        self.every, self.marks = every, marks
        self.known: dict[int, tuple[float, float]] = {}
        self.add(wrapper)

    def add(self, wrapper: Node) -> None:
        for x in reversed(_below(wrapper)):
            self.known[id(x)] = (self._own(x, False), self._own(x, True))

    def _own(self, x: Node, inside: bool) -> float:
        if x[KEY] == SLOT:
            return x[CHARS] if self.every or not _constant(x) else 0
        if x[KEY] != GROUP:
            if _never(x[KEY], inside) or not self.every and _constant(x):
                return 0
            inside = inside or _article(x[KEY]) > 0
        own = sum(self.known[id(y)][inside] for y in x[PARTS])
        return own / WEAK if self.marks and x[KEY] != GROUP and _marked(x[KEY], inside) else own

    def of(self, x: Node, inside: bool = False) -> float:
        return self.known[id(x)][inside]

    def parts_of(self, x: Node, inside: bool = False) -> float:
        """What a part's own parts hold together, whatever it is itself."""
        return sum(self.known[id(y)][inside] for y in x[PARTS])


def _parts(node: Node) -> Iterator[tuple[Node, bool]]:
    """What a part contains, and whether it repeats; groups count as what they repeat."""
    for x in node[PARTS]:
        if x[KEY] == GROUP:
            yield from ((y, True) for y, _ in _parts(x))
        else:
            yield x, x[REPEATED]


def _headed(wrapper: Node, varying: _Varying) -> set[int]:
    """Of the nodes: those that are or contain a heading that varies."""
    out: set[int] = set()
    for x in reversed(_below(wrapper)):
        if x[KEY] == GROUP and any(id(y) in out for y in x[PARTS]):
            out.add(id(x))
        elif x[KEY] in (SLOT, GROUP) or _never(x[KEY], False) or _marked(x[KEY], False):
            continue
        elif _tag(x[KEY]) in HEADINGS and varying.of(x) > 0 or any(id(y) in out for y in x[PARTS]):
            out.add(id(x))
    return out


def one_place(wrapper: Node) -> Node:
    """The wrapper with parts that stand in several orders put together where the first stands, for reading: how many pages have a part, how much of
    it and whether all agree, wherever it stands. It doesn't depend on the order in which pages were aligned."""
    root: Node = [*wrapper[:PARTS], []]
    open_: list[tuple[list[Node], Node]] = [([wrapper], root)]
    while open_:
        nodes, out = open_.pop()
        own: dict[tuple[str, int], list[Node]] = defaultdict(list)
        for node in nodes:
            for x in node[PARTS]:
                own[x[KEY], x[NTH]].append(x)
        for (key, nth), same in own.items():
            pages = min(sum(x[PAGES] for x in same), out[PAGES])
            within = any(x[OPTIONAL] & SAME_PAGE for x in same)
            fixed = same[0][FIXED] if all(x[FIXED] == same[0][FIXED] for x in same) else None
            optional = SAME_PAGE * within | OTHER_PAGE * (pages < out[PAGES])
            out[PARTS].append([key, optional, any(x[REPEATED] for x in same), pages, sum(x[CHARS] for x in same), fixed, nth, []])
            open_.append((same, out[PARTS][-1]))
    return root


def _path(place: tuple | None) -> str:
    keys = []
    while place is not None:
        place, key = place
        keys.append(key)
    return "".join(f"/{x}" for x in reversed(keys))


def reading(wrapper: Node) -> dict:
    """How to read a host's pages. main: path of the main part; spared: paths of parts that are read although names speak against them;
    common: digests of blocks that are template.

    The main part is an article (or what is marked as main) that half of the pages have and that holds a fifth of the varying text, or of all, at least, the
    one with most of it. Without one it is found from the top: the part that holds three fifths of the varying text, as long as there is one
    and no heading that varies stands beside it. On a host whose pages agree in all, or of one page, all text counts.
    Outside of articles, the main part's own parts of which every page has all blocks are template, unless they are most of a page's text.
    """
    wrapper = resolve(one_place(wrapper))
    pages = max(wrapper[PAGES], 1)
    varying, all_text = _Varying(wrapper, False), _Varying(wrapper, True)
    every = not varying.of(wrapper)
    if every:
        varying = all_text
    total, whole = varying.of(wrapper), all_text.of(wrapper)
    sure: list[tuple] = []
    unweighed: dict[bool, _Varying] = {}
    # A place is its parent's place and a token: paths are spelt out for few.
    open_: list[tuple[Node, tuple | None, bool]] = [(wrapper, None, False)]
    while open_:
        node, place, inside = open_.pop()
        for x, _ in reversed(list(_parts(node))):
            if x[KEY] == SLOT or _never(x[KEY], inside):
                continue
            here = (place, x[KEY])
            if _article(x[KEY]) and not (_tag(x[KEY]) == "article" and _marked(x[KEY], False)) and 2 * x[PAGES] >= pages:
                if _marked(x[KEY], True):
                    own, all_ = varying.of(x), all_text.of(x)
                else:
                    unweighed = unweighed or {k: _Varying(wrapper, k, marks=False) for k in (every, True)}
                    own, all_ = unweighed[every].of(x), unweighed[True].of(x)
                if own and 5 * own >= total or all_ and 5 * all_ >= whole:
                    sure.append((min(_article(x[KEY]), 2), own, all_, _path(here), x))
            open_.append((x, here, inside or _article(x[KEY]) > 0))
    if sure:
        *_, main, node = max(sure, key=lambda s: s[:4])
    else:
        main, node, headed = "", wrapper, _headed(wrapper, varying)
        while True:
            parts = [(x, repeated) for x, repeated in _parts(node) if x[KEY] != SLOT]
            rest = varying.parts_of(node)
            big = [x for x, repeated in parts if 5 * varying.of(x) > 3 * rest and not repeated and _tag(x[KEY]) not in LISTED | HEADINGS]
            if not big or any(id(x) in headed for x, _ in parts if x is not big[0]):
                break
            node = big[0]
            main += f"/{node[KEY]}"
    inside = bool(sure)
    whole = max(varying.parts_of(node, inside), 1e-9)
    spared: list[str] = []
    open_ = [(node, None, inside)]
    while open_:
        node, place, _ = open_.pop()
        for x, _ in reversed(list(_parts(node))):
            if x[KEY] != SLOT and not _never(x[KEY], inside):
                here = (place, x[KEY])
                if _marked(x[KEY], inside) and 2 * varying.of(x, inside) > whole:
                    spared.append(main + _path(here))
                open_.append((x, here, inside))
    return {"main": main, "article": inside, "spared": sorted(spared), "template": not sure and not every and pages > 1}


def _blocks(events: list[tuple], main: str = "", article: bool = False, spared: Iterable[str] = ()) -> tuple[list[tuple[int, str]], bool]:
    """The blocks in a page's main part, each with the number of the main part's own part that it is in; and whether there is a main part."""
    blocks: list[tuple[int, str]] = []
    number = 0
    run: list[str] = []
    keys, spared = main.split("/")[1:], frozenset(spared)
    # met: how many of the keys lead to where we are, or -1. path: where we are, as far as spared parts ask for it.
    met, inside, off, within, path = [0], [main == ""], [False], [False], [""]
    seen = main == ""

    def end() -> None:
        if run and (text := _plain("".join(run))):
            blocks.append((number, text))
        run.clear()

    for event in events:
        if event[0] == "open":
            end()
            key = event[1]
            number += inside[-1] and (len(inside) < 2 or not inside[-2])
            met.append(met[-1] + 1 if 0 <= met[-1] < len(keys) and keys[met[-1]] == key else -1)
            here = met[-1] == len(keys)
            path.append(f"{path[-1]}/{key}" if spared else "")
            # Above the main part, names and elements don't count: it has been found there.
            own = inside[-1] and (_never(key, within[-1]) or _marked(key, within[-1]) and path[-1] not in spared)
            off.append(off[-1] or event[2] or own)
            inside.append(inside[-1] or here)
            within.append(within[-1] or _article(key) > 0 or here and article)
            seen = seen or here
        elif event[0] == "close":
            end()
            for x in (met, inside, off, within, path):
                x.pop()
            number += inside[-1] and (len(inside) < 2 or not inside[-2])
        elif inside[-1] and not off[-1]:
            run.append(event[1])
    end()
    return blocks, seen


def main_text(page: str | None, how: dict | None) -> str:
    """Blocks of the page's main part, one a line."""
    events = _parse(page)
    if how is not None:
        blocks, seen = _blocks(events, how["main"], how.get("article", True), how.get("spared", ()))
        if seen:
            template = frozenset(how.get("common", ()))
            own = {number for number, text in blocks if _digest(text) not in template}
            kept = [text for number, text in blocks if number in own]
            # Pages of one host that share most of their text are copies: then it isn't template.
            if 2 * sum(map(len, kept)) < sum(len(text) for _, text in blocks):
                kept = [text for _, text in blocks]
            return "\n".join(kept)
    own = reading(page_wrapper(page))
    return "\n".join([text for _, text in _blocks(events, own["main"], own["article"], own["spared"])[0]])


def host_of(url: str | Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a task: align the pages of each host, and hand on what there is whenever much is held."""
    held: dict[str, _Wrappers] = defaultdict(_Wrappers)
    nodes = 0

    def flush():
        out = pa.record_batch({"host": pa.array(list(held), pa.string()), "wrapper": pa.array([x.to_json() for x in held.values()], pa.string())})
        held.clear()
        return out

    for batch in batches:
        for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            nodes += held[host].add_page(page)
            if len(held) > 2000 or nodes > HELD:
                yield flush()
                nodes = 0
    if held:
        yield flush()


def _join(pdf: pd.DataFrame) -> pd.DataFrame:
    own = _Wrappers()
    for text in pdf["wrapper"].sort_values():
        own.add_json(text)
    return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": own.to_json()})


def infer_wrappers(pages: DataFrame, salts: int = 16) -> DataFrame:
    """host and wrapper (JSON) of pages with host and html. A task's pages are one row a host, dealt to salted groups and then joined."""
    parts = materialize(pages.select("host", "html").mapInArrow(_infer, "host string, wrapper string"), "wrappers")
    dealt = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(salts)).alias("salt"))
    joined = dealt.applyInPandas(_join, "host string, wrapper string")
    return joined.groupBy("host").applyInPandas(_join, "host string, wrapper string")


def extract_main_text(pages: DataFrame, id: str = "page_id", url: str = "url", body: str = "html", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """A row per page: page_id, url, text (empty if none), n_chars (code points).

    text: blocks of the main part in page order, joined by one newline; character references decoded, white space inside a block
    one space, ends trimmed. The wrapper of the page's host tells the main part (see reading). Inside it menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, styles and comments are left out by their elements, roles and names of classes, and outside of
    articles blocks that all pages of the host have; an article's own text is never left out because other pages have it too. A page without the main part of its host's wrapper is read by its own. A null or empty
    page gives an empty text. A null or odd url counts as the host "". Broken markup never fails. Null ids and repeated rows each
    give their row; other columns aren't read; an empty table gives none. How to read each host is broadcast if that
    is at most broadcast_bytes in all; else it is joined on the host, a join that adaptive execution can split.
    """
    text_batches(pages.sparkSession)
    own = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html"), host_of(url).alias("host"))

    @F.pandas_udf("string")
    def how(wrappers: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            own = json.loads(text)
            found = reading(from_flat(own["wrapper"]))
            return json.dumps(found | ({"common": own["common"]} if found.pop("template") and own["common"] else {}))

        return wrappers.map(one)

    hosts = materialize(infer_wrappers(own).select("host", how("wrapper").alias("how")), "readings")
    bytes_ = hosts.agg(F.sum(F.length("how") + F.length("host") + 64)).first()[0] or 0
    joined = own.join(F.broadcast(hosts) if bytes_ <= broadcast_bytes else hosts, "host", "left").select("page_id", "url", "html", "how")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            texts = []
            for page, text in zip(batch["html"].to_pylist(), batch["how"].to_pylist(), strict=True):
                if text not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[text] = json.loads(text) if text else None
                texts.append(main_text(page, known[text]))
            yield pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return joined.mapInArrow(stream, "page_id long, url string, text string, n_chars long")
