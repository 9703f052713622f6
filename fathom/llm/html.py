"""Main text of web pages by union-free wrappers.

The markup of a page becomes a stream of symbols: tags with the words of their
class, id and role, and slots for texts. Streams of the same host are aligned one
by one; where they differ, the difference becomes an optional or a repeated
group, or a text slot. The result is a regular expression without unions, the
host's wrapper. What the pages of the host have in each slot decides what it is:
a slot with the same text on every page is template, and the main text stands in
the part of the wrapper that holds the most running text that varies. Tags such
as nav or article, and words of classes, weigh in that; by themselves they decide
only for pages that no others can be compared with.
"""

from __future__ import annotations

import html as html_module
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.stage import by_bytes, stored

# Fixed values of HTML: elements without an end, elements whose content isn't markup,
# elements that don't break a line, and elements whose whole content isn't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ASIDE = frozenset(
    "nav header footer aside form script style noscript template iframe svg canvas button select textarea object audio video menu dialog head title math".split()
)
MAIN = frozenset("article main".split())
#: Elements that can hold a page's main part.
PARTS_OF = frozenset("html body div section article main td tr table tbody ul ol dl blockquote center".split())
HEADINGS = frozenset("h1 h2".split())
#: Elements of running text.
BLOCKS = frozenset("p blockquote pre li dd dt td th figcaption h1 h2 h3 h4 h5 h6 q code em strong b i".split())
LISTS = frozenset("ul ol dl table thead tbody tfoot tr figure".split())
# Words in class, id or role that speak for what isn't main text, and for what is.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " side aside footer header masthead comment comments reply replies disqus cookie cookies consent notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login related recommended share sharing social toolbar pagination pager widget search complementary contentinfo"
    " disclaimer copyright skip".split()
)
MAIN_WORDS = frozenset("article main content post entry story".split())
QUALIFIERS = frozenset("has with no without".split())

#: A "<" begins the next tag even where this one has no end; an unpaired quote is a character.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/><]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|(?=<)|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_HIDDEN = re.compile(
    r"""(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*display\s*:\s*none|'[^']*display\s*:\s*none))""", re.IGNORECASE
)
_WORDS = re.compile(r"[a-z]+")

TEXT = "#"
HIDDEN = "!"
#: Words of an element's class, id and role up to which its symbol keeps those that say nothing.
NAMES = 4


def _names(attrs: str) -> list[str]:
    """The words of class, id and role, in lower case, numbers of two digits or more folded: all that say something, and others up to NAMES."""
    out: list[str] = []
    for m in _ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id", "role"):
            out += re.sub(r"\d\d+", "0", (m[2] or m[3] or m[4] or "").lower()).split()
    words = sorted(set(out))
    if len(words) <= NAMES:
        return words
    telling = [w for w in words if _said(w)]
    return sorted(telling + [w for w in words if not _said(w)][: max(0, NAMES - len(telling))])


def _symbol(name: str, attrs: str) -> str:
    """An element as a symbol: its name, its words after dots, and ! if it isn't shown."""
    if not attrs:
        return name
    words = "".join(f".{w}" for w in _names(attrs)) if "=" in attrs else ""
    return name + words + (HIDDEN if _HIDDEN.search(attrs) else "")


def _said(word: str) -> str:
    """What one word of a class, id or role says: "m" main, "X" surely aside, "x" perhaps; "with-sidebar" says nothing."""
    parts = _WORDS.findall(word)
    if not parts or QUALIFIERS & set(parts):
        return ""
    if parts[-1] in MAIN_WORDS:
        return "m"
    if parts[-1] in ASIDE_WORDS or ASIDE_WORDS >= set(parts):
        return "X"
    return "x" if ASIDE_WORDS & set(parts) else ""


def kind(symbol: str) -> str:
    """How an element's content counts by its symbol: "-" never, "X" aside, "x" perhaps aside, "m" main, "" as its surroundings do."""
    name, *words = symbol.removesuffix(HIDDEN).split(".")
    if name in ASIDE or symbol.endswith(HIDDEN):
        return "-"
    if name in MAIN:
        return "m"
    said = set(map(_said, words))
    if name in ("body", "html"):
        return ""
    if "X" in said:
        return "X"
    if "m" in said and name in ("div", "section", "td"):
        return "m"
    return "x" if "x" in said else ""


def stream(page: str) -> list[tuple[str, str, int]]:
    """The symbols of a page, each with its text and how many characters of that are links (for tags none).

    Inline tags leave no symbol: their texts run on, but for elements that aren't
    shown or say that they are aside, which go. An element whose content isn't
    markup leaves its symbol only.
    """
    out: list[tuple[str, str, int]] = []
    held: list[str] = []
    linked = in_link = 0
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html_module.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((TEXT, text, min(linked, len(text))))
        linked = 0

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            held.append(text)
            if in_link:
                linked += len(text)
        if m is None:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        attrs = m["attrs"]
        if name in INLINE:
            if name == "a":
                in_link = 0 if m["close"] else 1
            if not m["close"] and attrs and name not in endless and kind(_symbol(name, attrs)) in ("-", "X"):
                end = _after(page, name, at)
                if end < 0:
                    endless.add(name)
                else:
                    at, in_link = end, 0
            continue
        flush()
        if m["close"]:
            out.append((f"/{name}", "", 0))
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        out.append((f"{_symbol(name, attrs)}/" if attrs.endswith("/") and name not in VOID and name not in RAW else _symbol(name, attrs), "", 0))
    flush()
    return out


def _after(page: str, name: str, at: int) -> int:
    """The place after the end of an inline element; -1 if it has none."""
    depth = 1
    for m in re.compile(rf"<(/?){name}\b[^>]*>", re.IGNORECASE).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return -1


def nesting(symbols: Sequence[str]) -> list[int]:
    """For each symbol the place of the open element that it stands in; -1: none.

    Unclosed elements end with what encloses them; a p, or an li in a list, ends
    with the block that follows.
    """
    inside: list[int] = []
    stack: list[tuple[str, int]] = []
    open_now: dict[str, int] = {}

    def pop() -> str:
        name = stack.pop()[0]
        open_now[name] -= 1
        return name

    for i, symbol in enumerate(symbols):
        name = symbol.rstrip("/" + HIDDEN).split(".")[0]
        if symbol.startswith("/") and open_now.get(symbol[1:]):
            while pop() != symbol[1:]:
                pass
        elif symbol != TEXT and stack and (stack[-1][0] == "p" or stack[-1][0] == name == "li") and not symbol.startswith("/"):
            pop()
        inside.append(stack[-1][1] if stack else -1)
        if symbol != TEXT and not symbol.startswith("/") and name not in VOID and name not in RAW and not symbol.endswith("/"):
            stack.append((name, i))
            open_now[name] = open_now.get(name, 0) + 1
    return inside


# A wrapper is a list of nodes: a symbol, or [mark, nodes] with mark "?" or "+" for an optional or repeated group.


def fold(symbols: Sequence) -> list:
    """symbols with every immediate repetition of a run of up to 12 nodes folded into a repeated group.

    Works from left to right, shortest runs first, until nothing changes; runs of
    groups with equal content merge too. A run that ends an element which it
    doesn't begin isn't folded.
    """
    nodes = list(symbols)
    width = 1
    while width <= min(12, len(nodes)):
        changed, out, i = False, [], 0
        while i < len(nodes):
            run = nodes[i : i + width]
            body = run[0][1] if width == 1 and isinstance(run[0], list) and run[0][0] == "+" else run
            j = i + width
            while len(run) == width and (nodes[j : j + width] == run or (len(body) > 1 or body is not run) and nodes[j : j + len(body)] == body):
                j += width if nodes[j : j + width] == run else len(body)
            if j > i + width and _whole(body):
                out.append(["+", body])
                i, changed = j, True
            else:
                out.append(nodes[i])
                i += 1
        nodes, width = out, 1 if changed and width > 1 else width + 1
    return nodes


#: Cells of an alignment table; longer stretches are split at symbols that both have once, in order.
CELLS = 1 << 18


def align(a: list, b: list) -> list:
    """The least wrapper by this method that covers a and b: common nodes stay, what only one has becomes optional.

    Nodes that both begin or end with are set aside first. Stretches with more than
    CELLS pairs are split at nodes that occur once in each, in the longest common
    order of them; without such nodes, each side is optional as a whole.
    """
    if a == b:
        return a
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    head, tail = a[:low], a[len(a) - high :]
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if len(a) * len(b) <= CELLS:
        return head + _aligned(a, b) + tail
    out, i, j = head, 0, 0
    for x, y in [*_fixed(a, b), (len(a), len(b))]:
        part = (a[i:x], b[j:y])
        out += _aligned(*part) if len(part[0]) * len(part[1]) <= CELLS else [["?", p] for p in part]
        if x < len(a):
            out.append(a[x])
        i, j = x + 1, y + 1
    return out + tail


def _fixed(a: list, b: list) -> list[tuple[int, int]]:
    """Places of equal nodes that occur once in a and once in b, the most of them that stand in the same order."""
    once = []
    for nodes in (a, b):
        at: dict[str, int] = {}
        for k, node in enumerate(nodes):
            key = json.dumps(node)
            at[key] = -1 if key in at else k
        once.append({k: v for k, v in at.items() if v >= 0})
    pairs = sorted((once[0][k], once[1][k]) for k in once[0].keys() & once[1].keys())
    best: list[int] = []  # the last pair of the best run of each length
    before = [-1] * len(pairs)
    ends = np.zeros(0, np.int64)
    for k, (_, y) in enumerate(pairs):
        n = int(np.searchsorted(ends, y))
        before[k] = best[n - 1] if n else -1
        if n == len(best):
            best.append(k)
            ends = np.append(ends, y)
        else:
            best[n], ends[n] = k, y
    out, k = [], best[-1] if best else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _aligned(a: list, b: list) -> list:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = best[i], best[i + 1], a[i]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + _alike(x, b[j]))
    out: list = []
    left: list = []
    right: list = []

    def close() -> None:
        for own in (left, right):
            if own:
                if len(own) == 1 and isinstance(own[0], list) and own[0][0] == "?":
                    out.append(own[0])
                else:
                    out.append(["?", list(own)])
                own.clear()

    i = j = 0
    while i < n and j < m:
        if (gain := _alike(a[i], b[j])) and best[i][j] == best[i + 1][j + 1] + gain:
            close()
            out.append(_both(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            left.append(a[i])
            i += 1
        else:
            right.append(b[j])
            j += 1
    left += a[i:]
    right += b[j:]
    close()
    return out


def _whole(run: list) -> bool:
    """Whether run ends no element that it doesn't begin."""
    begun: dict[str, int] = {}
    for node in run:
        if isinstance(node, str) and node.startswith("/"):
            if not begun.get(node[1:]):
                return False
            begun[node[1:]] -= 1
        elif isinstance(node, str):
            name = node.split(".")[0].rstrip("/" + HIDDEN)
            begun[name] = begun.get(name, 0) + 1
    return True


def _alike(x: object, y: object) -> int:
    """How well two nodes match; 0: not at all."""
    if x == y:
        return 4
    gx, gy = isinstance(x, list), isinstance(y, list)
    if gx and gy:
        return 2 if x[1][:1] == y[1][:1] else 0
    if gx or gy:
        group, single = (x, y) if gx else (y, x)
        return 1 if group[1] == [single] else 0
    return 0


def _both(x: object, y: object) -> object:
    if x == y:
        return x
    if isinstance(x, list) and isinstance(y, list):
        mark = "?+" if {"?", "+"} <= {x[0], y[0]} or "?+" in (x[0], y[0]) else x[0]
        return [mark, align(x[1], y[1])]
    group = x if isinstance(x, list) else y
    return group


class Matcher:
    """A wrapper as an automaton; match() says which slot each symbol of a stream fills, or None where it doesn't fit."""

    def __init__(self, wrapper: list) -> None:
        self.symbol: list[str] = []
        self.next: list[set[int]] = []
        first, last, empty = self._build(wrapper)
        self.first, self.last, self.empty = first, last, empty

    def _build(self, nodes: list) -> tuple[set[int], set[int], bool]:
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for node in nodes:
            if isinstance(node, str):
                self.symbol.append(node)
                self.next.append(set())
                f = e = {len(self.symbol) - 1}
                skip = False
            else:
                f, e, skip = self._build(node[1])
                if "+" in node[0]:
                    for s in e:
                        self.next[s] |= f
                skip = skip or "?" in node[0]
            for s in last:
                self.next[s] |= f
            first = first | f if empty else first
            last = last | e if skip else set(e)
            empty = empty and skip
        return first, last, empty

    def match(self, symbols: Sequence[str]) -> list[int] | None:
        if not symbols:
            return [] if self.empty else None
        steps: list[dict[int, int]] = []
        live = {s: -1 for s in sorted(self.first) if self.symbol[s] == symbols[0]}
        steps.append(live)
        for want in symbols[1:]:
            new: dict[int, int] = {}
            for s in live:
                for t in sorted(self.next[s]):
                    if self.symbol[t] == want and t not in new:
                        new[t] = s
            live = new
            if not live:
                return None
            steps.append(live)
        ends = [s for s in live if s in self.last]
        if not ends:
            return None
        path = [ends[0]]
        for step in reversed(steps[1:]):
            path.append(step[path[-1]])
        return path[::-1]

    def slots(self) -> list[int]:
        return [i for i, s in enumerate(self.symbol) if s == TEXT]


@dataclass
class Seen:
    """What the pages of a host have in one slot: on how many it is, characters, those of links, and whether its text never changes."""

    pages: int
    chars: int
    links: int
    constant: bool


#: A slot with one text is template only if so many pages show it.
LEAST_PAGES = 3
#: A part that holds this share of the running text around it is looked into; else the text around it is all of one part.
SHARE = 0.8
#: How much a character weighs by the kind of what it stands in.
WEIGHT = {"m": 8.0, "": 1.0, "x": 0.5, "X": 0.02, "-": 0.0}


def main_slots(matcher: Matcher, seen: dict[int, Seen]) -> set[int]:
    """The slots of a wrapper that hold main text.

    Texts weigh by their characters outside of links and the kind of what they
    stand in; a text that never changes weighs nothing if others in the wrapper
    do. From the whole page on, the part with nearly all of the weight is entered,
    unless it is main already or a heading stands beside it. There every slot
    counts but template, what is aside, and, where a part of it is marked as main
    with most of the weight, what stands outside of that. Text that never changes
    is no template inside of what is main, nor as running text of the part, where
    it stands among text that does.
    """
    symbols = matcher.symbol
    inside = nesting(symbols)
    slots = matcher.slots()
    none = Seen(0, 0, 0, False)
    varied = any(not s.constant and s.chars for s in seen.values())

    # Of each element, from the outside in: whether it is never shown, inside of something main, or aside within that.
    name = [s.rstrip("/" + HIDDEN).split(".")[0] for s in symbols]
    never, main, aside, near = ({-1: x} for x in (False, False, "", -1))
    for i, s in enumerate(symbols):
        if s != TEXT and not s.startswith("/"):
            k, up = kind(s), inside[i]
            never[i] = never[up] or k == "-"
            main[i] = main[up] or k == "m"
            aside[i] = "" if k == "m" else max(aside[up], k if k in ("x", "X") else "", key=("", "x", "X").index)
            near[i] = i if name[i] in PARTS_OF else near[up]

    def of(i: int) -> str:
        e = inside[i]
        return "-" if never[e] else aside[e] or ("m" if main[e] else "")

    def template(i: int) -> bool:
        s = seen.get(i, none)
        return s.constant and s.pages >= LEAST_PAGES and varied

    weight = {i: 0.0 if template(i) else WEIGHT[of(i)] * max(0, seen.get(i, none).chars - seen.get(i, none).links) for i in slots}
    # The weight inside of each element and its last symbol, from the inside out; elements' symbols are contiguous.
    held, last = dict.fromkeys(near, 0.0), {e: e for e in near}
    for i in range(len(symbols) - 1, -1, -1):
        up = inside[i]
        held[up] += held[i] if i in near else weight.get(i, 0.0)
        last[up] = max(last[up], last.get(i, i))
    parts: dict[int, list[int]] = {}
    for e in near:
        if e >= 0 and near[e] == e:
            parts.setdefault(near[inside[e]], []).append(e)
    headings = [i for i in slots if weight[i] > 0 and inside[i] >= 0 and name[inside[i]] in HEADINGS]

    def count(e: int) -> int:
        return bisect_right(headings, last[e]) - bisect_left(headings, e)

    region = -1
    while held[region] > 0 and region in parts and not (region >= 0 and main[region]):
        best = max(parts[region], key=lambda e: (held[e], -e))
        if held[best] < SHARE * held[region] or count(best) < count(region):
            break
        region = best
    here = [i for i in slots if region < 0 or region <= i <= last[region]]
    marked = sum(weight[i] for i in here if main[inside[i]] and of(i) == "m")
    if marked and marked >= held[region] / 2:
        here = [i for i in here if main[inside[i]]]

    # Inside of what is main, or of a part that was entered, running text that never changes belongs to it where
    # it stands among text that does (a box of its own is template), unless the like of its element holds template elsewhere.
    within = set(here)
    elsewhere = {symbols[inside[i]] for i in slots if i not in within and template(i)}

    def belongs(i: int) -> bool:
        e = inside[i]
        while e >= 0 and (name[e] in BLOCKS or name[e] in LISTS):
            e = inside[e]
        known = main[inside[i]] and of(i) == "m" or region >= 0 and inside[i] >= 0 and name[inside[i]] in BLOCKS and symbols[inside[i]] not in elsewhere
        return known and held[e] > 0

    def kept(i: int) -> bool:
        s, k = seen.get(i, none), of(i)
        # Perhaps aside: only if it is mostly links.
        return k not in ("-", "X") and (not template(i) or belongs(i)) and not (k == "x" and s.links * 2 > s.chars)

    return {i for i in here if kept(i)}


def signature(page: str) -> str:
    return json.dumps(fold([s for s, _, _ in stream(page)]), separators=(",", ":"))


def merge(signatures: Sequence[str]) -> list:
    """The wrapper of some signatures; one that the wrapper covers already changes nothing."""
    wrapper: list | None = None
    for s in sorted(set(signatures), key=lambda x: (len(x), x)):
        nodes = json.loads(s)
        if wrapper is None:
            wrapper = nodes
            continue
        matcher = Matcher(wrapper)
        if any(matcher.match(_unfolded(nodes, times, skip)) is None for times, skip in ((1, False), (2, False), (1, True))):
            wrapper = fold(align(wrapper, nodes))
    return wrapper or []


def _unfolded(nodes: list, times: int, skip: bool) -> list[str]:
    """A stream that nodes describe: repeated groups so many times, optional ones left out or not."""
    out: list[str] = []
    for node in nodes:
        if isinstance(node, str):
            out.append(node)
        elif not (skip and "?" in node[0]):
            out += _unfolded(node[1], times, skip) * (times if "+" in node[0] else 1)
    return out


def filled(tokens: Sequence[tuple[str, str, int]], matcher: Matcher) -> dict[int, tuple[list[str], int]] | None:
    """For each slot that a page fills its texts and the characters of links in them; None where the wrapper doesn't fit."""
    slots = matcher.match([s for s, _, _ in tokens])
    if slots is None:
        return None
    out: dict[int, tuple[list[str], int]] = {}
    for (_, text, links), slot in zip(tokens, slots, strict=True):
        if text:
            texts, n = out.get(slot, ([], 0))
            texts.append(text)
            out[slot] = (texts, n + links)
    return out


def own_matcher(tokens: Sequence[tuple[str, str, int]]) -> Matcher:
    """A page's stream as the wrapper of that page alone."""
    return Matcher([s for s, _, _ in tokens])


def seen_alone(fills: dict[int, tuple[list[str], int]]) -> dict[int, Seen]:
    return {slot: Seen(1, sum(map(len, texts)), links, False) for slot, (texts, links) in fills.items()}


def main_text(page: str, known: tuple[Matcher, set[int]] | None = None) -> str:
    """The texts of a page's main slots, one line each, by a wrapper and its main slots, or by the page alone."""
    tokens = stream(page)
    symbols = [s for s, _, _ in tokens]
    slots = known[0].match(symbols) if known else None
    if slots is None:
        matcher = own_matcher(tokens)
        slots = range(len(symbols))
        main = main_slots(matcher, seen_alone(filled(tokens, matcher) or {}))
    else:
        main = known[1]
    return "\n".join(text for (_, text, _), slot in zip(tokens, slots, strict=True) if text and slot in main)


#: Wrappers up to so many bytes in all are broadcast; more are joined by host.
BROADCAST_BYTES = 8 << 20
#: The signatures of a host are merged in so many parts first.
PARTS = 32


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): for each host the wrapper that all its pages' streams were aligned into.

    A page is reduced to the folded signature of its stream; equal signatures of a
    host are gathered before the alignment, so that its work follows the number of
    different layouts. Those are merged in parts first, and the parts' wrappers
    then. A null url has the host "".
    """
    frame = pages.select(host(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            signs = [signature(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.string())], names=["host", "signature"])

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        wrapper = json.dumps(merge(rows.column("signature").to_pylist()), separators=(",", ":"))
        return pa.table({"host": [key[0].as_py()], "signature": [wrapper]}, schema=pa.schema([("host", pa.string()), ("signature", pa.string())]))

    signs = frame.mapInArrow(sign, "host string, signature string").distinct()
    signs = signs.withColumn("part", F.pmod(F.xxhash64("signature"), F.lit(PARTS)))
    parts = signs.groupBy("host", "part").applyInArrow(merged, "host string, signature string")
    return parts.groupBy("host").applyInArrow(merged, "host string, signature string").withColumnRenamed("signature", "wrapper")


def host(url: object) -> object:
    """The host of a url, in lower case; "" where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


class _Known:
    """Matchers of the wrappers that a task meets, the last thousand of them."""

    def __init__(self) -> None:
        self.kept: dict[str, Matcher] = {}

    def __call__(self, wrapper: str) -> Matcher:
        if wrapper not in self.kept:
            if len(self.kept) >= 1000:
                self.kept.clear()
            self.kept[wrapper] = Matcher(json.loads(wrapper))
        return self.kept[wrapper]


def _with_wrappers(pages: DataFrame, wrappers: DataFrame, columns: list[str], url_col: str) -> DataFrame:
    """columns of pages, and the columns of wrappers of their hosts; wrappers are a stored table."""
    size = wrappers.agg(F.sum(F.octet_length("_wrapper") + F.octet_length("_host") + 64)).first()[0] or 0
    d = pages.select(*columns, host(F.col(url_col)).alias("_host"))
    return d.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "_host", "left")


def slot_statistics(pages: DataFrame, wrappers: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, slot, pages, chars, links, constant) over all pages that their host's wrapper fits.

    Counts are summed in each batch before the shuffle; whether a slot's text ever
    changes follows from the least and the greatest hash of it.
    """
    d = _with_wrappers(pages, wrappers.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper")), [F.col(html_col).alias("_html")], url_col)
    d = d.select("_html", "_host", "_wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in by_bytes(batches, 0):
            sums: dict[tuple[str, int], list[int]] = {}
            for page, name, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fills = filled(stream(page or ""), known(wrapper)) if wrapper is not None else None
                for slot, (texts, links) in (fills or {}).items():
                    h = xxhash.xxh3_64_intdigest("\n".join(texts)) >> 1
                    s = sums.setdefault((name, slot), [0, 0, 0, h, h])
                    s[0] += 1
                    s[1] += sum(map(len, texts))
                    s[2] += links
                    s[3], s[4] = min(s[3], h), max(s[4], h)
            names, slots = [k[0] for k in sums], [k[1] for k in sums]
            columns = [pa.array(names, pa.string()), pa.array(slots, pa.int32())]
            columns += [pa.array([s[k] for s in sums.values()], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "slot", "pages", "chars", "links", "low", "high"])

    d = d.mapInArrow(run, "host string, slot int, pages long, chars long, links long, low long, high long")
    every = d.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "links")], F.min("low").alias("low"), F.max("high").alias("high"))
    return every.select("host", "slot", "pages", "chars", "links", (F.col("low") == F.col("high")).alias("constant"))


def decided_wrappers(wrappers: DataFrame, statistics: DataFrame) -> DataFrame:
    """(host, wrapper, main): wrappers with their main slots, by what all pages of the host have in them."""
    every = F.collect_list(F.struct("slot", "pages", "chars", "links", "constant")).alias("seen")
    d = wrappers.join(statistics.groupBy("host").agg(every), "host", "left").select("host", "wrapper", "seen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            main = []
            for wrapper, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen = {r["slot"]: Seen(r["pages"], r["chars"], r["links"], r["constant"]) for r in rows or []}
                main.append(sorted(main_slots(Matcher(json.loads(wrapper)), seen)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(main, pa.list_(pa.int32()))], names=["host", "wrapper", "main"])

    return d.mapInArrow(run, "host string, wrapper string, main array<int>")


def wrappers_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, main), inferred from all pages and decided by what they have in the slots."""
    wrappers = stored(infer_wrappers(pages, url_col, html_col), "wrappers")
    return stored(decided_wrappers(wrappers, slot_statistics(pages, wrappers, url_col, html_col)), "decided")


def extract(pages: DataFrame, wrappers: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with text: the main text by the wrapper of the page's host.

    wrappers is a stored table of wrappers_of(). A page that its wrapper doesn't
    fit (one that wasn't there when it was inferred), or whose host has none, is
    read by a wrapper of its own. Null and empty pages give "". A column named text
    is replaced; other columns stay.
    """
    wrappers = wrappers_of(pages, url_col, html_col) if wrappers is None else wrappers
    own = wrappers.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"), F.col("main").alias("_main"))
    rest = [c for c in pages.columns if c.lower() != "text"]
    d = _with_wrappers(pages, own, rest, url_col).select(*rest, "_wrapper", "_main")
    at = rest.index(html_col)
    schema = d.drop("_wrapper", "_main").withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in by_bytes(batches, at):
            texts = []
            for page, wrapper, main in zip(*(batch.column(k).to_pylist() for k in (at, len(rest), len(rest) + 1)), strict=True):
                texts.append(main_text(page or "", None if wrapper is None else (known(wrapper), set(main or ()))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], names=[*rest, "text"])

    return d.mapInArrow(run, schema)
