"""Main text of web pages by union-free wrappers, inferred per host.

A wrapper is a regular expression over the elements of a host's pages without alternatives:
elements, groups, text slots, and the marks ? (not on every page) and + (repeated).  It starts as
the first page's own structure and is aligned with one page after another: repeats inside a
sequence fold into one element or group marked +, what only one side has is marked ?, and texts
that differ turn a constant into a slot.  A sequence of more than LONGEST items becomes (a? b? ...)+,
each kind of element once, which still has no alternatives and matches all that it stands for.
Partial wrappers of parts of a host align with each other in the same way, so parts are inferred
where the pages are and only wrappers travel.

A page's main text is read off its match with the host's wrapper.  Each block lands in a slot, and
the slot's place decides: inside the article element (else the main element, else anywhere), under
no element that the page marks as navigation, header, footer, sidebar, notice, advert, form or
comments, and not a constant of the template.  Where several blocks share a slot, as paragraphs do,
the slot's sketch of texts and their pages tells which of them the template repeats.  Without an article,
slots that mostly hold links go too, but for a paragraph or heading that is none.  Inside an article
words of classes and ids that have another sense there ("header", "search") decide only about blocks that
are constants or mostly links.  Marks above an article do not count, but an article in a sidebar gives
way to one outside.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .markup import Page

#: Wrappers go out by broadcast up to so many bytes; beyond, pages are joined with them by host.
BROADCAST_BYTES = 16 << 20
#: A slot of one text on at least so many pages is the template's: outside an article, and inside one.
CONSTANT_PAGES, CONSTANT_IN_ARTICLE = 3, 8
#: A text among others in a slot is the template's on such a share of the slot's pages.
CONSTANT_SHARE = 0.4
#: Texts of a slot whose pages are counted (the rest by the frequent-items rule: a count lacks at most a
#: SKETCH-th of all), and blocks of a page that are, from either end of a slot.
SKETCH, ENDS = 48, 8
#: Items of a sequence; longer ones become bags.
LONGEST = 128
#: Elements that are not main text, and those of them that an article does not stand in.
AWAY_TAGS = frozenset("nav header footer aside form menu dialog button fieldset label search".split())
ABOVE_TAGS = frozenset("nav footer aside menu dialog".split())
SLOT, BAG = "#", "*"
#: Elements whose text is read for itself.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


class Item:
    """A part of a wrapper: an element, a group "(keys)", a slot SLOT or a bag BAG.

    stat, of slots: [pages, blocks, characters, of them in links, hash of the text or None if it
    varies, pages by hash of text]; at, of slots of a single page: the numbers of its blocks."""

    __slots__ = ("key", "kids", "optional", "repeated", "stat", "at")

    def __init__(self, key: str, kids: list[Item], optional: bool = False, repeated: bool = False, stat: list | None = None, at: list | None = None):
        self.key, self.kids, self.optional, self.repeated, self.stat, self.at = key, kids, optional, repeated, stat, at

    def as_optional(self) -> Item:
        return Item(self.key, self.kids, True, self.repeated, self.stat, self.at)


def deep() -> None:
    """Let pages nest as deep as they like: calls between Python functions take no C stack."""
    if sys.getrecursionlimit() < 1_000_000:
        sys.setrecursionlimit(1_000_000)


def marked(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text)[:12]


def _counted(a: dict[str, int], b: dict[str, int], same_page: bool) -> dict[str, int]:
    """Pages by text of two parts: of a page the first and last texts, of several the frequent ones."""
    if same_page:
        keys = list(dict.fromkeys((*a, *b)))
        return dict.fromkeys(keys if len(keys) <= 2 * ENDS else keys[:ENDS] + keys[-ENDS:], 1)
    out = dict(a)
    for k, n in b.items():
        out[k] = out.get(k, 0) + n
    if len(out) > SKETCH:
        less = sorted(out.values(), reverse=True)[SKETCH]
        out = {k: n - less for k, n in out.items() if n > less}
    return out


def shape(children: list, blocks: list) -> list[Item]:
    """A page's sequence of children as items, repeats folded."""
    items = []
    for c in children:
        if isinstance(c, int):
            text, linked = blocks[c]
            mark = marked(text)
            items.append(Item(SLOT, [], stat=[1, 1, len(text), min(linked, len(text)), mark, {mark: 1}], at=[c]))
        else:
            items.append(Item(c[0], shape(c[1], blocks)))
    return _folded(items)


def _folded(items: list[Item]) -> list[Item]:
    items = _adjacent(items, True)
    if len(items) > 3 and len({x.key for x in items}) < len(items):
        size = 2
        while 2 * size <= len(items) and size <= LONGEST // 2:
            items = _groups(items, size)
            size += 1
    return items if len(items) <= LONGEST else _bag(items, True)


def _adjacent(items: list[Item], same_page: bool) -> list[Item]:
    """Neighbours of one key as one."""
    out: list[Item] = []
    for x in items:
        if out and out[-1].key == x.key:
            y = out[-1]
            out[-1] = _merged(y, x, same_page)
            out[-1].optional, out[-1].repeated = y.optional and x.optional, True
        else:
            out.append(x)
    return out


def _groups(items: list[Item], size: int) -> list[Item]:
    keys, out, i = [x.key for x in items], [], 0
    while i < len(items):
        if keys[i] == (keys[i + size] if i + size < len(keys) else None) and keys[i : i + size] == keys[i + size : i + 2 * size]:
            group, of = items[i : i + size], keys[i : i + size]
            i += size
            while keys[i : i + size] == of:
                group = [_merged(x, y, True) for x, y in zip(group, items[i : i + size])]
                i += size
            out.append(Item(f"({' '.join(of)})", group, False, True))
        else:
            out.append(items[i])
            i += 1
    return out


def _merged(x: Item, y: Item, same_page: bool) -> Item:
    """Two items of one key as one."""
    stat = at = None
    if x.stat is not None:
        a, b = x.stat, y.stat
        stat = [max(a[0], b[0]) if same_page else a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3], a[4] if a[4] == b[4] else None, _counted(a[5], b[5], same_page)]
        at = x.at + y.at if same_page and x.at is not None and y.at is not None else None
    if x.key == BAG:
        return _bag([x, y], same_page)[0]
    return Item(x.key, aligned(x.kids, y.kids, same_page), x.optional or y.optional, x.repeated or y.repeated, stat, at)


def _bag(items: list[Item], same_page: bool) -> list[Item]:
    """(a? b? ...)+ of all keys in items, groups and bags in them opened."""
    held: dict[str, Item] = {}
    queue = list(reversed(items))
    while queue:
        x = queue.pop()
        if x.key == BAG or x.key.startswith("("):
            queue.extend(reversed(x.kids))
        else:
            held[x.key] = _merged(held[x.key], x, same_page) if x.key in held else x.as_optional()
            held[x.key].optional = held[x.key].repeated = True
    return [Item(BAG, list(held.values()), False, True)]


def pairs(a: list[Item], b: list[Item]) -> list[tuple[Item | None, Item | None]]:
    """Two sequences side by side: items of one key meet along a longest common run, others stand alone.

    Where one is a bag, each element of b meets its like in a."""
    ka, kb = [x.key for x in a], [x.key for x in b]
    if BAG in ka or BAG in kb:
        flat = lambda s: [k for x in s for k in (flat(x.kids) if x.key == BAG or x.key.startswith("(") else [x])]
        known = {x.key: x for x in flat(a)}
        return [(known.get(y.key), y) for y in flat(b)]
    if ka == kb:
        return list(zip(a, b))
    lo = 0
    while lo < min(len(a), len(b)) and ka[lo] == kb[lo]:
        lo += 1
    n, m = len(a), len(b)
    while n > lo and m > lo and ka[n - 1] == kb[m - 1]:
        n, m = n - 1, m - 1
    best = [[0] * (m - lo + 1) for _ in range(n - lo + 1)]
    for i in range(n - lo - 1, -1, -1):
        row, below, key = best[i], best[i + 1], ka[lo + i]
        for j in range(m - lo - 1, -1, -1):
            row[j] = below[j + 1] + 1 if key == kb[lo + j] else max(below[j], row[j + 1])
    out: list[tuple[Item | None, Item | None]] = list(zip(a[:lo], b[:lo]))
    i = j = lo
    while i < n or j < m:
        if i < n and j < m and ka[i] == kb[j]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1 - lo][j - lo] >= best[i - lo][j + 1 - lo]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out + list(zip(a[n:], b[m:]))


def aligned(a: list[Item], b: list[Item], same_page: bool = False) -> list[Item]:
    """Two sequences as one: what meets merges, the rest is optional."""
    if any(x.key == BAG for s in (a, b) for x in s):
        return _bag(a + b, same_page)
    out = [_merged(x, y, same_page) if x is not None and y is not None else (x or y).as_optional() for x, y in pairs(a, b)]
    # What was optional on both sides may now stand next to its like.
    out = _adjacent(out, same_page)
    return out if len(out) <= LONGEST else _bag(out, same_page)


def expression(items: list[Item]) -> str:
    """The wrapper as text."""
    parts = []
    for x in items:
        body = expression(x.kids)
        one = body if x.key == BAG or x.key.startswith("(") else SLOT if x.key == SLOT else f"<{x.key}>{body}</>"
        mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[x.optional, x.repeated]
        parts.append(f"({one}){mark}" if mark else one)
    return "".join(parts)


class Wrapper:
    """A host's grammar and the number of its pages."""

    def __init__(self, items: list[Item] | None = None, pages: int = 0):
        self.items, self.pages = items, pages

    def page(self, page: Page) -> None:
        deep()
        self.merge(Wrapper(shape(page.root[1], page.blocks), 1))

    def merge(self, other: Wrapper) -> None:
        deep()
        if other.items is not None:
            self.items = other.items if self.items is None else aligned(self.items, other.items)
        self.pages += other.pages

    def dumped(self) -> str:
        """Items in pre-order with the number of their children, so that depth costs nothing."""
        rows, stack = [], list(reversed(self.items or []))
        while stack:
            x = stack.pop()
            rows.append([x.key, len(x.kids), x.optional | x.repeated << 1, x.stat])
            stack.extend(reversed(x.kids))
        return json.dumps([self.pages, None if self.items is None else len(self.items), rows], ensure_ascii=False, separators=(",", ":"))

    @staticmethod
    def loaded(text: str) -> Wrapper:
        pages, n, rows = json.loads(text)
        root = Item("", [])
        stack = [[root, n or 0]]
        for key, kids, marks, stat in rows:
            while not stack[-1][1]:
                stack.pop()
            x = Item(key, [], bool(marks & 1), bool(marks & 2), stat)
            stack[-1][0].kids.append(x)
            stack[-1][1] -= 1
            stack.append([x, kids])
        return Wrapper(None if n is None else root.kids, pages)


def _name(key: str) -> str:
    return re.split(r"[.!~^*]", key, maxsplit=1)[0]


class Place:
    """Where an item stands: inside an article or main element, and whether something marks it as no main text
    anywhere above, since the article, since the main element, or above the article by its tag; weak: since
    the article by a weak word alone; prose: straight in a paragraph or heading."""

    __slots__ = ("article", "main", "off", "off_article", "off_main", "above", "weak", "prose")

    def __init__(self, article=False, main=False, off=False, off_article=False, off_main=False, above=False, weak=False, prose=False):
        self.article, self.main, self.off, self.off_article, self.off_main, self.above, self.weak, self.prose = article, main, off, off_article, off_main, above, weak, prose

    def under(self, key: str) -> Place:
        name = _name(key)
        within = self.article or self.main
        away = name in AWAY_TAGS or "!" in key or "~" in key and not within
        if name == "header" and "!" not in key and within:
            away = False  # an article's header is its own
        return Place(
            self.article or name == "article" or "^" in key, self.main or name == "main" or key.endswith("*"), self.off or away,
            self.off_article or self.article and away, self.off_main or self.main and away, self.above or not self.article and name in ABOVE_TAGS,
            self.weak or within and "~" in key and name != "header", name in PROSE,
        )


def landed(wrapper: list[Item], page: list[Item]) -> list[tuple[int, Place, Item]]:
    """For each block of a page: its number, its place, and the wrapper's slot (the page's own where the wrapper has none)."""
    out: list[tuple[int, Place, Item]] = []
    stack: list[tuple[list[Item], list[Item], Place]] = [(wrapper, page, Place())]
    while stack:
        w, p, place = stack.pop()
        for x, y in pairs(w, p):
            if y is None:
                continue
            if y.key == SLOT:
                out.extend((at, place, x or y) for at in y.at)
            elif y.key == BAG or y.key.startswith("("):
                stack.append((x.kids if x is not None else w, y.kids, place))
            else:
                stack.append((x.kids if x is not None else [], y.kids, place.under(y.key)))
    return sorted(out, key=lambda r: r[0])


def main_text(page: Page, wrapper: Wrapper | None) -> str:
    """The main text of a page by the wrapper of its host; a page without one is its own wrapper."""
    deep()
    if not page.blocks:
        return ""
    shaped = shape(page.root[1], page.blocks)
    known = landed(wrapper.items if wrapper is not None and wrapper.items is not None else shaped, shaped)

    def constant(row: tuple[int, Place, Item], pages: int) -> bool:
        seen = row[2].stat
        return seen[4] is not None and seen[0] >= pages or seen[5].get(marked(page.blocks[row[0]][0]), 0) >= max(pages, CONSTANT_SHARE * seen[0])

    def linked(row: tuple[int, Place, Item]) -> bool:
        text, links = page.blocks[row[0]]
        return 2 * links > len(text)

    def own(row: tuple[int, Place, Item]) -> bool:
        return not constant(row, CONSTANT_IN_ARTICLE) and not (row[1].weak and (constant(row, CONSTANT_PAGES) or linked(row)))

    regions = [lambda p: p.article and not p.off_article and not p.above, lambda p: p.article and not p.off_article, lambda p: p.main and not p.off_main]
    for region in regions:
        inside = [r for r in known if region(r[1])]
        own_text = [r for r in inside if own(r)]
        size = lambda rows: sum(len(page.blocks[r[0]][0]) for r in rows)
        if 2 * size(own_text) < size(inside) and 2 * len(own_text) < len(inside):
            own_text = inside  # pages that repeat each other, not a template
        if own_text:
            return _text(page, own_text)
    near = [r for r in known if not r[1].off]
    loose = [r for r in near if not constant(r, CONSTANT_PAGES) and (r[2].stat[3] * 2 <= r[2].stat[2] or r[1].prose and not linked(r))]
    return _text(page, loose or near)


def _text(page: Page, rows: list[tuple[int, Place, Item]]) -> str:
    return "\n\n".join(page.blocks[r[0]][0] for r in rows)


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, pages, wrapper (as an expression), grammar (as Wrapper.loaded reads it), of every host, over all its pages.

    Parts of a host merge in two steps, so the largest task of a host's merge holds the square root
    of what one step would."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}

        def out() -> pa.RecordBatch:
            made = [(h, w.dumped()) for h, w in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.string()) for k in (0, 1)], names=["host", "part"])

        for b in batches:
            for url, source in zip(b.column(0), b.column(1)):
                source = source.as_py()
                if source:
                    held.setdefault(host_of(url.as_py()), Wrapper()).page(Page(source, tree=True))
            if len(held) > 5000:
                yield out()
        yield out()

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        whole = Wrapper()
        for part in sorted(f.part):
            whole.merge(Wrapper.loaded(part))
        return pd.DataFrame({"host": [f.host.iloc[0]], "part": [whole.dumped()]})

    def done(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        deep()
        for f in frames:
            whole = [Wrapper.loaded(p) for p in f.part]
            yield pd.DataFrame({"host": f.host, "pages": [w.pages for w in whole], "wrapper": [expression(w.items or []) for w in whole], "grammar": f.part})

    made = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(parts, "host string, part string")
    some = made.groupBy("host", F.pmod(F.xxhash64("part"), F.lit(64)).alias("slice")).applyInPandas(merge, "host string, part string")
    return some.groupBy("host").applyInPandas(merge, "host string, part string").mapInPandas(done, "host string, pages long, wrapper string, grammar string")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages: the main text of the whole page.

    Null and empty pages have the text "".  Pages whose url is null or has no host share the host
    "".  A null id stays null; repeated rows are extracted each; an empty table gives no rows; other
    columns are not read.  Pages are read twice and not shuffled, unless wrappers outgrow a broadcast."""
    spark = pages.sparkSession
    known = staged(wrappers(pages, url_col, html_col), "wrappers").select("host", "grammar")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    size = known.select(F.sum(F.length("host") + F.length("grammar"))).first()[0] or 0
    schema = "page_id long, url string, text string, n_chars long"

    def rows(b: pa.RecordBatch, grammars: list[Wrapper | None]) -> pa.RecordBatch:
        text = [main_text(Page(h.as_py(), tree=True), w) if h.as_py() else "" for h, w in zip(b.column(2), grammars)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r.host: r.grammar for r in known.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read: dict[str, Wrapper | None] = {}
            for b in batches:
                hosts = [host_of(u.as_py()) for u in b.column(1)]
                for h in set(hosts) - read.keys():
                    read[h] = Wrapper.loaded(shared.value[h]) if h in shared.value else None
                yield rows(b, [read[h] for h in hosts])

        return src.mapInArrow(run, schema)

    host = F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = src.withColumn("h", F.coalesce(host, F.lit(""))).join(known, F.col("h") == F.col("host"), "left").select("page_id", "url", "html", "grammar")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str | None, Wrapper | None] = {None: None}
        for b in batches:
            texts = b.column(3).to_pylist()
            if len(read) > 1000:
                read = {None: None}
            for t in set(texts) - read.keys():
                read[t] = Wrapper.loaded(t)
            yield rows(b, [read[t] for t in texts])

    return joined.mapInArrow(run_joined, schema)
