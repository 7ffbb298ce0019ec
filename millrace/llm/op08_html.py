"""Main text of web pages by wrappers: union-free regular expressions per host.

A page is a stream of tags and text slots, which elements nest. Streams are
aligned element by element: what an element holds in one instance or page is
aligned with what it holds in the others. A child that one side lacks is
optional, one that comes again is a repeated group, children that come in turns
are a repeated group of optional members, texts are slots, and classes or ids
that vary from page to page are slots in a tag. The result is the host's
wrapper: a tree of aligned elements. Slots know in how many pages they stand,
how much text they hold, how much of it in links, and whether it varies.

The wrapper does the extraction. From its root it goes down to the element that
holds most of the varying text outside links and outside what markup itself
calls a menu, footer, form and the like, as long as one element holds it and no
heading stands beside it; hosts with several layouts have an element for each.
Inside, whole parts whose slots are the same in all pages, and lists made of
links, are boilerplate. Each page is walked beside the wrapper and gives the
slots that are left.

Alignment is linear in the tokens of a page and in the nodes of a wrapper. Pages
of a task make one wrapper a host, these are aligned in salted parts and then
to the whole, so no task sees all pages of a host, and memory holds wrappers,
not pages.

Defined results: null and empty html give empty text; a page without any of the
host's main elements gives its text outside boilerplate; with fewer than three
different pages a host has no evidence of slots that stay the same; rows are
judged each; a null url counts as a host of its own.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored

# Fixed names of markup.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("head nav footer aside form script style noscript template iframe object svg math canvas audio video select button textarea menu dialog title".split())
NAMES_LEFT_OUT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adverti[sz]\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|popup|modal|newsletter|subscribe|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|replies|disqus|social|share|sharing|related|recommended|pagination|widget)(?:$|[\s_-])",
    re.I,
)
ROLES_LEFT_OUT = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: An open element of the first kind ends when one of the second begins.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: Elements that lay out parts of a page, and lists that may be menus.
LAYOUT = frozenset("html body div section article main center table tbody tr td".split())
LISTS = frozenset("ul ol dl div section table".split())
ENDED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title)\b(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): open and close tags (value: attributes that name
    the element) and texts (value: the raw text)."""
    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            yield "text", "", m["text"]
        elif m["name"]:
            name = m["name"].lower()
            if m["close"]:
                yield "close", name, ""
            else:
                yield "open", name, m["attrs"] if "=" in m["attrs"] else ""
                if m["attrs"].endswith("/") and name not in VOID and name in ("svg", "math"):
                    yield "close", name, ""


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw else {}


def is_boilerplate(name: str, raw: str, inside_main: bool) -> bool:
    if name in LEFT_OUT or name == "header" and not inside_main:
        return True
    if not raw:
        return False
    found = attributes(raw)
    return found.get("role", "").lower() in ROLES_LEFT_OUT or bool(NAMES_LEFT_OUT.search(found.get("class", "")) or NAMES_LEFT_OUT.search(found.get("id", "")))


#: Share of a part's text that one element must hold to stand for it, and of
#: links in a list that is a menu.
HOLDS, LINKED = 0.6, 0.8
#: Markup says that these hold what the page is about.
SAYS_MAIN = {"article": 4.0, "main": 4.0}
#: Children of an element beyond which rare ones become one with a slot in the tag.
WIDE = 64
#: Nodes of the wrappers that a task holds before it passes them on.
HELD = 200_000


def label(name: str, raw: str) -> str:
    """A tag with its classes, or if it has none its id; longer numbers are slots."""
    found = attributes(raw)
    what = " ".join(sorted(set(re.sub(r"\d{2,}", "*", found.get("class", "")).split()))) or re.sub(r"\d{2,}", "*", found.get("id", "").strip())
    return f"{name} {what}" if what else name


class Element:
    """An open element of a page."""

    __slots__ = ("name", "raw", "above", "label", "node", "counts", "order", "state")

    def __init__(self, name: str, raw: str, above: Element | None):
        self.name, self.raw, self.above, self.label, self.node = name, raw, above, label(name, raw), -1
        self.counts: dict[str, int] = {}
        self.order: list[str] = []  # labels of children, runs of equal ones as one
        self.state: tuple[int, bool, bool, bool] | None = None


def blocks(page: str) -> Iterator[tuple[Element, str, int]]:
    """Text blocks of a page: the element around them, the text, and how many
    of its characters stand in links."""
    top = Element("", "", None)
    stack: list[tuple[str, Element]] = [("", top)]  # inline elements keep the element around them
    opened: dict[str, int] = {}
    now: list[str] = []
    links = 0

    def shut() -> None:
        name, _ = stack.pop()
        opened[name] -= 1

    for kind, name, value in tokens(page):
        if kind == "text":
            now.append(value)
            if opened.get("a"):
                links += len(value.strip())
            continue
        if name not in INLINE:
            text = " ".join(entities.unescape("".join(now)).split()) if now else ""
            if text:
                yield stack[-1][1], text, min(links, len(text))
            now, links = [], 0
        elif name == "br":
            now.append(" ")
        if kind == "open":
            while True:
                around = stack[-1][1].name
                if name not in ENDED_BY.get(around, ()):
                    break
                while stack[-1][0] != around:
                    shut()
                shut()
            if name in VOID:
                continue
            stack.append((name, stack[-1][1] if name in INLINE else Element(name, value, stack[-1][1])))
            opened[name] = opened.get(name, 0) + 1
        elif opened.get(name):
            while stack[-1][0] != name:
                shut()
            shut()
    text = " ".join(entities.unescape("".join(now)).split()) if now else ""
    if text:
        yield stack[-1][1], text, min(links, len(text))


class Wrapper:
    """Aligned elements, node 0 around all. Of each: the one above, the label,
    the children in order, those of them that come in turns, pages, the most
    instances in one instance of the one above, characters, those in links, and
    the three smallest hashes of what a page has in the slot."""

    def __init__(self):
        self.above, self.labels, self.kids, self.turns = [-1], [""], [{}], [set()]
        self.pages, self.most, self.chars, self.links, self.hashes = [0], [0], [0], [0], [()]

    def child(self, node: int, label_: str, after: int | None = None) -> int:
        kids = self.kids[node]
        if label_ not in kids:
            new = len(self.above)
            self.above.append(node)
            self.labels.append(label_)
            self.kids.append({})
            self.turns.append(set())
            for column, empty in ((self.pages, 0), (self.most, 0), (self.chars, 0), (self.links, 0), (self.hashes, ())):
                column.append(empty)
            if after is None or after >= len(kids):
                kids[label_] = new
            else:  # dictionaries keep order, so what comes later is put in anew
                items = list(kids.items())
                self.kids[node] = dict([*items[:after], (label_, new), *items[after:]])
        return self.kids[node][label_]

    @classmethod
    def of(cls, page: str) -> Wrapper:
        """The wrapper of one page: its instances aligned with each other."""
        out = cls()
        texts: dict[int, list[str]] = {}

        def place(element: Element) -> int:
            chain = []
            while element.node < 0 and element.above is not None:
                chain.append(element)
                element = element.above
            node = max(element.node, 0)
            element.node = node
            for e in reversed(chain):
                up, node = node, out.child(node, e.label)
                e.node = node
                counts, order = e.above.counts, e.above.order
                counts[e.label] = counts.get(e.label, 0) + 1
                out.most[node] = max(out.most[node], counts[e.label])
                if counts[e.label] > 1 and order[-1] != e.label:
                    at = len(order) - 1 - order[::-1].index(e.label)
                    out.turns[up].update(order[at:])
                if not order or order[-1] != e.label:
                    order.append(e.label)
            return node

        for element, text, links in blocks(page):
            node = place(element)
            out.chars[node] += len(text)
            out.links[node] += links
            texts.setdefault(node, []).append(text)
        out.pages = [1] * len(out.above)
        for node, found in texts.items():
            out.hashes[node] = (xxhash.xxh64_intdigest("\n".join(found)),)
        out.hashes[0] = (xxhash.xxh64_intdigest("\n".join(f"{n} {h}" for n, h in enumerate(out.hashes))),)
        return out

    def align(self, other: Wrapper) -> None:
        """Generalise this wrapper so that it covers the other."""
        work = [(0, 0)]
        while work:
            mine, theirs = work.pop()
            self.pages[mine] += other.pages[theirs]
            self.most[mine] = max(self.most[mine], other.most[theirs])
            self.chars[mine] += other.chars[theirs]
            self.links[mine] += other.links[theirs]
            self.hashes[mine] = tuple(sorted({*self.hashes[mine], *other.hashes[theirs]})[:3])
            self.turns[mine] |= other.turns[theirs]
            where = {k: i for i, k in enumerate(self.kids[mine])}
            at = 0
            for label_, kid in other.kids[theirs].items():
                i = where.get(label_)
                if i is None:
                    work.append((self.child(mine, label_, at), kid))
                    where = {k: i for i, k in enumerate(self.kids[mine])} if at < len(where) else where | {label_: at}
                    at += 1
                    continue
                if i < at:  # this one comes before in one stream and after in the other
                    names = list(self.kids[mine])
                    self.turns[mine].update(names[i:at])
                else:
                    at = i + 1
                work.append((self.kids[mine][label_], kid))
            if len(self.kids[mine]) > WIDE:
                self.loosen(mine)

    def loosen(self, node: int) -> None:
        """Children of one tag that stand in less than half of the pages each
        become one, with a slot for what they are called."""
        rare: dict[str, list[str]] = {}
        for label_, kid in self.kids[node].items():
            if 2 * self.pages[kid] < self.pages[node] or label_.endswith(" *"):
                rare.setdefault(label_.split(" ")[0], []).append(label_)
        for name, labels in rare.items():
            if len(labels) < 2:
                continue
            loose = f"{name} *"
            new = self.child(node, loose)
            for label_ in labels:
                if label_ != loose:
                    self._move(self.kids[node].pop(label_), new)
            self.turns[node] = {loose if t in labels else t for t in self.turns[node]}

    def _move(self, source: int, target: int) -> None:
        work = [(source, target)]
        while work:
            a, b = work.pop()
            self.pages[b] += self.pages[a]
            self.most[b] = max(self.most[b], self.most[a])
            self.chars[b] += self.chars[a]
            self.links[b] += self.links[a]
            self.hashes[b] = tuple(sorted({*self.hashes[a], *self.hashes[b]})[:3])
            self.turns[b] |= self.turns[a]
            for label_, kid in self.kids[a].items():
                work.append((kid, self.child(b, label_)))

    def dumps(self) -> str:
        """All nodes that are reached, above before below."""
        order, new = [0], {0: 0}
        for node in order:
            for kid in self.kids[node].values():
                new[kid] = len(order)
                order.append(kid)
        return json.dumps([[new.get(self.above[n], -1) if n else -1, self.labels[n], self.pages[n], self.most[n], self.chars[n], self.links[n], self.hashes[n], sorted(self.turns[n])] for n in order])

    @classmethod
    def loads(cls, written: str) -> Wrapper:
        out = cls()
        for i, (above, label_, *rest) in enumerate(json.loads(written)):
            node = out.child(above, label_) if i else 0
            out.pages[node], out.most[node], out.chars[node], out.links[node] = rest[:4]
            out.hashes[node], out.turns[node] = tuple(rest[4]), set(rest[5])
        return out

    def regex(self, node: int = 0) -> str:
        """The wrapper below a node as text: tags, # slots, ( )+ and ( )? groups."""
        parts = ["#"] if self.hashes[node] and node else []
        group: list[str] = []

        def end_group() -> None:
            if group:
                parts.append(f"( {' '.join(group)} )+")
                group.clear()

        for label_, kid in self.kids[node].items():
            name = label_.split(" ")[0]
            one = f"<{label_}> {self.regex(kid)} </{name}>".replace("  ", " ")
            if label_ in self.turns[node]:
                group.append(f"( {one} )?")
                continue
            end_group()
            some = self.pages[kid] < self.pages[node]
            many = self.most[kid] > 1
            parts.append(f"( {one} ){'*' if some and many else '+' if many else '?'}" if some or many else one)
        end_group()
        return " ".join(parts)


class Rules:
    """What a wrapper says of its nodes: which hold the main text (``main``),
    and which are boilerplate inside it (``out``)."""

    def __init__(self, wrapper: Wrapper):
        self.wrapper = w = wrapper
        todo = [0]
        while todo:
            node = todo.pop()
            w.loosen(node)
            todo += w.kids[node].values()
        order = [0]
        for node in order:
            order += w.kids[node].values()
        told = len(w.hashes[0]) >= 3
        size = len(w.above)
        all_, linked, mass, same = [0] * size, [0] * size, [0.0] * size, [True] * size
        for node in reversed(order):
            kids = list(w.kids[node].values())
            name, _, what = w.labels[node].partition(" ")
            varies = not told or w.pages[node] < 3 or len(w.hashes[node]) > 1
            all_[node] = w.chars[node] + sum(all_[k] for k in kids)
            linked[node] = w.links[node] + sum(linked[k] for k in kids)
            same[node] = not (varies and w.hashes[node] and node) and all(same[k] for k in kids)
            closed = bool(node) and is_boilerplate(name, f'class="{what}" id="{what}"', True)
            mass[node] = 0.0 if closed else (w.chars[node] - w.links[node]) * varies + sum(mass[k] for k in kids)
        if not mass[0]:
            same = [False] * size
        self.out = {n for n in order[1:] if all_[n] and (told and same[n] and w.pages[n] >= 3 or w.labels[n].split(" ")[0] in LISTS and linked[n] >= LINKED * all_[n])}
        self.main: set[int] = set()
        todo = [0]
        while todo:
            node = todo.pop()
            kids = list(w.kids[node].values())
            weight = lambda k: mass[k] * SAYS_MAIN.get(w.labels[k].split(" ")[0], 1.0)
            whole = sum(map(weight, kids)) + (w.chars[node] - w.links[node] if node else 0)
            # A layout has its own share of the pages, so shares are of a page.
            down = [k for k in kids if w.labels[k].split(" ")[0] in LAYOUT and w.most[k] == 1 and mass[k] and weight(k) / w.pages[k] >= HOLDS * whole / max(1, w.pages[node])]
            heading = any(w.labels[k].split(" ")[0] in HEADINGS and mass[k] and node not in (0,) and w.labels[k].split(" ")[0] != "header" for k in kids)
            if down and not (heading and not any(w.labels[k].split(" ")[0] in SAYS_MAIN for k in down)) and sum(w.pages[k] for k in down) >= HOLDS * w.pages[node]:
                todo += down
            else:
                self.main.add(node)
        # What lies outside of the main elements, for pages that have none of them.
        self.out -= self.main


@lru_cache(64)
def rules(written: str) -> Rules:
    return Rules(Wrapper.loads(written))


def extract(page: str | None, written: str | None = None) -> str:
    """Blocks inside the main elements of a wrapper, boilerplate left out,
    joined by newlines. Without a wrapper the page is its own."""
    if not page:
        return ""
    found = rules(written) if written else Rules(Wrapper.of(page))
    w = found.wrapper
    kept: list[str] = []
    outside: list[str] = []
    for element, text, _ in blocks(page):
        chain = []
        e = element
        while e is not None and e.state is None:
            chain.append(e)
            e = e.above
        for e in reversed(chain):
            if e.above is None:
                e.state = (0, 0 in found.main, False, False)
                continue
            node, inside, shut, article = e.above.state
            if node >= 0:
                kids = w.kids[node]
                node = kids.get(e.label, kids.get(f"{e.name} *", -1))
            inside = inside or node in found.main
            article = article or e.name in SAYS_MAIN
            shut = shut or node in found.out or is_boilerplate(e.name, e.raw, article or inside and 0 not in found.main)
            e.state = (node, inside, shut, article)  # in the wrapper; in a main element, left out, in an article
        _, inside, shut, _ = element.state
        if not shut:
            outside.append(text)
            if inside:
                kept.append(text)
    return "\n".join(kept or outside)


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of a task."""
    held: dict[str | None, Wrapper] = {}
    size = 0
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            one = Wrapper.of(page.as_py() or "")
            if host in held:
                before = len(held[host].above)
                held[host].align(one)
                size += len(held[host].above) - before
            else:
                held[host] = one
                size += len(one.above)
            if size > HELD:
                yield _written(held.items())
                held, size = {}, 0
    yield _written(held.items())


def _written(items: Iterable[tuple[str | None, Wrapper]]) -> pa.RecordBatch:
    items = list(items)
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in items], pa.string()), pa.array([w.dumps() for _, w in items], pa.string())], names=["host", "wrapper"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of host: one wrapper each, grown as the parts come."""
    host, wrapper = None, None
    for batch in batches:
        for name, written in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            one = Wrapper.loads(written)
            if wrapper is None or name != host:
                if wrapper is not None:
                    yield _written([(host, wrapper)])
                host, wrapper = name, one
            else:
                wrapper.align(one)
    if wrapper is not None:
        yield _written([(host, wrapper)])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [extract(page.as_py(), wrapper.as_py()) for page, wrapper in zip(batch.column("html"), batch.column("wrapper"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def hosts(pages: DataFrame) -> DataFrame:
    found = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return pages.select("page_id", "url", "html", found.alias("host"))


#: Parts that wrappers of one host are first aligned in.
PARTS = 16


def wrappers(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(host, wrapper) for every host."""
    small_batches(spark, 500)
    schema = "host string, wrapper string"
    some = hosts(pages).select("host", "html").mapInArrow(_wrappers, schema).withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = some.repartition(n, "host", "part").sortWithinPartitions("host", "wrapper").select("host", "wrapper").mapInArrow(_whole, schema)
    return stored(spark, parts.repartition(n, "host").sortWithinPartitions("host", "wrapper").mapInArrow(_whole, schema))


def main_texts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return hosts(pages).join(wrappers(spark, pages), "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
