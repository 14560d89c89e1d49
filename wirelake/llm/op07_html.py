"""HTML extraction by union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import html as htmllib
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate
from typing import NamedTuple, Union

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import checked_broadcast, cut, only, scratch_table

#: A slot of one text is the template's if more than SHARE of the host's distinct pages have it.
SHARE = 0.5
#: Structures that one task aligns; the wrappers of so many structures are aligned in their turn, until a host has one.
FAN = 64
#: Attributes up to the next < outside of quotes: a tag that isn't closed before it is text, so each byte is looked at a bounded number of times.
_ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(script|style|noscript|template)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES})>",
    re.S | re.I,
)
_CLASS = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
TEXT = "#"


class Tag(NamedTuple):
    """One token: a tag, or TEXT for a slot of text."""

    name: str


class Group(NamedTuple):
    """Tokens that may be left out (least 0), or follow themselves (many), or both."""

    body: tuple
    least: int
    many: bool


Node = Union[Tag, Group]


def tokens(page: str | None) -> tuple[list[str], list[str]]:
    """Tag symbols with TEXT where text stands, and the texts in order; comments, scripts and styles are left out."""
    symbols: list[str] = []
    texts: list[str] = []
    if not page:
        return symbols, texts
    at = 0
    run: list[str] = []

    def end_text() -> None:
        if run:
            piece = " ".join(" ".join(htmllib.unescape(x) for x in run).split())
            if piece:
                symbols.append(TEXT)
                texts.append(piece)
            run.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        if m.group(3):
            end_text()
            name = m.group(3).lower()
            if m.group(2):
                symbols.append(f"</{name}>")
            else:
                named = _CLASS.search(m.group(4))
                mark = next((g for g in named.groups() if g), "") if named else ""
                # numbers in names count the same: they tell instances apart
                symbols.append(f"<{name}.{re.sub(r'[0-9]+', '0', mark.strip())}>" if mark else f"<{name}>")
    run.append(page[at:])
    end_text()
    return symbols, texts


class _Interned:
    """Characters for nodes, so that repeats can be found in strings: closing tags and text, opening tags, groups."""

    def __init__(self):
        self.char: dict[Node, str] = {}
        self.node: dict[str, Node] = {}
        self.next = {"close": 0x1000, "open": 0x10000, "group": 0x60000}

    def of(self, x: Node) -> str:
        if (c := self.char.get(x)) is None:
            kind = "group" if isinstance(x, Group) else "close" if x.name == TEXT or x.name.startswith("</") else "open"
            c = self.char[x] = chr(self.next[kind])
            self.node[c] = x
            self.next[kind] += 1
        return c


_OPEN = 0x10000


def _repeats(s: str, period: int) -> list[tuple[int, int]]:
    """(start, times) of the tandem repeats of that period, from left to right; a repeat begins with a tag that opens or with a group."""
    a = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = a[:-period] == a[period:]
    if np.count_nonzero(same) < period:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    out = []
    for start, end in edge.reshape(-1, 2):
        if end - start >= period:
            begins = np.flatnonzero(a[start : end - period + 1] >= _OPEN)
            if len(begins):
                i = int(start + begins[0])
                out.append((i, int(end + period - i) // period))
    return out


def fold(nodes: list[Node]) -> list[Node]:
    """Tandem repeats of any number of nodes become groups that may follow themselves, shortest periods first, until nothing changes."""
    table = _Interned()
    s = "".join(table.of(x) for x in nodes)

    def group(body: str) -> str:
        g = table.node[body] if len(body) == 1 else None
        return body if isinstance(g, Group) and g.many else table.of(Group(tuple(table.node[c] for c in body), 1, True))

    before = ""
    while before != s:
        before = s
        period = 1
        while 2 * period <= len(s):
            out, at = [], 0
            for start, times in _repeats(s, period):
                if start >= at:
                    out += [s[at:start], group(s[start : start + period])]
                    at = start + times * period
            t = "".join([*out, s[at:]])
            if period == 1 or t != s:
                for c in sorted({c for c in t if c >= "\U00060000"}):
                    g = table.node[c]
                    if g.many:
                        body = re.escape("".join(table.of(x) for x in g.body))
                        t = re.sub(f"(?:{body})*{c}(?:{body}|{c})*", c, t)
                s = t
            period += 1
    return [table.node[c] for c in s]


def _optional(nodes: tuple | list) -> list[Node]:
    """The nodes as something that may be left out: groups stay groups, runs between them become one."""
    out: list[Node] = []
    run: list[Node] = []
    for x in [*nodes, None]:
        if isinstance(x, Tag):
            run.append(x)
            continue
        if run:
            out.append(Group(tuple(run), 0, False))
            run = []
        if x is not None:
            out.append(Group(x.body, 0, x.many))
    return out


def _key(x: Node) -> Node:
    """Groups align by what they hold, whether or not they may be left out."""
    return x if isinstance(x, Tag) else Group(x.body, 0, True)


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """The wrapper of both: what they share in order stays, mismatches become optional; a group and one instance of it become the group."""
    a, b = _absorb(a, b), _absorb(b, a)
    out: list[Node] = []
    for op, i, j, k, m in SequenceMatcher(None, [_key(x) for x in a], [_key(x) for x in b], autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(a[i:j], b[k:m]):
                out.append(x if isinstance(x, Tag) else Group(x.body, min(x.least, y.least), x.many or y.many))
        else:
            out += _optional(a[i:j]) + _optional(b[k:m])
    return fold(_settle(out))


def _absorb(a: list[Node], other: list[Node]) -> list[Node]:
    """Single instances in ``a`` of what repeats or is optional in ``other`` become such groups."""
    for g in sorted({x for x in other if isinstance(x, Group)}, key=lambda g: (-len(g.body), repr(g))):
        n, i, out = len(g.body), 0, []
        while i < len(a):
            if tuple(a[i : i + n]) == g.body:
                out.append(Group(g.body, 1, g.many))
                i += n
            else:
                out.append(a[i])
                i += 1
        a = out
    return a


def _settle(nodes: list[Node]) -> list[Node]:
    """Neighbouring groups of one body become one that repeats."""
    out: list[Node] = []
    for x in nodes:
        if out and isinstance(x, Group) and isinstance(out[-1], Group) and out[-1].body == x.body:
            out[-1] = Group(x.body, min(x.least, out[-1].least) if x.least == out[-1].least == 0 else max(x.least, out[-1].least), True)
        else:
            out.append(x)
    return out


def dump(nodes: list[Node] | tuple) -> str:
    def one(x: Node):
        return x.name if isinstance(x, Tag) else [[one(y) for y in x.body], x.least, int(x.many)]

    return json.dumps([one(x) for x in nodes], separators=(",", ":"))


def load(text: str) -> list[Node]:
    def one(x) -> Node:
        return Tag(x) if isinstance(x, str) else Group(tuple(one(y) for y in x[0]), x[1], bool(x[2]))

    return [one(x) for x in json.loads(text)]


def infer(structures: list[str]) -> str:
    """One wrapper for many (dumped) structures, aligned one after the other, the shortest first."""
    todo = sorted(set(structures), key=lambda s: (len(s), s))
    wrapper = load(todo[0])
    seen = {dump(wrapper)}
    for s in todo[1:]:
        if s not in seen and not Wrapper(wrapper).accepts(load(s)):
            wrapper = align(wrapper, load(s))
            seen.add(dump(wrapper))
    return dump(wrapper)


class Wrapper:
    """A wrapper as a regular expression over one character for each symbol, with the slots' places."""

    def __init__(self, nodes: list[Node]):
        self.nodes = nodes
        self.names: dict[str, str] = {}
        self.slot_paths: list[str] = []
        self.pattern = re.compile(self._regex(nodes))

    def _char(self, name: str) -> str:
        return self.names.setdefault(name, chr(0x4E00 + len(self.names)))

    def _regex(self, nodes) -> str:
        out = []
        for x in nodes:
            if isinstance(x, Tag):
                out.append(self._char(x.name) + ("?" if x.name == TEXT else ""))
            else:
                out.append(f"(?:{self._regex(x.body)})" + ("*+" if x.many and not x.least else "++" if x.many else "?+"))
        return "".join(out)

    def accepts(self, nodes: list[Node]) -> bool:
        """Whether one unfolding of ``nodes`` (each group twice if it repeats, else once) fits."""

        def flat(xs) -> str:
            return "".join(self.names.get(x.name, "\0") if isinstance(x, Tag) else flat(x.body) * (2 if x.many else 1) for x in xs)

        return self.pattern.fullmatch(flat(nodes)) is not None

    def match(self, symbols: list[str]) -> list[int] | None:
        """For each text of the page in order its slot (number of the TEXT token in the wrapper), or None if the page doesn't fit."""
        slots: list[int] = []
        end = self._walk(self.nodes, symbols, 0, slots, [0])
        return slots if end == len(symbols) else None

    def _walk(self, nodes, symbols: list[str], at: int, slots: list[int], counter: list[int]) -> int:
        for x in nodes:
            if isinstance(x, Tag):
                if x.name == TEXT:
                    if at < len(symbols) and symbols[at] == TEXT:
                        slots.append(counter[0])
                        at += 1
                    counter[0] += 1
                elif at < len(symbols) and symbols[at] == x.name:
                    at += 1
                else:
                    return -1
                continue
            base, width = counter[0], _slots(x.body)
            times = 0
            while times == 0 or x.many:
                mark = len(slots)
                counter[0] = base
                end = self._walk(x.body, symbols, at, slots, counter)
                if end <= at:
                    del slots[mark:]
                    break
                at, times = end, times + 1
            counter[0] = base + width
            if times < x.least:
                return -1
        return at


def _slots(nodes) -> int:
    return sum((x.name == TEXT) if isinstance(x, Tag) else _slots(x.body) for x in nodes)


def structure(page: str | None) -> str:
    return dump(fold([Tag(s) for s in tokens(page)[0]]))


_ASIDE = frozenset(("nav", "footer", "aside", "menu", "button", "select"))
#: Elements without an end tag, or whose end tags say nothing about what stands in them.
_UNNESTED = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "p"))


def contexts(symbols: list[str]) -> list[str]:
    """For each text in order: "title", "aside" (in an element of navigation or the like), or "body".

    Only elements that their own end tag closes count: those still open when an element around them or the page ends enclose nothing, and
    end tags of no open element are passed over.
    """
    n = sum(s == TEXT for s in symbols)
    steps = {"aside": [0] * (n + 1), "title": [0] * (n + 1)}
    stack: list[tuple[str, int]] = []
    still = Counter()
    at = 0
    for s in symbols:
        if s == TEXT:
            at += 1
            continue
        name = s.strip("</>").partition(".")[0]
        if name in _UNNESTED:
            continue
        if not s.startswith("</"):
            stack.append((name, at))
            still[name] += 1
        elif still[name]:
            while True:
                top, start = stack.pop()
                still[top] -= 1
                if top == name:
                    break
            if kind := "aside" if name in _ASIDE else "title" if name == "title" else None:
                steps[kind][start] += 1
                steps[kind][at] -= 1
    return ["title" if t else "aside" if x else "body" for t, x in list(zip(accumulate(steps["title"]), accumulate(steps["aside"])))[:n]]


def _host(url: str | None) -> str:
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", url or "")
    return m.group(1).lower() if m else ""


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[tuple[str, ...], str] = {}
    for batch in batches:
        rows = []
        for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            symbols, texts = tokens(page)
            key = tuple(symbols)
            if (shape := memo.get(key)) is None:
                if len(memo) > 10_000:
                    memo.clear()
                shape = memo[key] = dump(fold([Tag(x) for x in symbols]))
            rows.append((page_id, _host(url), symbols, texts, shape))
        cols = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["page_id", "host", "symbols", "texts", "shape"])


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: dict[str, Wrapper] = {}
    for batch in batches:
        rows = []
        for uid, page_id, host, symbols, texts, wrapper in zip(*(batch.column(c).to_pylist() for c in ("uid", "page_id", "host", "symbols", "texts", "wrapper"))):
            if wrapper not in made:
                if len(made) > 1_000:
                    made.clear()
                made[wrapper] = Wrapper(load(wrapper))
            slots = made[wrapper].match(symbols)
            seen: set[int] = set()
            first = [0 if s in seen else seen.add(s) or 1 for s in slots or [-1] * len(texts)]
            rows.append((uid, page_id, host, slots is not None, slots or [-1] * len(texts), first, contexts(symbols), texts))
        cols = list(zip(*rows)) or [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["uid", "page_id", "host", "fits", "slots", "first", "places", "texts"])


def wrappers(parsed: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper) from (host, shape) of all pages.

    A host's distinct shapes are parted by their hashes into parts of about ``fan``, each part is merged into one, and so on: a tree of
    merges, so no task holds all shapes of a large host.
    """
    shapes = cut(parsed.select("host", "shape").distinct())
    while True:
        sizes = cut(shapes.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return shapes.withColumnRenamed("shape", "wrapper")
        parts = F.ceil(F.col("n") / F.lit(fan)).cast("long")
        some = shapes.join(checked_broadcast(sizes, 100_000), "host").withColumn("part", F.pmod(F.xxhash64("shape"), parts))
        shapes = cut(some.groupBy("host", "part").applyInPandas(_infer_group, "host string, shape string"))


def _infer_group(f: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [f["host"].iloc[0]], "shape": [infer(f["shape"].tolist())]})


def extracted(pages: DataFrame, fan: int = FAN, share: float = SHARE) -> DataFrame:
    """(page_id, host, fits, title, text): each page's texts that its host's wrapper has a variable slot for.

    A host's pages become streams of tags and texts; tandem repeats, of any length, become groups that repeat. The distinct streams of a
    host are aligned one after another: what doesn't match becomes optional groups, what is found once and repeated elsewhere joins the
    group that repeats, and texts become slots. All pages take part; the outcome doesn't depend on their order. A slot that has one and the
    same text wherever it is, on more than ``share`` of the host's distinct pages and two at least, is the template's and is left out, as
    are texts in navigation, footers, asides, menus, buttons and selections that their own end tags close. Pages of the same texts count as
    one. A page that the finished wrapper doesn't take (fits is false) gives all of its texts but those in such places.

    Nulls: null or empty html gives null title and empty text; null or odd urls are one host "". A null page_id is kept. Repeated rows and
    pages crawled again under other page_ids count as one page when constant slots are looked for; each has its own row. An empty table
    gives an empty result. Pages of any length are parsed whole; comments and scripts that aren't closed end with the page, tags that aren't
    closed are text, elements that aren't closed enclose nothing. Other columns are ignored.
    """
    streams = only(pages, "page_id", "url", "html").mapInArrow(_parse, "page_id long, host string, symbols array<string>, texts array<string>, shape string")
    parsed = scratch_table(streams.withColumn("uid", F.monotonically_increasing_id()), "html-streams")
    made = wrappers(parsed, fan)
    slotted = parsed.drop("shape").join(checked_broadcast(made, 100_000), "host").mapInArrow(_assign, "uid long, page_id long, host string, fits boolean, slots array<int>, first array<int>, places array<string>, texts array<string>")
    copy = F.xxhash64("texts").alias("copy")
    alike = cut(parsed.select("host", copy, "uid").groupBy("host", "copy").agg(F.min("uid").alias("stands"), F.count(F.lit(1)).alias("n")))
    of_host = cut(alike.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    again = cut(alike.filter("n > 1").select("host", "copy", "stands"))
    each = slotted.filter("fits").select("host", copy, "uid", "slots", "first", "texts").join(checked_broadcast(again), ["host", "copy"], "left").filter("stands IS NULL OR stands = uid")
    each = each.select("host", F.explode(F.arrays_zip("slots", "first", "texts")).alias("s"))
    h = F.xxhash64("s.texts")
    slots = each.groupBy("host", F.col("s.slots").alias("slot")).agg(F.min(h).alias("a"), F.max(h).alias("b"), F.sum("s.first").alias("on")).filter("a = b AND on > 1")
    same = slots.join(checked_broadcast(of_host, 100_000), "host").filter(F.col("on") > F.lit(share) * F.col("pages"))
    constant = cut(same.groupBy("host").agg(F.collect_list("slot").alias("constant")))
    out = slotted.join(checked_broadcast(constant, 100_000), "host", "left").withColumn("z", F.arrays_zip("slots", "places", "texts"))
    of = lambda place: F.transform(F.filter("z", lambda x: (x["places"] == place) & (F.col("constant").isNull() | ~F.array_contains(F.col("constant"), x["slots"]))), lambda x: x["texts"])
    title = F.transform(F.filter("z", lambda x: x["places"] == "title"), lambda x: x["texts"])
    return out.select("page_id", "host", "fits", F.get(title, F.lit(0)).alias("title"), F.array_join(of("body"), "\n").alias("text"))


def op7_html_wrappers(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op7_html_wrappers": op7_html_wrappers}
ORACLE: dict[str, str] = {}
