"""Main text of pages by wrappers: union-free regular expressions inferred from all pages of a host.

The token streams of a host's pages are aligned one after another, each with the wrapper so far, kind of element by kind
of element. Mismatches are resolved: a kind that only one side has becomes optional, a kind that comes
again, or before and after another, becomes a repeated group, and text that differs becomes a text slot; text that
every page has at that place stays constant. Alignment is a union of kinds and an intersection of constants, so
wrappers of parts of a host merge in any order, and its result depends on the host's pages alone.

A page is read through its host's wrapper. Constants that stand on pages of several different stories are the
template and go. The prose that varies chooses the region: articles if the host marks them, else its main
element, else the innermost container with most of the prose; a page whose prose lies elsewhere is read by a wrapper of
its own. Inside the region, optional and repeated groups that are marked as menus, notices, adverts, forms or reader
comments are left out.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..scratch import saved
from .html import BLOCK, Element, parse, room_for
from .text import partitions, slices, text_or_empty

#: Hosts above this share of all html are hot; there are 1 / HOT_SHARE of them at most.
HOT_SHARE, HOT_BYTES = 1e-5, 1 << 20
#: More kinds of one tag below one element become one kind.
KINDS = 64
#: A constant is template text if it stands on pages of so many stories; sketches are kept of at most so many pages.
STORIES, SKETCHES = 3, 8
#: Wrappers that meet in one task before the last step, for each host; parts of wrappers that a task holds while it reads.
FAN, HELD_PARTS = 256, 50_000

# Elements, roles and words in class or id that mark what is no main text.
NO_TEXT = set("script style noscript template nav footer aside button select textarea iframe svg object dialog menu head title input canvas audio video label legend".split())
NO_TEXT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NEVER_WORDS = set("breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus footer gdpr menu nav navbar navigation pager pagination replies reply respond sidebar".split())
COMMENT_WORDS = set("comment comments commentlist disqus replies reply respond".split())
MARKED_WORDS = NEVER_WORDS | set("ad ads advert adverts advertisement advertising aside banner consent login masthead modal newsletter notice notices popup promo promos promotion related share sharing signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
BESIDE_WORDS = set("area article articles bar block body bottom box button buttons col column container content desktop entry fixed form global google group header holder icon icons id inner item items js left link links list main message mobile module outer page panel post posts primary reader right row secondary section site slot sticky stories story text title top unit user wp wrap wrapper".split())
CONTAINERS = set("#root html body div section center table tbody tr td main article span font form".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements whose like differ in layout alone, so that their place tells them apart.
PLAIN = set("div section table tr td center span".split())


def word_mark(names: str) -> str:
    """``!`` for classes and ids of what is never main text, ``?`` for those that may hold it, else empty.

    A name counts if one of its words marks it and all others only say where or what for, so that ``share-buttons`` does and ``share-price`` does not.
    """
    found = ""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        if set(words) & MARKED_WORDS and set(words) <= MARKED_WORDS | BESIDE_WORDS:
            if set(words) & NEVER_WORDS:
                return "!"
            found = "?"
    return found


@lru_cache(1 << 16)
def kind_of(tag: str, names: str, role: str, hidden: bool) -> str:
    """Kind of an element: its mark, tag and the words of class and id, numbers alike."""
    if tag in ("html", "body", "main", "#root"):
        mark = ""
    elif tag in NO_TEXT or hidden or role.lower() in NO_TEXT_ROLES - {"form"}:
        mark = "!"
    else:
        mark = word_mark(names) or ("?" if tag in ("form", "header") or role.lower() == "form" else "")
    if tag in HEADINGS and mark == "?":
        mark = ""
    if mark == "!" or tag in ("p", "b", "i", "a", "em", "strong"):
        names = ""
    words = [re.sub(r"\d+", "0", w) for w in re.split(r"[^a-z0-9]+", names.lower()) if w]
    return mark + ".".join([tag, *words])


def kind(e: Element) -> str:
    """Kind of an element of a page."""
    at = e.attrs
    if not at:
        return kind_of(e.tag, "", "", False)
    hidden = "hidden" in at or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", "")))
    return kind_of(e.tag, f"{at.get('class', '')} {at.get('id', '')}", at.get("role", ""), hidden)


def marked_by_words(e: Element) -> bool:
    """Is an element no main text by the words of its class or id alone?"""
    if not e.attrs or not ("class" in e.attrs or "id" in e.attrs):
        return False
    return kind(e)[0] == "!" and kind(Element(e.tag, {k: v for k, v in e.attrs.items() if k not in ("class", "id")}))[0] != "!"


def freed(page: Element) -> Element:
    """The page, without class and id of elements whose words would take most of its prose away.

    Names such as ``right-sidebar`` also stand for layouts. Words for reader comments give way only if the element also holds the
    heading of the page, or all but a twentieth of its prose.
    """
    order, stack = [], [(page, False)]
    while stack:
        e, linked = stack.pop()
        order.append((e, linked))
        for child in e.children:
            if not isinstance(child, str) and child.tag not in NO_TEXT:
                stack.append((child, linked or child.tag == "a"))
    named = [e for e, _ in order if marked_by_words(e)]
    if not named:
        return page
    prose: dict[int, int] = {}
    titled: set[int] = set()
    for e, linked in reversed(order):
        inner = [c for c in e.children if not isinstance(c, str)]
        prose[id(e)] = sum(len(line_of(c)) * (1 if linked else 5) for c in e.children if isinstance(c, str)) + sum(prose.get(id(c), 0) for c in inner)
        if e.tag == "h1" or any(id(c) in titled for c in inner):
            titled.add(id(e))
    for e in named:
        share = prose[id(e)] / max(1, prose[id(page)])
        words = set(re.split(r"[^a-z]+", f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}".lower()))
        if share > 0.5 and (not words & COMMENT_WORDS or id(e) in titled or share >= 0.95):
            e.attrs = {k: v for k, v in e.attrs.items() if k not in ("class", "id")}
    return page


def tag_of(key: str) -> str:
    """Tag of a kind."""
    return key.lstrip("!?").split(".")[0].split("~")[0]


@dataclass(eq=False)
class Part:
    """One kind of element in a wrapper: the kinds below, which came right after which, and what its pages have in common.

    ``pages`` is the number of pages that have it, ``mass`` five times its prose and once the text of its links, ``lines`` the
    constant texts (hash: mass), ``stories`` sketches of its pages.
    """

    key: str
    pages: int = 1
    repeated: bool = False
    mass: int = 0
    lines: dict[int, int] = field(default_factory=dict)
    stories: list[tuple[int, ...]] = field(default_factory=list)
    parts: dict[str, Part] = field(default_factory=dict)
    order: set[tuple[str, str]] = field(default_factory=set)
    slot: bool = False

    def below(self, key: str) -> Part | None:
        """The part of a kind below; kinds of a tag that became one stand under the tag and a star."""
        return self.parts.get(key) or self.parts.get(star(key))

    def __str__(self) -> str:
        body = "".join(f"({''.join(group)})*" if len(group) > 1 else group[0] for group in self.groups())
        return f"<{self.key}>{body}</>"

    def groups(self) -> list[list[str]]:
        """The expression: kinds in order; those that come before and after one another make one repeated group."""
        keys = ["#"] * (("#", "#") in self.order) + sorted(self.parts)
        after: dict[str, set[str]] = {k: {b for a, b in self.order if a == k} for k in keys}
        for _ in keys:  # what comes after, directly or not
            for k in keys:
                after[k] = after[k].union(*(after.get(x, set()) for x in after[k]))
        done, out = set(), []
        for k in sorted(keys, key=lambda k: -len(after[k])):
            if k not in done:
                group = [x for x in keys if x == k or (x in after[k] and k in after[x])]
                done |= set(group)
                out.append([self.shown(x) for x in group])
        return out

    def shown(self, key: str) -> str:
        """One kind with its quantifier; ``#`` is a text slot, ``=`` constant text."""
        if key == "#":
            return "#" if self.slot else "="
        part = self.parts[key]
        sign = ("*" if part.repeated else "?") if part.pages < self.pages else "+" if part.repeated else ""
        return f"({part}){sign}" if sign else str(part)


def star(key: str) -> str:
    """Name of the one kind that many kinds of a tag become."""
    mark = key[0] if key[0] in "!?" else ""
    return f"{mark}{tag_of(key)}.*"


def line_of(text: str) -> str:
    return " ".join(text.split())


def sketch(text: str) -> tuple[int, ...]:
    """Three minima over the hashes of all spans of 16 characters, so that near copies share one."""
    points = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    n = min(16, len(points))
    spans = np.zeros(len(points) - n + 1, np.uint64)
    for k in range(n):
        spans = spans * np.uint64(0x100000001B3) + points[k : len(points) - n + 1 + k]
    return tuple(int(((spans ^ (spans >> np.uint64(29))) * np.uint64(m) >> np.uint64(32)).min()) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def keyed_children(e: Element) -> Iterator[tuple[str, Element]]:
    """Elements below with their kinds; those of plain layout without a name are told apart by their place."""
    seen: dict[str, int] = {}
    for child in e.children:
        if not isinstance(child, str):
            key = kind(child)
            if key in PLAIN:
                seen[key] = seen.get(key, 0) + 1
                yield (key if seen[key] == 1 else f"{key}.~{seen[key]}"), child
            else:
                yield key, child


def wrapper_of(page: Element) -> Part:
    """The wrapper of one page."""
    longest = [""]

    def make(e: Element, key: str, linked: bool) -> Part:
        part, last = Part(key), ""
        keys = keyed_children(e)
        for child in e.children:
            if isinstance(child, str):
                if line := line_of(child):
                    weight = len(line) * (1 if linked else 5)
                    part.mass += weight
                    part.lines[xxh64_intdigest(line)] = weight
                    now = "#"
                    part.order.add(("#", "#"))
                    if not linked and len(line) > len(longest[0]):
                        longest[0] = line
                else:
                    continue
            else:
                now, _ = next(keys)
                below = Part(now) if now[0] == "!" else make(child, now, linked or child.tag == "a")
                held = part.parts.get(now)
                if held:
                    united(held, below, False)
                    held.repeated = True
                else:
                    part.parts[now] = below
                part.mass += below.mass if now[0] != "?" else 0
            if last and last != now:
                part.order.add((last, now))
            last = now
        bounded(part)
        return part

    root = make(page, "#root", False)
    stories = [sketch(longest[0])] if longest[0] else []
    stack = [root]
    while stack:
        at = stack.pop()
        at.stories = stories
        stack += at.parts.values()
    return root


def united(a: Part, b: Part, pages: bool = True) -> Part:
    """Align ``b`` with ``a``, which is changed: two wrappers of different ``pages``, or two like elements of one page."""
    if pages:
        a.pages += b.pages
        a.slot = a.slot or b.slot or a.lines.keys() != b.lines.keys()
        a.lines = {k: v for k, v in a.lines.items() if k in b.lines}
        a.stories = sorted(set(a.stories) | set(b.stories))[:SKETCHES]
    else:
        a.slot = a.slot or b.slot or a.lines.keys() != b.lines.keys()
        a.lines.update(b.lines)
    a.mass += b.mass
    a.repeated = a.repeated or b.repeated
    a.order |= b.order
    for key, below in b.parts.items():
        held = a.below(key)
        if held:
            united(held, below, pages)
        else:
            a.parts[key] = below
    bounded(a)
    return a


def bounded(part: Part) -> None:
    """Make one kind of the kinds of a tag where there are too many; what they have in common is then not told."""
    if len(part.parts) <= KINDS and not any(k.endswith(".*") for k in part.parts):
        return
    groups: dict[str, list[str]] = {}
    for key in part.parts:
        groups.setdefault(star(key), []).append(key)
    for name, keys in groups.items():
        if len(keys) > KINDS or name in part.parts and len(keys) > 1:
            whole = part.parts.pop(name, None) or Part(name, pages=0)
            for key in keys:
                if key != name:
                    united(whole, part.parts.pop(key))
            whole.lines, whole.slot, whole.repeated = {}, True, True
            part.parts[name] = whole
            part.order = {(a, b) for a, b in ((name if x in keys else x, name if y in keys else y) for x, y in part.order) if a != b or a == "#"}


def written(wrapper: Part) -> bytes:
    """A wrapper as bytes: its parts in depth-first order, flat."""
    rows, stack = [], [(0, wrapper)]
    while stack:
        depth, at = stack.pop()
        rows.append((depth, at.key, at.pages, at.repeated, at.mass, list(at.lines.items()), at.stories, sorted(at.order), at.slot))
        stack += [(depth + 1, p) for p in reversed(at.parts.values())]
    return zlib.compress(json.dumps(rows, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)


def read_back(data: bytes) -> Part:
    """The wrapper that ``written`` gave."""
    path: list[Part] = []
    for depth, key, pages, repeated, mass, lines, stories, order, slot in json.loads(zlib.decompress(data)):
        part = Part(key, pages, repeated, mass, {int(k): v for k, v in lines}, [tuple(s) for s in stories], {}, {(a, b) for a, b in order}, slot)
        del path[depth:]
        if path:
            path[-1].parts[key] = part
        room_for(depth)
        path.append(part)
    return path[0]


def size_of(wrapper: Part) -> int:
    """Number of parts."""
    stack, n = [wrapper], 0
    while stack:
        n += 1
        stack += stack.pop().parts.values()
    return n


def infer(pages: list[Element]) -> Part:
    """The wrapper of several pages."""
    wrapper = wrapper_of(pages[0])
    for page in pages[1:]:
        united(wrapper, wrapper_of(page))
    return wrapper


class Reader:
    """A wrapper made ready to read pages: which constants are template, where the prose is, which marked groups hold it."""

    def __init__(self, wrapper: Part) -> None:
        self.wrapper = wrapper
        self.weigh(wrapper)
        total = wrapper.prose
        stack = [wrapper]
        while stack:  # a marked group is open if most prose is in it
            at = stack.pop()
            for p in at.parts.values():
                p.open = p.key[0] != "!" and (p.key[0] != "?" or p.holds or tag_of(p.key) != "header" and p.prose > total / 2)
                if p.open:
                    stack.append(p)
        self.weigh(wrapper)
        self.choices = [c for c in (self.marked("article"), self.marked("main"), [self.densest()]) if c]

    def weigh(self, part: Part) -> None:
        """Set ``template`` (are the constants template text?), ``prose`` (varying mass) and ``holds`` (an article or main element below)."""
        part.template = part.pages >= STORIES and different(part.stories) >= STORIES
        constant = sum(part.lines.values()) * part.pages if part.template and tag_of(part.key) not in HEADINGS else 0
        own = part.mass - sum(p.mass for p in part.parts.values() if p.key[0] != "?")
        part.prose, part.holds = max(0, own - constant), False
        for p in part.parts.values():
            self.weigh(p)
            if p.key[0] != "?" or getattr(p, "open", False):
                part.prose += p.prose
            part.holds = part.holds or p.key[0] != "!" and (p.holds or tag_of(p.key) in ("article", "main"))

    def marked(self, tag: str) -> list[list[str]]:
        """Paths to the outermost elements of a tag: the heaviest, its siblings and those of at least half its prose."""
        found, stack = [], [(self.wrapper, [])]
        while stack:
            at, path = stack.pop()
            for key, p in at.parts.items():
                if p.key[0] != "!" and p.open:
                    if tag_of(key) == tag:
                        found.append((p.prose, [*path, key]))
                    else:
                        stack.append((p, [*path, key]))
        if not found:
            return []
        most, best = max(found, key=lambda x: (x[0], -len(x[1]), x[1]))
        return [path for prose, path in sorted(found, key=lambda x: x[1]) if path[:-1] == best[:-1] or 2 * prose >= most]

    def densest(self) -> list[str]:
        """Path to the innermost container with most of the prose."""
        path, at = [], self.wrapper
        while True:
            best = max(((p.prose, k) for k, p in at.parts.items() if p.open and tag_of(k) in CONTAINERS), default=(0, ""))
            if best[0] < 0.6 * at.prose or not best[0]:
                return path
            path, at = [*path, best[1]], at.parts[best[1]]

    def align(self, page: Element) -> None:
        """Give each element of a page its part of the wrapper, and its own prose."""

        def visit(e: Element, part: Part | None, linked: bool) -> None:
            e.part, e.prose = part, 0
            known = part.lines if part and part.template else {}
            for child in e.children:
                if isinstance(child, str):
                    if (line := line_of(child)) and not (known and xxh64_intdigest(line) in known):
                        e.prose += len(line) * (1 if linked else 5)
            for key, child in keyed_children(e):
                child.key = key
                if key[0] != "!":
                    below = part.below(key) if part else None
                    visit(child, below, linked or child.tag == "a")
                    if key[0] != "?" or below and below.open:
                        e.prose += child.prose

        page.key = "#root"
        visit(page, self.wrapper, False)

    def regions(self, page: Element, paths: list[list[str]]) -> list[Element]:
        """Elements of a page on one of the paths, in page order."""
        found: list[Element] = []

        def visit(e: Element, left: list[list[str]]) -> None:
            if any(not p for p in left):
                found.append(e)
                return
            for child in e.children:
                if not isinstance(child, str) and child.key[0] != "!":
                    below = [p[1:] for p in left if child.key == p[0] or star(child.key) == p[0]]
                    if below:
                        visit(child, below)

        visit(page, paths)
        return found

    def main_text(self, page: Element, own: bool = False) -> str:
        """Blocks of the region of one page; a page whose prose lies elsewhere is read by a wrapper of its own."""
        if not own:
            self.align(page)
        found: list[Element] = []
        for paths in self.choices:
            there = self.regions(page, paths)
            if there and (own or sum(e.prose for e in there) >= (0.2 if tag_of(paths[0][-1] if paths[0] else "") in ("article", "main") else 0.5) * page.prose):
                found = there
                break
        if not found:
            return Reader(wrapper_of(page)).main_text(page, own=True) if not own else ""
        lines: list[str] = []
        for region in found:
            lines += self.blocks(region)
        return "\n".join(lines)

    def blocks(self, region: Element) -> list[str]:
        """Text of the blocks of a region, white space as one space, without template lines and what is marked as no main text."""
        lines: list[str] = []
        now: list[str] = []
        whole_page = region.tag in ("#root", "html", "body")
        varying = heading = False
        stack: list = [(None, region, False), *((c, region, False) for c in reversed(region.children))]
        while stack:
            at, parent, in_header = stack.pop()
            if isinstance(at, str):
                if (in_header and not heading) or not at:
                    continue
                now.append(at)
                if not varying and (line := line_of(at)):
                    part = parent.part
                    varying = not (part and part.template and xxh64_intdigest(line) in part.lines)
                heading = heading or parent.tag in HEADINGS or parent.tag in ("th", "dt")
                continue
            skip = False
            if at is not None:
                key = at.key
                if at.tag == "header":
                    skip = whole_page and not (at.part and at.part.open)
                    in_header = not skip and not (at.part and at.part.open)
                else:
                    skip = key[0] == "!" or key[0] == "?" and not (at.part and at.part.open)
            if at is None or at.tag in BLOCK:  # None ends a block
                if (line := line_of("".join(now))) and (varying or heading):
                    lines.append(line)
                now.clear()
                varying = heading = False
            if at is not None and not skip:
                heading = heading or at.tag in HEADINGS
                stack += [(None, parent, in_header)] * (at.tag in BLOCK)
                stack += [(c, at, in_header) for c in reversed(at.children)]
        return lines


def different(stories: list[tuple[int, ...]]) -> int:
    """How many of the stories share no minimum with one before."""
    kept: list[tuple[int, ...]] = []
    for s in stories:
        if all(x != y for k in kept for x, y in zip(s, k)):
            kept.append(s)
    return len(kept)


def host_of(url: Column) -> Column:
    """The host of a url, lower case, without user and port."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def merged(wrappers: DataFrame, *keys: str) -> DataFrame:
    """host and wrapper: the wrappers of each group of ``keys`` aligned one after another as they stream by."""
    dealt = wrappers.repartition(partitions(wrappers.sparkSession), *keys).sortWithinPartitions(*keys)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole = None, None
        for batch in slices(it):
            done = []
            for *key, data in zip(*(batch.column(k).to_pylist() for k in (*keys, "wrapper"))):
                if key != now:
                    if whole is not None:
                        done.append((now[0], written(whole)))
                    now, whole = key, read_back(data)
                else:
                    united(whole, read_back(data))
            yield wrapper_batch(done)
        if whole is not None:
            yield wrapper_batch([(now[0], written(whole))])

    return dealt.mapInArrow(batches, "host string, wrapper binary")


def wrapper_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["host", "wrapper"])


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper of all pages (host, html): tasks align the pages they read, then the wrappers of each host meet in two steps."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Part] = {}
        parts = 0
        for batch in slices(it):
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = wrapper_of(freed(parse(html)))
                if host in held:
                    united(held[host], new)
                else:
                    held[host] = new
                    parts += size_of(new)
            if parts > HELD_PARTS:
                yield wrapper_batch([(h, written(w)) for h, w in held.items()])
                held, parts = {}, 0
        if held:
            yield wrapper_batch([(h, written(w)) for h, w in held.items()])

    first = pages.select("host", "html").mapInArrow(batches, "host string, wrapper binary")
    return merged(merged(first.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN))), "host", "salt"), "host")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``; page_id keeps its type.

    Null and empty html give an empty text; a null url belongs to the empty host; repeated rows stay repeated; an
    empty table gives no rows; other columns are not read. Of regions with as much prose the last by name is read. Elements
    may nest to any depth (a task needs about 1 KB for each level). Html is read twice, and shuffled once, by
    host, with the host's wrapper ahead of its pages; hot hosts are salted, which does not change the wrapper.
    """
    spark = pages.sparkSession
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].cast("string").alias("url"), text_or_empty(pages["html"]).alias("html"), host_of(pages["url"]).alias("host"))
    wrappers = saved(host_wrappers(rows), "html-wrappers")
    sizes = saved(rows.groupBy("host").agg(F.sum(F.octet_length("html").cast("long")).alias("bytes")), "html-hosts")
    bar = max(HOT_BYTES, int((sizes.agg(F.sum("bytes")).first()[0] or 0) * HOT_SHARE))
    hot = sizes.filter(F.col("bytes") > bar).select("host", F.ceil(F.col("bytes") / bar).cast("int").alias("salts"))  # at most 1 / HOT_SHARE rows
    salts = F.coalesce("salts", F.lit(1))
    ahead = wrappers.join(F.broadcast(hot), "host", "left").select("host", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("at"), F.lit(None).cast(rows.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "wrapper")
    salt = F.pmod(F.xxhash64(F.col("page_id").cast("string"), F.col("url"), F.col("html")), salts).cast("int")
    own = rows.join(F.broadcast(hot), "host", "left").select("host", salt.alias("salt"), F.lit(1).alias("at"), "page_id", "url", "html", F.lit(None).cast("binary").alias("wrapper"))
    dealt = own.unionByName(ahead).repartition(partitions(spark), "host", "salt").sortWithinPartitions("host", "salt", "at")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in slices(it):
            texts = []
            for data, html in zip(batch.column("wrapper").to_pylist(), batch.column("html").to_pylist()):
                if data is not None:
                    reader = Reader(read_back(data))
                else:
                    texts.append(reader.main_text(freed(parse(html))))
            own = batch.filter(batch.column("wrapper").is_null())
            yield pa.RecordBatch.from_arrays([own.column("page_id"), own.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return dealt.mapInArrow(batches, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
