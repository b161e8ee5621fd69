"""Main text of web pages by consensus on container paths.

Each page scores its containers (text, less linked text, weighed by how far below it stands) and
votes for the generalised tag-class path of the best one. The votes of a host are counted in Spark,
and every page is then extracted again from the containers on its host's winning path; a page that
has none of them, as those of a host's ninth template, falls back on its own best container. Elements
are left out by tag, role or name wherever they stand, paragraphs, items and word groups too; a name
counts only if all its words say so, and never against a box that holds nearly all of a page's prose.

Results for special input: null or empty HTML, or HTML without text, gives an empty text; unclosed
or crossing tags end where an enclosing container ends; a < that no > follows is text; the time for a
page grows with its length, however deep or broken it is; character references that are cut off stay
as they are; pages without a host share one vote; rows that repeat are each extracted; null keys are
kept; an empty table gives no rows. Columns other than the keys, URL and HTML are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm.components import stored
from askloom.llm.url_filters import url_host
from askloom.operators.sizes import broadcast_if

PATHS = 8  # winning paths tried per host, best first
NEARNESS = 0.8  # share of a block's weight that each further container above it gets

# HTML elements by their part in a page.
CONTAINERS = frozenset("html body main article section div td table tbody tr center details figure".split())
LEAVES = frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre address figcaption caption th hr option summary tr".split()
)
LEFT_OUT = frozenset(
    "head nav header footer aside form script style noscript template iframe svg canvas object button select textarea menu dialog fieldset".split()
)
RAW = frozenset("script style textarea title noscript iframe template svg".split())
VOID = frozenset("br img hr input meta link area base col embed source track wbr".split())
NAMES_LEFT_OUT = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent
    notice alert popup modal newsletter subscribe subscription sidebar side nav navbar navigation menu breadcrumb breadcrumbs
    header masthead topbar footer comment comments reply replies disqus respond share sharing social related recommended
    widget login signup search pagination pager skip""".split()
)
ROLES_LEFT_OUT = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())
ARTICLES = frozenset("html body main article".split())

# Words that only say where or how a named box stands; "ad-slot-2" is an advert, "side-effects" is not a sidebar.
NEUTRAL = frozenset(
    "box wrap wrapper container inner outer block section area item items list left right top bottom slot bar panel unit widget text title content body row col column s".split()
)
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
OUTWEIGHS = 4  # how many times the prose of all else a named box must hold to be the page's own
FLAT = frozenset("p h1 h2 h3 h4 h5 h6 figcaption caption address".split())  # end with the next block
ITEMS = frozenset("li dd dt".split())  # end with the next item

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_MARK = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[_\-]+")
_GAP = re.compile(r"\s+")
_ENDS = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in RAW}
IN, NAMED, OUT = 0, 1, 2


class Tags:
    """Tags of a page from left to right, in time that grows with the page whatever it holds.

    A tag ends at the first > outside quotes. Where a quote stays open to the end of the page, no tag
    that opens it ends; such quotes are remembered, so that none is followed twice.
    """

    def __init__(self, source: str):
        self.source = source
        self.marks = [m.start() for m in _MARK.finditer(source)]
        self.last = source.rfind(">")
        self.open: set[int] = set()

    def end(self, at: int) -> int:
        """Place of the > that ends a tag begun before ``at``, or -1."""
        followed = []
        while at <= self.last:
            i = bisect_left(self.marks, at)
            place = self.marks[i] if i < len(self.marks) else -1
            if place < 0 or place in self.open:
                break
            if self.source[place] == ">":
                return place
            followed.append(place)
            at = self.source.find(self.source[place], place + 1) + 1
            if not at:
                break
        self.open.update(followed)
        return -1

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        """(begin, end, name, closing, attributes) of the next tag; the name of a comment is empty, begin is -1 after the last."""
        source, cut = self.source, self.source.find("<", at)
        while cut >= 0:
            if source.startswith("<!--", cut):
                end = source.find("-->", cut + 4)
                return cut, end + 3 if end >= 0 else len(source), "", False, ""
            if cut > self.last:
                break
            if source[cut + 1] in "!?":
                return cut, source.find(">", cut) + 1, "", False, ""
            if source[cut + 1] == "/" or source[cut + 1].isalpha():
                end = self.end(cut + 1)
                found = _NAME.match(source, cut, end) if end >= 0 else None
                if found:
                    return cut, end + 1, found[1].lower(), source[cut + 1] == "/", source[found.end() : end]
            cut = source.find("<", cut + 1)
        cut = source.find("<!--", max(at, self.last)) if cut >= 0 else -1
        return (cut, len(source), "", False, "") if cut >= 0 else (-1, -1, "", False, "")


def _left_out(name: str) -> bool:
    parts = [x for x in _SPLIT.split(re.sub(r"\d+", "", name)) if x]
    return any(x in NAMES_LEFT_OUT for x in parts) and all(x in NAMES_LEFT_OUT or x in NEUTRAL for x in parts)


def _named(tag: str, raw: str) -> tuple[str, int, bool]:
    """Generalised name of an element (numbers as #), how it is left out, and whether it holds comments."""
    found = {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(raw)} if "=" in raw else {}
    words = found.get("class", "").lower().split()
    classes = sorted({re.sub(r"\d+", "#", c).replace("/", ":") for c in words})
    out = OUT if tag in LEFT_OUT else IN
    if not out and tag not in ARTICLES:
        words = [*words, *found.get("id", "").lower().split()]
        out = NAMED if any(_left_out(w) for w in words) or found.get("role", "").lower() in ROLES_LEFT_OUT else IN
    return ".".join([tag, *classes]), out, bool(out) and any(not COMMENTS.isdisjoint(_SPLIT.split(w)) for w in words)


class Page:
    """Blocks of text in page order, each with the container above it.

    Elements that are left out by tag are gone. Boxes that are left out by a name are kept aside: the
    largest, if it is not one of comments, comes back where it outweighs all else, as a page without
    other prose has its article there.
    """

    def __init__(self, source: str):
        self.names: list[str] = [""]  # of each container, by number; 0 is the page
        self.above: list[int] = [-1]
        self.kinds: list[int] = [0]  # number of each container's path
        self.known: dict[tuple[int, str], int] = {}  # path by (path above, name)
        self.boxes: list[tuple[bool, list]] = [(False, [])]  # of comments?, blocks with their places; 0 is what stands in no box
        self.placed = 0
        self._read(source)
        self.blocks: list[tuple[int, str, int]] = self._kept()  # container, text, linked characters

    def _flush(self, holder: int, box: int, parts: list[tuple[str, bool]]) -> None:
        if parts:
            text = _GAP.sub(" ", "".join(p for p, _ in parts)).strip()
            if text:
                self.placed += 1
                self.boxes[box][1].append((self.placed, holder, text, sum(len(p.strip()) for p, linked in parts if linked)))
            parts.clear()

    def _kept(self) -> list[tuple[int, str, int]]:
        prose = [sum(max(0, len(t) - 2 * linked) for _, _, t, linked in held) for _, held in self.boxes]
        own = max((i for i in range(1, len(prose)) if not self.boxes[i][0]), key=lambda i: prose[i], default=0)
        blocks = self.boxes[0][1]
        if own and prose[own] > OUTWEIGHS * prose[0]:
            blocks = sorted(blocks + self.boxes[own][1])
        return [b[1:] for b in blocks]

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, int, int]] = [("", 0, IN, 0)]  # tag, container, left out, named box
        opened: Counter[str] = Counter()
        parts: list[tuple[str, bool]] = []
        links, at, tags = 0, 0, Tags(source)
        word, depth = "", 0  # the named word group that is open, and how often its tag is

        def push(tag, raw, holds):
            name, out, comments = _named(tag, raw)
            _, holder, above_out, box = stack[-1]
            if not holds and not out:
                return
            if holds or tag not in FLAT:
                kind = self.known.setdefault((self.kinds[holder], name), len(self.known) + 1)
                self.names.append(name)
                self.above.append(holder)
                self.kinds.append(kind)
                holder = len(self.names) - 1
            if out == NAMED and above_out == IN:
                self.boxes.append((comments, []))
                box = len(self.boxes) - 1
            stack.append((tag, holder, max(out, above_out), box))
            opened[tag] += 1

        def pop(tag):
            gone = ""
            while gone != tag:
                gone = stack.pop()[0]
                opened[gone] -= 1

        while True:
            cut, end, tag, closing, raw = tags.next(at)
            text = source[at:cut] if cut >= 0 else source[at:]
            if text and stack[-1][2] != OUT and not depth:
                parts.append((html.unescape(text), links > 0))
            if cut < 0:
                break
            at, alone = end, raw.rstrip().endswith("/")
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            if not tag:
                continue
            if tag == "br":
                parts.append((" ", False))
            elif not closing and tag in RAW:
                ended = _ENDS[tag].search(source, at)
                at = ended.end() if ended else len(source)
            elif tag in CONTAINERS or tag in LEFT_OUT or tag in LEAVES:
                holds, depth = tag not in LEAVES or tag in CONTAINERS, 0
                self._flush(stack[-1][1], stack[-1][3], parts)
                links = 0 if holds else links
                if stack[-1][0] in FLAT or not closing and tag in ITEMS and stack[-1][0] in ITEMS:
                    pop(stack[-1][0])
                if closing and opened[tag] > 0:
                    pop(tag)
                elif not closing and not alone and tag not in VOID:
                    push(tag, raw, holds)
            elif depth:
                depth += (-1 if closing else not alone) if tag == word else 0
            elif not closing and not alone and tag not in VOID and "=" in raw and _named(tag, raw)[1]:
                word, depth = tag, 1
        self._flush(stack[-1][1], stack[-1][3], parts)

    def path(self, holder: int) -> str:
        names = []
        while holder > 0:
            names.append(self.names[holder])
            holder = self.above[holder]
        return "".join(f"/{n}" for n in reversed(names))

    def best(self) -> int:
        """The container with most unlinked text close below it, or -1."""
        score = [0.0] * len(self.names)
        for holder, text, linked in self.blocks:
            score[holder] += float(len(text) - 3 * min(linked, len(text)))
        for i in range(len(score) - 1, 0, -1):  # containers are numbered from the outside in
            score[self.above[i]] += NEARNESS * score[i]
        top = max(range(len(score)), key=lambda i: (score[i], -i))
        return top if score[top] > 0 else -1

    def text(self, paths: list[str]) -> str:
        """Blocks below the containers of the first path the page has, or else below its best container."""
        for path in paths:
            kind = 0
            for name in path.split("/")[1:]:
                kind = self.known.get((kind, name), -1) if kind >= 0 else -1
            found = self._below({i for i, k in enumerate(self.kinds) if k == kind})
            if found:
                return "\n".join(found)
        return "\n".join(self._below({self.best()}))

    def _below(self, roots: set[int]) -> list[str]:
        under = [0 in roots]
        for i in range(1, len(self.names)):
            under.append(under[self.above[i]] or i in roots)
        return [t for h, t, _ in self.blocks if under[h]]


def votes(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path, votes, place) of each host's ``PATHS`` most voted container paths."""

    def run(batches):
        for b in batches:
            found = []
            for t in b.column("html").to_pylist():
                page = Page(t or "")
                top = page.best()
                found.append(page.path(top) if top >= 0 else None)
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(found, pa.string())], names=["host", "path"])

    told = pages.select(url_host(F.col(url)).alias("host"), F.col(source).alias("html")).mapInArrow(run, "host string, path string")
    counted = told.where("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PATHS)


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), url: str = "url", source: str = "html") -> DataFrame:
    """(keys, url, text) of every page.

    Hosts' winning paths are joined to the pages by broadcast while their counted rows are below a
    bound, and by host beyond it, where a host with very many pages is split by adaptive execution.
    """
    won = votes(pages, url, source).groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("place", "path"))).alias("w")
    ).select("host", F.transform("w", lambda x: x["path"]).alias("paths"))
    won = stored(won, "paths")

    def run(batches):
        for b in batches:
            texts = [Page(t or "").text(p or []) for t, p in zip(b.column("html").to_pylist(), b.column("paths").to_pylist(), strict=True)]
            columns = [b.column(c) for c in b.schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*b.schema.names[:-2], "text"])

    rows = pages.select(*keys, F.col(url).alias("url"), url_host(F.col(url)).alias("host"), F.col(source).alias("html"))
    met = rows.join(broadcast_if(won, won.count()), "host", "left").select(*keys, "url", "html", "paths")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields[:-2])
    return met.mapInArrow(run, f"{kinds}, text string")
