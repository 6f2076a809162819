"""Main text of web pages by consensus host paths.

Pages are parsed once into blocks of text and a tree of generalised paths (tags and classes from
the root, digits folded). Blocks that many pages of a host share are furniture. Each page scores
its containers by the text they hold, leaving furniture and link lists out, and votes for the
innermost one that holds all of it; Spark counts the votes per host, and every page is extracted
again from the path that won on its host.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quotemill.llm.common import saved

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z/][^>]*+\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NOTED = re.compile("class|id|role|style|hidden", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# What HTML calls these things.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section "
    "summary table tbody tfoot thead title tr ul".split()
)
SPACES = {"br", "td", "th", "option", "img", "input", "button"}
CONTAINERS = set("article body center div main section table tbody td tr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES = {  # an opening tag ends these open elements, up to the named borders
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NEVER_TEXT = set(
    "script style textarea title noscript template iframe xmp noembed noframes head nav header footer aside "
    "form button select option datalist input svg math canvas object audio video map dialog menu".split()
)
NEVER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NEVER_NAMES = set(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising breadcrumb breadcrumbs "
    "comment comments commentlist commentform consent cookie cookies cookiebar cookiebanner disqus footer form gdpr masthead menu modal nav navbar "
    "navigation topnav sidenav pagination pager popup related replies respond sidebar".split()
)
# Names that an article's own parts have as well: such blocks go only if they are repeated or link lists.
WEAK_NAMES = set(
    "banner disclaimer header login newsletter notice notices notification promo promotion search share sharing signup social "
    "sponsor sponsored subscribe toolbar widget widgets".split()
)
STATES = set("no has with without not is enabled disabled open opened closed hide hidden".split())
CONTENT_NAMES = {"article", "post", "entry", "story", "content", "main"}
# Furniture is on so many pages of its host, and on at least the root of all of them.
LEAST_PAGES = 3
LEAST_PAGES_SHORT = 2  # for blocks of less than SHORT_BLOCK characters
SHORT_BLOCK = 100


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)} if text.strip(" /\n\t\r") else {}


def _named(tag: str, attributes: dict[str, str]) -> int:
    """1 if class or id call an element boilerplate, 3 if they only may, else 0.

    Names of a state ("no-sidebar", "comments-open") say nothing, and an article or an element
    with a name that is only content ("entry-content") is content whatever its other names are.
    """
    if tag == "article":
        return 0
    names = [{n.lower() for n in NAME_PART.findall(t)} for t in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]
    names = [n for n in names if n.isdisjoint(STATES)]
    unwanted = NEVER_NAMES | WEAK_NAMES
    if any(n & CONTENT_NAMES and n.isdisjoint(unwanted) for n in names):
        return 0
    every = set().union(*names)
    if every & NEVER_NAMES:
        return 1
    found = every & WEAK_NAMES
    return 3 if found and not (found == {"header"} and every & CONTENT_NAMES) else 0


def _boilerplate(tag: str, attributes: dict[str, str]) -> int:
    """0: content; 1: boilerplate by name or a form, unless the page's text is in it; 2: boilerplate; 3: doubtful."""
    if tag in NEVER_TEXT:
        return 1 if tag == "form" else 2
    if tag in ("html", "body", "main") or not attributes:
        return 0
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style:
        return 2
    if attributes.get("role", "").lower() in NEVER_ROLES:
        return 2
    if tag in HEADINGS:
        return 0
    return _named(tag, attributes)


def _label(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted(re.sub(r"\d+", "0", attributes.get("class", "")).split())
    return ".".join([tag, *classes])


@lru_cache(maxsize=4096)
def _opening(tag: str, attrs: str) -> tuple[str, int]:
    """The label of an opening tag and its kind of boilerplate."""
    attributes = _attributes(attrs)
    return _label(tag, attributes), _boilerplate(tag, attributes)


@dataclass
class Page:
    """The visible blocks of a page and the tree of paths they lie on; path 0 is the page."""

    parents: list[int] = field(default_factory=lambda: [-1])
    labels: list[str] = field(default_factory=lambda: [""])
    opened: list[int] = field(default_factory=lambda: [0])  # how often a container's path was opened
    at: list[int] = field(default_factory=list)  # per block: its path,
    texts: list[str] = field(default_factory=list)  # its text with single spaces,
    linked: list[int] = field(default_factory=list)  # its characters inside links,
    weak: list[bool] = field(default_factory=list)  # whether its element's name is doubtful

    def link_list(self, i: int) -> bool:
        return 2 * self.linked[i] > len(self.texts[i])

    def path(self, node: int) -> str:
        out = []
        while node > 0:
            out.append(self.labels[node])
            node = self.parents[node]
        return " > ".join(reversed(out))

    def find(self, path: str) -> int:
        """The number of a path, or -1."""
        steps = {(p, label): i for i, (p, label) in enumerate(zip(self.parents, self.labels))}
        node = 0
        for label in path.split(" > "):
            node = steps.get((node, label), -1)
            if node < 0:
                break
        return node

    def inside(self, node: int) -> list[int]:
        """The blocks below a path."""
        below = [False] * len(self.parents)
        for i, parent in enumerate(self.parents):
            below[i] = i == node or parent >= 0 and below[parent]
        return [i for i, at in enumerate(self.at) if below[at]]


def parse(html: str | None) -> Page:
    """The text blocks outside boilerplate, in page order.

    An element that is boilerplate by its name or a form is read if next to nothing is left without
    it (a form: if it holds most of the text), judged by the text outside links.
    """
    page, doubtful = _parse(html or "", frozenset())
    if not doubtful:
        return page
    read = _needed(sum(len(t) for i, t in enumerate(page.texts) if not page.link_list(i)), doubtful)
    return _parse(html or "", read)[0] if read else page


def _needed(left: int, doubtful: list[list]) -> frozenset[int]:
    """The numbers of the [tag, number of the doubtful element around or -1, text] to be read."""
    held = [own for _, _, own in doubtful]
    for i in range(len(doubtful) - 1, -1, -1):
        if doubtful[i][1] >= 0:
            held[doubtful[i][1]] += held[i]
    read: set[int] = set()
    waiting = [(-held[i], i) for i, d in enumerate(doubtful) if d[1] < 0]
    heapq.heapify(waiting)
    inside = defaultdict(list)
    for i, (_, around, _) in enumerate(doubtful):
        if around >= 0:
            inside[around].append(i)
    total = left + sum(held[i] for _, i in waiting)
    while waiting:
        _, i = heapq.heappop(waiting)
        if held[i] and (held[i] >= 10 * left or doubtful[i][0] == "form" and 2 * held[i] > total):
            read.add(i)
            left += doubtful[i][2]
            for inner in inside[i]:
                heapq.heappush(waiting, (-held[inner], inner))
    return frozenset(read)


def _parse(html: str, read: frozenset[int]) -> tuple[Page, list[list]]:
    """The page with the doubtful elements of these numbers read, and all doubtful elements."""
    page, doubtful = Page(), []
    steps: dict[tuple[int, str], int] = {}
    within: list[tuple[int, int]] = []  # (place among the open elements, number) of open doubtful ones
    tags: list[str] = []  # the open elements, and their paths
    nodes: list[int] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag
    open_blocks: list[int] = []
    hidden = certain = weak = None  # the place where unread, certain or doubtful boilerplate begins
    buffer: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                page.at.append(nodes[-1] if nodes else 0)
                page.texts.append(text)
                page.linked.append(linked)
                page.weak.append(weak is not None)
            buffer.clear()
            linked = 0

    def innermost(wanted, borders=()) -> int:
        """The place of the innermost open element of `wanted` above any of `borders`, or -1."""
        last = lambda names: max((places[n][-1] for n in names if places[n]), default=-1)
        found = last(wanted)
        return found if found > last(borders) else -1

    def pop(index: int) -> None:
        nonlocal hidden, certain, weak
        if buffer and open_blocks and open_blocks[-1] >= index:
            flush()
        for tag in reversed(tags[index:]):
            places[tag].pop()
        while open_blocks and open_blocks[-1] >= index:
            open_blocks.pop()
        del tags[index:], nodes[index:]
        hidden = None if hidden is not None and hidden >= index else hidden
        certain = None if certain is not None and certain >= index else certain
        weak = None if weak is not None and weak >= index else weak
        while within and within[-1][0] >= index:
            within.pop()

    def text(raw: str) -> None:
        nonlocal linked
        if raw and hidden is None:
            plain = unescape(raw)
            buffer.append(plain)
            if places["a"]:
                linked += len(plain.strip())
        elif raw and within and certain is None and not places["a"]:
            doubtful[within[-1][1]][2] += len(" ".join(raw.split()))

    size = len(html)
    while at < size:
        token = TOKEN.search(html, at)
        if token is None:
            text(html[at:])
            break
        text(html[at : token.start()])
        at = token.end()
        close, tag, attrs = token.groups()
        if not tag:
            continue
        tag = tag.lower()
        if close:
            index = innermost((tag,))
            if index >= 0:
                pop(index)
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in SPACES and hidden is None:
            buffer.append(" ")
        if tag in BLOCKS:
            if places["p"]:
                pop(places["p"][-1])
            flush()
        if tag in CLOSES:
            index = innermost(*CLOSES[tag])
            if index >= 0:
                pop(index)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        label, boilerplate = _opening(tag, attrs) if NOTED.search(attrs) else (tag, _boilerplate(tag, {}))
        place = len(tags)
        tags.append(tag)
        places[tag].append(place)
        if tag in BLOCKS:
            open_blocks.append(place)
        around = nodes[-1] if nodes else 0
        if boilerplate == 1 and certain is None:
            doubtful.append([tag, within[-1][1] if within else -1, 0])
            within.append((place, len(doubtful) - 1))
        elif boilerplate == 2 and certain is None:
            certain = place
        elif boilerplate == 3 and weak is None:
            weak = place
        if hidden is None and (boilerplate == 2 or boilerplate == 1 and len(doubtful) - 1 not in read):
            hidden = place
        if hidden is not None:
            nodes.append(around)
            continue
        node = steps.setdefault((around, label), len(page.parents))
        if node == len(page.parents):
            page.parents.append(around)
            page.labels.append(label)
            page.opened.append(0)
        page.opened[node] += 1
        nodes.append(node)
    flush()
    return page, doubtful


def best_path(page: Page, repeated: frozenset[int] = frozenset()) -> tuple[str, int]:
    """The path of the page's best container ("" for the whole page) and the text it holds.

    A container's score is the text it holds, without link lists and the blocks whose numbers are
    in `repeated`. The innermost one-off container that holds all of it wins: a step inwards
    leaves only furniture and links behind.
    """
    weights = [0] * len(page.parents)
    for i, node in enumerate(page.at):
        if i not in repeated and not page.link_list(i):
            weights[node] += len(page.texts[i])
    for node in range(len(weights) - 1, 0, -1):  # a path comes after its parent
        weights[page.parents[node]] += weights[node]
    best = 0
    for node in range(1, len(weights)):
        # Paths that hold everything lie one inside the other.
        container = page.labels[node].split(".", 1)[0] in CONTAINERS
        if weights[0] and weights[node] == weights[0] and container and page.opened[node] == 1:
            best = node
    return page.path(best), weights[0]


def main_text(page: Page, path: str | None, repeated: frozenset[int] = frozenset()) -> str:
    """The blocks inside the containers of `path`, joined by two newlines.

    Without such a container on the page, the page's own best one; without any, all blocks. A
    block whose element has a doubtful name is left out if it is repeated or a list of links.
    """
    inside: list[int] = []
    for wanted in (path, None):
        if not inside:
            wanted = best_path(page, repeated)[0] if wanted is None else wanted
            node = page.find(wanted) if wanted else -1
            inside = page.inside(node) if node >= 0 else []
    kept = inside or range(len(page.at))
    return "\n\n".join(page.texts[i] for i in kept if not (page.weak[i] and (i in repeated or page.link_list(i))))


def host_of(url: Column) -> Column:
    """The host of a url with a scheme, A-Z lower-cased; otherwise empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, letters, letters.lower())


STRUCTURE = "parents array<int>, labels array<string>, opened array<int>, at array<int>, linked array<int>, weak array<boolean>"


def parsed(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, host, texts, hashes, structure) for (page_id, url, host, html), stored; `row` is unique."""
    names = ["row", "page_id", "url", "host", "texts", "parents", "labels", "opened", "at", "linked", "weak"]
    ints, texts = pa.list_(pa.int32()), pa.list_(pa.string())

    def run(stream):
        for batch in stream:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = [parse(h) for h in part.column("html").to_pylist()]
                lists = [("texts", texts), ("parents", ints), ("labels", texts), ("opened", ints), ("at", ints), ("linked", ints), ("weak", pa.list_(pa.bool_()))]
                columns = [*(part.column(c) for c in names[:4]), *(pa.array([getattr(p, n) for p in found], k) for n, k in lists)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"row long, page_id long, url string, host string, texts array<string>, {STRUCTURE}"
    rows = pages.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema)
    # The last bit of a block's hash tells whether the block is long.
    even = lambda t: F.xxhash64(t) - F.xxhash64(t).bitwiseAND(F.lit(1))
    hashes = F.transform("texts", lambda t: even(t) + F.when(F.length(t) >= SHORT_BLOCK, 1).otherwise(0))
    return saved(rows.withColumn("hashes", hashes), "html-parsed")


def furniture(rows: DataFrame) -> DataFrame:
    """(host, hash): the blocks on at least LEAST_PAGES pages of a host (short ones: LEAST_PAGES_SHORT) and on the root of all its pages.

    Pages with the same blocks count as one, so copies of a page make no furniture.
    """
    pages = rows.where(F.size("hashes") > 0).groupBy("host", F.xxhash64("hashes").alias("page")).agg(F.first("hashes").alias("hashes"))
    pages = saved(pages, "html-pages")
    total = saved(pages.groupBy("host").agg(F.count("*").alias("pages")), "html-hosts")
    blocks = pages.select("host", F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    least = F.when(F.col("hash").bitwiseAND(F.lit(1)) == 1, LEAST_PAGES).otherwise(LEAST_PAGES_SHORT)
    many = blocks.where(F.col("n") >= least).join(total, "host").where(F.col("n") * F.col("n") >= F.col("pages"))
    return saved(many.select("host", "hash"), "html-furniture")


def repeated_blocks(rows: DataFrame) -> DataFrame:
    """(row, repeated): the numbers of a page's blocks that are furniture of its host."""
    blocks = rows.select("row", "host", F.posexplode("hashes").alias("number", "hash"))
    held = blocks.join(furniture(rows), ["host", "hash"])
    return saved(held.groupBy("row").agg(F.collect_list("number").alias("repeated")), "html-repeated")


def _pages(part: pa.RecordBatch):
    """(page, its repeated blocks) of the rows of a batch; texts may be missing."""
    for row in part.to_pylist():
        texts = row["texts"] if "texts" in row else [" " * n for n in row["sizes"]]
        page = Page(row["parents"], row["labels"], row["opened"], row["at"], texts, row["linked"], row["weak"])
        yield page, frozenset(row["repeated"] or ())


def winning_paths(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """(host, path): the path with most page votes per host; ties to more text, then the path.

    One vote per page. Votes are summed before they are shuffled, so a host with most of the pages
    is no hot group; the texts stay behind.
    """

    def vote(stream):
        for batch in stream:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                paths, scores = zip(*[best_path(page, shared) for page, shared in _pages(part)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("host"), pa.array(paths, pa.string()), pa.array(scores, pa.int64())],
                    ["host", "path", "score"],
                )

    sizes = F.transform("texts", lambda t: F.length(t)).alias("sizes")
    structure = rows.select("row", "host", "parents", "labels", "opened", "at", "linked", "weak", sizes)
    votes = structure.join(repeated, "row", "left").mapInArrow(vote, "host string, path string, score long")
    counted = votes.where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    best = F.max(F.struct("n", "score", "path")).alias("best")
    return counted.groupBy("host").agg(best).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block is one space, blocks are joined
    in page order by two newlines; nothing is cut. A null html is an empty page, and a page without
    text outside boilerplate has an empty text. Pages without a host vote together. Repeated rows
    and null keys are rows like any other; other columns are ignored. Parsed pages are stored.
    """
    rows = parsed(
        pages.select(
            F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html")
        )
    )
    repeated = repeated_blocks(rows)
    # Written first: its size is then known, and a small table of hosts needs no shuffle of pages.
    winners = saved(winning_paths(rows, repeated), "html-paths")

    def cut(stream):
        for batch in stream:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = [main_text(page, path, shared) for (page, shared), path in zip(_pages(part), part.column("path").to_pylist())]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    joined = rows.drop("hashes").join(repeated, "row", "left").join(winners, "host", "left")
    return joined.mapInArrow(cut, "page_id long, url string, text string, n_chars long")
