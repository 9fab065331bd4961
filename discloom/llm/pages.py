"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text that they hold outside links and
boilerplate.  A page votes for the generalised path (host, tags and classes,
numbers masked) of its best container; Spark counts the votes of each path.
Pages are then extracted again at whichever of their containers' paths has most
votes of the host, so that an odd page follows its site; only a page that has
no path with votes of two pages uses its own best container.

Paths are 64-bit codes chained from element to element, so a page takes time
and memory linear in its length however deep it nests.  What names an element
has is evidence, weighed against the text in it.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from discloom.llm.support import cut

#: Votes that make a consensus: a path that one page alone votes for is none.
LEAST_VOTES = 2
#: Paths with votes that are sent to every task; with more of them, pages meet them by host.
BROADCAST_PATHS = 1 << 20
#: An element beside the text is taken for it, if it holds more than this many times all other text.
BESIDE_TIMES = 8
#: Pages of one host in one task's turn where they meet by host, and hosts that may need several turns.
TURN_PAGES, LARGE_HOSTS = 10_000, 100_000

# Element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noframes".split())
DROPPED = frozenset("head nav footer select menu".split()) | RAW
#: Boilerplate unless nothing else on the page comes near what they hold.
BESIDE = frozenset("aside dialog".split())
#: Boilerplate unless they hold what pages are about.
DOUBTED = frozenset("header form".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CONTAINERS = frozenset("body main article section div td center form".split())
#: An open element of the second kind ends where one of the first begins.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where the search for an element to end stops.
SCOPES = frozenset("ul ol dl table select body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset({"article", "main"})
#: Words that name boilerplate wherever a name begins or ends with them.
SURE_WORDS = frozenset(
    "ad ads adsbygoogle adslot adunit advert adverts advertisement advertising adbox breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies cookiebar cookiebanner "
    "footer footnav gdpr masthead menubar navbar navigation newsletter pagination pager popup sidebar sponsored toolbar topbar".split()
)
#: Words that name boilerplate where a name ends with them.
LAST_WORDS = SURE_WORDS | frozenset(
    "banner byline consent disclaimer feedback header menu modal nav notice notices notification promo promoted reactions recommended related replies respond share sharing side signup skip social sponsor subscribe "
    "teaser widget".split()
)
#: Words that say nothing of what a name means.
LAYOUT_WORDS = frozenset(
    "area articles bar block body box buttons button bottom column col container content global group header inner item items left link links list main outer page panel posts primary right row section secondary site "
    "slot stories text thread top widget widgets wrap wrapper".split()
)
#: Classes that speak for an element, whatever its other classes say.
MAIN_WORDS = frozenset("article content entry main post story".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # Quotes count only where a value begins.
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=>/]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAMING = re.compile(r"class|id|role|hidden|style", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Names that say what a layout has, not what an element is.
MODIFIER = re.compile(r"(?:^|[_-])(?:has|no|with|without|sticky)[_-]", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARTS = re.compile(r"[^\W\d_]+")
ENDS_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}


class Node:
    """An element that may hold the main text: where its text begins and ends, and how much it is."""

    __slots__ = ("path", "depth", "first", "last", "size", "linked", "weight")

    def __init__(self, path: int, depth: int, first: int, weight: float) -> None:
        self.path, self.depth, self.first, self.last, self.size, self.linked, self.weight = path, depth, first, -1, 0, 0, weight


@lru_cache(maxsize=1 << 16)
def step_code(path: int, name: str) -> int:
    """Code of the path one step below ``path``."""
    return int.from_bytes(blake2b(b"%d>%b" % (path, name.encode("utf-8", "replace")), digest_size=8).digest(), "big", signed=True)


def boilerplate_name(value: str) -> int:
    """How surely one class or id names boilerplate: 2, 1 or 0."""
    if MODIFIER.search(value):
        return 0
    parts = [x.lower() for x in PARTS.findall(HUMP.sub("-", value))]
    meant = [x for x in parts if x not in LAYOUT_WORDS] or [x for x in parts if x in LAST_WORDS]
    if not meant:
        return 0
    return 2 if meant[0] in SURE_WORDS or meant[-1] in SURE_WORDS else int(meant[-1] in LAST_WORDS)


@lru_cache(maxsize=4096)
def _named(tag: str, attributes: str) -> tuple[str, bool, bool, int]:
    """Generalised class of a start tag, whether it is out of sight or beside the text, and how far its names call it boilerplate (0 to 2).

    Names of headings say nothing, nor do ids of paragraphs and sections, which
    are often slugs of their text.
    """
    names, hide, beside, like, speaks = "", tag in DROPPED, tag in BESIDE, 0, False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        hide |= name == "hidden" or name == "aria-hidden" and value.lower() == "true"
        beside |= name == "role" and value.lower() in ROLES
        hide |= name == "style" and UNSEEN.search(value) is not None
        if name in ("class", "id") and tag not in HEADINGS and tag not in ("body", "html", "main", "article"):
            slug = name == "id" and (tag == "p" or tag == "section" and re.search("[-_]", value) is not None)
            like = max([like, *map(boilerplate_name, () if slug else value.split())])
        if name == "class":
            names = ".".join(sorted(re.sub(r"\d+", "#", value).lower().split()))
            speaks = not MAIN_WORDS.isdisjoint(value.lower().split())
    like = min(like, 1) if speaks else like
    return names, hide, beside and not hide, 0 if hide or beside else max(like, 2 * (tag in DOUBTED))


class Open:
    """An open element; ``size`` and ``linked`` count what it holds so far."""

    __slots__ = ("tag", "path", "node", "dropped", "link", "size", "linked", "named", "sure", "hidden", "unlinked", "seen", "holds", "heading")

    def __init__(self, tag: str, path: int, node: Node | None, dropped: bool, link: bool, named: Named | None = None, sure: bool = False, hidden: bool = False) -> None:
        self.tag, self.path, self.node, self.dropped, self.link, self.named, self.sure, self.hidden = tag, path, node, dropped, link, named, sure, hidden
        # Unlinked text that isn't surely boilerplate, or isn't out of sight, and whether an article or a heading is in it.
        self.size = self.linked = self.unlinked = self.seen = 0
        self.holds, self.heading = tag in ARTICLES, tag in HEADINGS


class Named:
    """An element whose names or kind call it boilerplate, or that is beside the text; its number is its place on the page."""

    __slots__ = ("number", "like", "within", "beside", "size", "holds", "titled")

    def __init__(self, number: int, like: int, within: bool, beside: bool) -> None:
        self.number, self.like, self.within, self.beside, self.size, self.holds, self.titled = number, like, within, beside, 0, False, False


def outline(page: str, host: str = "") -> tuple[list[str], list[Node]]:
    """Pieces of text outside boilerplate, in page order, and the containers over them.

    A piece " " stands for the edge of a block.  An element that only its names
    or kind call boilerplate is not, if it holds an article; if it is the
    header of one and holds a heading; or, on a page that has no article
    elsewhere, if it holds most of the unlinked text where its names leave
    doubt, and nearly all of it where they don't.  An aside, a dialog or what has
    such a role is part of the text only on a page without an article, and if
    hardly any text is left without it.
    """
    pieces, nodes, marked, whole = _outline(page, host, frozenset())
    named = [x for x in marked if not x.beside]
    article = whole.holds and not any(x.holds for x in named)
    kept = set()
    for x in named:
        most = 2 * x.size > whole.unlinked if x.like == 1 else 8 * x.size > 7 * whole.unlinked
        if x.holds or x.titled and x.within or most and not article:
            kept.add(x.number)
    if kept:
        pieces, nodes, _, whole = _outline(page, host, frozenset(kept))
    beside = max((x for x in marked if x.beside), key=lambda x: x.size, default=None)
    if beside is not None and not whole.holds and beside.size > BESIDE_TIMES * (whole.size - whole.linked):
        pieces, nodes = _outline(page, host, frozenset({*kept, beside.number}))[:2]
    return pieces, nodes


def _outline(page: str, host: str, kept: frozenset) -> tuple[list[str], list[Node], list[Named], Open]:
    """Pieces and containers; elements named like boilerplate; the page."""
    named: list[Named] = []
    pieces: list[str] = []
    nodes: list[Node] = []
    stack = [Open("", step_code(0, host), None, False, False)]
    # Depths of open elements: of each tag, of those that are not inline, and of containers.
    places: defaultdict[str, list[int]] = defaultdict(list)
    blocks, containers = [0], [0]

    def close(depth: int) -> None:
        while len(stack) > depth:
            e, up = stack.pop(), stack[-1]
            places[e.tag].pop()
            up.size += e.size
            up.linked += e.linked
            up.unlinked += e.unlinked
            up.seen += e.seen
            up.holds |= e.holds and not e.sure
            up.heading |= e.heading
            if e.named is not None:
                e.named.size, e.named.holds, e.named.titled = e.seen if e.named.beside else e.unlinked, e.holds, e.heading and e.tag == "header"
            if e.node is not None:
                e.node.last, e.node.size, e.node.linked = len(pieces), e.size, e.linked
            if e.tag in CONTAINERS:
                containers.pop()
            if e.tag not in INLINE:
                blocks.pop()
                pieces.append(" ")

    def deepest(tags: frozenset | set) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        start = end if m is None else m.start()
        if start > at:
            top = stack[-1]
            if not top.hidden and not top.link:
                size = start - at - page.count(" ", at, start)
                top.seen += size
                top.unlinked += 0 if top.sure else size
            if not top.dropped:
                text = page[at:start]
                pieces.append(references.unescape(text) if "&" in text else text)
                size = len(text) - text.count(" ")
                top.size += size
                if top.link:
                    top.linked += size
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA[") and not stack[-1].dropped:
                pieces.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if m[1]:
            # A stray end tag of these ends nothing outside its container.
            bound = containers[-1] if inline or tag in ("p", "li") else 0
            if places[tag] and places[tag][-1] > bound:
                close(places[tag][-1])
            if not inline:
                pieces.append(" ")
            continue
        if not inline:
            pieces.append(" ")
        if tag in RAW:
            found = ENDS_RAW[tag].search(page, at)
            at = end if found is None else page.find(">", found.end()) + 1 or end
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in ENDS and (depth := deepest(ENDS[tag])) > deepest(SCOPES):
            close(depth)
        up, attributes = stack[-1], m[3]
        names, hide, beside, like = _named(tag, attributes if NAMING.search(attributes) else "")
        # A button after words of its paragraph is one of them.
        hide |= tag == "button" and not (stack[blocks[-1]].tag == "p" and stack[blocks[-1]].size)
        within = bool(places["article"] or places["main"])
        number = m.start()
        mark = Named(number, like, within, beside) if (like or beside) and not up.sure and not hide else None
        if mark is not None:
            named.append(mark)
        taken = mark is not None and number in kept
        sure = up.sure or hide or beside and not taken
        path, node, dropped = up.path, None, up.dropped or hide or beside and not taken or mark is not None and not taken
        if not inline:
            path = step_code(path, f"{tag}.{names}" if names else tag)
            if (tag in CONTAINERS or beside) and not dropped:
                node = Node(path, len(stack), len(pieces), 1.5 if tag in ARTICLES else 0.5 if mark is not None else 1.0)
                nodes.append(node)
            blocks.append(len(stack))
        if tag in CONTAINERS:
            containers.append(len(stack))
        places[tag].append(len(stack))
        stack.append(Open(tag, path, node, dropped, up.link or tag == "a", mark, sure, up.hidden or hide))
    close(1)
    return pieces, nodes, named, stack[0]


def best(nodes: list[Node]) -> Node | None:
    """The container with the best score; among those close to it, the innermost."""
    scored = [(n, (n.size - 2 * n.linked) * n.weight) for n in nodes]
    top = max((s for _, s in scored), default=0)
    if top <= 0:
        return max(nodes, key=lambda n: n.size, default=None)
    return max((n for n, s in scored if s >= 0.85 * top), key=lambda n: n.depth)


def joined(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


class Votes:
    """Votes of paths, looked up by code."""

    def __init__(self, path: np.ndarray, votes: np.ndarray) -> None:
        order = np.argsort(path, kind="stable")
        self.path, self.votes = path[order], votes[order]

    def of(self, paths: list[int]) -> list[int]:
        """The votes of each path; 0 for one without."""
        if not len(self.path) or not paths:
            return [0] * len(paths)
        wanted = np.array(paths, np.int64)
        at = np.minimum(np.searchsorted(self.path, wanted), len(self.path) - 1)
        return np.where(self.path[at] == wanted, self.votes[at], 0).tolist()


def extract(page: str, votes: Votes, host: str = "") -> str:
    """The text at the page's path with most votes, ties to the lesser code; without one, at its best container."""
    pieces, nodes = outline(page, host)
    paths = sorted({n.path for n in nodes})
    for _, path in sorted((-v, p) for v, p in zip(votes.of(paths), paths, strict=True) if v):
        parts, after = [], 0
        for n in nodes:  # in page order; one inside another adds nothing
            if n.path == path and n.first >= after:
                parts.append(joined(pieces[n.first : n.last]))
                after = n.last
        if text := " ".join(x for x in parts if x):
            return text
    node = best(nodes)
    return joined(pieces if node is None else pieces[node.first : node.last])


def _ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host and path of each page's vote."""
    for b in batches:
        hosts, paths = [], []
        for host, page in zip(b.column(0), b.column(1), strict=True):
            node = best(outline(page.as_py(), host.as_py())[1]) if page.is_valid else None
            if node is not None and node.size:
                hosts.append(host.as_py())
                paths.append(node.path)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64())], ["host", "path"])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path long, votes long``: all paths that two pages of a host or more vote for.

    ``path`` is the code of host, tags and classes; pages without a container
    that holds text don't vote.
    """
    own = pages.select(host_of(url).alias("host"), F.col(html).alias("html"))
    votes = own.mapInArrow(_ballots, "host string, path long").groupBy("host", "path").agg(F.count("*").alias("votes"))
    return votes.filter(F.col("votes") >= LEAST_VOTES)


def host_of(url: str):
    """Lower-case host of a URL; the empty text for a null one or one without a host."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _texts(ids: pa.Array, urls: pa.Array, texts: list[str]) -> pa.RecordBatch:
    found = pa.array(texts, pa.string())
    return pa.RecordBatch.from_arrays([ids, urls, found, pc.utf8_length(found).cast(pa.int64())], ["id", "url", "text", "n_chars"])


def _at_sent_paths(shared):
    """Extraction where all votes are with the task; rows are ``id, url, host, html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(*shared.value)
        for b in batches:
            yield _texts(b.column(0), b.column(1), [extract(p.as_py(), votes, h.as_py()) if p.is_valid else "" for h, p in zip(b.column(2), b.column(3), strict=True)])

    return run


def _at_met_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extraction of rows sorted by host and turn, of which those with votes come before those with pages."""
    at, paths, counts, votes = None, [], [], None
    for b in batches:
        texts, own = [], []
        for i, (host, turn, path, count, page) in enumerate(zip(*(b.column(c) for c in ("host", "turn", "path", "votes", "html")), strict=True)):
            if at != (host.as_py(), turn.as_py()):
                at, paths, counts, votes = (host.as_py(), turn.as_py()), [], [], None
            if path.is_valid:
                paths.append(path.as_py())
                counts.append(count.as_py())
                continue
            if votes is None:
                votes = Votes(np.array(paths, np.int64), np.array(counts, np.int64))
            own.append(i)
            texts.append(extract(page.as_py(), votes, host.as_py()) if page.is_valid else "")
        rows = b.take(pa.array(own, pa.int64()))
        yield _texts(rows.column("id"), rows.column("url"), texts)


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", most: int = BROADCAST_PATHS) -> DataFrame:
    """``id_col, url, text, n_chars`` for every row of ``pages``.

    A null or empty page has an empty text, as has a page without a container
    that holds any.  Pages without a host share one vote.  Repeated rows each
    vote and are each returned.  Very long and very deep pages take linear time
    and memory.  Other columns are ignored, whatever their names.

    The votes are written once.  Up to ``most`` paths are sent to all tasks, and
    pages are not shuffled.  Above, pages meet the votes of their host, which
    are repeated for each turn of a large host.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), host_of(url).alias("host"), F.col(html).alias("html"))
    schema = StructType([own.schema["id"], own.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])
    votes = cut(host_paths(pages, url, html))
    if votes.count() <= most:
        found = votes.select("path", "votes").toPandas()  # at most ``most`` rows of two numbers
        shared = pages.sparkSession.sparkContext.broadcast((found["path"].to_numpy(np.int64), found["votes"].to_numpy(np.int64)))
        texts = own.mapInArrow(_at_sent_paths(shared), schema)
    else:
        texts = _by_host(own, votes).mapInArrow(_at_met_paths, schema)
    return texts.withColumnsRenamed({"id": id_col, "url": url})


def _by_host(own: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes and pages of each host and turn in one partition, sorted."""
    turn_pages = max(TURN_PAGES, own.count() // LARGE_HOSTS)
    sizes = own.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > turn_pages)
    # At most LARGE_HOSTS hosts have more pages than that.
    large = cut(sizes.select(F.col("host").alias("of"), F.ceil(F.col("n") / turn_pages).cast("long").alias("turns")))
    turns = F.coalesce("turns", F.lit(1).cast("long"))
    placed = lambda df: df.join(F.broadcast(large), F.col("host") == F.col("of"), "left")
    rows = placed(own).select("id", "url", "host", F.pmod(F.xxhash64("html", "url", "id"), turns).alias("turn"), F.lit(None).cast("long").alias("path"), F.lit(None).cast("long").alias("votes"), "html")
    each = placed(votes).select("host", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1)).alias("turn"), "path", "votes")
    rows = rows.unionByName(each, allowMissingColumns=True)
    return rows.repartition("host", "turn").sortWithinPartitions("host", "turn", F.col("path").asc_nulls_last())
