"""HTML main-text extraction by consensus host paths.

First pass: every page is parsed into a tree and its containers are scored by how much of the page's running
text they hold; the best few vote with generalised tag-class paths (digits in class names are folded). Spark
sums the votes by host and path, and each host's best path wins. Second pass: every page is parsed again and
its text is taken from the containers at its host's winning path; a page without such a container, or where it
holds almost nothing of the page's running text, falls back on its own best container.

Menus, headers outside the article, footers, side bars, notices, adverts, forms, scripts, styles and reader
comments are never text, whichever container holds them. What an element is follows from its tag, or from a class
name, role or id all of whose words say so: ``ad-slot``, ``adsbygoogle`` and ``site-footer`` do, ``share-price``
and ``notice-period`` do not; sizes such as ``300x250`` say nothing. Within the article the ids of containers count, but only those of adverts and
comments (``comments``, ``respond``, ``disqus_thread``). Headings, paragraphs, table cells and inline elements are dropped by such a name only
if it is that of an advert. Where an element that is dropped by its name holds most of the article or nearly
all of the page, its name is taken to mean something else, unless it is one of reader comments. Within the article
every other block is kept: character references are decoded, white space inside a block becomes one space, empty
blocks go and blocks are joined by one space. Elements may be nested to any depth.

Votes are pre-aggregated in every task, so a host with a third of all pages costs no more than others. The
winning paths are broadcast only when their counted rows and lengths stay under ``broadcast_bytes``; else the
pages are joined with them by host, where Spark can split a hot host's pages. Defined results: null or empty
html has empty text; a page with a null URL votes and is judged under the empty host; ties between paths go
to the deeper, then to the smaller path; repeated pages vote repeatedly and get equal texts; time and memory grow
in proportion to a page's length, however long or deep it is; an empty table gives an empty result; columns besides the
three named ones are not read, whatever they are called.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise
from .url_filters import address

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noframes noembed".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article body center details div main section table tbody td tr figure blockquote html".split())
DROPPED = set("annotation annotation-xml aside audio button canvas dialog footer form head iframe input menu nav noscript object search select script style svg template textarea title video".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tr td th thead tbody", "tfoot": "tr td th thead tbody"}
#: Names of these make an element an advert even where it is a paragraph, a cell or inline.
ADVERT = {"ad", "ads", "advert", "advertisement", "sponsored"}
COMMENT = {"comment", "comments", "disqus", "replies", "reply", "respond"}
# Words of class names, ids and roles that mark what is not the article, words that add nothing to them, and what is.
NOT_ARTICLE = ADVERT | COMMENT | set(
    "adsense advertorial alert banner breadcrumb breadcrumbs complementary contentinfo cookie cookies disclaimer feedback footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup popular promo promoted promotion recommended related search share sharing sidebar skip social sponsor subscribe subscription tags toc toolbar widget widgets".split()
)
NEUTRAL = set(
    "area articles bar block body bottom box buttons center col column consent container content desktop discussion fixed floating global google group holder icons inline inner item items left links list main message mobile module news outer page panel placeholder post posts primary reader right row secondary section side signup site slot space sticky stories text thread title top unit user wrap wrapper".split()
)
ARTICLE = set("article articlebody articlecontent articletext content contentbody entry entrycontent hentry main maincontent maintext pagecontent post postbody postcontent story storybody".split())

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Sizes in names, as of a place for an advert.
_SIZE = re.compile(r"\d+x\d+")
#: Words that are an advert's mark and another word written together.
_JOINED = re.compile(r"ads?(?:by[a-z]+|banner|block|box|container|frame|holder|label|sense|slot|space|unit|wrap|wrapper|zone)s?")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
#: Elements that are dropped by any name that says so; others only by an advert's.
NAMED = CONTAINERS - {"td", "tr", "tbody", "html", "body"} | set("ul ol dl fieldset address hgroup details".split())
HEADINGS = set("p h1 h2 h3 h4 h5 h6".split())
LISTS = set("ul ol dl table select".split())
#: A new block closes an open paragraph or heading unless one of these is in between.
_STOPS = HEADINGS | CONTAINERS | {"ul", "ol", "dl"}
#: Shares of the article, and of the page, above which an element's name does not have it dropped.
MOST_OF_ARTICLE, MOST_OF_PAGE = 0.5, 0.8


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    name: str  # tag and generalised classes
    parent: Node | None
    key: int  # of the path
    place: int = 0  # in the stack of open elements
    dropped: bool = False
    named: str = ""  # what its names make of it: nothing, "advert" (or another part that is not the article) or "comment"
    semantic: bool = False
    depth: int = 0
    within: bool = False  # in an article
    stop: Node | None = None  # the innermost open element, itself included, of _STOPS
    closable: Node | None = None  # the same for elements that others of a list or table close, and their lists
    own: int = 0  # characters of running text
    own_links: int = 0  # of them, in links
    text: int = 0  # the same with all elements below
    links: int = 0
    chosen: bool = False

    @property
    def path(self) -> str:
        parts, node = [], self
        while node is not None:
            parts.append(node.name)
            node = node.parent
        return ">".join(reversed(parts))


@dataclass(slots=True)
class Block:
    """Text between two block boundaries, and the innermost element that holds it."""

    node: Node
    parts: list[str] = field(default_factory=list)
    links: int = 0


def _generalised(tag: str, classes: str) -> str:
    if not classes:
        return tag
    return ".".join([tag, *sorted({_DIGITS.sub("#", c).replace(">", "#") for c in classes.split()})])


def _key(above: int, name: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{above}>{name}")


def path_key(path: str) -> int:
    key = 0
    for name in path.split(">"):
        key = _key(key, name)
    return key


def _words(name: str) -> set[str]:
    return {"ad" if _JOINED.fullmatch(w) else w for w in _WORDS.findall(_SIZE.sub("", name))}


def _named(tag: str, attributes: dict[str, str], within: bool) -> str:
    """What the element's names say it is: "", "part" or "comment". All words of a name must agree. In an article an id counts
    only for containers, and only if it is that of an advert or of reader comments."""
    names = f"{attributes.get('class', '')} {attributes.get('role', '')}".lower().split()
    ids = attributes.get("id", "").lower().split() if not within or tag in NAMED else []
    found = ""
    for i, name in enumerate(names + ids):
        words = _words(name)
        marks = words & NOT_ARTICLE
        if within and i >= len(names) and not marks & (ADVERT | COMMENT):
            continue
        if not marks or words - marks - NEUTRAL or (tag not in NAMED and not marks & ADVERT):
            continue
        if tag not in NAMED and len(words) > 1 and not words <= ADVERT:
            continue
        if within and marks == {"header"}:
            continue
        if marks & COMMENT:
            return "comment"
        found = "part"
    return found


CLOSABLE = set("li dt dd tr td th option tbody thead tfoot".split()) | LISTS


def parse(html: str | None) -> tuple[list[Node], list[Block]]:
    """All block elements in page order, and all blocks of text that no tag has dropped."""
    root = Node("html", "html", None, _key(0, "html"))
    root.stop = root
    nodes, blocks, stack = [root], [], [root]
    opened: dict[str, list[int]] = {}  # places of the open elements of each tag
    inline: list[str] = []  # open links above the innermost block
    now = Block(root)
    text, at, end = html or "", 0, len(html or "")
    last = text.rfind(">")
    ends: dict[str, tuple[int, int]] = {}
    paragraph = -1

    def cut() -> None:
        nonlocal now
        if now.parts:
            blocks.append(now)
        now = Block(stack[-1])

    def close(place: int) -> None:
        for node in stack[place:]:
            opened[node.tag].pop()
        del stack[place:]

    while at < end:
        if at > last and text[at] == "<":  # no tag ends from here on
            if not stack[-1].dropped:
                now.parts.append(html_module.unescape(text[at:]))
            break
        m = _PIECE.match(text, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if not stack[-1].dropped and not (piece[0] == "<" and len(piece) > 1):
                plain = html_module.unescape(piece) if "&" in piece else piece
                now.parts.append(plain)
                if inline:
                    now.links += len(plain)
            continue
        tag = tag.lower()
        if m[1]:  # an end tag
            if tag == "a" and inline:
                inline.pop()
            if tag == "p":
                cut()  # parts blocks even where it closes nothing
            if (tag in BLOCKS or tag in DROPPED) and opened.get(tag):
                close(opened[tag][-1])
                inline.clear()
                cut()
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
            at = found.end() if found else end
            continue
        if tag == "br":
            now.parts.append(" ")
            continue
        if tag == "a":
            inline.append(tag)
            continue
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true"
        if tag not in BLOCKS and tag not in DROPPED:
            if tag not in VOID and (hidden or attributes and _named(tag, attributes, True)) and not m[3].rstrip().endswith("/"):
                # An inline advert or the like. Where its end, or a paragraph, comes next is looked up once for all of a kind.
                if ends.get(tag, (0, 0))[0] < at:
                    found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
                    ends[tag] = found.span() if found else (end + 1, end + 1)
                if paragraph < at:
                    paragraph = text.find("<p", at) % (end + 2)  # beyond the end if there is none
                start, after = ends[tag]
                if start <= end and paragraph > start:
                    at = after
            continue
        # A new block: what cannot hold it is closed.
        if tag in BLOCKS:
            stop = stack[-1].stop
            if stop is not None and stop.tag in HEADINGS and tag != "option":
                close(stop.place)
                inline.clear()
            closes = CLOSES.get(tag, "").split()
            inner = stack[-1].closable if closes else None
            while inner is not None:
                if inner.tag in closes:
                    close(inner.place)
                    inner = stack[-1].closable
                elif inner.tag in LISTS:
                    break
                else:
                    inner = inner.parent.closable
        if tag in VOID:
            cut()
            continue
        above = stack[-1]
        within = above.within
        semantic = tag in ("article", "main") or bool(attributes) and _is_article(attributes)
        named = _named(tag, attributes, within) if attributes and tag not in ("html", "body", "main") else ""
        if semantic and named == "part" and not {"sidebar", *ADVERT} & set(_WORDS.findall(attributes.get("class", "").lower())) and tag != "article":
            named = ""
        dropped = above.dropped or hidden or tag in DROPPED or (tag == "header" and not within)
        if tag == "html" or tag == "body" and opened.get(tag):
            cut()
            continue
        name = _generalised(tag, attributes.get("class", ""))
        node = Node(tag, name, above, _key(above.key, name), len(stack), dropped, named, semantic, above.depth + 1, within or semantic)
        node.stop = node if tag in _STOPS else above.stop
        node.closable = node if tag in CLOSABLE else above.closable
        nodes.append(node)
        opened.setdefault(tag, []).append(len(stack))
        stack.append(node)
        cut()
    cut()
    return nodes, blocks


def _is_article(attributes: dict[str, str]) -> bool:
    plain = lambda name: name.replace("-", "").replace("_", "")
    names = {plain(x) for x in attributes.get("class", "").lower().split()} | {plain(attributes.get("id", "").lower()), attributes.get("role", "").lower()}
    return bool(names & ARTICLE)


def _sum(nodes: list[Node]) -> int:
    """How much running text every element holds that is not dropped; returns the page's."""
    for n in nodes:
        n.text, n.links = (0, 0) if n.dropped else (n.own, n.own_links)
    for n in reversed(nodes):  # an element comes after the one it is in
        if n.parent is not None:
            n.parent.text += n.text
            n.parent.links += n.links
    return nodes[0].text


def weigh(nodes: list[Node], blocks: list[Block]) -> int:
    """Decides which elements their names have dropped and fills in how much running text every element holds; returns the
    page's. A page of which nothing would be left is read by its tags alone."""
    for b in blocks:
        size = len(_SPACE.sub(" ", "".join(b.parts)).strip())
        b.node.own += size
        b.node.own_links += min(b.links, size)
    whole = _sum(nodes)
    by_tag = [n.dropped for n in nodes]
    article: dict[int, int] = {}  # key of an element's place: text of the article around it
    for i, n in enumerate(nodes[1:], 1):
        above = n.parent
        around = article[id(n)] = above.text if above.semantic else article.get(id(above), 0)
        if above.dropped:
            n.dropped = True
        elif n.named:
            most = n.text > (MOST_OF_ARTICLE * around if above.within else MOST_OF_PAGE * whole)
            n.dropped = n.dropped or n.named == "comment" or not most or 2 * n.links > n.text
    total = _sum(nodes)
    if not total and whole:
        for n, dropped in zip(nodes, by_tag):
            n.dropped = dropped
        total = _sum(nodes)
    return total


def score(node: Node, total: int) -> float:
    """Share of the page's running text, less for links and a little more for depth. What says that it is the article need
    only hold a good half of it; of other containers one that holds nearly all is wanted."""
    if node.dropped or node.tag not in CONTAINERS or not total:
        return 0.0
    share = node.text / total
    weight = 2.4 * share if node.tag == "article" else 2.0 * share if node.tag == "main" else 1.8 * share if node.semantic else share * share
    return weight * (1 - 0.7 * node.links / max(1, node.text)) * (1 + 0.01 * min(node.depth, 12))


def best_containers(html: str | None, most: int = 3) -> list[tuple[str, float]]:
    """(path, score) of a page's best containers; equal paths count together."""
    nodes, blocks = parse(html)
    total = weigh(nodes, blocks)
    by: dict[int, list] = {}
    for n in nodes:
        if (s := score(n, total)) > 0:
            by.setdefault(n.key, [n, 0.0])[1] += s
    best = sorted(by.values(), key=lambda x: (-x[1], -x[0].depth, x[0].key))[:most]
    return [(n.path, s) for n, s in best]


def main_text(html: str | None, path: str | None, least_share: float = 0.2) -> str:
    """The text of the containers at path, or of the page's best container where they hold too little."""
    nodes, blocks = parse(html)
    total = weigh(nodes, blocks)
    wanted = None if path is None else path_key(path)
    chosen = [n for n in nodes if n.key == wanted and not n.dropped]
    for n in chosen:
        n.chosen = True
    if not chosen or sum(n.text for n in chosen) < least_share * total:
        for n in chosen:
            n.chosen = False
        by: dict[int, list] = {}
        for n in nodes:
            if (value := score(n, total)) > 0:
                group = by.setdefault(n.key, [0.0, n.depth, -n.key, []])
                group[0] += value
                group[3].append(n)
        for n in max(by.values(), key=lambda g: g[:3])[3] if by else nodes[:1]:  # all of the best path, as votes count
            n.chosen = True
    for n in nodes[1:]:
        n.chosen = n.chosen or n.parent.chosen
    out = []
    for b in blocks:
        if b.node.chosen and not b.node.dropped and (clean := _SPACE.sub(" ", "".join(b.parts)).strip()):
            out.append(clean)
    return " ".join(out)


def host_votes(pages: DataFrame, *, url_col: str, html_col: str) -> DataFrame:
    """host, path: the winning path of every host. Votes are summed in each task before they are shuffled."""
    source = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where("html is not null")

    def vote(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            sums: dict[tuple[str, str], float] = {}
            for url, html in zip(b["url"], b["html"]):
                host = address(url)[0]
                for path, s in best_containers(html):
                    sums[host, path] = sums.get((host, path), 0.0) + round(s, 6)
            yield {"host": [k[0] for k in sums], "path": [k[1] for k in sums], "votes": list(sums.values())}

    votes = map_batches(source, vote, "host string, path string, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 3).alias("votes"))
    order = F.struct(F.col("votes"), F.length(F.regexp_replace("path", "[^>]", "")).alias("depth"))
    best = votes.groupBy("host").agg(F.max(order).alias("most"))
    return votes.join(best, "host").where(order == F.col("most")).groupBy("host").agg(F.min("path").alias("path"))


def extract(pages: DataFrame, *, id_col: str, url_col: str, html_col: str, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Every row of pages: id_col, url, path (the host's winning path), text."""
    winners = materialise(host_votes(pages, url_col=url_col, html_col=html_col), "host-paths")
    size = winners.agg(F.sum(F.length("host") + F.length("path") + 64)).first()[0] or 0
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = source.schema[0].dataType.simpleString()
    by_host = None
    if size <= broadcast_bytes:
        by_host = source.sparkSession.sparkContext.broadcast(dict(winners.collect()))  # at most broadcast_bytes
    else:
        host = F.coalesce(F.translate(F.regexp_extract("url", "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
        source = source.withColumn("host", host).join(winners, "host", "left").select("id", "url", "html", "path")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            paths = b["path"] if by_host is None else [by_host.value.get(address(u)[0]) for u in b["url"]]
            yield {"id": b["id"], "url": b["url"], "path": paths, "text": [main_text(h, p) for h, p in zip(b["html"], paths)]}

    return map_batches(source, run, f"id {kind}, url string, path string, text string").withColumnRenamed("id", id_col)
