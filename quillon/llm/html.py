"""Main text of web pages by consensus host paths.

Every page is parsed and its containers (main, section, div, ...) are scored by the
text of their blocks, less for blocks further down and for link text; an article
element (else a main element) is one container with all that is in it.  A container's
path is its chain of tags and classes, digits left out, held as a 63-bit number.
Pages vote with their paths' shares of the best score; of a host's paths the one with
most votes wins (of equal ones the lesser number).  Two kinds of paths get no votes
while there are others: those that have the same text on most different pages of the
host, which are boilerplate, and those below a class or id that names comments,
adverts and the like.  Pages whose own best path is the host's are done; the others
are extracted again by the host's path where they have it, and so are pages with
boilerplate of the host inside that path, which is left out.

Text is taken from the container's blocks in page order.  Left out are menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments, known by tag, role, or a word of class or id, and hidden elements.
Character references are decoded, white space inside a block (line breaks too)
becomes one space, blocks are trimmed and joined by one newline.

Votes are summed map-side before they are dealt by host and path, different texts are
counted by sketches; html is shuffled only for pages to be extracted again, after a
bounded pre-filter.

Defined results: null html and pages without text give the empty text.  A null
page_id or url is kept; repeated rows are pages of their own.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import PREFILTER_BUCKETS, columns_of, ship, table
from quillon.llm.urls import host_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noembed xmp".split())
SKIPPED = frozenset("head nav header footer aside form script style noscript template iframe svg math canvas object audio video button select option textarea input label dialog menu noembed xmp title fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br td th".split())
CONTAINERS = frozenset("article main section div td body center".split())
#: Words of a class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer copyright comment comments disqus respond replies widget search pagination pager toolbar skip hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Elements that end an open element of the same kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section main div body aside nav header footer form blockquote".split())

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An open or closed element: its container path, and its outermost article, or else main, element."""

    __slots__ = ("tag", "path", "parent", "skip", "marked", "link", "unit")

    def __init__(self, tag, path, parent, skip, marked, link):
        self.tag, self.path, self.parent, self.skip, self.marked, self.link = tag, path, parent, skip, marked, link
        above = parent.unit if parent else None
        unit = tag == "article" and (above is None or above.tag == "main") or tag == "main" and above is None
        self.unit = self if unit else above


class Block(NamedTuple):
    text: str
    node: Node
    linked: float  # share of link text
    marked: bool  # all of it is below a name that marks what is not the article


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


@lru_cache(4_096)
def _step(parent: int, step: str) -> int:
    """The number of a path that goes on with a step."""
    return _hash(f"{parent}/{step}")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw and not raw.isspace() else {}


#: Of an article or main element only these words count: it may well be laid out "with-sidebar".
ARTICLE_MARKS = frozenset("ad ads advert advertisement sponsored comment comments related recommended promo".split())


def _hidden(attrs: dict[str, str]) -> bool:
    return bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES or ("style" in attrs and bool(_HIDDEN.search(attrs["style"]))))


def _marked(tag: str, attrs: dict[str, str]) -> bool:
    if not attrs:
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    marks = ARTICLE_MARKS if tag in ("article", "main") else MARKS
    return any(w.lower() in marks for w in _WORDS.findall(names))


def parse(text: str) -> list[Block]:
    """Blocks in page order that are not left out by tag, role or style.

    A block that is in part below a marking name holds the rest only.
    """
    root = Node("body", 0, None, False, False, False)
    stack, blocks = [root], []
    parts: list[tuple[str, bool]] = []
    linked = total = paragraphs = 0

    def flush() -> None:
        nonlocal linked, total
        if parts:
            if line := " ".join("".join(raw for raw, marked in parts if not marked).split()):
                blocks.append(Block(line, stack[-1], linked / max(total, 1), False))
            elif line := " ".join("".join(raw for raw, _ in parts).split()):
                blocks.append(Block(line, stack[-1], linked / max(total, 1), True))
            parts.clear()
            linked = total = 0

    def add(raw: str) -> None:
        nonlocal linked, total
        top = stack[-1]
        if raw and not top.skip:
            raw = entities.unescape(raw) if "&" in raw else raw
            parts.append((raw, top.marked))
            total += len(raw)
            linked += len(raw) * top.link

    def pop_to(depth: int) -> None:
        nonlocal paragraphs
        while len(stack) > depth:
            if stack[-1].tag not in INLINE:
                flush()
            paragraphs -= stack.pop().tag == "p"

    at = 0
    while m := _TOKEN.search(text, at):
        add(text[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag == "br" or tag == "p" and not paragraphs:
                parts.append((" ", False)) if tag == "br" else flush()
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    if tag in ("td", "th"):
                        parts.append((" ", False))
                    pop_to(depth)
                    break
                if tag in INLINE and stack[depth].tag in SCOPES:
                    break
            continue
        attrs = _attributes(m[3] or m[6])
        if tag in ("html", "body"):
            continue
        if tag not in INLINE:
            flush()
            # A block ends an open paragraph; a list item, row or cell ends the one before it.
            ends = CLOSES.get(tag, ()) + ("p",)
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ends:
                    pop_to(depth)
                    break
                if stack[depth].tag in SCOPES:
                    break
        elif tag in CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in CLOSES[tag]:
                    pop_to(depth)
                    break
                if stack[depth].tag in SCOPES:
                    break
        if tag in ("br", "td", "th"):
            parts.append((" ", False))
        top = stack[-1]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in VOID:
            continue
        classes = ".".join(sorted(_DIGITS.sub("", attrs["class"]).split())) if "class" in attrs else ""
        step = f"{tag}.{classes}" if classes else tag
        path = _step(top.path, step) if tag not in INLINE or tag in CONTAINERS else top.path
        node = Node(tag, path, top, top.skip or tag in SKIPPED or _hidden(attrs), top.marked or _marked(tag, attrs), top.link or tag == "a")
        paragraphs += tag == "p"
        stack.append(node)
        if tag in INLINE and (node.skip and not top.skip or node.marked and not top.marked):
            parts.append((" ", False))
    # An unclosed tag at the very end has been consumed by the pattern; the rest is text.
    add(text[at:])
    pop_to(1)
    flush()
    return blocks


#: What a block gives to the containers above it: the nearest all, each further one this share of it, as far as LEVELS.
DECAY = 0.5
LEVELS = 10
LEAST = DECAY**LEVELS


def _upward(node: Node | None, end: Node | None = None) -> list[Node]:
    """The containers from a node up, LEVELS at most, before ``end``."""
    out: list[Node] = []
    while node is not None and node is not end and len(out) < LEVELS:
        if node.tag in CONTAINERS:
            out.append(node)
        node = node.parent
    return out


class Path(NamedTuple):
    share: float  # of the page's best score
    text: int  # a hash of the blocks that count for it
    marked: bool
    above: list[int]  # paths of containers above


def paths(blocks: list[Block]) -> dict[int, Path]:
    """Every path of a page that holds text."""
    score: dict[int, float] = {}
    texts: dict[int, int] = {}
    first: dict[int, list[Node]] = {}
    unmarked: set[int] = set()
    for block in blocks:
        weight, size, h = 1.0, len(block.text) * (1 - block.linked), _hash(block.text)
        unit = block.node.unit
        above = _upward(unit or block.node)
        for k, node in enumerate(above):
            score[node.path] = score.get(node.path, 0.0) + size * weight
            texts[node.path] = texts.get(node.path, 0) + h & _MASK
            first.setdefault(node.path, above[k + 1 :])
            if not (block.marked or node.marked):
                unmarked.add(node.path)
            weight *= DECAY
        # What lies inside an article has no vote, but may be the same on all pages of a host.
        for node in _upward(block.node, unit) if unit else ():
            texts[node.path] = texts.get(node.path, 0) + h & _MASK
            score.setdefault(node.path, 0.0)
            first.setdefault(node.path, above)
            unmarked.add(node.path)
    top = max(score.values(), default=0.0) or 1.0
    return {p: Path(s / top, texts[p], p not in unmarked, [n.path for n in first[p]]) for p, s in score.items()}


_MASK = (1 << 63) - 1


def best(found: dict[int, Path], barred: frozenset[int] = frozenset()) -> int | None:
    """A page's own path: the best that is neither marked nor barred, while there are others."""
    live = [p for p in found if found[p].share > 0]
    for ok in (lambda p: not found[p].marked and p not in barred, lambda p: p not in barred, lambda p: True):
        if some := [p for p in live if ok(p)]:
            return min(some, key=lambda p: (-found[p].share, p))
    return None


def votes(text: str | None) -> tuple[int, int | None, dict[int, Path]]:
    """A hash of a page's text, its own best path, and all its paths."""
    blocks = parse(text) if text else []
    found = paths(blocks)
    return sum(_hash(b.text) for b in blocks) & _MASK, best(found), found


def extract(text: str | None, path: int | None = None, fixed: Sequence[int] = ()) -> str:
    """The main text: by containers of ``path`` where the page has any that score, else by its best.

    fixed: paths of the host's boilerplate, left out inside the chosen containers.  Where
    marks and boilerplate would leave out everything, they are not heeded.
    """
    blocks = parse(text) if text else []
    found = paths(blocks)
    own = best(found, frozenset(fixed))
    if path not in found or found[path].share < LEAST:
        path = own
    if path is None:
        return "\n".join(b.text for b in blocks if not b.marked) or "\n".join(b.text for b in blocks)
    barred, kept, known = frozenset(fixed), [[], [], []], {None: (False, False)}

    def place(node: Node) -> tuple[bool, bool]:
        """Whether the node lies in a chosen container, and there in boilerplate."""
        way = []
        while node not in known:
            way.append(node)
            node = node.parent
        for n in reversed(way):
            chosen, out = known[n.parent]
            known[n] = (True, False) if n.path == path and not chosen else (chosen, out or chosen and n.path != path and n.path in barred)
        return known[way[0] if way else node]

    for b in blocks:
        chosen, out = place(b.node)
        if chosen:
            kept[2].append(b.text)
            if not b.marked:
                kept[1].append(b.text)
                if not out:
                    kept[0].append(b.text)
    return "\n".join(next((k for k in kept if k), []))


def _texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` from ``page_id, url, html, path, fixed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                out = [extract(h, p, f or ()) for h, p, f in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return pages.mapInArrow(run, "page_id long, url string, text string")


def _parts(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


_BALLOT = "page_id long, h long, host string, page long, own long, votes array<struct<path:long,share:double,text:long,marked:boolean,above:array<long>>>"


def _ballots(pages: DataFrame) -> DataFrame:
    """_BALLOT rows from ``page_id, h, host, html``."""
    kind = pa.list_(pa.struct([("path", pa.int64()), ("share", pa.float64()), ("text", pa.int64()), ("marked", pa.bool_()), ("above", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                made = [votes(h) for h in part.column(3).to_pylist()]
                said = [[{"path": p, **v._asdict()} for p, v in found.items()] for _, _, found in made]
                columns = [part.column(0), part.column(1), part.column(2), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array(said, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "h", "host", "page", "own", "votes"])

    return pages.mapInArrow(run, _BALLOT)


#: A path is boilerplate if its texts are at most this share of the host's different pages that have it, and those are so many.
FIXED_SHARE = 0.3
FIXED_PAGES = 5


def host_paths(ballots: DataFrame) -> DataFrame:
    """``host, winner, fixed`` from ballots: the winning path, and the boilerplate paths that lie inside it."""
    v = ballots.where("host <> ''").select("host", "page", F.explode("votes").alias("v")).select("host", "page", "v.*")
    v = v.groupBy("host", "path").agg(
        F.sum("share").alias("score"), F.approx_count_distinct("text").alias("texts"), F.approx_count_distinct("page").alias("pages"),
        F.min(F.col("marked").cast("int")).alias("marked"), F.first("above").alias("above"),
    )
    v = v.withColumn("fixed", (F.col("pages") >= FIXED_PAGES) & (F.col("texts") <= FIXED_SHARE * F.col("pages")))
    rank = F.struct((F.col("score") > 0).alias("any"), (~F.col("fixed") & (F.col("marked") == 0)).alias("free"), (~F.col("fixed")).alias("varied"), "score", (-F.col("path")).alias("path"))
    by_host = v.groupBy("host").agg(F.max_by(F.when(F.col("score") > 0, F.col("path")), rank).alias("winner"), F.collect_list(F.when(F.col("fixed"), F.struct("path", "above"))).alias("fixed"))
    inner = F.transform(F.filter("fixed", lambda f: F.array_contains(f["above"], F.col("winner"))), lambda f: f["path"])
    return by_host.where("winner is not null").select("host", "winner", inner.alias("fixed"))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""
    ship(pages.sparkSession)
    p = columns_of(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    h = F.xxhash64("url", "html")
    ballots = table(_ballots(p.select("page_id", h.alias("h"), host_of(F.col("url")).alias("host"), "html")), "html-votes")
    winners = table(host_paths(ballots), "html-winners")
    again = ballots.where("own is not null").select("page_id", "h", "host", "own", F.transform("votes", lambda v: v["path"]).alias("paths")).join(winners, "host")
    again = again.where((F.col("own") != F.col("winner")) | F.arrays_overlap("paths", "fixed"))
    again = table(again.select(F.coalesce("page_id", F.lit(-1)).alias("pid"), F.col("h").alias("ph"), F.col("winner").alias("path"), "fixed").dropDuplicates(["pid", "ph"]), "html-again")

    p = p.withColumn("pid", F.coalesce("page_id", F.lit(-1))).withColumn("slot", F.pmod(F.xxhash64("pid"), F.lit(PREFILTER_BUCKETS)))
    # At most PREFILTER_BUCKETS numbers are broadcast; pages outside them keep their own path.
    slots = F.broadcast(again.select(F.pmod(F.xxhash64("pid"), F.lit(PREFILTER_BUCKETS)).alias("slot")).distinct())
    keep = ("page_id", "url", "html", "path", "fixed")
    plain = p.join(slots, "slot", "left_anti").select("page_id", "url", "html", F.lit(None).cast("long").alias("path"), F.lit(None).cast("array<long>").alias("fixed"))
    maybe = p.join(slots, "slot", "left_semi").withColumn("ph", h).join(again, ["pid", "ph"], "left").select(*keep)
    out = _texts(plain).unionByName(_texts(maybe))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
