"""Main text of web pages by paths that the pages of a host agree on."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusweave.llm.common import written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "head script style noscript template svg annotation annotation-xml iframe object canvas audio video select textarea "
    "button form nav header footer aside menu dialog title".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div main section td".split())
# an open element of the first kind ends where one of the second kind begins
CLOSED_BY = {
    "p": BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody"]),
    "th": frozenset(["td", "th", "tr", "tbody"]),
    "option": frozenset(["option", "optgroup"]),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
# words of class names and ids that mark what may not be the article
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disclaimer disqus footer header login masthead menu modal nav "
    "navbar navigation newsletter notice notices pagination pager popup promo promoted promotion "
    "recommended related replies reply respond response share sharing sidebar sidebars signup skip "
    "social sponsor sponsored subscribe tags toc toolbar widget widgets".split()
)
# words of class names and ids that articles have
CONTENT = frozenset("article body content entry main page post story text".split())
# what the text inside marked elements counts: by a part of a name, by a whole name
WEAK, STRONG = 0.25, 0.05
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?"
    # a quote opens a value only right after its "="
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|$)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
READ = frozenset("class id role hidden".split())
NAME_WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
# winners of hosts are broadcast while they are so many at most, some 16 MB
MOST_WINNERS = 200_000
# beyond, pages of a host that meet its winner in one part
PART_PAGES = 20_000
# elements that end one of ``CLOSED_BY``; running text, which only a name of its own marks
ENDERS = frozenset().union(*CLOSED_BY.values())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())


@dataclass(slots=True)
class Path:
    """The steps to an element: a link to the path around it, and a hash that names all of it."""

    key: int
    length: int
    step: str

    def to(self, step: str) -> Path:
        return Path(_hash(self.key, step), self.length + len(step) + 1, step)


@lru_cache(100_000)
def _hash(key: int, step: str) -> int:
    found = hashlib.blake2b(step.encode("utf-8", "surrogatepass"), digest_size=8, key=key.to_bytes(8))
    return int.from_bytes(found.digest())


@dataclass(slots=True)
class Element:
    tag: str
    path: Path
    skipped: bool
    nearest: Container
    mark: Mark | None = None


@dataclass(slots=True)
class Container:
    path: Path
    up: Container | None
    score: float = 0.0


@dataclass(slots=True)
class Mark:
    """A marked element: what its text counts, the container and the mark around it."""

    weight: float
    outer: Container
    up: Mark | None
    size: int = 0


@dataclass
class Page:
    """Text blocks in page order, each with its line, nearest container and mark.  A line is
    several blocks where marked elements begin or end inside it."""

    blocks: list[str] = field(default_factory=list)
    owners: list[Container] = field(default_factory=list)
    marks: list[Mark | None] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)
    containers: list[Container] = field(default_factory=list)
    all_marks: list[Mark] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        if name.lower() in READ:
            found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def _step(tag: str, attributes: dict[str, str]) -> str:
    """A tag with its classes, generalised: numbers out, in order."""
    names = {re.sub(r"[\d_-]*\d[\w-]*$", "", c.lower()) for c in attributes.get("class", "").split()}
    return ".".join([tag, *sorted(n for n in names if n)])


def _is_skipped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    # the header of an article is its title
    if tag == "header" and in_article:
        return False
    return tag in SKIPPED or "hidden" in attributes or attributes.get("role", "").lower() in ROLES


def _weight(tag: str, attributes: dict[str, str]) -> float:
    """What text counts inside an element, by its class names and id: a boilerplate word as a
    whole name lowers it more than as a part of one (``has-sidebar``) or beside a content word."""
    if tag in ("body", "html", "article", "main"):
        return 1.0
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    words = {w for name in names for w in NAME_WORD.findall(name)}
    if not words & BOILERPLATE or tag in RUNNING and not BOILERPLATE.issuperset(names):
        return 1.0
    return STRONG if BOILERPLATE.intersection(names) and not words & CONTENT else WEAK


def parse(source: str | None) -> Page:
    """Blocks and containers of a page, in one pass over its tags.

    Open paragraphs, items and cells end as browsers end them, an end tag
    without a start is left out, what is never closed ends with the page.  Raw
    elements end at their own end tag.  Comments and skipped elements give no text,
    marked ones do: what it counts is lowered, and the mark stays with the block.
    """
    text, page = source or "", Page()
    root = Container(Path(0, 0, ""), None)
    page.containers.append(root)
    stack = [Element("", root.path, False, root)]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = [0, 0]  # characters in links, in all

    line = 0

    def flush(ends: bool = True) -> None:
        nonlocal line
        block = SPACE.sub(" ", html.unescape("".join(pieces)))
        size = len(block.strip())
        if size or block and not ends:
            owner, mark = stack[-1].nearest, stack[-1].mark
            weight = mark.weight if mark else 1.0
            owner.score += weight * size * (1 - linked[0] / max(linked[1], 1))
            page.blocks.append(block)
            page.owners.append(owner)
            page.marks.append(mark)
            page.lines.append(line)
        line += ends
        pieces.clear()
        linked[:] = [0, 0]

    def add(piece: str) -> None:
        if piece and not stack[-1].skipped:
            pieces.append(piece)
            n = len(piece.strip())
            linked[1] += n
            if any(e.tag == "a" for e in stack[-3:]):
                linked[0] += n

    def close(depth: int) -> None:
        if any(e.tag in BLOCKS for e in stack[depth:]):
            flush()
        elif stack[-1].mark is not stack[depth - 1].mark:
            flush(ends=False)
        opened.subtract(e.tag for e in stack[depth:])
        del stack[depth:]

    at = 0
    while at < len(text):
        token = TOKEN.search(text, at)
        if not token:
            break
        add(text[at : token.start()])
        at = token.end()
        tag = (token.group(2) or "").lower()
        if not tag:
            if text.startswith("<![CDATA[", token.start()):
                add(token.group()[9:-3])
            continue
        if token.group(1):
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in ENDERS and any(opened[t] > 0 for t, enders in CLOSED_BY.items() if tag in enders):
            for i in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(stack[i].tag, ()):
                    close(i)
                    break
                if stack[i].tag in ("table", "ul", "ol", "dl") or stack[i].tag in CONTAINERS:
                    break
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        attributes = _attributes(token.group(3)) if token.group(3) else {}
        top = stack[-1]
        in_article = opened["article"] > 0 or opened["main"] > 0
        skipped = top.skipped or _is_skipped(tag, attributes, in_article)
        path, nearest, mark = top.path, top.nearest, top.mark
        weight = 1.0 if skipped or not attributes else _weight(tag, attributes)
        if weight < 1:
            flush(ends=tag in BLOCKS)
            mark = Mark(min(weight, mark.weight) if mark else weight, nearest, mark)
            page.all_marks.append(mark)
        if tag in BLOCKS:
            path = top.path.to(f"{_step(tag, attributes)}{'' if weight == 1 else '?' if weight == WEAK else '!'}")
        if tag in CONTAINERS and not skipped:
            nearest = Container(path, nearest)
            page.containers.append(nearest)
        if not token.group(3).rstrip().endswith("/") or tag in BLOCKS or tag in RAW:
            stack.append(Element(tag, path, skipped, nearest, mark))
            opened[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(text, at)
            at = end.start() if end else len(text)
    add(text[at:] if at < len(text) else "")
    flush()
    return page


def _totals(page: Page) -> dict[int, tuple[float, Path]]:
    """Score by path: a container's own blocks, and half of what each one inside it has."""
    own = {id(c): c.score for c in page.containers}
    totals: dict[int, tuple[float, Path]] = {}
    for c in reversed(page.containers):  # inner ones come later
        score = own[id(c)]
        if score:
            totals[c.path.key] = totals.get(c.path.key, (0.0, c.path))[0] + score, c.path
            if c.up is not None:
                own[id(c.up)] += score / 2
    return totals


def best_path(page: Page) -> Path | None:
    """The path of the best container: most text of its own, articles before others."""
    totals = _totals(page).values()
    tag = re.compile(r"(article|main)[^/]*$")

    def order(found: tuple[float, Path]) -> tuple[float, int, int]:
        score, path = found
        return -score * (2 if tag.match(path.step) else 1), path.length, path.key

    return min(totals, key=order)[1] if totals else None


def text_under(page: Page, key: int | None) -> str | None:
    """The blocks inside containers of a path, joined by line ends; None if the page has no such.

    Marked elements inside them are left out, unless all the text is in such, or half of it
    or more in one that is marked weakly: that one is the article.  Marks at or around the
    containers do not count."""
    inside = set()
    there = False
    for c in page.containers:  # outer ones come first
        if c.path.key == key or id(c.up) in inside:
            inside.add(id(c))
            there = there or c.path.key == key
    if not there:
        return None
    counts = [m for m in page.all_marks if id(m.outer) in inside]
    for m in counts:
        m.size = 0
    blocks: list[tuple[int, str, Mark | None]] = []
    for line, block, owner, mark in zip(page.lines, page.blocks, page.owners, page.marks):
        if id(owner) in inside:
            mark = mark if mark is not None and id(mark.outer) in inside else None
            if mark:
                mark.size += len(block.strip())
            blocks.append((line, block, mark))
    held = {id(m) for m in counts}
    for m in reversed(counts):  # inner ones come later
        if id(m.up) in held:
            m.up.size += m.size
    half = sum(len(b.strip()) for _, b, _ in blocks) / 2
    good: dict[int, bool] = {}
    for m in counts:  # outer ones come first
        good[id(m)] = m.weight == WEAK and m.size >= half and good.get(id(m.up), True)
    kept = [x for x in blocks if x[2] is None or good[id(x[2])]]
    return _joined(kept) or _joined(blocks)


def _joined(blocks: list[tuple[int, str, list[Mark]]]) -> str:
    lines: dict[int, str] = {}
    for line, block, _ in blocks:
        lines[line] = lines.get(line, "") + block
    return "\n".join(text for x in lines.values() if (text := SPACE.sub(" ", x).strip()))


def _signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [best_path(parse(h.as_py())) for h in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([p and _signed(p.key) for p in paths], pa.int64()),
                pa.array([p and p.length for p in paths], pa.int64()),
            ],
            ["host", "path", "length"],
        )


def _extract(source: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page; ``source`` is the place of its html in the record."""
    for batch in batches:
        texts = []
        for html_, winner in zip(batch.column(0).field(source), batch.column(1).to_pylist()):
            page = parse(html_.as_py())
            text = text_under(page, winner if winner is None else winner % (1 << 64))
            if not text and (own := best_path(page)):
                text = text_under(page, own.key)
            texts.append(text or "")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string())], ["record", "main_text"]
        )


def main_text(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """The main text of each page, found where most pages of its host have theirs.

    First pass: each page votes for the path (tags and classes, numbers left
    out) of its best container.  The votes of a host are counted map-side, so
    a host with a third of all pages is no heavier than others; ties go to the
    shorter path.  Second pass: each page gives the text under its host's
    winning path or, where it has none, under its own best.

    Returns ``record`` (a struct of all columns, whatever their names) and
    ``main_text``: blocks in page order, character references decoded, white
    space single, one line end between blocks.  Empty for null or empty pages;
    pages without a host vote together.  Repeated rows vote and return as often
    as they come.  A page of any length or depth takes time and memory in
    proportion to it.

    Pages are not shuffled while the winners, counted first, are few enough to
    be broadcast (a row of some 80 bytes per host).  Beyond that each host's
    pages are dealt to as many parts as their number asks for.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1))
    votes = pages.select(host.alias("host"), F.col(source)).mapInArrow(
        _vote, "host string, path long, length long"
    )
    counts = votes.where("path is not null").groupBy("host", "path", "length").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct("n", (-F.col("length")).alias("short"), "path")
    winners = counts.groupBy("host").agg(F.max(order).alias("best"), F.sum("n").alias("n"))
    winners = written(winners.select("host", "best.path", "n"))
    rows = pages.select(F.struct("*").alias("record"), host.alias("host"))
    schema = StructType([rows.schema["record"]]).add("main_text", "string")
    size = winners.agg(F.count(F.lit(1)).alias("hosts"), F.max(F.length("host")).alias("longest")).first()
    if size.hosts <= MOST_WINNERS and (size.longest or 0) <= 1024:
        joined = rows.join(F.broadcast(winners.drop("n")), "host", "left")
    else:
        # a hot host's pages are dealt out: every part of a host meets a copy of its winner
        parts = F.ceil(F.col("n") / PART_PAGES).cast("int")
        most = winners.agg(F.max(parts)).first()[0]
        part = F.pmod(F.xxhash64(F.col("record").getField(source)), F.lit(most)).cast("int")
        copies = winners.select("host", "path", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("part"))
        joined = rows.withColumn("part", part).join(copies, ["host", "part"], "left")
    extract = partial(_extract, pages.columns.index(source))
    return joined.select("record", "path").mapInArrow(extract, schema)
