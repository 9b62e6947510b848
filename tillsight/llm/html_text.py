"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once into flat blocks, the runs of text between block-level tags, and a tree of the
containers they lie in.  A block's features are its word count and link density, those of its neighbours, the share of the
page's words and the link density of its container, whether it lies in the article, a mark of its place and whether it
is a heading.  A decision tree (CART, Gini) trained on the small labelled table of pages below keeps or drops it.  The tree is trained on the driver from fixed rows
and sent to the executors; pages never leave them.

A container is marked if its tag, or a part of a word of its class, id or role, names what is no article
("reader-comments", "commentlist", "ad-slot"); the weak mark is for names that parts of an article have too
("teaser", "share").  The text can outvote a mark: a container that holds over half of the page's words and the
place where its article begins wraps the page, whatever it is called; so does a form around that place.

Character references are decoded, white space inside a block becomes one blank, kept
blocks are joined by one line feed.  A ``br`` is white space; scripts, styles, comments,
``title`` and other text that is not shown is no block.

Defined cases: null or empty html, and pages without a kept block, give the empty text.
Unclosed tags end with the page or with what HTML closes them by; an unclosed comment or
script takes the rest of the page, and a tag cut off by the page's end is dropped.  A self-closed ``svg`` or ``math`` is
empty, and an element such as ``svg-icon`` is none of those.  Pages are read whole, in time that grows with their length
whatever is left open in them.  Rows are independent.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tillsight.llm.batches import bounded_batches

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr img picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text of these is never shown as a block.
HIDDEN = "script|style|title|noscript|template|svg|math|iframe|object|textarea|select|button"
#: Blocks that are no containers of their own.
LEAVES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 tr tbody thead pre html head".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
ARTICLE_TAGS = frozenset(["article", "main"])
#: Their class words tell of the page's layout.
PAGE_TAGS = frozenset(["html", "body"])
#: Parts of class, id or role that name a container which is no article, and such as parts of an article have too.
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "cookiebar dialog disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification outbrain "
    "overlay pager paginator pagination popup promo promoted promotion replies reply respond responses sidebar signup skyscraper sponsor "
    "sponsored subscribe subscription taboola toolbar topbar".split())
WEAK_WORDS = frozenset("form header related recommended search share sharing social tags teaser widget".split())
#: Words that begin so are marks too, whatever follows without a break ("commentlist").
BOILER_STARTS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "footer", "navbar", "newsletter", "pagination", "sidebar", "sponsor", "subscri")
#: A name that begins so speaks of what is there or not there, not of what the container is.
ABOUT = frozenset("no not has have with without hide show is can allow enable enabled disable disabled".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?:svg|math)(?=[\s/])(?:[^<>\"'/]|\"[^\"]*\"|'[^']*'|/(?!>))*+/>"
    rf"|<(?P<raw>{HIDDEN})(?=[\s/>])[^>]*>.*?(?P<shut></(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>[^<>\"']+|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>",
    re.S | re.I)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
CUT_OFF = re.compile(r"<[!?/a-zA-Z]")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
COMMENTS = re.compile(r"comment|disqus|discussion|repl(?:y|ies)|respon[ds]", re.I)
LABEL = re.compile(r"<!--label (\d)-->")

PLAIN, WEAK, BOILER, UNSEEN = range(4)


def mark_of_name(name: str) -> int:
    """What one class, id or role says: by its parts, at breaks and capitals."""
    parts = [p.lower() for p in PART.findall(name)]
    if not parts or parts[0] in ABOUT:
        return PLAIN
    if any(p in BOILER_WORDS or p.startswith(BOILER_STARTS) for p in parts):
        return BOILER
    return WEAK if not WEAK_WORDS.isdisjoint(parts) else PLAIN


def mark_of(tag: str, attrs: str) -> int:
    """What a container's own tag and attributes say of it."""
    mark = PLAIN
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "style" and UNSHOWN.search(value)) or (name == "aria-hidden" and value.lower() == "true"):
            return UNSEEN
        if name in ("class", "id", "role") and tag not in PAGE_TAGS:
            mark = max(mark, *map(mark_of_name, value.split()), PLAIN)
    return mark


@dataclass
class Zone:
    """A container: its own mark, whether it clears what is around it, and what it holds."""

    parent: int
    mark: int = PLAIN
    clears: bool = False
    article: int = -1
    comments: bool = False
    form: bool = False
    words: int = 0
    linked: int = 0
    begins: bool = False
    seen: int = PLAIN  # the mark that counts for its blocks


@dataclass
class Block:
    text: str
    words: int
    linked: int
    zone: int
    heading: bool
    label: int = -1


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    zones: list[Zone] = field(default_factory=lambda: [Zone(-1)])


def read_page(page: str) -> Page:
    """Flat blocks of a page, in page order, and its containers."""
    out = Page()
    found, zones = out.blocks, out.zones
    open_tags: list[tuple[str, int, int, bool]] = []  # tag, its zone, how many list tags lie below, a heading
    depth: Counter = Counter()
    lists: list[int] = []  # places of open ul, ol and li
    parts: list[str] = []
    linked = in_link = 0
    label, begun = -1, {"h1": False, "article": False}

    def close_from(i: int) -> None:
        for tag, *_ in open_tags[i:]:
            depth[tag] -= 1
        del lists[open_tags[i][2] :]
        del open_tags[i:]

    def flush() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            zone = open_tags[-1][1] if open_tags else 0
            heading = any(t[3] for t in open_tags[-3:])
            n, links = len(words), min(linked, len(words))
            found.append(Block(" ".join(words), n, links, zone, heading, label))
            zones[zone].words += n
            zones[zone].linked += links
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text.split())

    at, last = 0, page.rfind(">") + 1
    for m in TOKEN.finditer(page, 0, last):  # with a ``>`` ahead no tag is looked for in vain
        add(page[at : m.start()])
        at = m.end()
        if m.group("raw"):
            if not m.group("shut"):
                at = len(page)
            continue
        tag = (m.group("tag") or "").lower()
        if not tag:
            if m.group().startswith("<!--"):
                mark = LABEL.fullmatch(m.group())
                if mark:  # only in the labelled pages below
                    flush()
                    label = int(mark.group(1))
                elif at == last and not m.group().endswith("-->"):
                    at = len(page)
            continue
        end = bool(m.group("end"))
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if end else 1
            continue
        flush()
        in_link = in_link if tag in ("p", "div") else 0
        if end:
            if depth[tag] > 0:
                i = len(open_tags) - 1
                while open_tags[i][0] != tag:
                    i -= 1
                close_from(i)
            continue
        if tag in VOID:
            continue
        if open_tags and open_tags[-1][0] == "p":
            close_from(len(open_tags) - 1)
        if tag == "li" and lists and open_tags[lists[-1]][0] == "li":
            close_from(lists[-1])
        zone = open_tags[-1][1] if open_tags else 0
        mark = mark_of(tag, m.group("attrs")) if m.group("attrs") else PLAIN
        kind = "article" if tag in ARTICLE_TAGS else tag
        # the page's first heading and article tell where it begins; a comment may be an article too
        first = not begun.get(kind, True) and not zones[zone].comments
        if first:
            begun[kind] = True
        if tag not in LEAVES or mark > PLAIN:
            outer = zones[zone].article
            if tag in BOILER_TAGS or (tag == "header" and outer < 0):
                mark = max(mark, BOILER)
            comments = zones[zone].comments or (mark == BOILER and bool(COMMENTS.search(m.group("attrs"))))
            clears = tag == "body" or (first and kind == "article")  # what is around the article says nothing of it
            zones.append(Zone(zone, mark, clears, len(zones) if tag in ARTICLE_TAGS and outer < 0 else outer, comments, tag == "form"))
            zone = len(zones) - 1
        if first:
            up = zone
            while up >= 0:
                zones[up].begins = True
                up = zones[up].parent
        open_tags.append((tag, zone, len(lists), tag in HEADINGS))
        depth[tag] += 1
        if tag in ("ul", "ol", "li"):
            lists.append(len(open_tags) - 1)
    tail = page[at:]
    cut = CUT_OFF.search(tail, max(0, last - at))
    add(tail[: cut.start()] if cut else tail)
    flush()
    settle(zones)
    return out


def settle(zones: list[Zone]) -> None:
    """Words of containers with all they hold, and the marks that count."""
    for z in reversed(zones):
        if z.parent >= 0:
            zones[z.parent].words += z.words
            zones[z.parent].linked += z.linked
    total, any_begins = zones[0].words, zones[0].begins
    for z in zones:
        around = zones[z.parent].seen if z.parent >= 0 else PLAIN
        wraps = (2 * z.words > total and (z.begins or not any_begins)) or (z.form and z.begins)
        if around < UNSEEN and z.clears:
            around = PLAIN
        z.seen = max(around, z.mark if z.mark == UNSEEN or not wraps else PLAIN)


#: Names of the features.  The place is 0 beside an article that the page names, 1 if it names none, and up to 2 in the article; the mark is 0, 1 or 2.
FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "share of container", "links of container", "place", "mark", "heading")


def features(page: Page) -> list[list[float]]:
    """A row for each block of a page."""
    blocks, zones = page.blocks, page.zones
    total = max(1, zones[0].words)
    # of several articles, each counts by its size beside the largest
    most = max((z.words for i, z in enumerate(zones) if z.article == i and z.seen <= WEAK), default=0)
    own = [(float(min(b.words, 200)), b.linked / b.words) for b in blocks]
    around = [(0.0, 0.0), *own, (0.0, 0.0)]
    rows = []
    for i, b in enumerate(blocks):
        z = zones[b.zone]
        place = 1.0 if not most else 0.0 if z.article < 0 else 1 + min(1.0, zones[z.article].words / most)
        rows.append([*own[i], *around[i], *around[i + 2], z.words / total, z.linked / max(1, z.words), place, float(min(z.seen, BOILER)), float(b.heading)])
    return rows


# The labelled table: pages put together from the pieces below.  Label 1 is main text, 0 is not.
_WORDS = "the quiet river ran past an old mill and nobody there spoke of it again until late summer came".split()
_LONG = "{l}"  # two or three sentences
_MENUS = ("<ul><li><a href=/a>{a}</a></li><li><a href=/b>{b}</a></li><li><a href=/c>{a} {b}</a></li></ul>", "<div><a href=/p>{a} {b}</a> | <a href=/q>{c}</a> | <a href=/r>{a}</a></div>",
          "<p><a href=/a>{a}</a></p><p><a href=/b>{b} {c}</a></p><p><a href=/c>{c}</a></p>", "<table><tr><td><a href=/a>{a}</a></td><td><a href=/b>{b}</a></td></tr></table>")
_LINES = ("<div>{a} {b}</div>", "<div>{c}</div>", "<p>{a} <a href=/s>{b}</a></p>", "<div>&copy; {a} {b}</div>")
#: Containers with a mark, around a menu, a line or long text.
_MARKED = ("<nav>{}</nav>", "<header>{}</header>", "<footer>{}</footer>", "<aside>{}</aside>", "<form action=/f>{}</form>", "<div class='ad'>{}</div>", "<div class='ad-slot'>{}</div>",
           "<div class='sidebar'>{}</div>", "<div id=cookie-notice>{}</div>", "<div class='newsletter-box'>{}</div>", "<section class=comments>{}</section>", "<ol class=commentlist><li>{}</li></ol>",
           "<div id=disqus_thread>{}</div>", "<div class=readerComments>{}</div>", "<div role=navigation>{}</div>", "<div class='site-footer'>{}</div>")
_WEAK = ("<div class=share>{}</div>", "<section class=related>{}</section>", "<div class='social tags'>{}</div>", "<div class='widget'>{}</div>")
_MAIN = ("<p>" + _LONG + "</p>", "<p>" + _LONG + " <a href=/r>{a} {b}</a> " + _LONG + "</p>", "<p>{c}</p>", "<p>{a} {b}.</p>", "<h2>{a} {b}</h2>", "<p>" + _LONG + "</p>",
         "<blockquote>" + _LONG + "</blockquote>", "<ul><li>{a} {b}</li><li>" + _LONG + "</li><li>{c}</li></ul>", "<p><b>{a}<br><p>" + _LONG + "</p>", "<pre>{c}</pre>", "<p>" + _LONG + "</p>")
#: These are main text only where the page names its article.
_NAMED_MAIN = ("<p><a href=/w>{a} {b} {c}</a></p>", "<ul><li><a href=/u>{a} {b}</a></li><li><a href=/v>{c} {b} {a}</a></li></ul>", "<section class=teaser><p>" + _LONG + "</p></section>",
               "<div class='entry-header'><h1>{a} {b}</h1></div>", "<p>&copy; {a} {b}</p>", "<p>{b}</p>", "<p>" + _LONG + "</p>", "<h3><a href=/h>{a} {c}</a></h3>")
_ARTICLES = ("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<article class='post has-comments'>{}</article>", "<article class=share>{}</article>", "<div role=main><article>{}</article></div>")
_BARE = ("<div>{}</div>", "<div class=content>{}</div>", "<td>{}</td>", "<section>{}</section>", "{}", "<form id=aspnetForm>{}</form>")
_WRAPS = ("{}", "{}", "<body class='no-sidebar'>{}", "<body class='sidebar'><div class='layout has-sidebar'>{}</div>", "<div style='overflow:hidden' class='with-comments'>{}</div>",
          "<form id=aspnetForm>{}</form>", "<div class='page sidebar-right'>{}</div>", "<table><tr><td>{}</td></tr></table>")
_CARDS = "<article class=card><h3><a href=/k>{a} {b}</a></h3><p>{c}</p></article>"


def labelled_pages(count: int = 400) -> list[str]:
    rng = random.Random(7)
    pick = rng.choice

    def some(least: int, most: int) -> str:
        words = " ".join(pick(_WORDS) for _ in range(rng.randint(least, most)))
        return words.capitalize()

    def told(piece: str) -> str:
        fill = {"l": lambda: " ".join(some(8, 22) + "." for _ in range(rng.randint(1, 4))), "a": lambda: some(1, 2), "b": lambda: some(1, 3), "c": lambda: some(2, 6)}
        return re.sub(r"\{([labc])\}", lambda m: fill[m.group(1)](), piece)

    def no_article(links_only: bool) -> str:
        kind = rng.random()
        if links_only or kind < 0.3:
            return pick(_MENUS)
        if kind < 0.85:
            return pick(_MARKED).replace("{}", pick((*_MENUS, *_LINES, "<p>" + _LONG + "</p>", "<p>" + _LONG + "</p><p>{c}</p>")))
        return pick(_WEAK).replace("{}", pick(_MENUS))

    def around(bare: bool) -> str:
        return "".join(no_article(bare and rng.random() < 0.5) for _ in range(rng.randint(1, 3)))

    def article(named: bool) -> str:
        if named and rng.random() < 0.25:  # an article of a few words
            return "<!--label 1-->" + "".join(pick(("<h1>{a}</h1>", "<p>{a}</p>", "<p>{b}</p>", "<p><b>{a}<br><p>{c}</p>", "<p>{c}.</p>")) for _ in range(rng.randint(1, 4)))
        out = ["<!--label 1--><h1>{a} {c}</h1>" if rng.random() < 0.8 else "<!--label 1-->", "" if named and rng.random() < 0.4 else "<p>" + _LONG + "</p>"]
        for _ in range(rng.randint(0 if named else 2, 6)):
            out.append("<!--label 1-->" + pick(_MAIN + _NAMED_MAIN if named else _MAIN))
            if rng.random() < 0.25:
                out.append("<!--label 0-->" + pick(_MARKED[2:] + _WEAK).replace("{}", pick((*_MENUS, *_MENUS, "<p>" + _LONG + "</p>"))).replace("<section class=related>", "<section class=comments>"))
        return "".join(out) + ("" if named else "<!--label 1--><p>" + _LONG + "</p>")

    pages = []
    for k in range(count):
        named = k % 2 == 0
        main = pick(_ARTICLES if named else _BARE).replace("{}", article(named))
        after = around(not named) + (_CARDS * rng.randint(1, 3) if named and rng.random() < 0.3 else "")
        thread = "<div class=comments>" + ("<article><p>" + _LONG + "</p><p>{c}</p></article>") * rng.randint(1, 8) + "</div>" if rng.random() < 0.2 else ""
        outside = "<!--label 0-->" + pick(("", *_LINES, "<p>" + _LONG + "</p>")) * named + around(not named)
        pages.append(told(pick(_WRAPS).replace("{}", f"{outside}{main}<!--label 0-->{after}{thread}")))
    return [*pages, *map(told, ["<!--label 1-->" + _LONG, "<!--label 1--><p>" + _LONG + "</p>", "<article><!--label 1--><p>{c}</p></article>", "<article><!--label 1--><p>{a}</p><p>{b}</p></article>"])]


def labelled_table() -> tuple[list[list[float]], list[int]]:
    rows, labels = [], []
    for text in labelled_pages():
        page = read_page(text)
        rows += features(page)
        labels += [b.label for b in page.blocks]
    return rows, labels


def grow(rows: list[list[float]], labels: list[int], depth: int = 12, least: int = 8):
    """CART: (feature, threshold, left, right), or the label of a leaf."""
    ones = sum(labels)
    if depth == 0 or ones in (0, len(labels)):
        return int(2 * ones > len(labels))

    def gini(n: int, k: int) -> float:
        return n - (k * k + (n - k) * (n - k)) / n if n else 0.0

    best = (gini(len(labels), ones) - 1e-9, -1, 0.0)
    for f in range(len(rows[0])):
        order = sorted(range(len(rows)), key=lambda i, f=f: rows[i][f])
        left_ones = 0
        for at, i in enumerate(order[:-1], 1):
            left_ones += labels[i]
            here, there = rows[i][f], rows[order[at]][f]
            if here < there and at >= least and len(rows) - at >= least:
                score = gini(at, left_ones) + gini(len(rows) - at, ones - left_ones)
                if score < best[0] - 1e-12:
                    best = (score, f, (here + there) / 2)
    _, f, cut = best
    if f < 0:
        return int(2 * ones > len(labels))
    sides = [[i for i, r in enumerate(rows) if (r[f] > cut) == side] for side in (False, True)]
    return (f, cut, *[grow([rows[i] for i in s], [labels[i] for i in s], depth - 1, least) for s in sides])


def trained_tree():
    return grow(*labelled_table())


def classify(tree, row: list[float]) -> int:
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def main_text(text: str | None, tree) -> str:
    page = read_page(text or "")
    return "\n".join(b.text for b, row in zip(page.blocks, features(page)) if classify(tree, row))


def text_column(spark: SparkSession, page: Column) -> Column:
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(trained_tree())

    @arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tree = sent.value
        for pages in batches:
            yield pa.array([main_text(p.as_py(), tree) for p in pages], pa.string())

    return extract(page)


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per row of ``pages``: the ``keep`` columns and ``text``."""
    return pages.select(*keep, text_column(pages.sparkSession, F.col(html_col)).alias("text"))
