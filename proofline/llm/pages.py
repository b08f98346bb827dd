"""Main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, ship

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>?", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SPACE = re.compile(r"\s+")

BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page: raw ones end at their own closing tag only, or with the page.
RAW = set("script style textarea noframes noembed xmp".split())
#: These too, but one that is never closed ends at the next block or with what it stands in.
UNSEEN = set("noscript template iframe svg object canvas audio video select button".split())
UNSEEN_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|noframes|noembed|xmp)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|<(/?)({'|'.join(sorted(UNSEEN))})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>?", re.S | re.I)
SILENT = {"head", "title"}
#: Closed by the next of their kind, or by a block.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table", "menu", "select"}

#: Costs by the words of tags, classes, ids and roles of what a block stands in: above 0 for content, below for the rest.
TAG_COST = {"article": 3.0, "main": 2.5, "nav": -9.0, "aside": -9.0, "footer": -9.0, "header": -6.0, "form": -9.0, "menu": -6.0, "fieldset": -9.0, "dialog": -9.0}
HINT_COST = -9.0
HINT_BAD = re.compile(
    r"^(?:ads?|advert\w*|adv|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|notification\w*|alert\w*|popup|modal|overlay|navs?|navbars?|navmenu|navlinks?|navigations?|menu\w*|breadcrumb\w*|sidebar\w*|side|aside|footer\w*|foot|header|masthead|topbar|"
    r"toolbar|comment\w*|disqus|respond|responds|responses?|repl(?:y|ies)|discussion|feedback|share|sharing|social\w*|related\w*|recommend\w*|subscribe\w*|newsletter\w*|signup|login|search\w*|widget\w*|pagination|pager|copyright|legal|"
    r"disclaimer|skip\w*|hidden|complementary|contentinfo|outbrain|taboola)$"
)
#: Names by which even an article is no page's main one: a reader's comment, a teaser, an advert. What others say of an article is its subject.
HINT_OTHER = re.compile(r"^(?:ads?|advert\w*|sponsor\w*|promo\w*|comment\w*|repl(?:y|ies)|responses?|related\w*|recommend\w*|sidebar\w*|hidden)$")
#: Names that articles have too: they cost less in an article or main.
HINT_LOOSE, LOOSE_COST = re.compile(r"^(?:reviews?|forms?)$"), -1.5
HINT_GOOD = re.compile(r"^(?:article\w*|content|main|post|entry|story|body|text|prose|maincontent)$")
WORDS_IN_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


#: Ends of names that say how a part stands or whether there is one (`sidebar-left`, `comments-open`), which wrappers and articles bear too.
STATES = set("left right top bottom fixed sticky open opened closed enabled disabled on off active visible page layout wide full collapsed expanded".split())
#: Ancestors by which blocks are compared; sharing only higher ones weighs less than 2^-15 and counts as sharing none.
NEAR = 16


@dataclass
class Node:
    """An open element and its number."""

    tag: str
    serial: int
    inside_article: bool
    hidden: bool
    heading: bool


@dataclass
class Element:
    """An element, the number of the one around it, what its tag and names say, its own characters, whether it is a title."""

    tag: str
    parent: int
    hints: list[tuple[str, float]]
    title: bool = False
    chars: int = 0
    link_chars: int = 0


@dataclass
class Block:
    """A text, the numbers of its nearest ancestors and how many there are above, what these cost."""

    text: str
    path: tuple[int, ...]
    above: int
    cost: float
    link_share: float
    heading: bool


def _attributes(tag: str, name: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(tag[1 + len(name) :].rstrip(">").rstrip("/"))}


def _hints(tag: str, attrs: dict[str, str], inside_article: bool) -> list[tuple[str, float]]:
    """(sort, cost) of what tag, class, id and role say of an element; how much it counts is told by what the element holds."""
    out = []
    if tag in TAG_COST and not (tag == "header" and inside_article):
        out.append(("good" if TAG_COST[tag] > 0 else "bad", TAG_COST[tag]))
    if tag in ("html", "body"):
        return out
    within, whole = inside_article or tag in ("article", "main"), tag in ("article", "main")
    for key in ("class", "id", "role"):
        for name in attrs.get(key, "").split():
            parts = [w.lower() for w in WORDS_IN_NAME.findall(name)]
            words = [*parts, name.lower().replace("-", "").replace("_", "")]
            good, bad = any(HINT_GOOD.match(w) for w in words), {w for w in words if HINT_BAD.match(w) and (not whole or HINT_OTHER.match(w))}
            if bad <= {"header", "head"} and bad and (good or inside_article):
                continue  # the article's own heading
            if {"has", "with", "no"} & set(words):
                continue  # says what else the page has
            loose = any(HINT_LOOSE.match(w) for w in words)
            if bad or loose and not within:
                state = len(parts) > 1 and parts[-1] in STATES
                out.append(("state" if state else "other" if any(HINT_OTHER.match(w) for w in words) else "bad", HINT_COST))
            elif loose or good:
                out.append(("good", LOOSE_COST if loose else 1.5))
    return out


def _costs_of_elements(elements: list[Element]) -> list[float]:
    """What each element and those around it come to, ancestors first.

    A bad name counts in full where it is the name of a part. It says nothing of what holds the page's article, be it
    the article itself or a wrapper (`sidebar-left`, `menu-open`, a form round the page), and within the article
    nothing of what is most of it.
    """
    plain = [e.chars - e.link_chars for e in elements]
    titled = [e.title for e in elements]
    for k in range(len(elements) - 1, 0, -1):
        plain[elements[k].parent] += plain[k]
        titled[elements[k].parent] |= titled[k]
    apart = [False] * len(elements)  # in a comment, a teaser or an advert
    for k, e in enumerate(elements[1:], 1):
        apart[k] = apart[e.parent] or e.tag == "aside" or any(sort == "other" for sort, _ in e.hints)
    ranked = [k for k, e in enumerate(elements) if e.tag in ("main", "article") and not apart[k] and plain[k]]
    # The text of an article is weighed against all of the page; without any, what has most of the text and a title stands in.
    article = max(ranked, key=lambda k: (elements[k].tag == "main", plain[k], -k), default=None)
    holds = [False] * len(elements)
    if article is None:
        holds = [titled[k] and 2 * plain[k] >= plain[0] > 0 for k in range(len(elements))]
    else:
        k = article
        while k:
            holds[k] = True
            k = elements[k].parent
    within = [False] * len(elements)
    out = [0.0] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        within[k] = k == article or within[e.parent]
        most = within[k] and article is not None and 2 * plain[k] >= plain[article] and plain[k] > 0
        free = {"bad", "other", "state"} if holds[k] else {"bad", "state"} if most else {"state"} if (titled[k] or 5 * plain[k] >= 2 * plain[0] > 0) and not apart[e.parent] else set()
        hint = sum(cost for sort, cost in e.hints if sort not in free)
        out[k] = out[e.parent] + hint if hint < 0 else max(out[e.parent], min(3.0, out[e.parent] + hint))
    return out


def _closed(page: str) -> dict[int, int]:
    """Where each unseen element that is closed ends, by where it starts; a closing tag ends the latest of its name."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for m in UNSEEN_TAG.finditer(page):
        if not m[3] or m[0].endswith("/>"):
            continue
        starts = open_.setdefault(m[3].lower(), [])
        if not m[2]:
            starts.append(m.start())
        elif starts:
            out[starts.pop()] = m.end()
    return out


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order: text between block tags, white space run together, blanks left out."""
    out: list[Block] = []
    stack = [Node("", 0, False, False, False)]
    elements = [Element("", 0, [])]
    open_: Counter = Counter()
    serial, at, n = 0, 0, len(page)
    text: list[str] = []
    link_chars = 0
    links = 0
    ends: dict[int, int] | None = None
    unseen = 0  # how many elements are open around one that is unseen and never closed

    def flush() -> None:
        nonlocal text, link_chars
        said = SPACE.sub(" ", html.unescape("".join(text))).strip()
        top = stack[-1]
        if said and not top.hidden:
            path = tuple(x.serial for x in stack[-NEAR:])
            out.append(Block(said, path, len(stack) - len(path), 0.0, min(1.0, link_chars / len(said)), top.heading))
            elements[top.serial].chars += len(said)
            elements[top.serial].link_chars += min(len(said), link_chars)
        text, link_chars = [], 0

    def say(part: str) -> None:
        nonlocal link_chars
        if part and not unseen:
            text.append(part)
            if links:
                link_chars += len(part.strip())

    def close(k: int) -> None:
        nonlocal unseen
        if k < unseen:
            unseen = 0
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m[0]
        if tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                say(tag[9:-3])
            continue
        name = NAME.match(tag)[1].lower()
        if name in BLOCKS and name != "option":
            unseen = 0
        if tag[1] == "/":
            if name in BLOCKS:
                flush()
            if name == "a":
                links = max(0, links - 1)
            if open_[name]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == name))
            continue
        if name in RAW and not tag.endswith("/>"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            text.append(" ")
            continue
        if name in UNSEEN and not tag.endswith("/>"):
            ends = _closed(page) if ends is None else ends
            at = ends.get(m.start(), at)
            if m.start() not in ends:
                unseen = unseen or len(stack)
            text.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
            links = 0
            if open_["p"]:  # a block ends the paragraph and what is open in it
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p")
                if not any(x.tag in BLOCKS for x in stack[k + 1 :]):
                    close(k)
            if closes := IMPLIED.get(name):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in LISTS:
                        break
                    if stack[k].tag in closes:
                        close(k)
                        break
        attrs = _attributes(tag, name) if len(tag) > len(name) + 2 else {}
        if name == "a":
            links += 1
        if tag.endswith("/>") and name not in BLOCKS:
            continue
        top = stack[-1]
        hidden = name in SILENT or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(INVISIBLE.search(attrs.get("style", "")))
        serial += 1
        elements.append(Element(name, top.serial, _hints(name, attrs, top.inside_article), name == "h1"))
        stack.append(Node(name, serial, top.inside_article or name in ("article", "main"), top.hidden or hidden, top.heading or name in HEADINGS))
        open_[name] += 1
    flush()
    total = _costs_of_elements(elements)
    for b in out:
        b.cost = total[b.path[-1]]
    return out


def costs(b: Block) -> tuple[float, float]:
    """(cost of calling the block boilerplate, cost of calling it content): a logistic guess from its place and text."""
    n = min(60, len(b.text.split()))
    z = b.cost + 0.7 * math.log1p(n) - 1.5 - 4.0 * b.link_share + (0.5 if b.heading else 0.0)
    if b.text[-1:] in ".!?…\"'”»)":
        z += 0.4
    z = max(-12.0, min(12.0, z))
    return math.log1p(math.exp(z)), math.log1p(math.exp(-z))


def edges(found: list[Block]) -> Iterator[tuple[int, int, float]]:
    """Smoothness: neighbours on the page cost more apart the more of their ancestors they share; so do nearest siblings beyond."""
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            yield k - 1, k, 0.1 + 0.7 * _near(found[k - 1], b)
        parent = b.path[-2] if len(b.path) > 1 else 0
        if parent in last and last[parent] < k - 1:
            yield last[parent], k, 0.4
        last[parent] = k


def _near(a: Block, b: Block) -> float:
    """1 for children of one element, less for each level up to what two blocks have in common."""
    common = set(a.path) & set(b.path)
    if not common:
        return 0.0
    depth = a.above + a.path.index(max(common)) + 1
    return 2.0 ** -max(0, max(a.above + len(a.path), b.above + len(b.path)) - depth - 1)


def minimum_cut(source: list[float], sink: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side of a minimum cut (the smallest such side).

    Maximum flow by shortest augmenting levels (Dinic). First each node's two terminals are set against one
    another, which leaves one of them; flow then goes over links only where neighbours differ.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k in range(n):
        d = source[k] - sink[k]
        if d > 0:
            link(s, k, d, 0.0)
        elif d < 0:
            link(k, t, -d, 0.0)
    for a, b, c in links:
        link(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for x in queue:
            for e in out[x]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        spot = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                x = to[path[k] ^ 1]
                del path[k:]
                continue
            while spot[x] < len(out[x]):
                e = out[x][spot[x]]
                if cap[e] > tiny and level[to[e]] == level[x] + 1:
                    break
                spot[x] += 1
            if spot[x] < len(out[x]):
                path.append(out[x][spot[x]])
                x = to[path[-1]]
            elif path:
                e = path.pop()
                x = to[e ^ 1]
                spot[x] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """The page's content blocks in order, a line each."""
    found = blocks(page or "")
    if not found:
        return ""
    terminals = [costs(b) for b in found]
    keep = minimum_cut([a for a, _ in terminals], [b for _, b in terminals], list(edges(found)))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text string, n_chars long) of each row.

    A null, empty or textless page has the empty text. A very long page is one page like any other. Of several least
    cuts the one with the fewest content blocks counts. Equal rows each get a row, null ids and urls stay. An empty
    table gives no rows; further columns, whatever their names, go.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return given.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
