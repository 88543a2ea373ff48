"""Main text of web pages: flat text blocks classified by a decision tree.

The markup is read once as a flat stream; block tags end a block.  A block is described by
its words, its link density, those of its two neighbours, and by what encloses it.  A small
decision tree (Gini) keeps or drops it; it is grown from a small labelled table, the blocks of
PAGES pages that are laid out by rule (see lay_out) with each block marked as main text or not.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

# Elements of the markup language by role.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW_TAGS = ("script", "style", "template", "noscript", "iframe", "svg", "textarea", "select", "title", "canvas", "audio", "video")
BAD_TAGS = frozenset("nav header footer aside form button menu dialog head".split())
MAIN_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disclaimer|footer|form|header|legal|login|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|replies|reply|search|share|sharing|sidebars?|signup|social|sponsor\w*|subscribe|tags|toolbar|widget)(?:$|[\s_-])", re.I)
# Names of a state, as has-sidebar, that say nothing of what the element holds; elements that hold the page, whatever their names.
STATE_NAMES = re.compile(r"(?<![^\s_-])(?:has|with|no)[_-]\S+", re.I)
PAGE_TAGS = MAIN_TAGS | {"html", "body"}
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(" + "|".join(RAW_TAGS) + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?/][^>]*>?")
_NAMES = re.compile(r"(?:\s|^)(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ROLE = re.compile(r"(?:\s|^)role\s*=\s*[\"']?([a-z]+)", re.I)
_HIDDEN = re.compile(r"(?:\s|^)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_WHITE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    bad: bool
    main: bool
    item: bool
    heading: bool


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order; empty ones are left out."""
    out: list[Block] = []
    if not page:
        return out
    page = _RAW.sub(lambda m: "<hr>" if m[1] and m[1].lower() in BLOCK_TAGS else "", page)
    open_: list[tuple[str, bool]] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name in open_
    edges: list[int] = []  # places of the open elements that end blocks
    bad = main = links = items = 0
    parts: list[tuple[str, bool]] = []
    heading = False

    def flush() -> None:
        nonlocal parts
        if parts:
            text = _WHITE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
            if text:
                linked = sum(len(html.unescape(p).split()) for p, a in parts if a)
                out.append(Block(text, len(text.split()), linked, bad > 0, main > 0, items > 0, heading))
            parts = []

    def shut(k: int) -> None:
        nonlocal bad, main, links, items, heading
        for name, is_bad in reversed(open_[k:]):
            bad -= is_bad
            main -= name in MAIN_TAGS
            links -= name == "a"
            items -= name in ("li", "td", "th", "option")
            if len(name) == 2 and name[0] == "h":
                heading = False
            places[name].pop()
        del open_[k:]
        while edges and edges[-1] >= k:
            edges.pop()

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        block = name in BLOCK_TAGS
        if block:
            flush()
        elif name in ("br", "img", "input"):
            parts.append((" ", False))
        if m[1]:
            if places[name] and (block or not edges or places[name][-1] > edges[-1]):
                shut(places[name][-1])
        elif name not in VOID_TAGS and not m[3].rstrip().endswith("/"):
            if block and edges and open_[edges[-1]][0] == "p":  # a new block ends a paragraph, with what is open inside it
                shut(edges[-1])
            given = m[3]
            is_bad = name in BAD_TAGS
            if given and not is_bad:
                is_bad = name not in PAGE_TAGS and any(BAD_NAMES.search(STATE_NAMES.sub("", " ".join(x))) for x in _NAMES.findall(given)) or bool(_HIDDEN.search(given)) or (r := _ROLE.search(given)) is not None and r[1].lower() in BAD_ROLES
            places[name].append(len(open_))
            if block:
                edges.append(len(open_))
            open_.append((name, is_bad))
            bad += is_bad
            main += name in MAIN_TAGS
            links += name == "a"
            items += name in ("li", "td", "th", "option")
            heading = heading or len(name) == 2 and name[0] == "h" and name[1].isdigit()
    if at < len(page):
        parts.append((page[at:], links > 0))
    flush()
    return out


#: Columns of the labelled rows; densities in hundredths.
FEATURES = ("words", "link", "words_before", "link_before", "words_after", "link_after", "bad", "main", "page_main", "item", "heading")
#: Pages of the labelled table, the rule's seed, and the least rows that a split leaves on a side.
PAGES, SEED, LEAF = 300, 20250102, 2

# Parts of a page: how the markup of one is made, and whether it is main text. A part is one block or more.
Part = tuple[str, list[int]]


def _filler(n: int) -> str:
    return " ".join(["word"] * n)


def _linked(rng: Random, low: int, high: int) -> str:
    return f"<a href=x>{_filler(rng.randint(low, high))}</a>"


def _paragraph(rng: Random) -> Part:
    """Mostly long, at times a few words; at times with a link."""
    n = rng.choice([rng.randint(18, 140), rng.randint(18, 140), rng.randint(9, 30), rng.randint(1, 8)])
    link = " " + _linked(rng, 1, 1 + n // 12) if rng.random() < 0.25 and n > 8 else ""
    return f"<{(tag := rng.choice(['p', 'p', 'p', 'blockquote']))}>{_filler(n)}{link}</{tag}>", [1]


def _list(rng: Random) -> Part:
    items = [_filler(rng.choice([rng.randint(1, 6), rng.randint(5, 25)])) + (" " + _linked(rng, 1, 2) if rng.random() < 0.15 else "") for _ in range(rng.randint(2, 6))]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", [1] * len(items)


def _table(rng: Random) -> Part:
    n = 2 * rng.randint(2, 4)
    cells = [f"<td>{_filler(rng.randint(1, 4))}</td>" for _ in range(n)]
    return "<table>" + "".join("<tr>" + "".join(cells[k : k + 2]) + "</tr>" for k in range(0, n, 2)) + "</table>", [1] * n


def _section(rng: Random) -> Part:
    body, labels = "", []
    for part in [_paragraph(rng)] + [rng.choice([_paragraph, _paragraph, _list, _table])(rng) for _ in range(rng.randint(0, 3))]:
        body, labels = body + part[0], labels + part[1]
    return f"<h2>{_filler(rng.randint(1, 9))}</h2>{body}", [1, *labels]


def _story(rng: Random) -> Part:
    """The main text: mostly a title, then paragraphs, and at times sections with lists and tables; it begins, and mostly ends, with a paragraph of some words."""
    title = rng.random() < 0.8
    body, labels = (f"<h1>{_filler(rng.randint(1, 12))}</h1>" if title else "") + f"<p>{_filler(rng.randint(12, 90))}</p>", [1] * (1 + title)
    for _ in range(rng.randint(0, 4)):
        part = rng.choice([_paragraph, _paragraph, _section, _list])(rng)
        body, labels = body + part[0], labels + part[1]
    end = _list(rng) if rng.random() < 0.15 else (f"<p>{_filler(rng.randint(9, 90))}</p>", [1])
    return body + end[0], labels + end[1]


def _note(rng: Random) -> Part:
    """A short article: a few words a block, linked ones among them."""
    texts = [_linked(rng, 1, 6) if rng.random() < 0.25 else _filler(rng.randint(1, 12)) for _ in range(rng.randint(1, 5))]
    tags = [rng.choice(["p", "p", "h1", "li", "td"]) for _ in texts]
    return "".join(f"<{t}>{x}</{t}>" for t, x in zip(tags, texts, strict=True)), [1] * len(texts)


def _menu(rng: Random) -> Part:
    n = rng.randint(2, 7)
    return "<ul>" + "".join(f"<li>{_linked(rng, 1, 3)}</li>" for _ in range(n)) + "</ul>", [0] * n


def _bar(rng: Random) -> Part:
    return "<div>" + " | ".join(_linked(rng, 1, 2) for _ in range(rng.randint(2, 6))) + "</div>", [0]


def _brand(rng: Random) -> Part:
    return f"<div>{_filler(rng.randint(1, 5))}</div>", [0]


def _related(rng: Random) -> Part:
    n = rng.randint(2, 6)
    return f"<h3>{_filler(rng.randint(1, 3))}</h3><ul>" + "".join(f"<li>{_linked(rng, 3, 11)}</li>" for _ in range(n)) + "</ul>", [0] * (n + 1)


def _legal(rng: Random) -> Part:
    return f"<div>{_filler(rng.randint(2, 14))} {_linked(rng, 1, 4) if rng.random() < 0.5 else ''}</div>", [0]


def _dropped(rng: Random) -> Part:
    """A part that its element or its name gives away."""
    n = rng.choice([1, 2])
    start, end = rng.choice([("<nav>", "</nav>"), ("<aside>", "</aside>"), ("<footer>", "</footer>"), ("<form>", "</form>"), ("<div class=ad>", "</div>"), ("<div class='cookie-notice'>", "</div>"), ("<section id=comments>", "</section>"), ("<div class='share-buttons'>", "</div>")])
    return start + "".join(f"<p>{_filler(rng.choice([rng.randint(1, 12), rng.randint(10, 80)]))}</p>" for _ in range(n)) + end, [0] * n


def lay_out(rng: Random) -> tuple[str, list[int]]:
    """A page and, for each of its blocks in order, whether it is main text."""
    tag = rng.choice(["article", "main", "", ""])
    story, kept = (_note if tag and rng.random() < 0.6 else _story)(rng)
    if tag or rng.random() < 0.3:
        for _ in range(rng.randint(0, 2)):
            part = _dropped(rng)
            story, kept = (part[0] + story, part[1] + kept) if rng.random() < 0.5 else (story + part[0], kept + part[1])
    much = 0.2 if rng.random() < 0.2 else 1.0
    some = lambda share, *kinds: [rng.choice(kinds)(rng)] if rng.random() < share * much else []
    above = [*some(0.6, _menu, _bar), *some(0.4, _brand), *some(0.5, _dropped), *some(0.2, _menu)]
    rng.shuffle(above)
    above += some(0.7, _menu, _bar, _dropped)
    below = [*some(0.6, _related, _menu, _bar), *some(0.3, _related), *some(0.5, _dropped), *some(0.4, _legal)]
    if tag:
        extra = [f"<div>{_filler(rng.randint(1, 80))}</div>" for _ in range(rng.choice([0, 1, 2]))]
        above += [(x, [0]) for x in extra]
        story = f"<{tag}>{story}</{tag}>"
    parts = [*above, (f"<div>{story}</div>", kept), *below]
    return "<html><body>" + "".join(x for x, _ in parts) + "</body></html>", [y for _, labels in parts for y in labels]


@lru_cache(maxsize=4)
def labelled(pages: int = PAGES, seed: int = SEED) -> tuple[list[tuple[float, ...]], list[int]]:
    """The labelled table: FEATURES of every block of the pages, and 1 for main text."""
    rng, rows, labels = Random(seed), [], []
    for _ in range(pages):
        page, kept = lay_out(rng)
        found = describe(blocks(page))
        assert len(found) == len(kept)
        rows += found
        labels += kept
    return rows, labels


def grow_tree(rows: list[tuple[float, ...]], labels: list[int], depth: int = 10, leaf: int = LEAF):
    """A binary decision tree by Gini impurity: (feature, threshold, below, above), or the share of main text in a leaf."""

    def grow(x: np.ndarray, y: np.ndarray, depth: int):
        share = float(y.mean())
        if depth == 0 or share in (0.0, 1.0):
            return share
        best = (2 * len(y) * share * (1 - share) - 1e-9, 0, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, good = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            a, b = good[:-1], good[-1] - good[:-1]
            cost = 2 * a * (n - a) / n + 2 * b * (len(y) - n - b) / (len(y) - n)
            cost[(v[1:] == v[:-1]) | (np.minimum(n, len(y) - n) < leaf)] = np.inf
            k = int(cost.argmin())
            if cost[k] < best[0] - 1e-9:
                best = (cost[k], f, (v[k] + v[k + 1]) / 2)
        if best[2] == 0.0 and best[1] == 0:
            return share
        low = x[:, best[1]] <= best[2]
        return best[1], float(best[2]), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)

    return grow(np.array(rows, np.float64), np.array(labels, np.float64), depth)


def classify(tree, row: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def describe(found: list[Block]) -> list[tuple[float, ...]]:
    page_main = float(any(b.main and not b.bad for b in found))
    edge = (0.0, 0.0)
    own = [edge, *((float(b.words), 100.0 * b.linked / b.words) for b in found), edge]
    return [(*own[i + 1], *own[i], *own[i + 2], float(b.bad), float(b.main), page_main, float(b.item), float(b.heading)) for i, b in enumerate(found)]


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, row in zip(found, describe(found), strict=True) if classify(tree, row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page. A null or empty page, or one without main text, gives an empty text.

    Rows are independent; ids and urls may be null or repeated.
    """
    small_batches(pages.sparkSession)
    tree = grow_tree(*labelled())

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x, tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(fn, "page_id long, url string, text string, n_chars long")
