"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one labels a block by itself: boilerplate
elements and names, link density, length and stop-word density make it good, bad, near (middling)
or short. Stop words judge only blocks in Latin script of pages that hold known stop words at all;
texts in other languages are judged by length and links. Pass two gives near and short blocks the
label of their nearest decided neighbours: the same label on both sides, else the nearer side, the
one after for headings. Boilerplate elements around or within an article say nothing about its own
blocks; nor do they on a page on which no block is good. A suspect name is no proof for a wrapper
(`blocks_of`). Without a decided neighbour a block inside
an article or main element is good, a near block too, and a short one if the page has no good block.
Inside an article a block is never bad for lack of stop words alone.

Inline boilerplate (buttons, labels, choices, and inline elements with a boilerplate name) loses
its own text only; the paragraph around it stays one block.

Defined results: a null or empty page, and one without main text, has the text "" and 0
characters; unclosed tags, quotes and comments end with the page; character references are decoded
once, unknown ones stay as they are; equal pages get equal texts; every row is kept; an empty
table gives no rows. A page takes time in proportion to its length. Only the given columns are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STOP = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were their we",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son mais comme",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque",
}
STOP_WORDS = frozenset(w for words in STOP.values() for w in words.split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no main text: whole blocks, and inline ones, of which only the own text goes.
BOILERPLATE = frozenset("head title nav aside footer form fieldset menu dialog".split())
INLINE = frozenset("button select label datalist optgroup option output".split())
#: Words of class names and ids that name what is no main text: of reader comments and notices, and of other parts.
REMARKS = frozenset("comment comments commentlist commenters disqus reply replies respond response responses discussion discussions cookie cookies consent gdpr ccpa dialog alertdialog popup modal paywall".split())
PARTS = frozenset("ad ads adsbygoogle adsense adslot adunit adbox advert adverts advertisement advertisements advertising banner sponsor sponsors sponsored promo promos promotion promotions sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead notice notices alert alerts newsletter subscribe subscription social share sharing sharebar related widget widgets login signup signin toolbar pagination pager search".split())
#: Words that also begin other names: they count alone, or before one of these words.
LOOSE = frozenset("social related search share sharing notice alert banner promo promotion response discussion comment reply subscription".split())
COMPANIONS = frozenset("ad ads area bar block body box button buttons card cards col column container content feed footer form group header icon icons inner inline item items link links list listing media meta module news nav outer panel popup post posts read reading results row section sharing share slider slot stories story strip text thread title toggle tools top topics video videos widget wrap wrapper articles article products small large left right bottom primary secondary main".split())
#: First words of names that say what an element has, or which kit made it, not what it is.
NEUTRAL = frozenset("has with no not without elementor".split())
ROLES = frozenset("dialog alertdialog alert navigation complementary contentinfo banner search menu menubar toolbar".split())
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")
PAGE = frozenset("html body main".split())
#: Words of notices, which mark a text without stop words as bad outside articles.
NOTICE = re.compile(r"(?i)\u00a9|\bcopyright\b|all rights reserved|\bcookies?\b|privacy policy|terms of (?:use|service)|\bnewsletter\b|\bsubscribe\b|\bsign (?:in|up)\b|\blog ?in\b")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|object|annotation|annotation-xml)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)"
    r"|([^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: An unquoted value that ends with a slash, which then closes nothing.
VALUE = re.compile(r"=[^\s\"']*/\Z")
WORD = re.compile(r"\w+")
#: Lengths in characters, link density, stop-word densities.
SHORT, LONG, LINKS, STOP_LOW, STOP_HIGH = 70, 200, 0.4, 0.10, 0.25


class Open(NamedTuple):
    """An open element, and what holds inside it."""

    tag: str
    bad: bool
    article: bool
    link: bool
    #: Text inside is left out without ending the block.
    dropped: bool
    #: The innermost block-level tag.
    block: str
    #: The innermost element that a name, a role or a form makes suspect: its number, or 0.
    suspect: int


OUTSIDE = Open("", False, False, False, False, "body", 0)


def suspicion(attributes: str, article: bool) -> str:
    """What the names of an element make it: "remark" (comments, notices), "part", or nothing. Names are read by their words, cut at hyphens, underscores and capitals."""
    found = ""
    for key, *value in ATTRIBUTE.findall(attributes):
        for name in "".join(value).split():
            if key.lower() == "role":
                if name.lower() in ROLES:
                    return "remark" if name.lower() in REMARKS else "part"
                continue
            words = [w.lower() for w in NAME_WORD.findall(name)]
            if not words or words[0] in NEUTRAL:
                continue
            for k, word in enumerate(words):
                if word not in REMARKS and word not in PARTS:
                    continue
                if word in LOOSE and k + 1 < len(words) and words[k + 1] not in COMPANIONS:
                    continue
                if article and key.lower() == "id" and word in ("discussion", "response"):
                    continue  # a section of the article
                if word in REMARKS:
                    return "remark"
                found = "part"
    return found


def blocks_of(page: str) -> list[tuple[str, str, bool, bool, float]]:
    """(text, tag, boilerplate, in an article, link density) of each block with text, in page order.

    Names, roles and forms make an element suspect only. One that holds all articles (and main elements) of
    the page and a third of its text, or more than half of its text, is a wrapper and says nothing; but
    comments and notices without an article stay so however long they are.
    """
    out: list[tuple[str, str, bool, int, bool, float]] = []
    stack: list[Open] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    state, linked = OUTSIDE, 0
    kinds, parents, sizes, bodies = ["page"], [0], [0], [0]

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append((whole, state.block, state.bad, state.suspect, state.article, min(1.0, linked / len(whole))))
                if not state.bad:
                    sizes[state.suspect] += len(whole)
            text.clear()
        linked = 0

    def close(tag: str) -> Open:
        while True:
            last = stack.pop()
            opened[last.tag] -= 1
            if last.tag == tag:
                return stack[-1] if stack else OUTSIDE

    for m in TOKEN.finditer(page):
        words = m.group(5)
        if words is not None:
            if not state.dropped:
                piece = html.unescape(words) if "&" in words else words
                text.append(piece)
                if state.link:
                    linked += len(piece.strip())
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCKS and not state.dropped
        if m.group(2):
            if block:
                flush()
            if opened[tag]:
                if tag in BLOCKS and state.dropped:
                    flush()  # a block that ends with an inline element still open
                state = close(tag)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if block:
            flush()
            if state.block == "p" and opened["p"]:  # a block ends an open paragraph
                state = close("p")
            if tag == "body":
                stack = [x for x in stack if x.tag == "html"]
                opened = Counter(x.tag for x in stack)
                state = OUTSIDE
        if tag in VOID or m.group(4).endswith("/") and tag not in BLOCKS and not VALUE.search(m.group(4)):
            continue
        kind = suspicion(m.group(4), state.article) if m.group(4) and tag not in PAGE else ""
        inline = tag in INLINE or bool(kind) and tag not in BLOCKS
        if tag in BLOCKS or tag == "a" or inline:
            body = tag in ("article", "main") and not kind
            own = inline or (tag in BOILERPLATE and tag != "form") or (tag == "header" and not state.article)
            suspect = state.suspect
            if not own and (kind or tag == "form"):
                kinds.append(kind or "part")
                parents.append(suspect)
                sizes.append(0)
                bodies.append(0)
                suspect = len(kinds) - 1
            if body and not state.bad:
                bodies[suspect] += 1
            state = Open(tag, own or state.bad, state.article or body, state.link or tag == "a", state.dropped or inline, tag if block else state.block, suspect)
            stack.append(state)
            opened[tag] += 1
    flush()
    for k in range(len(kinds) - 1, 0, -1):  # what an element holds, its parts' included
        sizes[parents[k]] += sizes[k]
        bodies[parents[k]] += bodies[k]
    guilty = [False]
    for k in range(1, len(kinds)):
        wrapper = (0 < bodies[0] == bodies[k] and 3 * sizes[k] > sizes[0]) or (kinds[k] == "part" and 2 * sizes[k] > sizes[0])
        guilty.append(guilty[parents[k]] or not wrapper)
    return [(whole, tag, bad or guilty[suspect], article, links) for whole, tag, bad, suspect, article, links in out]


def weighed(text: str) -> tuple[int, int, int, bool]:
    """Length (characters of scripts without blanks between words count three times), words, stop words, and whether it is mostly Latin."""
    words = WORD.findall(text.lower())
    wide = 0 if text.isascii() else sum(c >= "\u2e80" for c in text)
    other = 0 if text.isascii() else sum(c >= "\u0250" and c.isalpha() for c in text)
    return len(text) + 2 * wide, len(words), sum(w in STOP_WORDS for w in words), 2 * other < sum(c.isalpha() for c in text) if other else True


def first_label(text: str, boilerplate: bool, article: bool, links: float, weights: tuple[int, int, int, bool], known: bool) -> str:
    """Pass one. `known`: the page holds stop words, so its Latin blocks can be judged by them."""
    size, words, stops, latin = weights
    if boilerplate or links > LINKS:
        return "bad"
    if size < SHORT:
        return "bad" if links > 0 and not article else "short"
    if not (known and latin):
        return "good" if size > LONG else "near"
    density = stops / max(words, 1)
    if density >= STOP_HIGH:
        return "good" if size > LONG else "near"
    if density >= STOP_LOW or article:
        return "near"
    return "bad" if links > 0 or NOTICE.search(text) else "near"


def labels_of(found: list[tuple[str, str, bool, bool, float]]) -> list[bool]:
    """Whether each block is main text."""
    weights = [weighed(b[0]) for b in found]
    own = [w for w, b in zip(weights, found, strict=True) if not b[2] and b[4] <= LINKS]
    known = 2 * sum(w[2] for w in own) >= STOP_LOW * sum(w[1] for w in own)
    first = [first_label(t, bad, inside, links, w, known) for (t, _, bad, inside, links), w in zip(found, weights, strict=True)]
    ends = [0, *accumulate(len(b[0]) for b in found)]
    n, left, right = len(first), [], [None] * len(first)
    last = None
    for i, label in enumerate(first):
        left.append(last)
        last = i if label in ("good", "bad") else last
    last = None
    for i in range(n - 1, -1, -1):
        right[i] = last
        last = i if first[i] in ("good", "bad") else last
    none_good = "good" not in first
    out = []
    for i, label in enumerate(first):
        inside = found[i][3]
        if label in ("good", "bad"):
            out.append(label == "good")
            continue
        near = [j for j in (left[i], right[i]) if j is not None and not (inside and (found[j][2] or not found[j][3])) and not (none_good and found[j][2])]
        if not near:
            out.append(inside or label == "near" or none_good)
        elif len({first[j] for j in near}) == 1:
            out.append(first[near[0]] == "good" or (label == "near" and inside))
        elif found[i][1] in HEADINGS:
            out.append(first[near[1]] == "good")
        else:
            before, after = ends[i] - ends[near[0] + 1], ends[near[1]] - ends[i + 1]
            out.append(first[near[0] if before <= after else near[1]] == "good" or (label == "near" and inside))
    return out


def main_text(page: str | None) -> str:
    found = blocks_of(page or "")
    return "\n\n".join(b[0] for b, good in zip(found, labels_of(found), strict=True) if good)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page; one pass without a shuffle."""
    rows = pages.select(id, url, F.col(page).cast("string").alias("_page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 500
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                texts = [main_text(p.as_py()) for p in part.column("_page")]
                yield pa.RecordBatch.from_arrays([part.column(id), part.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id, url, "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"`{id}` {kinds[id]}, `{url}` {kinds[url]}, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
