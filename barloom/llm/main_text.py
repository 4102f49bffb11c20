"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores the log odds that a word
in such surroundings belongs to the main text, as counted on labelled pages; a
tag scores negative. The contiguous run with the greatest sum is the content
region, found in one linear scan. Blocks of the region that are page furniture
by their own markup are left out of the text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_map, batch_of, text_slices

# Fixed values of HTML: elements by their role.
RAW = frozenset("script style noscript template textarea iframe svg title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button select option label head".split())
CONTENT = frozenset("article main".split())
WHOLE = frozenset("html body article main".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split()
)
CLOSED_BY_BLOCK = frozenset("p".split())
NOT_CONTENT = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|header|footer|sidebar|side|aside|widget\w*|cookie\w*|consent|notice\w*"
    r"|newsletter|subscribe|comments?|reply|replies|respond|disqus|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|popup|modal"
    r"|overlay|login|signup|search|skip\w*|hidden|legal|copyright)(?:$|[-_ ])",
    re.IGNORECASE,
)
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())

# a quotation begins only after an equals sign; possessive, so that a tag without an end is given up at once
START = re.compile(r"<!--|<[!?]|</?[A-Za-z]")
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class HtmlParameters:
    """``max_labelled`` pages are drawn for the weights; ``tag`` is the score of a tag, ``marked`` is added to words in content elements."""

    max_labelled: int = 2000
    tag: float = -0.5
    marked: float = 2.0
    smoothing: float = 1.0


@dataclass
class Block:
    """Text between two block borders: raw parts, whether it is furniture or lies in a content element, and its features."""

    parts: list[str] = field(default_factory=list)
    element: str = ""
    furniture: bool = False
    marked: bool = False
    tags: int = 0
    words: int = 0
    linked: int = 0

    def features(self) -> tuple[str, ...]:
        size = min(6, self.words.bit_length())
        links = 0 if not self.linked else 1 if 2 * self.linked < self.words else 2
        return f"element={self.element}", f"words={size}", f"links={links}", f"furniture={self.furniture}"


def extract_main_text(pages: DataFrame, parameters: HtmlParameters = HtmlParameters()) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null html is empty and gives an empty text. Repeated rows each get their
    row; other columns are not read. Pages without labels elsewhere still get
    text: without any labelled page the weights are those of smoothing alone.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html").cast("string").alias("html"))
    weights = fit_weights(rows, parameters)
    return arrow_map(rows, _extract, "page_id long, url string, text string, n_chars long", p=parameters, weights=weights)


def fit_weights(pages: DataFrame, p: HtmlParameters) -> dict[str, float]:
    """Log odds of each feature, from pages that label their own text with a content element.

    A bounded sample: the ``max_labelled`` different pages with the smallest hash
    of the html. The draw sorts hashes alone, so no task gathers pages. Features count in the executors; a few dozen sums come back.
    """
    labelled = pages.where(F.lower("html").rlike(r"<(article|main)[\s>]")).select("html", F.xxhash64("html").alias("draw"))
    last = labelled.select("draw").distinct().orderBy("draw").limit(p.max_labelled).agg(F.max("draw")).first()[0]
    drawn = labelled.where(F.col("draw") <= F.lit(last)).dropDuplicates(["draw"]).select("html")
    counts = arrow_map(drawn, _count_features, "feature string, inside long, outside long")
    rows = counts.groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    total = next((r for r in rows if r["feature"] == "all"), None)
    inside, outside = (total["inside"], total["outside"]) if total else (0, 0)
    s = p.smoothing
    return {
        r["feature"]: math.log((r["inside"] + s) / (inside + 2 * s)) - math.log((r["outside"] + s) / (outside + 2 * s))
        for r in rows
        if r["feature"] != "all"
    }


COUNTS = pa.schema([("feature", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())])
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for _, pages in text_slices(batches, "html"):
        for page in pages:
            for block in blocks_of(page.decode("utf-8", "replace")):
                target = inside if block.marked and not block.furniture else outside
                for feature in ("all", *block.features()):
                    target[feature] += block.words
    names = sorted(inside | outside)
    yield batch_of(COUNTS, names, [inside[n] for n in names], [outside[n] for n in names])


def _extract(batches: Iterator[pa.RecordBatch], p: HtmlParameters, weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for batch, pages in text_slices(batches, "html"):
        texts = [main_text(page.decode("utf-8", "replace"), weights, p) for page in pages]
        yield batch_of(TEXTS, batch.column("page_id"), batch.column("url").cast(pa.string()), texts, [len(t) for t in texts])


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order; comments, declarations and raw elements hold no text."""
    blocks, block = [], Block()
    open_elements: list[tuple[str, bool, bool]] = []  # name, furniture, content: of each open element
    open_names: Counter[str] = Counter()
    furniture_depth = content_depth = math_depth = links = 0

    def turn(name: str) -> None:
        nonlocal block
        blocks.append(block)
        block = Block(element=name, furniture=furniture_depth > 0, marked=content_depth > 0)

    def close() -> str:
        nonlocal furniture_depth, content_depth
        name, furniture, content = open_elements.pop()
        open_names[name] -= 1
        furniture_depth -= furniture
        content_depth -= content
        return name

    for text, closing, name, attributes in tokens_of(page):
        if text:
            block.parts.append(text)
            if words := len(text.split()):
                block.words += words
                block.linked += words * (links > 0)
        if not name:
            continue
        block.tags += 1
        if name == "br":
            block.parts.append(" ")
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name == "math":
            math_depth = max(0, math_depth + (-1 if closing else not attributes.endswith("/")))
        # a formula and its parts stand in the line
        if name in INLINE or name == "math" or math_depth:
            continue
        if closing:
            if open_names[name]:
                while close() != name:
                    pass
        elif name not in VOID and not attributes.endswith("/"):
            if name in CLOSED_BY_BLOCK and open_elements and open_elements[-1][0] == name:
                close()
            furniture = name in FURNITURE or (name not in WHOLE and _furniture_by_name(attributes))
            open_elements.append((name, furniture, name in CONTENT))
            open_names[name] += 1
            furniture_depth += furniture
            content_depth += name in CONTENT
        turn(name)
    blocks.append(block)
    return blocks


def tokens_of(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, whether a closing tag, its name, its attributes) in one pass; the name is empty where only text is left.

    A tag that the page's end cuts off ends the text before it. An angle
    bracket that opens nothing is text. What raw elements hold is left out.
    """
    at = begun = 0
    parts: list[str] = []
    ends: dict[str, re.Pattern[str]] = {}
    while start := START.search(page, at):
        parts.append(page[begun : start.start()])
        if start[0].startswith(("<!", "<?")):
            # a comment may close within its own opening dashes
            end = page.find("-->", start.start() + 2) if start[0] == "<!--" else page.find(">", start.end())
            at = begun = len(page) if end < 0 else end + (3 if start[0] == "<!--" else 1)
            continue
        tag = TAG.match(page, start.start())
        if tag is None:
            begun = len(page)
            break
        at = begun = tag.end()
        closing, name, attributes = bool(tag[1]), tag[2].lower(), tag[3]
        if name in RAW and not closing:
            # graphics close themselves; the others need their end tag
            if not (name == "svg" and attributes.endswith("/")):
                if name not in ends:
                    ends[name] = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE)
                end = ends[name].search(page, at)
                at = begun = end.end() if end else len(page)
            continue
        yield "".join(parts), closing, name, attributes
        parts = []
    parts.append(page[begun:])
    yield "".join(parts), False, "", ""


def _furniture_by_name(attributes: str) -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        if name.lower() in ("class", "id"):
            names = (x for x in value.split() if not x.lower().startswith(("has-", "no-", "with-")))
            if any(NOT_CONTENT.search(x) for x in names):
                return True
        if name.lower() == "role" and value.lower() in NOT_CONTENT_ROLES:
            return True
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
            return True
    return False


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the greatest positive sum; the first of equal ones; (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str, weights: dict[str, float], p: HtmlParameters) -> str:
    blocks = blocks_of(page)
    # all words of a block score alike, so a block's words count as one step of the scan
    scores = []
    for block in blocks:
        word = sum(weights.get(f, 0.0) for f in block.features()) + p.marked * block.marked
        scores.append(block.words * max(-4.0, min(4.0, word)) + p.tag * block.tags)
    first, end = best_run(scores)
    texts = (SPACE.sub(" ", entities.unescape("".join(b.parts))).strip() for b in blocks[first:end] if not b.furniture)
    return "\n\n".join(t for t in texts if t)
