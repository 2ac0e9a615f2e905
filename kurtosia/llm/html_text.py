"""Main text of web pages: the maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that a fit reads at most, smallest hash of the page first.
SAMPLE = 2000
WORD_SCORE = 1.0
LINKED_SCORE = 0.25
DROPPED_TAG = 0.25
TAG_SCORES = (0.05, 4.0)
PRIOR = 3.0
NAMED_PRIOR = 0.5

# HTML element names and the words by which pages name their parts.
BLOCKS = "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = "script style noscript template textarea svg iframe".split()
ENDLESS = "script style".split()
HEAD_PARTS = "base basefont bgsound head html link meta noscript script style template title".split()
DROPPED = "head nav aside footer form button select dialog menu".split()
DROPPED_WORDS = "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus notice notices cookie cookies consent newsletter subscribe signup login share sharing social related recommended popup modal widget pagination pager toolbar skip".split()
MAIN_WORDS = "article main".split()

_TOKEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(%s)(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+|<)" % "|".join(RAW))
_ATTRIBUTE = re.compile(r"""(?s)([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_NAMING = frozenset(("class", "id", "role"))
_MARK = re.compile(r"[a-z]+")
_BLOCKS, _VOID, _DROPPED, _DROPPED_WORDS, _MAIN = map(frozenset, (BLOCKS, VOID, DROPPED, DROPPED_WORDS, MAIN_WORDS))
_P_ENDS = _BLOCKS - {"body", "html", "head"}
_HEAD_PARTS = frozenset(HEAD_PARTS)
_NAMED_COSTS = {"." + w: NAMED_PRIOR for w in DROPPED_WORDS}


class Token:
    """A tag or a run of text, with the element around it."""

    __slots__ = ("block", "element", "text", "words")

    def __init__(self, element, text=None, block=False):
        self.text, self.block = text, block
        self.element = element
        self.words = len(text.split()) if text is not None else 0


class Element:
    """An element; ``boilerplate`` are those whose name or class, id or role as a whole says that they are no content."""

    __slots__ = ("barrier", "boilerplate", "dropped", "holds_main", "linked", "main", "marks", "name", "parent", "words")

    def __init__(self, name: str, marks: tuple[str, ...], parent: Element | None, named: bool = False):
        self.name, self.marks, self.parent = name, marks, parent
        header = name == "header" and not (parent and parent.main)
        self.boilerplate = name in _DROPPED or header or (named and name not in ("html", "body"))
        self.main = bool(parent and parent.main) or name in _MAIN
        self.linked = bool(parent and parent.linked) or name == "a"
        self.dropped, self.holds_main, self.words = False, name in _MAIN, 0
        #: The nearest paragraph or block, itself included: an open paragraph that a new block ends, if it is one.
        self.barrier = self if name == "p" or name in _BLOCKS or not parent else parent.barrier


def _names(attributes: str) -> tuple[list[str], bool]:
    """The words of class, id and role as marks, and whether one of these names has only words of DROPPED_WORDS."""
    words, named = set(), False
    for a in _ATTRIBUTE.finditer(attributes):
        if (a[1] or "").lower() not in _NAMING:
            continue
        for whole in (a[2] or a[3] or a[4] or "").lower().split():
            parts = _MARK.findall(whole)
            words.update(parts)
            named = named or bool(parts) and _DROPPED_WORDS.issuperset(parts)
    return sorted("." + w for w in words), named


def _drop(elements: list[Element], found: list[Token]) -> None:
    """Sets ``dropped``: boilerplate, but for elements that are or hold a main element or most of the page's words.

    ``elements`` are in page order.  Heads are always dropped.
    """
    total = 0
    for t in found:
        if t.words:
            t.element.words += t.words
            total += t.words
    for e in reversed(elements):
        if e.parent and e.name != "head":
            e.parent.words += e.words
            e.parent.holds_main = e.parent.holds_main or e.holds_main
        elif e.parent:
            total -= e.words
    for e in elements:
        kept = e.name != "head" and (e.holds_main or 2 * e.words > total)
        e.dropped = bool(e.parent and e.parent.dropped) or (e.boilerplate and not kept)


def raw_end(page: str, name: str, attributes: str, at: int, missing: set[str]) -> int:
    """Where a raw element ends whose start tag ends at ``at``.

    Without an end tag, scripts and styles go on to the end of the page and others
    are empty, as are self-closed ones that are no scripts or styles.  ``missing`` keeps
    the names that have no end tag in the rest of the page.
    """
    closed = attributes.endswith("/")
    if closed and name not in ENDLESS:
        return at
    end = None if name in missing else re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*>").search(page, at)
    if end:
        return end.end()
    missing.add(name)
    return len(page) if name in ENDLESS and not closed else at


def tokens(page: str) -> list[Token]:
    """Tags and runs of text of a page in order; comments and what scripts and styles hold are left out.

    Markup may be broken: an end tag closes the nearest open element of its name,
    and is passed over if there is none; a block ends an open paragraph, and what no
    head may hold ends an open head.
    """
    out, elements = [], []
    top, head, at, missing = Element("", (), None), None, 0, set()
    still_open: Counter = Counter()  # names of top and what it stands in: an end tag without a start is passed over at once

    def closed(e: Element) -> Element:
        """What stands around e, when e and all that is open in it end."""
        x = top
        while x is not e.parent:
            still_open[x.name] -= 1
            x = x.parent
        return x

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        raw, raw_attributes, slash, name, attributes, text = m.groups()
        if text is not None:
            if head is top and text.strip():
                top, head = closed(head), None
            out.append(Token(top, text))
        elif name:
            name = name.lower()
            if slash:
                e = top
                while still_open[name] and e.name != name:
                    e = e.parent
                if still_open[name]:
                    out.append(Token(e, None, name in _BLOCKS))
                    top = closed(e)
                    head = None if e.name in ("head", "html") else head
                continue
            if head and name not in _HEAD_PARTS:
                e = top
                while e.parent and e is not head:
                    e = e.parent
                top, head = closed(head) if e is head else top, None
            if name in _P_ENDS and top.barrier.name == "p":
                top = closed(top.barrier)
            marks, named = _names(attributes) if attributes else ((), False)
            e = Element(name, (name, *marks), top, named)
            elements.append(e)
            out.append(Token(e, None, name in _BLOCKS))
            if name not in _VOID and not attributes.endswith("/"):
                top = e
                still_open[name] += 1
                head = e if name == "head" else head
            elif name == "br":
                out.append(Token(top, " "))
        elif raw:
            at = raw_end(page, raw.lower(), raw_attributes, at, missing)
            out.append(Token(top, " "))
    _drop(elements, out)
    return out


def mark_counts(page: str) -> Counter:
    """(mark, whether it is in the labelled content) -> tags; nothing for pages that name no main element.

    A page labels itself when it has an article or main element: what that holds
    is content.  Dropped parts (menus, adverts, scripts) teach nothing, on either
    side: their tags always take off DROPPED_TAG.
    """
    found = tokens(page)
    if not any(t.element.main for t in found):
        return Counter()
    taught = (t.element for t in found if t.text is None and t.element.name not in _MAIN and not t.element.dropped)
    return Counter((m, e.main) for e in taught for m in e.marks)


def tag_costs(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """What a tag with a mark takes off: the more, the more of its tags lie outside content; TAG_SCORES bounds it."""
    lo, hi = TAG_SCORES
    total = {c: sum(n for (_, x), n in counts.items() if x == c) + 1 for c in (True, False)}
    odds = {m: math.log((counts.get((m, False), 0) + 0.5) / total[False]) - math.log((counts.get((m, True), 0) + 0.5) / total[True]) for m, _ in counts}
    return {m: min(hi, max(lo, x)) for m, x in odds.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous part of the largest sum above 0, the first of equals; one pass."""
    best = total = 0.0
    first, region = 0, (0, 0)
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, first = 0.0, i + 1
        elif total > best:
            best, region = total, (first, i + 1)
    return region


def main_text(page: str | None, costs: dict[str, float]) -> str:
    """The blocks of the best region, joined by a newline.

    A word scores WORD_SCORE, in a link LINKED_SCORE and in a part that is dropped
    nothing; a tag takes off the largest cost of its marks, in a dropped part
    DROPPED_TAG.  A mark that no sample taught costs NAMED_PRIOR if it is a word of
    DROPPED_WORDS.  One scan finds the contiguous tokens of the
    largest sum; of equal sums the first.
    """
    found = tokens(page or "")
    default = TAG_SCORES[0] * PRIOR
    costs = _NAMED_COSTS | costs

    def score(t: Token) -> float:
        e = t.element
        if t.text is not None:
            return 0.0 if e.dropped else t.words * (LINKED_SCORE if e.linked else WORD_SCORE)
        return -DROPPED_TAG if e.dropped else -max(costs.get(m, default) for m in e.marks)

    start, end = best_region([score(t) for t in found])
    blocks, part = [], []
    for t in found[start:end]:
        if t.block:
            blocks.append("".join(part))
            part = []
        elif t.text is not None and not t.element.dropped:
            part.append(t.text)
    blocks.append("".join(part))
    lines = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def learn_costs(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Tag costs from SAMPLE different pages at most that label themselves; without any, all tags cost the same.

    Only hashes are sorted to draw the sample; pages stay where they are.
    """
    page = F.col(html_col).cast("string")
    labelled = pages.select(page.alias("html")).where(F.col("html").rlike("(?i)<(article|main)\\b"))
    drawn = labelled.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    sample = labelled.where(F.xxhash64("html") <= F.lit(drawn))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for x in b["html"].to_pylist():
                total.update(mark_counts(x))
        keys = sorted(total)
        yield pa.RecordBatch.from_pydict({"mark": pa.array([k[0] for k in keys], pa.string()), "content": pa.array([k[1] for k in keys], pa.bool_()), "n": pa.array([total[k] for k in keys], pa.int64())})

    rows = sample.mapInArrow(count, "mark string, content boolean, n long").groupBy("mark", "content").agg(F.sum("n").alias("n"))
    return tag_costs({(r["mark"], r["content"]): r["n"] for r in rows.collect()})


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of the whole page.

    Character references are decoded, white space in a block becomes one space, and
    blocks are joined in page order by a newline.  Null and empty pages, and pages
    without words, have an empty text.  Broken and very long pages are read to the
    end.  Repeated rows are extracted one by one; a column ``text`` of ``pages`` gives way.
    """
    costs = learn_costs(pages, html_col)

    @F.pandas_udf("string")
    def text(column):
        return column.map(lambda x: main_text(x, costs))

    return pages.withColumn("text", text(F.col(html_col).cast("string")))


def op9(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
