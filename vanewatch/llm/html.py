"""Main text of web pages by a maximum-scoring run of their words and tags.

A page is read as a line of tokens. Words score positive, tags negative; the main text is the
contiguous run with the largest sum, found in one scan. How much a tag costs is learned: pages
that mark their content with ``article`` or ``main`` serve as labelled pages, and a tag costs the
more the more often it stands outside the marked content. Elements that are never content
(scripts, menus, adverts, comments and the like) are left out, also inside the run. A form or an element
told by its class or id only stays if it wraps the article: if it holds ``article`` or ``main``, or,
on a page without these, most of the page's words.

Weights come from at most ``SAMPLE_PAGES`` labelled pages, chosen by hash; every page is
extracted whole, in its own task, without a shuffle.

Defined results: a null or empty page gives an empty text; markup that is never closed reaches
to the end of its parent; ``br`` is white space; a page without words gives an empty text;
repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 2000
WORD_SCORE = 1.0
#: What any tag costs at least, and what one costs that only stands outside of content.
LEAST_COST, MOST_COST = 0.01, 4.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object canvas".split())
#: Of these, the ones whose content is markup, so that they may hold one another.
NESTING = frozenset("template svg object canvas".split())
DROPPED = RAW | frozenset("head nav header footer aside button select dialog menu".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTENT = frozenset(("article", "main"))
#: All that may stand in a head; anything else ends it.
IN_HEAD = VOID | RAW
#: Words after these in one class name say what the element is or is not beside.
BESIDE = frozenset("has have no non not with without".split())
#: Words in a class or id, and roles, that mark an element as something other than the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pagination pager popup promo promotion related recommended "
    "share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset(
    "banner navigation complementary contentinfo search form dialog alert alertdialog menu "
    "menubar toolbar".split()
)

NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
TAG_STOP = re.compile(r"[>\"']")
UNQUOTED_END = re.compile(r"=\s*[^\s\"']*/\Z")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
PART = re.compile(r"[a-z]+")


def _marks(page: str, resume: list[int]) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", lower-case name, rest) of each tag; no name for comments and the like.

    One pass: a ``<`` that no ``>`` follows is text, a comment without an end takes the rest. Where
    a quote is never closed, tags from there on end at their first ``>``. A reader that skips raw
    content puts the place to go on from into ``resume``.
    """
    at, last, loose = 0, page.rfind(">"), False
    while True:
        start = page.find("<", max(at, resume[0]))
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", "", ""
            continue
        if start > last:
            at = start + 1
            continue
        if page[start + 1] in "!?":
            at = page.find(">", start) + 1
            yield start, at, "", "", ""
            continue
        name = NAME.match(page, start + 1)
        if not name:
            at = start + 1
            continue
        end = name.end()
        while not loose:
            stop = TAG_STOP.search(page, end)
            if stop and stop.group() == ">":
                end = stop.start()
                break
            closed = page.find(stop.group(), stop.end()) if stop else -1
            loose = closed < 0
            end = closed + 1
        if loose:
            end = page.find(">", name.end())
        at = end + 1
        yield start, at, name.group(1), name.group(2).lower(), page[name.end() : end]


def _raw_end(page: str, name: str, at: int) -> int:
    """Where a raw element that began before ``at`` ends, with those of its kind inside it."""
    depth = 1
    for tag in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        if tag.group(1):
            depth -= 1
        elif name in NESTING and not tag.group().endswith("/>"):
            depth += 1
        if not depth:
            return tag.end()
    return len(page)


def _aside(name: str, rest: str) -> bool:
    """Is this element something other than the article, whatever it is called."""
    if name in DROPPED:
        return True
    if not rest or name in ("html", "body", "article", "main"):
        return False
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key == "role" and value.strip() in ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
    return False


def _called_aside(rest: str) -> bool:
    """Do class or id call this element something other than the article."""
    for key, *values in ATTRIBUTE.findall(rest):
        if key.lower() in ("class", "id"):
            for called in "".join(values).lower().split():
                parts = PART.findall(called)
                if not MARKS.isdisjoint(parts) and BESIDE.isdisjoint(parts):
                    return True
    return False


def _wrappers(page: str) -> set[int]:
    """Where elements begin that are called aside but wrap the article."""
    called: dict[int, list] = {}  # words, holds content, may hold it
    total, content = 0, False
    for kind, value, inside, around in _read(page, None):
        if kind == "text":
            n = len(value.split())
            total += n
            for at in around:
                called[at][0] += n
        elif kind == "called":
            called[int(value)] = [0, False, not inside]
        elif kind == "open" and value in CONTENT:
            content = True
        elif kind == "content":
            for at in around:
                called[at][1] = True
    return {
        at for at, (n, holds, may) in called.items() if may and (holds or not content and 2 * n > total)
    }


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, value, inside marked content) for kinds ``text``, ``open`` and ``close``.

    What is never content is skipped with all it holds.
    """
    for kind, value, inside, _ in _read(page, _wrappers(page)):
        yield kind, value, inside


def _read(page: str, spared: set[int] | None) -> Iterator[tuple[str, str, bool, tuple[int, ...]]]:
    """``tokens``, without elements called aside that do not begin in ``spared``.

    If that is None they are all read, and announced by the kind ``called``; ``content`` then stands
    for an article that is not called aside. The last value holds the places of those around.
    """
    stack: list[str] = []
    marked = 0
    skip = 0  # depth of the stack at which the skipped element sits
    around: list[tuple[int, int]] = []  # depth and place of elements called aside
    at, size, resume = 0, len(page), [0]
    for start, end, closing, name, rest in chain(_marks(page, resume), [(size, size, "", "", "")]):
        if start > at and not skip:
            yield "text", page[at:start], marked > 0, tuple(p for _, p in around)
        at = end
        if not name:
            continue
        if closing:
            if name not in stack:
                continue
            while True:
                top = stack.pop()
                while around and len(stack) < around[-1][0]:
                    around.pop()
                if top in CONTENT:
                    marked -= 1
                if skip and len(stack) < skip:
                    skip = 0
                elif not skip:
                    yield "close", top, marked > 0 or top in CONTENT, ()
                if top == name:
                    break
            continue
        if skip and stack[skip - 1] == "head" and name not in IN_HEAD:
            del stack[skip - 1 :]
            skip = 0
        closes_itself = name in ("svg", "math") and rest.endswith("/") and not UNQUOTED_END.search(rest)
        if name in VOID or closes_itself:
            if not skip:
                yield "open", name, marked > 0, ()
            continue
        if name in RAW:
            at = resume[0] = _raw_end(page, name, at)
            continue
        if stack and (stack[-1] == name and name in ("p", "li", "dt", "dd", "tr", "td", "th", "option")):
            stack.pop()
            while around and len(stack) < around[-1][0]:
                around.pop()
            if len(stack) < skip:
                skip = 0
        inside = marked > 0
        if name in CONTENT:
            marked += 1
        stack.append(name)
        if not skip:
            called = name == "form" or bool(rest) and name not in ("html", "body") and _called_aside(rest)
            if _aside(name, rest) or called and name not in CONTENT and spared is not None and start not in spared:
                skip = len(stack)
                continue
            if spared is None and name in CONTENT and not called:
                yield "content", name, True, tuple(p for _, p in around)
            elif spared is None and called and name not in CONTENT:
                around.append((len(stack), start))
                yield "called", str(start), inside, ()
            yield "open", name, marked > 0, ()


def tag_counts(page: str | None) -> dict[str, list[int]]:
    """[inside, outside] of each tag, on a page that marks its content; else nothing."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    labelled = False
    for kind, value, inside in tokens(page or ""):
        if kind != "text":
            labelled |= inside
            counts[value][0 if inside else 1] += 1
    return counts if labelled else {}


def learn_costs(pages: DataFrame, most: int = SAMPLE_PAGES) -> dict[str, float]:
    """Cost of each tag from at most about ``most`` labelled pages, whatever the table's size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for page in batch["html"]:
                for tag, (a, b) in tag_counts(page).items():
                    total[tag][0] += a
                    total[tag][1] += b
            yield pd.DataFrame(
                [(t, a, b) for t, (a, b) in total.items()], columns=["tag", "inside", "outside"]
            )

    n = pages.count()
    share = min(1.0, most / n) if n else 1.0
    chosen = pages.select("html").where(
        F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    )
    seen = (
        chosen.mapInPandas(count, "tag string, inside long, outside long")
        .groupBy("tag")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "tag")
        .limit(500)
        .collect()
    )
    costs = {}
    for row in seen:
        outside = (row["outside"] + 0.0) / (row["inside"] + row["outside"] + 1.0)
        costs[row["tag"]] = LEAST_COST + (MOST_COST - LEAST_COST) * outside
    return costs


def main_text(page: str | None, costs: dict[str, float]) -> str:
    """The text of the best run of tokens."""
    best, best_run = 0.0, (0, 0)
    score, begin = 0.0, 0
    line = [(kind, value) for kind, value, _ in tokens(page or "")]
    for i, (kind, value) in enumerate(line):
        if kind == "text":
            n = len(value.split())
            if score <= 0:
                score, begin = 0.0, i
            score += n * WORD_SCORE
            if score > best:
                best, best_run = score, (begin, i + 1)
        else:
            score -= costs.get(value, LEAST_COST)
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        words = unescape("".join(parts)).split()
        if words:
            blocks.append(" ".join(words))
        parts.clear()

    for kind, value in line[best_run[0] : best_run[1]]:
        if kind == "text":
            parts.append(value)
        elif value == "br":
            parts.append(" ")
        elif value not in INLINE:
            flush()
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, most: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    costs = learn_costs(pages, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page, costs) for page in batch["html"]]
            yield pd.DataFrame({
                "page_id": batch["page_id"], "url": batch["url"], "text": texts,
                "n_chars": [len(t) for t in texts],
            })

    return pages.select("page_id", "url", "html").mapInPandas(
        run, "page_id long, url string, text string, n_chars long"
    )
