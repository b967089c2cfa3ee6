"""Main text of web pages by line-block distribution.

Markup is stripped into lines: block-level tags end a line, inline tags leave no trace, character references are decoded
and white space becomes single spaces.  Every line has a length that counts: the length of its text, or 0 if it stands in
a menu, header, footer, sidebar, form, notice, advert or reader comment, or if it is mostly links, or, on pages that mark
their article, if it stands outside.  Lengths are summed over sliding windows of ``WINDOW`` lines.  The text surges where
a sum reaches the threshold and dives where the sums fall to zero; the lines that count between these points are the main
text, joined by single spaces.

Pages are independent rows: no shuffle, and memory for one batch of pages.  Null pages and pages without text give the
empty text.  Broken tags and cut-off pages are read as far as they go; nothing is capped.  Only scripts, styles and
comments run to the end where they aren't closed; other elements without text (``_DROPPED``) are plain tags then, and
self-closed ones are empty.  A head ends at its closing tag or at the first tag or text that can't stand in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Characters in a window at which text surges on pages that don't mark their article.
SURGE = 80
LINK_SHARE = 0.6

_NAME = r"[a-zA-Z][^\s/>]*"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|canvas|head|title|textarea|select|button)(?=[\s/>])([^>]*)>"
    rf"|<(/?)({_NAME})((?:\s+[^\s=>\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']*))?)*\s*/?)>"
    rf"|</?{_NAME}[^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
_NESTING = frozenset("template svg math object canvas".split())
_DROPPED = frozenset("script style noscript template svg math iframe object canvas head title textarea select button".split())
_OF_HEAD = frozenset("title meta link base basefont bgsound script style noscript template".split())
_ENDS = {n: re.compile(rf"<(/?){n}(?=[\s/>])[^>]*>", re.I) for n in _DROPPED}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav footer aside form menu dialog".split())
_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar".split())
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "sidebar sidenav nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar comment comments disqus reply replies share sharing social related recommended "
    "newsletter subscribe subscription signup login pagination pager toolbar widget search skip copyright".split()
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']*)))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def _is_aside(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element holds something else than the article."""
    if name in _ASIDE or (name == "header" and not in_article):
        return True
    if name in ("html", "body", "main") or not attributes.strip():
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next(filter(None, values), "")
        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id"):
            words = {w.lower() for w in _PARTS.findall(value)}
            if words & _HINTS or (not in_article and "header" in words and name != "article"):
                return True
    return False


class _Ends:
    """Where the elements of a page that are dropped whole end."""

    def __init__(self, page: str) -> None:
        self.page, self.known = page, {}

    def _closings(self, name: str) -> dict[int, int]:
        """Ends of opening tags -> ends of the elements, of those that are closed; found once for all elements of a name."""
        if name not in self.known:
            closed: dict[int, int] = {}
            open_at: list[int] = []
            for tag in _ENDS[name].finditer(self.page):
                if not tag[1]:
                    if not tag[0].endswith("/>"):
                        # Elements that can't hold their like: one that is open before is never closed.
                        if name not in _NESTING:
                            open_at.clear()
                        open_at.append(tag.end())
                elif open_at:
                    closed[open_at.pop()] = tag.end()
            self.known[name] = closed
        return self.known[name]

    def of(self, name: str, attributes: str, at: int) -> int | None:
        """Where the element whose opening tag ends at ``at`` ends; None if it is never closed."""
        empty = attributes.rstrip().endswith("/")
        if name in ("script", "style"):
            end = next((t for t in _ENDS[name].finditer(self.page, at) if t[1] or empty), None)
            # Scripts ignore the slash, unless no closing tag is meant for them.
            return end.end() if end and end[1] else at if empty else len(self.page)
        return at if empty else self.head(at) if name == "head" else self._closings(name).get(at)

    def head(self, at: int) -> int:
        """Where a head ends: after its closing tag, or before what can't stand in it."""
        text = None
        for_title = False
        while tag := _TAG.search(self.page, at):
            if text is None and not for_title and self.page[at : tag.start()].strip():
                text = at
            raw, name = (tag[1] or "").lower(), (tag[4] or "").lower()
            for_title = False
            if name == "head" and tag[3]:
                return tag.end()
            if (raw and raw not in _OF_HEAD) or (name and name not in _OF_HEAD):
                return tag.start() if text is None else text
            at = tag.end()
            if raw:
                end = self.of(raw, tag[2], at)
                at, for_title = (at, raw == "title") if end is None else (end, False)
        if text is None and not for_title and self.page[at:].strip():
            text = at
        return len(self.page) if text is None else text


def page_lines(page: str) -> list[tuple[str, bool, int, float]]:
    """The lines of a page: text, whether it stands aside, number of its article (0: none), share of it in links."""
    return _lines_and_mains(page)[0]


def _lines_and_mains(page: str) -> tuple[list[tuple[str, bool, int, float]], dict[int, int]]:
    """The lines of a page, and the number of the main element that an article stands in."""
    lines: list[tuple[str, bool, int, float]] = []
    parts: list[str] = []
    regions: list[tuple[str, int]] = []
    mains: dict[int, int] = {}
    ends = _Ends(page)
    links = article = articles = 0
    in_link, aside, nested, at = False, "", 0, 0

    def end_line() -> None:
        nonlocal links
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            lines.append((text, bool(aside), article, min(1.0, links / len(text))))
        parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        parts.append(raw)
        if in_link:
            links += len(raw.strip())

    while tag := _TAG.search(page, at):
        if tag.start() > at:
            add(page[at : tag.start()])
        at = tag.end()
        if tag[1]:
            end = ends.of(tag[1].lower(), tag[2], at)
            if end is None:
                end_line()
            else:
                at = end
            continue
        name = (tag[4] or "").lower()
        if not name:
            continue
        closing = bool(tag[3])
        if name == "a":
            in_link = not closing
        if name not in _INLINE:
            end_line()
        if aside:
            if name == aside:
                nested += -1 if closing else not tag[5].rstrip().endswith("/")
                if nested == 0:
                    end_line()
                    aside = ""
            elif name in ("article", "main") and not closing and not _closes(page, at, aside, nested):
                aside = ""
            if aside:
                continue
        if name in ("article", "main"):
            if closing:
                # Closes the innermost open element of that name and what is left open inside it.
                while any(n == name for n, _ in regions) and regions.pop()[0] != name:
                    pass
                article = regions[-1][1] if regions else 0
            elif _is_aside(name, tag[5], False):
                aside, nested = name, 1
            else:
                if all(n == "main" for n, _ in regions):
                    articles += 1
                    if regions:
                        mains[articles] = article
                    article = articles
                regions.append((name, article))
        elif not closing and name not in _VOID and _is_aside(name, tag[5], article > 0):
            if not tag[5].rstrip().endswith("/"):
                if name in _INLINE:
                    end_line()
                aside, nested = name, 1
    rest = page[at:]
    # A tag cut off at the end of the page is no text.
    cut = re.search(rf"<(?:/?{_NAME}[^<>]*|[!?/][^<>]*)?\Z", rest)
    add(rest[: cut.start()] if cut else rest)
    end_line()
    return lines, mains


def _closes(page: str, at: int, name: str, nested: int) -> bool:
    """Whether the open element still gets its closing tag."""
    for tag in re.finditer(rf"<(/?){name}\b", page[at:], re.I):
        nested += -1 if tag[1] else 1
        if nested == 0:
            return True
    return False


def main_text(page: str) -> str:
    """The main text of one page."""
    lines, mains = _lines_and_mains(page)
    sizes: dict[int, int] = {}
    for text, aside, article, _ in lines:
        if article and not aside:
            sizes[article] = sizes.get(article, 0) + len(text)
    # The article with the most text, the first of equals; what stands around it in main elements goes with it.
    chosen = max(set(sizes) - {mains[a] for a in sizes if a in mains}, key=lambda a: (sizes[a], -a), default=0)
    inside = {chosen}
    while (outer := mains.get(min(inside))) is not None:
        inside.add(outer)
    counts = []
    for text, aside, article, linked in lines:
        out = aside or (article not in inside if chosen else linked > LINK_SHARE)
        counts.append(0 if out else len(text))
    least = 1 if chosen else SURGE
    kept, surged = [], False
    for i, (text, *_) in enumerate(lines):
        # Blocks that hold this line: the text surges if one of them is heavy enough, and dives where none has text.
        sums = [sum(counts[max(0, j) : j + WINDOW]) for j in range(i - WINDOW + 1, i + 1)]
        surged = any(s >= least for s in sums) or (surged and any(sums))
        if surged and counts[i]:
            kept.append(text)
    if not kept and not chosen:
        # No block is heavy: a short page is its own main text.
        kept = [text for (text, *_), n in zip(lines, counts) if n]
    return " ".join(kept)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` to ``page_id`` and ``url``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) if p else "" for p in batch.column("page").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(page).alias("page"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
