"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines: one per block of text, with blank lines where
elements that lay out the page begin or end. Elements that are no article (menus,
forms, adverts, comments and the like) leave blank lines only. The text lengths
of sliding windows of lines are summed; text surges where the sums rise from
nothing and dives where they fall back, and what lies between is kept.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.text import row_wise

WINDOW = 3  # lines summed
SURGE = 86  # characters of a window that mark an article for sure
SHARE = 0.2  # of the largest stretch's length, for further stretches of a page without marks

# Elements whose content is no text, elements that are no article, and blocks.
RAW = "script style template title textarea select iframe object svg math noscript noframes noembed canvas".split()
APART = set("nav header footer aside form menu dialog button audio video map".split())
WIDE = APART | set("html body main article section table ul ol dl hr fieldset".split())
BLOCKS = WIDE | set("div p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre address center "
                    "figure figcaption details summary legend hgroup search".split())
VOID = set("br hr img input meta link area base col embed source track wbr param".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Parts of class names and ids.
APART_NAMES = set(
    "nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs crumbs topbar toolbar masthead header footer "
    "sidebar aside rail comment comments commentlist disqus respond replies reply cookie cookies consent gdpr notice notices "
    "notification banner alert popup modal overlay ad ads advert adverts advertisement advertising adsense sponsor sponsored "
    "promo promotion social share sharing sharebar related recommended recommendations teaser newsletter subscribe "
    "subscription signup login search widget widgets pagination pager pagenav skip copyright legal disclaimer form".split())
TITLE_NAMES = set("article entry post page story content title".split())
MAIN_NAMES = set("article post entry story content main".split())
STATES = set("has no not with without is hide show open".split())

_ATTRIBUTES = r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    rf"|<({'|'.join(RAW)})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:/>|>.*?(?:</\1\s*+[^>]*+(?:>|\Z)|\Z))"
    rf"|<(/?)([a-z][^\s/>]*+){_ATTRIBUTES}"
    r"|<(/?)([a-z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.I | re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_RIGHTS = re.compile(r"\s*(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)


def _standing(name: str, attributes: str, level: int) -> tuple[bool, int]:
    """Whether an element is no article, and the mark of its text: 2 in an article, 1 in main content, 0 else."""
    mark = max(level, {"article": 2, "main": 1}.get(name, 0))
    apart = name in APART
    if name in ("header", "hgroup") and level == 2:
        apart = False  # the heading of an article
    if not attributes or name in ("html", "body"):
        return apart, mark
    for key, value in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        for word in value.strip("\"'").split():
            if key == "role":
                apart |= word.lower() in ROLES
                mark = max(mark, {"main": 1, "article": 2}.get(word.lower(), 0))
                continue
            parts = [p.lower() for p in _PARTS.findall(word)]
            if key == "itemprop":
                mark = max(mark, 2 * (word.lower() == "articlebody"))
                continue
            if not parts or parts[0] in STATES:
                continue
            known = APART_NAMES.intersection(parts)
            if known and not (known == {"header"} and TITLE_NAMES.intersection(parts)):
                apart |= name != "main"
            elif parts[0] in MAIN_NAMES and name in BLOCKS and name != "p":
                mark = max(mark, 1)
    return apart, mark


def page_lines(page: str) -> list[tuple[str, int, int, int]]:
    """The lines of a page that may be article: text, characters outside links, mark, blank lines before.

    A line that is mostly links has no characters that count. Marked pages give the lines of their strongest mark only.
    """
    lines: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, bool, int]] = []  # name, no article, mark
    parts: list[str] = []
    apart, mark, linked, in_links, blank = False, 0, 0, 0, WINDOW

    def end_line(blanks: int) -> None:
        nonlocal parts, in_links, blank
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append((text, len(text) - in_links if 2 * in_links < len(text) else 0, mark, blank))
                blank = 0
            parts, in_links = [], 0
        blank = max(blank, blanks)

    def leave(depth: int) -> None:
        nonlocal apart, mark, linked
        for name, _, _ in stack[depth:]:
            linked -= name == "a"
        del stack[depth:]
        apart, mark = stack[-1][1:] if stack else (False, 0)

    def opened(name: str) -> int:
        """The depth of the innermost open element `name`, -1 if there is none."""
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at and not apart:
            text = page[at:token.start()]
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            in_links += len(text) if linked else 0
        at = token.end()
        name = token[3] or token[6]
        if not name:
            continue
        name, closing = name.lower(), bool(token[2] or token[5])
        block = name in BLOCKS
        if block:
            end_line(WINDOW if name in WIDE else int(name == "div"))
        elif name == "br" and not apart:
            parts.append(" ")
        if closing:
            depth = opened(name)
            if depth >= 0:
                leave(depth)
            continue
        if block and stack and stack[-1][0] == "p":
            leave(len(stack) - 1)
        if name == "a" and (depth := opened("a")) >= 0:
            leave(depth)
        attributes = token[4] or token[7] or ""
        if name in VOID or attributes.endswith("/") and not block:
            continue
        if not (block or name in ("a", "span")) and "=" not in attributes:
            continue  # plain inline markup says nothing of the layout
        no_article, new_mark = _standing(name, attributes, mark)
        if no_article and not apart:
            end_line(WINDOW if block else 0)
        stack.append((name, apart or no_article, new_mark))
        apart, mark = stack[-1][1:]
        linked += name == "a"
    if not apart:
        rest = page[at:]
        parts.append(html.unescape(rest))
        in_links += len(rest) if linked else 0
    end_line(0)
    best = max((m for _, _, m, _ in lines), default=0)
    return [line for line in lines if line[2] == best] if best else lines


def kept_lines(weights: np.ndarray, blanks: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Which lines lie between a surge and its dive; lines of all pages in order, `page` their owner."""
    if not len(weights):
        return np.zeros(0, bool)
    first = np.concatenate([[True], page[1:] != page[:-1]])
    at = np.cumsum(np.where(first, WINDOW, blanks) + 1) - 1
    dense = np.zeros(int(at[-1]) + WINDOW + 1, np.int64)
    dense[at] = weights
    upto = np.concatenate([[0], np.cumsum(dense)])
    block = upto[WINDOW:] - upto[:-WINDOW]  # of the lines i to i + WINDOW - 1
    full = np.concatenate([[False], block > 0, [False]])
    surge = np.flatnonzero(full[1:] & ~full[:-1])
    dive = np.flatnonzero(full[:-1] & ~full[1:])
    if not len(surge):
        return np.zeros(len(weights), bool)
    peak = np.maximum.reduceat(block, np.stack([surge, dive], 1).ravel())[::2]
    total = upto[dive] - upto[surge]  # the last line of weight is the one before the dive
    owner = page[np.searchsorted(at, surge + WINDOW - 1)]
    pages, inverse = np.unique(owner, return_inverse=True)
    most, high = np.zeros(len(pages), np.int64), np.zeros(len(pages), np.int64)
    np.maximum.at(most, inverse, total)
    np.maximum.at(high, inverse, peak)
    good = (peak >= np.minimum(SURGE, high[inverse])) & (total >= SHARE * most[inverse])
    stretch = np.searchsorted(surge, at, side="right") - 1
    inside = (stretch >= 0) & (at >= surge[np.maximum(stretch, 0)] + WINDOW - 1) & (at < dive[np.maximum(stretch, 0)])
    return inside & good[np.maximum(stretch, 0)]


def main_texts(pages: list[str]) -> list[str]:
    """The main text of each page, its blocks joined by an empty line."""
    each = [page_lines(p) for p in pages]
    owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
    flat = [line for lines in each for line in lines]
    # Marked text is article however short it is; a line of rights alone never is.
    weights = np.array([free + SURGE * len(pages) if mark else 0 if _RIGHTS.match(text) else free
                        for text, free, mark, _ in flat], dtype=np.int64)
    marked = np.array([mark > 0 for _, _, mark, _ in flat], dtype=bool)
    keep = kept_lines(weights, np.array([blank for *_, blank in flat], dtype=np.int64), owner) | marked
    chosen: list[list[str]] = [[] for _ in each]
    for i in np.flatnonzero(keep):
        chosen[owner[i]].append(flat[i][0])
    return ["\n\n".join(c) for c in chosen]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html).

    Text is the article without menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles, markup and reader comments: blocks in page
    order, white space within one turned into one space, joined by an empty line.
    Pages with an article or main element, or a name that says as much, keep
    what is in it; others keep the stretches between surges and dives of their
    text. A null or empty page, or one without article, has an empty text of no
    characters; null ids and urls stay; repeated rows and pages of any length are
    taken one by one, whole; an empty table gives an empty result; other columns
    are ignored.
    """
    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts([h or "" for h in batch.column("html").to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(row_wise(extract, "html"), "page_id long, url string, text string, n_chars long")


# Holds for pages whose article is one article element of headings and paragraphs, as in the given tables; the
# operator is compared with hand-made pages of other kinds in the tests.
SQL = r"""
WITH cut AS (
  SELECT page_id, url, string_split_regex(regexp_replace(regexp_replace(
    regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1),
    '(?s)<!--.*?-->', '', 'g'), '<br>', ' ', 'g'), '</?(?:p|h1)>') AS parts
  FROM pages),
plain AS (
  SELECT page_id, url, list_transform(parts, lambda p: trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      p, '</?[a-z]+>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'),
    '\s+', ' ', 'g'))) AS parts
  FROM cut),
joined AS (
  SELECT page_id, url, array_to_string(list_filter(parts, lambda p: p <> ''), chr(10) || chr(10)) AS text FROM plain)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM joined
"""
