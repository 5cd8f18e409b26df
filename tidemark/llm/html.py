"""Main text of web pages by line-block distribution.

A page's markup is stripped to lines, one for each block element. Lines of boilerplate
(menus, page headers, footers, sidebars, notices, adverts, forms, comments) weigh nothing. The
weights are summed over sliding windows of lines. A surge is a line at which the sum rises
from zero, a dive one at which it is back at zero; the text from a surge to the next dive is
kept if some window in between is heavy enough.

Where a page marks articles, the lines inside and those outside compete by their text: if the
article isn't far the lighter, its lines weigh a heavy window more, and lines outside weigh
nothing; else it is taken for a teaser, and its lines weigh nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Lines in a window, and the text (code points) that makes a window heavy.
WINDOW = 3
HEAVY = 86
#: Text outside of articles by which they are teasers, as a multiple of the text inside.
TEASER = 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|noscript|template|iframe|textarea|select)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    # In drawings these may close themselves.
    r"|<(style|title)\b[^<>]*+(?<!/)>.*?(?:</\2\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)/?>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
#: A tag that the page's end cuts off: it has no end after it.
_CUT = re.compile(r"<[a-zA-Z]")
_BLOCK = frozenset("address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul video audio".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILERPLATE = frozenset("nav header footer aside form button dialog menu fieldset".split())
_CONTAINER = frozenset("article main".split())
#: A page's head may be left open: any other element ends it.
_HEAD = frozenset("base basefont bgsound head link meta noframes style title".split())
#: Elements whose class, id or role can make them boilerplate.
_NAMED = frozenset("div section ul ol dl p span table td aside header footer nav form article a h1 h2 h3 h4 h5 h6 li figure".split())
_NAME = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+")
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation navigator newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar toc widget complementary".split())
#: Of these, what can name a topic as well: boilerplate only alone or with words for parts of a page.
_TOPICS = frozenset("banner copyright disclaimer discussion header login menu navigator notice notices notification popup related replies reply respond search share sharing skip social tags toc widget".split())
_PARTS = frozenset("area articles bar block bottom box btn button buttons column container field fixed float footer form global grid group heading home icon icons inner input item items left link links list main meta mobile modal module news outer page panel posts primary right row secondary section site slot small stories sub tab the this title top unit user web wrap wrapper".split())
_CONTENT = frozenset("article body content entry main post story text".split())
_NEAR = frozenset("has is no not with without".split())
_COMMENTS = frozenset("comment comments discussion disqus replies reply respond related complementary".split())


def _named(attributes: str) -> str | None:
    """'comments', 'boilerplate' or None by the class, id and role of an element.

    A name with a word for content (article-text, content-ad-free) doesn't make boilerplate unless
    it ends in one for boilerplate (article-footer), nor does one that only states what is near
    (with-sidebar), nor one that names a topic (tags-history, search-results).
    """
    kind = None
    for m in _NAME.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = _WORDS.findall(name)
            if not words or words[0] in _NEAR or _CONTENT.intersection(words) and words[-1] not in _NAMES:
                continue
            found = _NAMES.intersection(words)
            if found <= _TOPICS and any(len(w) > 2 and w not in _NAMES and w not in _PARTS for w in words):
                continue
            if _COMMENTS.intersection(words):
                return "comments"
            if found:
                kind = "boilerplate"
    return kind


def lines_of(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, code points in links, inside an article) of each line, blank for boilerplate; has an article."""
    lines: list[tuple[str, int, bool]] = []
    text: list[str] = []
    linked = links = depth = articles = 0
    skip, closing = "", 0  # the open boilerplate element and how many of its name are open in it
    skip_comments = False
    at, found, in_head = 0, False, False
    if cut := _CUT.search(page, page.rfind(">") + 1):
        page = page[: cut.start()]

    def piece(a: int, b: int) -> str:
        s = page[a:b]
        return html.unescape(s) if "&" in s else s

    def end_line() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                lines.append((joined, linked, articles > 0))
            text.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        a, b = m.span()
        if a > at and not skip:
            s = piece(at, a)
            text.append(s)
            if links:
                linked += len(s.strip())
        at = b
        name = m[4] or m[7]
        if name is None:
            raw = (m[1] or m[2] or "script").lower()
            if in_head and raw in ("iframe", "textarea", "select"):
                in_head = False
            if raw not in ("script", "style") and not in_head:
                end_line()
            continue
        name, is_end, attributes = name.lower(), bool(m[3] or m[6]), m[5] or m[8] or ""
        if name == "head" and not skip:
            if not is_end:
                end_line()
            elif in_head:
                text.clear()  # what stands in a closed head isn't shown
                linked = 0
            in_head = not is_end
            continue
        if in_head and name not in _HEAD:
            in_head = False
            end_line()
        if skip:
            if skip in ("p", "li") and not is_end and (name == skip or skip == "p" and name in _BLOCK and name not in ("br", "button", "option")):
                skip = ""  # the next paragraph or block ends an open one
                lines.append(("", 0, False))
            elif name == skip:
                closing += -1 if is_end else 1
                if closing <= 0:
                    skip = ""
                    lines.append(("", 0, False))
            elif name in _CONTAINER and not is_end and not skip_comments and not (len(attributes) > 4 and _named(attributes)):
                skip = ""  # an article doesn't start inside a menu: the menu was left open
                lines.append(("", 0, False))
            if skip:
                continue
            if is_end and name not in _CONTAINER:
                continue
        if name in _BLOCK:
            end_line()
        if is_end:
            if name == "a":
                links = max(0, links - 1)
            elif name in _CONTAINER:
                articles = max(0, articles - 1)
            continue
        kind = None
        if name in _BOILERPLATE:
            kind = "boilerplate"
        elif len(attributes) > 4 and name in _NAMED:
            kind = _named(attributes) or ("boilerplate" if _HIDDEN.search(attributes) else None)
        if kind:
            end_line()
            skip, closing, skip_comments = name, 1, kind == "comments" or name == "aside"
            continue
        if name == "a":
            links = 1
        elif name in _CONTAINER:
            articles += 1
            found = True
    if at < len(page) and not skip:
        text.append(piece(at, len(page)))
    end_line()
    return lines, found


def main_text(page: str | None) -> str:
    """The main text of one page, '' if there is none."""
    if not page:
        return ""
    lines, article = lines_of(page)
    weights = [len(t) if 5 * linked < 4 * len(t) else 0 for t, linked, _ in lines]
    if article:
        inside = sum(len(t) for t, _, own in lines if own)
        outside = sum(w for w, (_, _, own) in zip(weights, lines, strict=True) if not own)
        if outside > TEASER * inside + HEAVY:
            weights = [0 if own else w for w, (_, _, own) in zip(weights, lines, strict=True)]
        else:
            weights = [len(t) + HEAVY if own and t else 0 for t, _, own in lines]
    # Sums over the windows that end at each line, WINDOW lines of nothing around.
    sums, total = [], 0
    padded = [*weights, *[0] * WINDOW]
    for i, w in enumerate(padded):
        total += w - (padded[i - WINDOW] if i >= WINDOW else 0)
        sums.append(total)
    heavy = min(HEAVY, max(sums, default=0))
    kept: list[str] = []
    surge = -1
    for i, s in enumerate(sums):
        if s and surge < 0:
            surge = i
        elif not s and surge >= 0:
            if heavy and max(sums[surge:i]) >= heavy:
                last = max(j for j in range(surge, min(i, len(weights))) if weights[j])
                kept += [t for (t, _, _), w in zip(lines[surge : last + 1], weights[surge : last + 1], strict=True) if w or t and not article]
            surge = -1
    return " ".join(kept)


_OUT = "page_id long, url string, text string, n_chars long"


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (columns page_id, url, html).

    A null or empty html, and one without any main text, gives '' and 0. Null ids and urls are
    carried through; repeated rows give repeated rows; the whole html is read, however long;
    an empty table gives an empty one; other columns are ignored. No shuffle.
    """
    small_batches(pages.sparkSession, 500)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, _OUT)
