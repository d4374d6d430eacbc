"""Main text of web pages by line-block distribution: markup is stripped to lines, text lengths are summed
over sliding windows of lines, and the text between the surge and the dive of that sum is kept."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window.
BLOCK = 3
#: Code points in a window that make a surge.
SURGE = 40
#: A line with a greater part of its text in links is a menu.
LINK_PART = 0.6

# possessive, so a tag is read once; quotes count after an equals sign only
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: Elements left out with all they hold, even to the end of the page, ...
_RAW = frozenset("script style noscript template textarea iframe title".split())
#: ... and those of which only the tag is left out if they are never closed.
_CLOSED = frozenset("select svg math object canvas audio video button datalist".split())
_END_OF = {x: re.compile(rf"</{x}(?![^\s/>])", re.IGNORECASE) for x in _RAW | _CLOSED}
_LONG_NUMBER = re.compile(r"&#0*+([0-9]{8,});?")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold the article's own text.
_OUTSIDE = frozenset("nav footer aside form menu dialog head fieldset".split())
_OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: Words in a class or id that name something beside the article, whatever else the name says ...
_OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr "
    "comment comments disqus replies nav navbar navigation menu breadcrumb breadcrumbs footer related "
    "recommended share sharing social newsletter subscribe signup popup modal paywall".split()
)
#: ... and those that may also be part of a wrapper's name.
_MAYBE_NAMES = frozenset("sidebar header masthead notice notices alert banner widget toolbar pagination pager tags meta login search".split())
_INSIDE_NAMES = frozenset("article body content entry main page post story text wrapper container".split())
_KEPT_ANYWAY = frozenset("html body main article".split())


def _outside(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _OUTSIDE or tag == "header" and not in_article:
        return True
    if not attributes or attributes.isspace():
        return False
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
        return True
    if given.get("role", "").lower() in _OUTSIDE_ROLES:
        return True
    names = {x.lower() for key in ("class", "id") for x in _PARTS.split(given.get(key, "")) if x}
    if tag in _KEPT_ANYWAY:
        return tag == "article" and bool(names & {"comment", "comments", "reply", "teaser", "related"})
    return bool(names & _OUTSIDE_NAMES) or bool(names & _MAYBE_NAMES and not names & _INSIDE_NAMES)


class Line:
    """A block's text: all of it, how much of it stands in links, and the article it stands in (0: none)."""

    __slots__ = ("parts", "linked", "article")

    def __init__(self, article: int):
        self.parts: list[str] = []
        self.linked = 0
        self.article = article

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _decoded(text: str) -> str:
    """With character references replaced; numbers beyond Unicode become U+FFFD, however long."""
    try:
        return html.unescape(text)
    except ValueError:
        return html.unescape(_LONG_NUMBER.sub("�", text))


def _tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before the tag, whether it closes, name, attributes) of every tag, then the text at the end with no name.

    Comments, declarations and elements left out with their content have no name. Every place is read a
    bounded number of times: searches that fail aren't made again, and where the quotes of the rest of the
    page don't pair up, tags end at the next bracket.
    """
    at = text_from = 0
    paired, unclosed = True, set()
    while (at := page.find("<", at)) >= 0:
        following = page[at + 1 : at + 2]
        if following in ("!", "?"):
            closing = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(closing, at + (4 if closing == "-->" else 2))
            yield page[text_from:at], False, "", ""
            at = text_from = end + len(closing) if end >= 0 else len(page)
            continue
        head = _TAG_NAME.match(page, at)
        if not head:  # a bracket in the text
            at += 1
            continue
        tag = _TAG.match(page, at) if paired else None
        paired = tag is not None
        end = tag.end() if tag else page.find(">", head.end()) + 1
        before, close, name = page[text_from:at], bool(head[1]), head[2].lower()
        attributes = page[head.end() : end - 1] if end else ""
        at = text_from = end or len(page)
        if not end:  # the page ends inside a tag
            yield before, False, "", ""
        elif close or name not in _END_OF or name in _CLOSED and (name in unclosed or attributes.endswith("/")):
            yield before, close, "" if name in _CLOSED else name, attributes
        else:
            yield before, False, "", ""
            over = _END_OF[name].search(page, at)
            if over:
                end = page.find(">", over.end())
                at = text_from = end + 1 if end >= 0 else len(page)
            elif name in _CLOSED:
                unclosed.add(name)
            else:
                at = text_from = len(page)
    yield page[text_from:], False, "", ""


def lines_of(page: str) -> list[Line | None]:
    """The page's lines in order; None marks where something beside the article was left out."""
    lines: list[Line | None] = []
    line = Line(0)
    skipped: list[str] = []  # open elements that are left out: the outermost and those of its name inside
    heading_only, articles, open_articles, links = 0, 0, [], 0

    def flush() -> None:
        nonlocal line
        if line.parts:
            lines.append(line)
        line = Line(open_articles[-1] if open_articles else 0)

    in_heading = False
    for text, closing, tag, attributes in _tokens(page):
        if text and not skipped and (not heading_only or in_heading):
            decoded = _decoded(text)
            line.parts.append(decoded)
            if links:
                line.linked += len(decoded.strip())
        if not tag:  # a comment, a declaration, or an element left out with its content
            continue
        if skipped:
            if closing and tag == skipped[0]:
                skipped.pop()
            elif not closing and tag == skipped[0] and not attributes.rstrip().endswith("/"):
                skipped.append(tag)
            elif tag == "main" and not closing or skipped[0] == "form" and tag == "article" and not closing:
                skipped.clear()
            elif skipped[0] == "p" and tag not in _INLINE and tag not in _VOID:
                skipped.clear()  # a paragraph ends where the next block begins
            if skipped:
                continue
            if closing:
                continue
        if not closing and tag not in _VOID and _outside(tag, attributes, bool(open_articles)):
            flush()
            lines.append(None)
            skipped = [tag]
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        elif tag == "br":
            line.parts.append(" ")
        elif tag not in _INLINE:
            flush()
            links = 0
            if tag in _HEADINGS:
                in_heading = not closing
            elif tag == "header" and open_articles:
                heading_only = max(0, heading_only + (-1 if closing else 1))
            elif tag in ("article", "main"):
                if not closing:
                    articles += 1
                    open_articles.append(articles)
                elif open_articles:
                    open_articles.pop()
                line.article = open_articles[-1] if open_articles else 0
                line.parts = []
    flush()
    return lines


def main_text(page: str | None) -> str:
    """The article's text, blocks joined by one space; '' if there is none."""
    if not page:
        return ""
    lines = [(x, x.text()) if x else None for x in lines_of(page)]
    marked = {}
    for x in lines:
        if x and x[0].article:
            marked[x[0].article] = marked.get(x[0].article, 0) + len(x[1])
    wanted: set[int] = set()  # the articles that a page is mostly about: in them links are text, too
    if any(marked.values()):
        first = min(marked)
        most = first if marked[first] * 2 >= sum(marked.values()) else max(marked, key=marked.get)
        wanted = {k for k in marked if k == most or k > most and marked[k] * 4 >= marked[most]}
    plain, weight = [], []
    for x in lines:
        n = len(x[1]) if x else 0
        if n and x[0].linked > LINK_PART * n and x[0].article not in wanted:
            n = 0  # a menu counts as an empty line
        plain.append(n)
        # the mark is one more weight: a marked line makes a surge, and on a page with marks the others
        # weigh what they have only if they make one alone
        if n and wanted:
            n = n + SURGE if x[0].article else n if n >= SURGE else 0
        weight.append(n)
    return " ".join(lines[i][1] for i in sorted(_between(plain, weight)))


def _between(plain: list[int], weight: list[int]) -> set[int]:
    """Lines with text between surge and dive of the windows' weight, from the first that weighs to the last."""
    total = [sum(weight[i : i + BLOCK]) for i in range(len(weight))]
    out: set[int] = set()
    i = 0
    while i < len(weight):
        if not weight[i] or total[i] < SURGE:
            i += 1
            continue
        j = i
        while j < len(weight) and total[j]:  # the dive: a whole window without text
            j += 1
        start, last = i, j - 1
        while start and weight[start - 1]:  # short lines right above, such as the title
            start -= 1
        while not weight[last]:
            last -= 1
        out |= {k for k in range(start, last + 1) if plain[k]}
        i = j
    return out or {k for k, w in enumerate(weight) if w}  # no surge anywhere: a page of a few words


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Replace the markup by ``text``, the main text, and ``n_chars``, its code points.

    Left out are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
    comments. Character references are decoded, white space within a block becomes one space, blocks are
    joined in page order by one space; nothing else is dropped or capped.

    Null and empty pages, and pages without text, give '' and 0. Rows are independent: repeated rows give
    repeated results, nothing is shuffled. Columns named ``text`` or ``n_chars`` are replaced; an empty
    table stays empty.
    """
    plain = pages.drop("text", "n_chars")
    keep = [c for c in plain.columns if c != html_col]
    schema = plain.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(html_col)
            texts = [main_text(x) for x in batch.column(at).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            sizes = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), sizes], schema.names)

    return plain.mapInArrow(run, schema)


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages)
