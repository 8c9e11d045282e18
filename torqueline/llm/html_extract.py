"""Main-text extraction by line-block distribution.

Markup is stripped to lines, one per text block, each with the characters of it that stand in links. Parts that are never article
text leave no line (head, navigation, header, footer, aside, form, script, style, and by names adverts, notices, comments and the like;
inside an article only whole names of containers decide, such as ``comments`` or ``ad-slot``, never those of paragraphs, headings,
figures or phrases, and never one word of a longer name). Text lengths outside links are summed over sliding windows of lines. A window with
enough text is a surge and opens a stretch, which reaches to both sides until a window without any text, the dive, so short
paragraphs at its ends stay. Windows do not cross the tags of ``article`` and ``main``; inside those, links count as text, and a
single article, or one with the text of a surge, surges with its first character. An ``article`` that is a comment by its names
is dropped.

Defined cases: null or empty html, or html without text outside the dropped parts, gives the empty text; a page cut off
inside a tag loses that tag only, one cut off inside an element keeps its text (but for script, style, textarea, title and
iframe, whose text goes); controls and noscript, template and svg may lack their end tags; repeated pages each get the same row; an
empty table gives an empty result; other columns are ignored. Pages are never cut.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's raw-text elements, elements outside article text, elements that end a block, and void elements.
RAW = "script style noscript template textarea title svg iframe".split()
#: Raw-text elements that end at once where the page never ends them; the text of the others is lost then, as in a browser.
OPTIONAL_END = "noscript template svg".split()
#: Controls, whose text goes; their end tags can be left out, so the next block tag ends them too.
CONTROL = "select datalist optgroup option button".split()
#: Elements that mark up words; their names say nothing about the part they stand in.
PHRASE = "b i em strong mark sub sup code kbd samp small s u q cite dfn abbr var time".split()
ASIDE = "head nav header footer aside form menu dialog".split()
BLOCK = (
    "address article blockquote body dd div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section "
    "table tbody td tfoot th thead tr ul details summary"
).split() + ASIDE
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Elements that an opening tag of the same kind, or a block tag, closes.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
#: Words of class, id and role names that mark parts outside the article.
NOT_TEXT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|"
    r"sidebar|side|nav\w*|menu|breadcrumb\w*|header|footer|masthead|comment\w*|respon[sd]\w*|disqus|share|social|related|"
    r"recommend\w*|pagination|pager|widget|toolbar|login|signup|search|complementary|contentinfo|banner|navigation)(?:$|[\s_-])", re.I)

#: Elements that hold text; inside an article their names do not drop them.
TEXT = "p h1 h2 h3 h4 h5 h6 span a figure figcaption blockquote pre table caption dl dt dd li label".split()
#: Whole names of containers inside an article that are none of its text; one word of a longer name does not decide there.
_BOX = r"(?:[_-](?:box|bar|slot|unit|area|banner|list|links?|buttons?|posts?|articles?|form|signup|notice|section|thread|item|body|content|container|wrapper|block|inline|top|bottom|\d+))*"
INSERTED = re.compile(
    rf"(?:(?:reader|user|post|article)[_-])?comments?{_BOX}|(?:ads?|advert\w*|sponsor(?:ed)?|promo\w*){_BOX}|"
    rf"(?:cookies?|consent|newsletter|subscribe|popup|modal|notice|sidebar|share|social|related|breadcrumbs?|menu|nav|navbar|navigation|pagination|pager|login|signup|toolbar|widget){_BOX}", re.I)

#: Single names of an ``article`` that is a comment; its other names say nothing, as pages call articles many things.
COMMENT = re.compile(r"(?:^|\s)(?:div-)?(?:comment|reply|replie|response)s?(?:[_-](?:\d+|item|body|content|card))?(?:$|\s)", re.I)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|<(?=/?\Z)", re.S)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
SPACE = re.compile(r"\s+")


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """The blocks of a page outside the dropped parts: (text, characters in links, number of the outermost article or main, or 0)."""
    lines: list[tuple[str, int, int]] = []
    open_tags: list[tuple[str, bool, int, bool]] = []  # name, dropped, number of the article, in a link
    text: list[str] = []
    linked = inside = articles = 0
    dropped = in_link = False
    raw = ""
    at = 0
    last_end: dict[str, int] = {}  # where an element of optional end is ended for the last time

    def ended(name: str, after: int) -> bool:
        if name not in last_end:
            last_end[name] = max((m.start() for m in re.finditer(f"</{name}", page, re.I)), default=-1)
        return last_end[name] >= after

    def flush(article: int) -> None:
        nonlocal linked
        if text:
            line = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if line:
                lines.append((line, linked, article))
            text.clear()
        linked = 0

    def top() -> tuple[bool, int, bool]:
        return open_tags[-1][1:] if open_tags else (False, 0, False)

    for m in TOKEN.finditer(page):
        if raw:  # only its own end tag ends a raw-text element
            if not (m[1] and m[2] and m[2].lower() == raw):
                continue
            raw, at = "", m.end()
            continue
        if at < m.start() and not dropped:
            piece = page[at : m.start()]
            text.append(piece)
            linked += len(piece) * in_link
        at = m.end()
        name = (m[2] or "").lower()
        if not name or not m[4]:
            continue
        if name in RAW and not m[1]:
            raw = "" if m[3].endswith("/") or name in OPTIONAL_END and not ended(name, m.end()) else name
            continue
        block = name in BLOCK
        if block:
            flush(inside)
        elif name == "br" and not dropped:
            text.append(" ")
        if m[1]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    del open_tags[i:]
                    break
                if open_tags[i][0] in ASIDE + ["article", "main"] and not block:
                    break
        else:
            while open_tags and (open_tags[-1][0] in IMPLIED.get(name, ()) or block and open_tags[-1][0] in CONTROL):
                open_tags.pop()
            if block:  # a block inside a paragraph ends it, with the inline elements that stand open in it
                for i in range(len(open_tags) - 1, -1, -1):
                    if open_tags[i][0] == "p":
                        del open_tags[i:]
                    if i >= len(open_tags) or open_tags[i][0] in BLOCK:
                        break
            if name not in VOID and not m[3].endswith("/"):
                names = " ".join(a or b or c for a, b, c in NAMED.findall(m[3]))
                gone, art, link = top()
                is_article = name in ("article", "main")
                gone = gone or (name in ASIDE and not (art and name == "header")) or name in CONTROL or bool(HIDDEN.search(m[3]))
                if names and not is_article and name not in ("body", "html", *PHRASE):
                    inserted = name not in TEXT and any(map(INSERTED.fullmatch, names.split()))
                    gone = gone or bool(inserted if art else NOT_TEXT.search(names))
                gone = gone or name == "article" and bool(COMMENT.search(names))
                if is_article and not art and not gone:
                    articles += 1
                    art = articles
                open_tags.append((name, gone, art, link or name == "a"))
        dropped, inside, in_link = top()
    if not raw and at < len(page) and not dropped:
        text.append(page[at:])
        linked += len(page[at:]) * in_link
    flush(inside)
    return lines


def main_text(page: str | None, width: int = 3, surge: int = 80) -> str:
    """Blocks between surge and dive points, joined by two line feeds.

    ``width``: lines of a window. ``surge``: characters outside links that a window needs to open a stretch. A stretch goes on to both
    sides until a window has no character outside links."""
    lines = lines_of(page or "")
    own: dict[int, int] = {}  # characters of each article
    for line, _, article in lines:
        own[article] = own.get(article, 0) + len(line)
    articles = len(own.keys() - {0})
    keep: list[bool] = []
    while len(keep) < len(lines):
        article = lines[len(keep)][2]
        part = list(itertools.takewhile(lambda x: x[2] == article, lines[len(keep) :]))
        # Links inside an article are part of its text, and the page's only article needs no more than a character to surge.
        weights = [len(line) if article else max(0, len(line) - 2 * linked) for line, linked, _ in part]
        keep += between(weights, width, 1 if article and (articles == 1 or own[article] >= surge) else surge)
    if not any(keep):  # a page without any surge is one short stretch
        keep = [len(line) > 2 * linked for line, linked, _ in lines]
    return "\n\n".join(line for (line, _, _), k in zip(lines, keep, strict=True) if k)


def between(weights: list[int], width: int, surge: int) -> list[bool]:
    """Which of the lines lie in a stretch, from its first to its last line with weight."""
    sums = [sum(weights[i : i + width]) for i in range(max(1, len(weights) - width + 1))]  # of the window that begins at a line
    keep = [False] * len(weights)
    i = 0
    while i < len(sums):
        if sums[i] < surge:
            i += 1
            continue
        first = last = i
        while first and sums[first - 1] > 0:
            first -= 1
        while last + 1 < len(sums) and sums[last + 1] > 0:
            last += 1
        inside = [j for j in range(first, min(last + width, len(weights))) if weights[j] > 0]
        keep[inside[0] : inside[-1] + 1] = [True] * (inside[-1] + 1 - inside[0])
        i = last + 1
    return keep


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row per input row: ``id, url, text``."""
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x.as_py()) for x in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), text], ["id", "url", "text"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("id", "url")}
    return pages.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string")
