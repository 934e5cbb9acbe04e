r"""Main text of web pages by line-block distribution.

A page's markup is stripped to lines, one per block element, menus and footers included. Each line weighs something: the
length of its text; nothing, if most of it is links; and what stands in a menu, an advert, a form and the like weighs minus
infinity. Sums over a sliding window of lines decide, first where the text is: the window with the most text, the peak,
says whether a page's articles hold its text. If the peak is in an article, what stands beside the articles weighs minus
infinity; if it is outside all of them and they hold less than half as much as the rest, they are teasers and weigh minus
infinity themselves. A <main> is the page's by definition, and peaks count inside it. Then where it begins and ends: the
text surges at a line that has weight while nothing is kept, and dives where the window ahead sums to nothing or is walled off. What
lies between a surge and a dive is kept, with the lines of links that it holds, and all regions together are the main
text, short ones too, with lines of links between two of them that are fewer than the window. So a line that stands aside
is in no region wherever it is, a list of links as long as the window goes, and so do links before the first line of text
and after the last; nothing else does.

Words of class and id values are not trusted against the text: an element that they set aside keeps its weight all the
same if it holds a <main>, or more than half of the page's text while no article stands outside all such elements. Words of
readers' comments are trusted unless it holds nine tenths. An article inside such an element spares nothing.

A page is scanned once, in time that grows with its length however its markup is broken.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.shared import small_batches

#: Lines of the sliding window; share of link text from which a line is a menu's; share of a page's text from which an
#: element is not set aside by words, and by words of readers' comments.
LINES, LINKS, MOST, NEARLY_ALL = 3, 0.5, 0.5, 0.9
#: How an element stands aside: not, by words of its class or id, by words of readers' comments, by what it is.
IN, BY_WORDS, BY_READERS, BY_KIND = 0, 1, 2, 3
#: What holds a line: an article, a main.
ARTICLE, MAIN = 1, 2

#: Elements without content, elements that start a new line, and elements that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split())
NEVER = frozenset("head title script style noscript template nav footer aside form button select textarea iframe object svg math canvas audio video dialog menu search datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id values (split where letters end) that mark what is not the article.
OTHER = re.compile(
    r"(?:^|[^a-z])(?<!\bno[-_])(?<!\bhas[-_])(?<!\bwith[-_])(?:ads?|adv|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlays?|newsletters?|subscri(?:be|ption)|shar(?:e|ing)|sharedaddy|addthis|addtoany|social|related|recommend(?:ed|ations?)?|sidebars?|side-?bar|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|pagination|pager|footers?|masthead|topbar|toolbar|comments?|disqus|respond|repl(?:y|ies)|discussion|login|signup|sign-?up|search(?:box|form|bar)?|skip|disclaimer|copyright)(?:$|[^a-z])"
)
READERS = re.compile(r"(?:^|[^a-z])(?<!\bno[-_])(?<!\bhas[-_])(?<!\bwith[-_])(?:comments?|disqus|respond|repl(?:y|ies)|discussion)(?:$|[^a-z])")
READERS_ARTICLE = re.compile(r"(?:^|\s)(?:comment|reply)(?:-body|-item|-content)?(?:$|\s)")
PAGE_HEADER = re.compile(r"(?:^|[^a-z])(?:page|site|top|main|global)?-?header(?:$|[^a-z])")

#: Elements whose content is not markup.
RAW = frozenset("script style noscript textarea title template iframe svg".split())
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile("[>\"']")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _aside(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element holds no main text, and by what."""
    if name in NEVER or name == "header" and not in_article:
        return BY_KIND
    how = IN
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id") and name in ("article", "main"):
            how = max(how, BY_READERS if READERS_ARTICLE.search(value) else IN)
        elif key in ("class", "id") and name not in ("html", "body"):
            words = READERS.search(value) and BY_READERS or OTHER.search(value) and BY_WORDS or not in_article and PAGE_HEADER.search(value) and BY_WORDS
            how = max(how, words or IN)
        elif key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "hidden":
            return BY_KIND
    return how


def _set_aside(around: list[int], readers: list[bool], sizes: list[int], total: int, marks: list[tuple[str, int]]) -> list[bool]:
    """Whether what is in each element with words of class or id stands aside. around: the nearest such element around
    each, or -1; readers: whether its words are of comments; sizes: its own text; total: the page's text; marks: each
    article and main with the nearest such element around it."""
    n = len(around)
    sizes, main, gone = sizes[:], [False] * n, [False] * n
    free = any(k < 0 for _, k in marks)
    for name, k in marks:
        if k >= 0:
            main[k] = main[k] or name == "main"
    for k in range(n - 1, -1, -1):
        if (up := around[k]) >= 0:
            sizes[up] += sizes[k]
            main[up] = main[up] or main[k]
    for k, up in enumerate(around):
        most = sizes[k] > (NEARLY_ALL if readers[k] else MOST) * total and not free
        gone[k] = up >= 0 and gone[up] or not (main[k] or most)
    return gone


def tokens_of(page: str):
    """(text, "", "", "") of what lies between tags and ("", "/" of an end tag, name, attributes) of each tag, in order.
    Comments, declarations and the content of RAW elements go. A tag ends at the first ">" outside quotes; if a quote
    never closes, at the first ">" of all. What cannot be a tag is text."""
    at = done = 0
    last = {c: page.rfind(c) for c in ">\"'"}
    broken = 0  # before it, quotes are not trusted: one of them never closes
    while (at := page.find("<", at)) >= 0:
        start, end, tag = at, -1, None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1 or len(page)
        elif last[">"] > at and (m := NAME.match(page, at + 1)):
            i = m.end()
            while end < 0:
                found = QUOTE_OR_END.search(page, i)
                i = found.start()
                if page[i] == ">":
                    end = i + 1
                elif at < broken or i >= last[page[i]]:
                    broken = max(broken, i)
                    end = page.find(">", m.end()) + 1
                else:
                    i = page.find(page[i], i + 1) + 1
                    if i > last[">"]:
                        broken = max(broken, i)
                        end = page.find(">", m.end()) + 1
            tag = m[1], m[2].lower(), page[m.end() : end - 1]
            if not m[1] and tag[1] in RAW and not tag[2].endswith("/"):
                close = RAW_END[tag[1]].search(page, end)
                end = (page.find(">", close.end()) + 1 or len(page)) if close else len(page)
                tag = None
        if end < 0:
            at += 1
            continue
        if start > done:
            yield page[done:start], "", "", ""
        if tag:
            yield "", *tag
        at = done = end
    if done < len(page):
        yield page[done:], "", "", ""


#: An open paragraph, item or cell ends where the next one starts.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """The page's lines that have text: text, code points of it in links, whether it stands aside, what holds it: nothing,
    ARTICLE, MAIN or both."""
    lines: list[tuple[str, int, bool, int, int]] = []
    held: list[str] = []
    links = 0
    #: open elements: name, and what holds within: stands aside by kind, nearest element with words around, article and
    #: main around, is in a link
    open_: list[tuple[str, bool, int, int, bool]] = []
    names: Counter = Counter()
    aside = link = False
    worded, article = -1, 0
    around: list[int] = []
    readers: list[bool] = []
    marks: list[tuple[str, int]] = []

    def end_line() -> None:
        nonlocal held, links
        if held:
            if text := " ".join("".join(held).split()):
                lines.append((text, links, aside, worded, article))
            held, links = [], 0

    def leave(k: int) -> None:
        nonlocal aside, worded, article, link
        names.subtract(x[0] for x in open_[k:])
        del open_[k:]
        aside, worded, article, link = open_[-1][1:] if open_ else (False, -1, 0, False)

    for raw, ends, name, attributes in tokens_of(page):
        if not name:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if link:
                links += len(" ".join(text.split()))
            continue
        if name in BLOCK:
            end_line()
        elif name in ("br", "td", "th", "img"):
            held.append(" ")
        if ends:
            if names[name] > 0:
                k = next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name)
                if (aside, worded) != (open_[k - 1][1:3] if k else (False, -1)):
                    end_line()
                leave(k)
            continue
        closes = (*CLOSES.get(name, ()), "p") if name in BLOCK else CLOSES.get(name, ())
        if any(names[c] > 0 for c in closes):
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in closes:
                    leave(k)
                    break
                if open_[k][0] in BLOCK and open_[k][0] != "p":
                    break
        if name not in VOID and not attributes.endswith("/"):
            how = IN if aside else _aside(name, attributes, article > 0)
            if how != IN:
                end_line()
            inner = worded
            if how in (BY_WORDS, BY_READERS):
                inner = len(around)
                around.append(worded)
                readers.append(how == BY_READERS)
            mark = {"article": ARTICLE, "main": MAIN}.get(name, 0)
            if mark and not aside and how != BY_KIND:
                marks.append((name, inner))
            open_.append((name, aside or how == BY_KIND, inner, article | mark, link or name == "a"))
            names[name] += 1
            aside, worded, article, link = open_[-1][1:]
    end_line()
    sizes, total = [0] * len(around), 0
    for text, _, by_kind, k, _ in lines:
        if not by_kind:
            total += len(text)
            if k >= 0:
                sizes[k] += len(text)
    gone = _set_aside(around, readers, sizes, total, marks)
    return [(text, links, by_kind or k >= 0 and gone[k], article) for text, links, by_kind, k, article in lines]


def peak(lengths: list[int], window: int = LINES) -> int:
    """The most text that a window of consecutive lines holds."""
    most = now = 0
    for i, n in enumerate(lengths):
        now += n - (lengths[i - window] if i >= window else 0)
        most = max(most, now)
    return most


def weights_of(lines: list[tuple[str, int, bool, int]]) -> list[float]:
    """Of each line: the length of its text, 0 if most of it is links, minus infinity if it stands aside, or if the peak of
    the page says that its text is elsewhere. Inside a main, or articles that hold the peak, lines of links weigh their
    length."""
    shown = [not aside for _, _, aside, _ in lines]
    plain = [len(text) if ok and links <= LINKS * len(text) else 0 for (text, links, _, _), ok in zip(lines, shown)]
    if main := any(ok and held & MAIN for (_, _, _, held), ok in zip(lines, shown)):
        shown = [ok and held & MAIN > 0 for (_, _, _, held), ok in zip(lines, shown)]
    inside = [ok and held & ARTICLE > 0 for (_, _, _, held), ok in zip(lines, shown)]
    within = [n if ok else 0 for n, ok in zip(plain, inside)]
    beside = [n if ok and not own else 0 for n, ok, own in zip(plain, shown, inside)]
    marked = any(inside) and peak(within) >= peak(beside)
    if marked and not main:
        shown = inside
    elif not marked and any(inside) and 2 * sum(within) < sum(beside):
        shown = [ok and not own for ok, own in zip(shown, inside)]
    return [-math.inf if not ok else len(text) if main or marked else n for (text, _, _, _), ok, n in zip(lines, shown, plain)]


def regions(weights: list[float], window: int = LINES) -> list[tuple[int, int]]:
    """(first, end) of each region: it surges at a line that has weight, and dives where the lines of the window ahead, up
    to one that stands aside, sum to nothing."""
    out, start = [], None
    for i, w in enumerate(weights):
        if w > 0 and start is None:
            start = i
        if start is not None and not sum(takewhile(lambda x: x > -math.inf, weights[i + 1 : i + 1 + window])):
            out.append((start, i + 1))
            start = None
    return out


def kept_lines(weights: list[float], window: int = LINES) -> list[int]:
    """The lines of all regions, and the lines of links between two of them that are fewer than the window."""
    out: list[int] = []
    for a, b in regions(weights, window):
        links = [i for i in range(out[-1] + 1, a) if not weights[i]] if out else []
        out += links if len(links) < window else []
        out += range(a, b)
    return out


def main_text(page: str | None) -> str:
    """The page's main text: its lines, in order, joined by a newline; empty if it has none."""
    lines = lines_of(page or "")
    return "\n".join(lines[i][0] for i in kept_lines(weights_of(lines)))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars. A null or empty page has an empty text; rows with the same
    page_id, or null, are read each on its own; an empty table gives an empty result; other columns are ignored. Pages
    of any length are read whole, in a task that shuffles nothing."""
    small_batches(pages.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [pages.schema[c].dataType for c in (id_col, url_col)]
    schema = pa.schema([("page_id", to_arrow_type(kinds[0])), ("url", to_arrow_type(kinds[1])), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = list(map(main_text, batch.column("html").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    return pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url", f"`{html_col}` AS html").mapInArrow(run, f"page_id {kinds[0].simpleString()}, url {kinds[1].simpleString()}, text string, n_chars long")
