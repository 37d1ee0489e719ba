"""Main text of raw HTML pages by line-block distribution.

The markup is stripped to lines: one line for each block element's text, and empty lines where an
element stood that cannot hold main text (scripts, menus, adverts, forms ...), or where an article
begins or ends. Text lengths are summed over sliding windows of lines. Text surges where the sums
rise from nothing and come to reach a threshold, and dives where they fall to nothing again; the
lines between a surge and its dive are kept. Article markup (``article``, ``main``) and headings make
a line count more; text of links counts nothing outside an article. Beside an article, ranges of
other lines stay if they hold at least a third as much text as the article: second parts do, notices without a name don't.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memloom.llm.arrow_text import tidy

# HTML element names by how they shape text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split()
)
DROPPED = frozenset("applet aside button canvas datalist dialog embed footer frameset head iframe label map menu nav noscript object optgroup option select svg template textarea title audio video".split())
#: Elements that hold controls, but often the whole page, too: evidence, as names are.
WRAPPERS = frozenset("form fieldset search".split())
#: Controls that are words of a sentence where one has begun.
INLINE = frozenset("button label".split())
RAW = frozenset("script style xmp noembed noframes".split())
#: A start tag of the first kind ends an open element of the second kind in the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset({"ul", "ol", "dl", "table"})
CONTAINERS = frozenset("article aside blockquote body center dd details dialog div dl dt fieldset figure footer form header html li main nav ol section table td th tr ul".split())

# Words in class, id and role that name what is no main text.
NO_TEXT = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disclaimer disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words behind which, and before which, such a word describes the layout.
NEGATORS = frozenset("has no not non with without overflow".split())
MODIFIERS = frozenset("active allowed closed disabled enabled free inactive loaded off on open opened ready visible".split())
#: Readers' text: as long as it may be, in an article it isn't the main text.
READERS = frozenset("comment comments commentlist disqus replies respond".split())
HEADERS = frozenset({"header", "masthead", "banner"})
SCOPES = frozenset({"article", "main"})
NEVER_BY_NAME = frozenset({"html", "body", "article", "main"})

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_REST = re.compile(r"""(?:[^"'>]+|"[^"]*"|'[^']*')*+>""")
_NAMED = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\s(hidden)(?=[\s/>])""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")

#: Lines in a window, and weighted characters in a window at which text surges.
WINDOW, SURGE = 3, 60
#: What a character counts in an article, and in a heading elsewhere.
IN_ARTICLE, IN_HEADING = 8, 4
#: A range beside an article stays if so many times its text is that of the article at least.
BESIDE = 3
HEADINGS = frozenset({"h1", "h2"})
#: Containers of a whole page: what they hold on both sides of a dropped element isn't of one block for that.
WHOLE = frozenset({"html", "body"})

Line = tuple[str, bool, int, bool]


def _evidence(attributes: str, in_article: bool) -> tuple[bool, set[str]]:
    """Whether an element is hidden, and the words in its class, id and role that name no main text.

    A word tells nothing behind one of ``NEGATORS`` or before one of ``MODIFIERS`` in the same name.
    """
    named: set[str] = set()
    for key, a, b, c, hidden in _NAMED.findall(attributes):
        value = a or b or c
        if hidden or (key.lower() == "aria-hidden" and value.lower() == "true"):
            return True, named
        if key.lower() == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return True, named
            continue
        for part in value.split():
            words = [w.lower() for w in _WORD.findall(part)]
            for i, word in enumerate(words):
                if word in NEGATORS:
                    break
                if (word in NO_TEXT or (not in_article and word == "header")) and not MODIFIERS.intersection(words[i + 1 : i + 2]):
                    named.add(word)
    return False, named


def lines_of(page: str) -> list[Line]:
    """The lines of a page: text with single spaces, whether it lies in an article, characters of it in links, whether it is a heading.

    A dropped element leaves ``WINDOW`` empty lines, but not in an article, nor between lines of the container that
    it stands in; so does the border of an article, but not behind a heading. An element that only its names
    speak against, and a form or the like, stays if it holds ``main``, the only articles, or most of the text (outside an article beside it: nearly all).
    """
    lines, spared = _parse(page, frozenset())
    return _parse(page, spared)[0] if spared else lines


def _parse(page: str, spared: frozenset[int]) -> tuple[list[Line], frozenset[int]]:
    """The lines of a page, with elements that start at ``spared`` kept whatever their names, and starts of those to spare."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool, tuple | None]] = []  # name, whether its text is dropped, for sure, and what was seen before an element under suspicion
    opened: dict[str, list[int]] = {}  # depths of the open elements of a name
    boxes: list[tuple[int, int]] = []  # depth and number of the open containers
    suspects: list[tuple[int, bool, int, int, int]] = []  # start, whether readers' text in an article, and mains, articles and text inside
    text: list[str] = []
    sure = under = mains = articles = plain = size = 0
    dropped = scopes = links = linked = headings = n_boxes = last_box = 0
    heading = False
    gaps: list[int] = []  # containers of the dropped elements since the last line; 0 for a gap in any case
    gap = ("", False, 0, False)

    def flush() -> None:
        nonlocal linked, last_box, heading
        if text:
            if line := " ".join("".join(text).split()):
                box = boxes[-1][1] if boxes else 0
                if any(x == 0 or x != last_box or x != box for x in gaps):
                    out.extend([gap] * WINDOW)
                gaps.clear()
                last_box = box
                out.append((line, scopes > 0, linked, heading))
            text.clear()
        linked, heading = 0, False

    def pop(depth: int) -> None:
        nonlocal dropped, scopes, links, sure, under, headings
        while len(stack) > depth:
            name, off, certain, before = stack[-1]
            if name in BLOCKS:
                flush()
            stack.pop()
            opened[name].pop()
            if boxes and boxes[-1][0] == len(stack):
                boxes.pop()
            sure -= certain
            if before:
                under -= 1
                suspects.append((before[0], before[1], mains - before[2], articles - before[3], size - before[4]))
            dropped -= off
            scopes -= name in SCOPES
            links -= name == "a"
            headings -= name in HEADINGS
            if off and not dropped and not scopes:
                gaps.append(boxes[-1][1] if boxes and stack[boxes[-1][0]][0] not in WHOLE else 0)
            elif name in SCOPES and not scopes and not dropped:
                gaps.append(0)

    def find(names: set[str] | frozenset[str], through: bool) -> int:
        """Depth of the innermost open element of these names; not through containers unless told."""
        depth = max((opened[x][-1] for x in names if opened.get(x)), default=-1)
        return depth if through or not boxes or boxes[-1][0] <= depth else -1

    def add(piece: str) -> None:
        nonlocal linked, size, heading
        if piece and not sure:
            size += len(piece.strip())
        if piece and not dropped:
            piece = entities.unescape(piece)
            text.append(piece)
            heading = heading or headings > 0
            if links:
                linked += len(piece)

    at = 0
    while tag := _TAG.search(page, at):
        add(page[at : tag.start()])
        if tag[1]:
            end = page.find("-->", tag.end())
            at = len(page) if end < 0 else end + 3
            continue
        rest = _REST.match(page, tag.end())
        at = rest.end() if rest else (page.find(">", tag.end()) + 1 or len(page))
        if not tag[3]:
            continue
        name, attributes = tag[3].lower(), page[tag.end() : at]
        if tag[2]:
            if (depth := find({name}, name in CONTAINERS)) >= 0:
                pop(depth)
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
            close = page.find(">", at)
            at = len(page) if close < 0 else close + 1
            continue
        if name in BLOCKS:
            if (depth := find({"p"}, False)) >= 0:
                pop(depth)
            flush()
        if name in ENDS and (depth := find(ENDS[name] | LISTS, True)) >= 0 and stack[depth][0] in ENDS[name]:
            pop(depth)
        if name in VOID or attributes.endswith("/>") and name in ("svg", "path"):
            if name == "br" or name == "hr":
                add(" ")
            continue
        if name in ("td", "th"):
            add(" ")
        hidden, named = _evidence(attributes, scopes > 0) if attributes else (False, set())
        by_name = name not in NEVER_BY_NAME
        # a reader comment marked up as an article in the article goes for sure
        word = name in INLINE and find({"p"}, False) >= 0 and not any(opened.get(x) for x in WRAPPERS) and any(not x.isspace() for x in text)
        certain = (name in DROPPED and not word) or (name == "header" and not scopes) or (by_name and hidden) or (name == "article" and scopes > 0 and (hidden or bool(named)))
        before = None
        if by_name and (named or name in WRAPPERS) and not certain and not sure:
            before = (at, scopes > 0 and bool(named & READERS), mains, articles if not scopes else float("inf"), size)
            under += 1
        off = certain or (before is not None and at not in spared)
        if name in SCOPES and not certain and not sure:
            mains += name == "main"
            articles += name == "article"
            plain += name == "article" and not under
        if name in SCOPES and not scopes and not dropped and not off and not (out and out[-1][3] and not gaps):
            gaps.append(0)
        opened.setdefault(name, []).append(len(stack))
        if name in CONTAINERS:
            n_boxes += 1
            boxes.append((len(stack), n_boxes))
        stack.append((name, off, certain, before))
        headings += name in HEADINGS
        sure += certain
        dropped += off
        scopes += name in SCOPES
        links += name == "a"
    add(page[at:])
    flush()
    for *_, before in stack:
        if before:
            suspects.append((before[0], before[1], mains - before[2], articles - before[3], size - before[4]))
    # beside an article that nothing speaks against, an element outside it needs more text than the article's markup outweighs
    much = lambda held, inside: 2 * held > size if inside or not plain else held > IN_ARTICLE * (size - held)
    spare = frozenset(at for at, readers, main, article, held in suspects if main > 0 or (article > 0 and not plain) or (much(held, article < 0) and not readers))
    return out, spare


def between_surge_and_dive(lengths: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Ranges of lines from a surge to its dive.

    The sum of a window starts at each line. Where sums rise from nothing a range starts, at its first
    line with text, if they reach ``surge`` before they fall to nothing again, which ends it, or the page ends.
    """
    sums = [0] * len(lengths)
    running = 0
    for i in range(len(lengths) - 1, -1, -1):
        running += lengths[i] - (lengths[i + window] if i + window < len(lengths) else 0)
        sums[i] = running
    ranges, start, most = [], -1, 0
    for i, total in enumerate([*sums, 0]):
        if start < 0 and i < len(lengths) and lengths[i]:
            start, most = i, 0
        if start >= 0:
            most = max(most, total)
            if not total:
                if most >= surge:
                    ranges.append((start, i))
                start = -1
    return ranges


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks in order, white space single, joined by empty lines. Empty if none.

    A page whose windows nowhere reach ``SURGE`` gives all of its text.
    """
    lines = lines_of(page or "")
    lengths = [len(text) * IN_ARTICLE if inside else max(0, len(text) - linked) * (IN_HEADING if heading else 1) for text, inside, linked, heading in lines]
    ranges = between_surge_and_dive(lengths, SURGE) or between_surge_and_dive([len(x[0]) for x in lines], 1)
    marked = [any(lines[i][1] for i in range(*x)) for x in ranges]
    held = [sum(len(lines[i][0]) for i in range(*x)) for x in ranges]
    article = sum(n for n, inside in zip(held, marked, strict=True) if inside)
    kept = [x for x, n, inside in zip(ranges, held, marked, strict=True) if inside or n * BESIDE >= article]
    return "\n\n".join(lines[i][0] for x in kept for i in range(*x) if lines[i][0])


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The main text of every whole page.

    Returns the ``keep`` columns, ``text`` (string, empty if none) and ``n_chars`` (its code
    points). Null html counts as empty. Rows are worked on one by one where they are read: no
    shuffle; repeated rows are all returned, an empty table gives no rows.
    """
    schema = T.StructType([*(pages.schema[x] for x in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return pages.select(*keep, html_column).mapInArrow(tidy(run), schema)
