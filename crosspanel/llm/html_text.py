"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element; where boxes of several blocks begin and end there are empty lines,
as in their source. What an element's role or class names as menu, form, notice, comment or the like is left out. A line is as
long as its text outside of links, and mostly linked lines have no length. The lengths of a few neighbouring lines are summed: a
stretch without a dive to nothing is kept if its sums surge above a level somewhere. Where article elements hold the page's text,
any length is a surge; elsewhere the level follows from the page's own sums, and stretches beside the greatest one stay if they
share its box.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidy

# Element names of HTML by their role.
RAW = frozenset("script style template noscript textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that never hold the article, and those that do only if they hold an article element or most of the page.
OUTSIDE = frozenset("head nav footer aside button select dialog menu svg canvas object audio video map datalist search".split())
DOUBTFUL = frozenset("form fieldset header".split())
ARTICLE = frozenset("article main".split())
# Which open elements a start tag ends, by the rules of implied end tags; the search stops at the barriers.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CELLS = frozenset("td th caption".split())
#: Boxes: block elements that hold other blocks rather than text.
BOX = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre caption legend figcaption summary option hr address tr td th html body".split())
#: Parts of class, id or role names that mark what isn't the article, and beginnings of such parts.
MARKS = frozenset(
    "ad ads adv advert banner nav navbar menu footer masthead topbar cookie cookies consent notice alert popup modal overlay login signup share sharing social respond reply replies discussion "
    "pager toolbar widget widgets complementary contentinfo search skip copyright legal disclaimer tracking".split()
)
BEGINNINGS = ("comment", "advert", "adsby", "sponsor", "promo", "sidebar", "navig", "breadcrumb", "newsletter", "subscri", "related", "recommend", "pagin", "gdpr", "disqus")
#: Of these, what readers write: an article element in it is no article.
READERS = ("comment", "respond", "reply", "replies", "discussion", "disqus")
#: Before a mark these say that it isn't there, or is elsewhere; names with such parts and no mark are those of articles.
ABSENT, CONTENT = frozenset("no has with without hide hidden not is".split()), frozenset("article entry post content main story text body".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
#: Lines summed; the highest level of a surge, in characters; the part of the page's greatest sum that is enough.
SPAN, LEVEL, SHARE = 3, 86, 4
_SPACE = re.compile(r"\s+")


def marked(attributes: str) -> int:
    """How a class, id or role names an element: 3 as readers' comments, 2 as something beside the article, 1 as that and as the
    article too (``entry share``), 0 as none of these (``no-sidebar``)."""
    found, article = 0, False
    for m in NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [x.lower() for x in PARTS.split(name) if x]
            hits = [p for i, p in enumerate(parts) if (p in MARKS or p.startswith(BEGINNINGS)) and not (i and parts[i - 1] in ABSENT)]
            found = max(found, 3 if any(p.startswith(READERS) for p in hits) else 2 if hits else 0)
            article |= not hits and not CONTENT.isdisjoint(parts)
    return 1 if found == 2 and article else found


class Page:
    """A page as lines. Each is a list of pieces (text, in a link, element that may be left out), whether it is in an article, and its box.

    A line without pieces is the edge of its box.
    """

    def __init__(self, page: str) -> None:
        self.lines: list[tuple[list[tuple[str, bool, int]], int, int]] = []
        #: Boxes: (the one around it, the outermost article box that it is in or -1), and how much they hold: 2 for a box, 1 for a line; one line alone makes no box.
        self.boxes: list[tuple[int, int]] = [(-1, -1)]
        self.holds: list[int] = [2]
        #: Elements that may be left out: (name, the one around it or -1).
        self.doubts: list[tuple[str, int]] = []
        self.held: list[tuple[str, bool, int]] = []
        self.stack: list[tuple[str, int, int, bool, int]] = []  # name, innermost doubt, 2 in an article or 1 in main, in a link, innermost box
        self.open: dict[str, int] = {}  # how many elements of each name are open
        self.saved: set[int] = set()  # doubts around an article
        self._read(page)

    def _close(self) -> None:
        if self.held:
            self.lines.append((self.held, self._top()[2], self._top()[4]))
            self.held = []

    def _top(self) -> tuple[str, int, int, bool, int]:
        return self.stack[-1] if self.stack else ("", -1, 0, False, 0)

    def _pop(self, at: int) -> None:
        """End all elements from ``at`` on."""
        if any(e[0] in BLOCK for e in self.stack[at:]):
            self._close()
        for e in reversed(self.stack[at:]):
            self.open[e[0]] -= 1
            if e[0] in BOX:
                self.lines.append(([], e[2], e[4]))
        del self.stack[at:]

    def _end(self, names: set[str] | frozenset[str], barriers: set[str] | frozenset[str]) -> None:
        if not any(map(self.open.get, names)):
            return None
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in names:
                return self._pop(at)
            if self.stack[at][0] in barriers:
                return None

    def _start(self, name: str, attributes: str) -> None:
        block = name in BLOCK
        if block:
            self._close()
        if name in ENDS_P:
            self._end({"p"}, CELLS | {"button", "object"})
        if name in ENDS:
            self._end(*ENDS[name])
        if name == "a":
            self._end({"a"}, BLOCK)
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            if name == "br":
                self.held.append((" ", False, self._top()[1]))
            return
        _, doubt, article, link, box = self._top()
        named = 0 if name in ("html", "body", "main") or not attributes else marked(attributes)
        fresh = name not in ("html", "body", "main") and (name in OUTSIDE or (name in DOUBTFUL and not (name == "header" and article))) or named > 0
        if block:
            self.holds[box] += 1 + (name in BOX)
        if name in BOX:
            self.boxes.append((box, self.boxes[box][1] if self.boxes[box][1] >= 0 or name not in ARTICLE or fresh else len(self.boxes)))
            self.holds.append(0)
            box = len(self.boxes) - 1
        if fresh:
            self.doubts.append((name if name in OUTSIDE or name in DOUBTFUL else ("", "both", "beside", "readers")[named], doubt))
            doubt = len(self.doubts) - 1
        elif name in ARTICLE:
            article, around = max(article, 2 if name == "article" else 1), doubt
            while around >= 0 and around not in self.saved:
                self.saved.add(around)
                around = self.doubts[around][1]
        if block or fresh or name == "a":
            self.stack.append((name, doubt, article, link or name == "a", box))
            self.open[name] = self.open.get(name, 0) + 1
        if name in BOX:
            self.lines.append(([], article, box))

    def _read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            m = TOKEN.search(page, at)
            piece = page[at : m.start() if m else end]
            if piece:
                _, doubt, _, link, _ = self._top()
                self.held.append((piece, link and not self.open.get("h1"), doubt))  # a title may be a link
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if not (m[1] or m[4]):
                if name in RAW:
                    stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
                    at = stop.start() if stop else end
                else:
                    self._start(name, m[3] or m[6] or "")
            elif name in BLOCK:
                self._end({name}, CELLS - {name} if name not in ("tr", "table", "tbody", "thead", "tfoot") else frozenset())
                self._close()
            else:
                self._end({name}, BLOCK)
        self._pop(0)
        self._close()

    def left_out(self) -> list[bool]:
        """For each doubtful element whether it goes: not around an article, unless it is for readers' comments; a form, and an element
        whose names speak of the article too, stay if they hold most of the page's text."""
        size = [0] * len(self.doubts)
        whole, article = 0, 0
        for pieces, inside, _ in self.lines:
            for text, link, doubt in pieces:
                n = 0 if link else len(text.strip())
                whole += n
                article = max(article, inside if n else 0)
                if doubt >= 0:
                    size[doubt] += n
        for i in range(len(size) - 1, -1, -1):  # an element comes after the one around it
            if (around := self.doubts[i][1]) >= 0:
                size[around] += size[i]
        out: list[bool] = []
        for i, (name, around) in enumerate(self.doubts):
            most = 2 * size[i] > whole
            keep = name not in OUTSIDE and name != "readers" and i in self.saved or name == "both" and most or name in ("form", "fieldset") and not article and most
            out.append(not keep or (around >= 0 and out[around]))
        return out

    def within(self, box: int, other: int) -> bool:
        """Whether ``box`` is ``other`` or inside of it; boxes come after those around them."""
        while box > other:
            box = self.boxes[box][0]
        return box == other

    def around(self, a: int, b: int) -> int:
        """The innermost box that holds both."""
        while a != b:
            a, b = (self.boxes[a][0], b) if a > b else (a, self.boxes[b][0])
        return a


@dataclass
class Line:
    text: str
    size: int  # characters outside of links; 0 where most are linked
    bar: bool  # several links
    inside: int  # 2 in an article, 1 in main
    box: int


def lines_of(read: Page) -> list[Line]:
    """Lines in page order. Empty ones stand at the edges of boxes that hold blocks, but not within articles, and for what is left out."""
    gone = read.left_out()
    out: list[Line] = []
    for pieces, inside, box in read.lines:
        if not pieces:
            inner = inside and read.boxes[box][1] != box
            out += [Line("", 0, False, 0, box)] * (SPAN if read.holds[box] > 1 and not inner else 0)
            continue
        mine = [(text, link) for text, link, doubt in pieces if doubt < 0 or not gone[doubt]]
        text = _SPACE.sub(" ", html.unescape("".join(t for t, _ in mine))).strip()
        if text:
            free, linked = (sum(len(_SPACE.sub("", html.unescape(t))) for t, link in mine if link == x) for x in (False, True))
            home = box if read.holds[box] > 1 else max(read.boxes[box][0], 0)
            out.append(Line(text, 0 if 2 * free < linked else free, sum(link for _, link in mine) > 1, inside, home))
        elif not inside and len(mine) < len(pieces):
            out.append(Line("", 0, False, 0, box))
    return out


def stretches(size: list[int], span: int = SPAN) -> list[tuple[int, int, int]]:
    """(first, end, greatest sum) of the stretches of lines between dives: runs of ``span`` lines and more whose sums are nothing."""
    out: list[tuple[int, int, int]] = []
    first, empty = None, 0
    for i in range(len(size) + span):
        if i < len(size) and size[i]:
            first, empty = i if first is None else first, 0
        else:
            empty += 1
            if empty == span and first is not None:
                end = i - span + 1
                out.append((first, end, max(sum(size[k : k + span]) for k in range(first, end))))
                first = None
    return out


def main_text(page: str | None, span: int = SPAN, level: int = LEVEL) -> str:
    """The article of a page: its lines, white space turned into single spaces, joined by newlines.

    Where article (else main) elements hold the page's text, every stretch of theirs is kept: runs of three and more linked lines
    are dives, all else is text. Elements whose text is less than half of a stretch outside of them are teasers, and count as nothing.
    Without articles a stretch surges above ``level``, or a quarter of the greatest sum if that is less, and above a sixteenth of that;
    stretches in the box of the longest one stay however short.
    """
    read = Page(page or "")
    lines = lines_of(read)
    best = max((x.inside for x in lines if x.text), default=0)
    own: dict[int, int] = {}
    for x in lines:
        if best and x.inside == best:
            own[read.boxes[x.box][1]] = own.get(read.boxes[x.box][1], 0) + x.size
    rest = [0 if x.inside == best else x.size for x in lines]
    if best and max((sum(rest[a:b]) for a, b, _ in stretches(rest, span)), default=0) > 2 * max(own.values()):
        best = 0  # teasers: the story is elsewhere
    sizes = [x.size if not best or x.inside == best else 0 for x in lines]
    found = stretches(sizes, span)
    top = max((s for *_, s in found), default=0)
    if best:
        return "\n".join(x.text for a, b, _ in found for x in lines[a:b] if x.text and x.inside == best)
    high = max(min(level, top / SHARE), top / SHARE**2)
    longest = max(found, key=lambda f: sum(sizes[f[0] : f[1]]), default=None)
    if longest is None:
        return ""
    homes = [x.box for x in lines[longest[0] : longest[1]] if x.size]
    home = homes[0]
    for h in homes[1:]:
        home = read.around(home, h)
    out: list[str] = []
    for a, b, s in found:
        near = home > 0 and all(read.within(x.box, home) for x in lines[a:b] if x.size)
        if s > high or near:
            while a < b and lines[a].bar and not lines[a].size:
                a += 1
            out += [x.text for x in lines[a:b] if x.text]
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every page; a null or empty page, or one without text between surge and dive, has an empty text.

    Null ids and urls are kept, repeated rows are extracted each, and other columns are not read. Pages are independent:
    there is no shuffle. Malformed and truncated markup ends at the end of the page.
    """
    small_batches(pages.sparkSession)
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(tidy(_extract), schema).withColumnsRenamed({"id": id_col, "url": url_col})
