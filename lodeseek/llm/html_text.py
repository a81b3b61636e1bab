"""Main text of web pages by line-block distribution.

Markup is stripped so that each block of a page is a line. Furniture goes with its markup and leaves no
line: what is inside a menu, header, footer, sidebar, notice, advert, form or comments by element, role,
class or id (unless an element so marked by class or id lies around the article or its heading, or only has
a weak mark and holds a good deal of prose), so that what stands inside an article does not part it.

A line counts the characters of its text that are no links, and EDGE more if its element is one of text (a
paragraph, a list item); a line of links mostly counts nothing. Where the page marks an article, lines
inside count SURGE more and lines outside count nothing. The counts are summed over windows of WINDOW lines
that slide down the page. A surge is where a sum rises to SURGE (or half of the page's largest sum, if that
is less), a dive where it falls below a quarter of that, and the text between a surge and its dive is a
stretch of the article. Lines at the ends of a stretch that count less than EDGE go; every stretch is kept.
"""

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import arrow_map

WINDOW = 3
#: Characters in a window from which text begins; a quarter of them ends it.
SURGE = 80.0
#: Characters from which a line may begin or end the text.
EDGE = 25.0
#: A weakly marked element is text if it has so many paragraphs and characters.
PROSE_PARAGRAPHS, PROSE_CHARS = 3, 500
#: A line outside a marked article is furniture if more of its characters than this share are links.
LINKS = 0.6

# Elements, roles and the words of classes and ids that mark furniture.
DROPPED = frozenset(
    "script style noscript template iframe svg canvas math object audio video head title nav footer aside form button select textarea datalist dialog menu".split()
)
RAW = frozenset("script style noscript template iframe svg textarea title".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li main ol p pre section summary table tbody tfoot thead tr ul caption search hgroup".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
MARKS = frozenset(
    """ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars rail widget widgets related
    recommended recommendations teaser teasers footer masthead topbar toolbar cookie cookies consent gdpr notice notices banner
    alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist
    respond reply replies disqus discussion reactions form search copyright disclaimer skip""".split()
)
STRONG = frozenset("ad ads advert advertisement sponsored promo related teaser comment comments reply replies".split())
WEAK = frozenset("search notice notices social form skip banner alert rail modal widget widgets overlay share sharing promotion".split())
TEXT = frozenset("p h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption caption tr td th summary".split())
PAGE_HEADS = frozenset("header head top".split())
OWN = frozenset("article post entry content story main page body title text".split())
NEVER = frozenset("html body h1 h2 h3 h4 h5 h6 b i em strong u mark code sub sup small abbr".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
_P = re.compile(r"<p(?=[\s>])", re.I)
_TAG = re.compile(r"<[^>]*>")
_SPACE = re.compile(r"\s+")
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _is_furniture(name: str, attrs: str, inside: bool) -> str:
    """What tells that an element is furniture: "part" for its name, role or state, "mark" for its class or id; empty if nothing does."""
    if name in DROPPED or (name == "header" and not inside):
        return "part"
    if not attrs.strip() or name in NEVER:
        return ""
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(attrs)}
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return "part"
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return "part"
    words = _words(found)
    if name in ("article", "main"):
        return "part" if words & STRONG else ""
    if words & MARKS or (words & PAGE_HEADS and not words & OWN and not inside):
        return "mark"
    return ""


def _words(found: dict[str, str]) -> set[str]:
    return {w.lower() for k in ("class", "id") for w in _WORD.findall(found.get(k, ""))}


class _Outline:
    """Where elements end, and where articles, main parts and h1 begin; positions are those after the start tag."""

    def __init__(self, page: str):
        self.page, self.ends, self.pieces, self.h1 = page, {}, [], []
        mains, opened, at = [], {}, 0
        while m := _TOKEN.search(page, at):
            at = m.end()
            name = (m["name"] or "").lower()
            if not name or name in VOID:
                continue
            if m["close"]:
                if opened.get(name):
                    self.ends[opened[name].pop()] = m.start()
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            opened.setdefault(name, []).append(at)
            if name == "h1":
                self.h1.append(at)
            elif name in ("article", "main") and not _is_furniture(name, m["attrs"] or "", True):
                self.pieces.append(at)
                if name == "main":
                    mains.append(at)
        # The page's own article: its main part, or else the one that runs longest before another begins.
        sizes = [min(self.end(p), after) - p for p, after in zip(self.pieces, [*self.pieces[1:], len(page)])]
        self.own = mains[0] if mains else self.pieces[sizes.index(max(sizes))] if sizes else -1

    def end(self, at: int) -> int:
        return self.ends.get(at, len(self.page))

    def is_layout(self, attrs: str, at: int) -> bool:
        """Whether an element that a mark calls furniture holds the text of the page all the same.

        It does if its marks are weak and it has much prose, if it holds the page's own article, or any article and has an OWN word, or an h1 and paragraphs (on a
        page without paragraphs, an h1). One with a STRONG mark has to hold the own article or all h1 of the page.
        """
        end = self.end(at)
        if at <= self.own < end:
            return True
        words = _words({k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(attrs)})
        if words & MARKS <= WEAK and self._is_prose(at, end):
            return True
        if words & OWN and not words & STRONG and any(at <= p < end for p in self.pieces):
            return True
        held = sum(at <= p < end for p in self.h1)
        if not held or (words & STRONG and held < len(self.h1)):
            return False
        return _P.search(self.page, at, end) is not None or _P.search(self.page) is None


    def _is_prose(self, at: int, end: int) -> bool:
        begins = [m.start() for m in _P.finditer(self.page, at, end)]
        if len(begins) < PROSE_PARAGRAPHS:
            return False
        return len(_SPACE.sub(" ", _TAG.sub("", self.page[begins[0] : end]))) >= PROSE_CHARS


def _lines(page: str) -> tuple[list[tuple[str, int, bool, str]], bool]:
    """Lines of a page: text, characters inside links, inside an article, element; and whether the page marks an article."""
    lines: list[tuple[str, int, bool, str]] = []
    parts: list[str] = []
    linked, in_link, depth, marked, kind = 0, False, 0, False, ""
    skip, skip_depth, until = "", 0, -1
    whole = re.search(r"</(?:body|html)\s*>", page, re.I) is not None
    at = 0
    outline: _Outline | None = None

    def end_line() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append((text, min(linked, len(text)), depth > 0, kind))
        parts.clear()
        linked = 0

    def read(text: str) -> None:
        nonlocal linked
        if text and not skip:
            parts.append(text)
            if in_link:
                linked += len(text)

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            read(page[at:])
            break
        read(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        closing = bool(m["close"])
        if skip:
            if name == skip:
                skip_depth += -1 if closing else 1
            # A part that is never closed in a page that is complete ends where the article begins.
            lost = until < 0 and whole and not closing and name in ("article", "main", "h1")
            if skip == "head" and not closing and name == "body":
                lost = True
            if skip_depth <= 0 or lost:
                skip = ""
                if not lost:
                    continue
            else:
                continue
        if closing:
            if name in ("article", "main"):
                end_line()
                depth, kind = max(0, depth - 1), ""
            elif name in BLOCKS:
                end_line()
                kind = ""
            elif name == "a":
                in_link = False
            elif name in ("td", "th"):
                parts.append(" ")
            continue
        furniture = name not in VOID and _is_furniture(name, m["attrs"] or "", depth > 0)
        if furniture == "mark":
            outline = outline or _Outline(page)
            if outline.is_layout(m["attrs"], at):
                furniture = ""
        if furniture:
            if name in BLOCKS or name in DROPPED - RAW:
                end_line()
            if name in RAW:
                # Content up to its own end tag, whatever it looks like.
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            skip, skip_depth = name, 1
            closed = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            until = closed.end() if closed else -1
            continue
        if name in ("article", "main"):
            end_line()
            depth, kind = depth + 1, ""
            marked = True
        elif name in BLOCKS:
            end_line()
            kind = name
        elif name in ("br", "td", "th", "wbr"):
            parts.append("" if name == "wbr" else " ")
        elif name == "a":
            in_link = True
    end_line()
    return lines, marked


def _counts(lines: list[tuple[str, int, bool, str]], marked: bool) -> list[float]:
    """What each line counts in a window."""
    counts = []
    for text, linked, inside, kind in lines:
        if marked:
            counts.append(len(text) + SURGE if inside else 0.0)
        elif linked > LINKS * len(text):
            counts.append(0.0)
        else:
            counts.append(len(text) - linked + (SURGE if kind == "h1" else EDGE if kind in TEXT else 0.0))
    return counts


def stretches(counts: list[float], window: int = WINDOW) -> list[tuple[int, int]]:
    """First line and the one after the last of each stretch between a surge and its dive."""
    # Sums over the windows that begin at each line; the last windows run past the end.
    sums, total = [0.0] * len(counts), 0.0
    for i in range(len(counts) - 1, -1, -1):
        total += counts[i] - (counts[i + window] if i + window < len(counts) else 0.0)
        sums[i] = total
    surge = min(SURGE, max(sums, default=0.0) / 2)
    edge = min(EDGE, max(counts, default=0.0))
    found, begin = [], None
    for i, s in enumerate([*sums, 0.0]):
        if begin is None and s >= surge > 0:
            begin = i
        elif begin is not None and s < surge / 4:
            # A window reaches ahead of the text: it begins and ends at lines that count enough by themselves.
            full = [k for k in range(begin, i) if counts[k] >= edge]
            if full:
                found.append((full[0], full[-1] + 1))
            begin = None
    return found


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The main text of a page: its blocks in order, joined by blank lines; empty if there is none."""
    lines, marked = _lines(page or "")
    kept = [x for a, b in stretches(_counts(lines, marked), window) for x in lines[a:b]]
    return "\n\n".join(text for text, _, inside, _ in kept if inside or not marked)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text and n_chars (code points).

    The whole page is read; a null page counts as empty and has an empty text. Ids and URLs may be null or
    repeat; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    out = arrow_map(rows, run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
