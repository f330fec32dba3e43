"""HTML extraction with tag-path ratios.

A page becomes a list of blocks, each with its path of block tags from the root.
For every path the text, the text in links and the punctuation of its blocks are
added up, per block. Both ratios are smoothed over neighbouring blocks, fused by
multiplication, and paths at or above a share of the standard deviation are content.
Content nodes name the part of the page that is kept: the articles that hold one, all
of them, else the main element, else their deepest common element; there everything
stays that is not a menu, header, footer, sidebar, notice, advert, form, script, style
or reader comment by its element, role, class or id. An element that only its class or
id calls so, as in `has-sidebar` or `comments-open`, is kept where it holds the page
itself, and so is a form around a page; a paragraph needs a whole word of its class, as
in `notice`, not `notice-board`. Only where the deepest common element is the body itself do the paths alone
decide.

Results: NULL and empty html give an empty text; so do pages without text. Broken
markup is read as browsers do: unclosed elements end with their parent, blocks end an
open paragraph. Repeated rows are extracted each for itself; extra columns are not
returned. Pages are independent; a page is read whole, in one pass.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: share of the standard deviation of fused scores at which a path is content
THRESHOLD = 0.5
#: elements that are open at once; deeper ones stand beside each other, as in browsers
DEEPEST = 256

# Elements by their role in HTML
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div "
    "dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe legend li main menu nav noscript object ol option p pre search section select summary "
    "svg table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
EMPTY = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
LEFT_OUT = frozenset(
    "head nav footer aside script style noscript template iframe svg canvas object button "
    "select menu dialog textarea title video audio search noembed noframes".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar "
    "form toolbar tooltip".split()
)
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo "
    "promotion banner cookie cookies consent gdpr notice notices notification sidebar comment "
    "comments commentlist disqus reply replies respond menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead share sharing social related recommended newsletter subscribe "
    "signup login popup modal overlay widget widgets pagination pager toolbar skip".split()
)
#: elements that hold text itself: only a whole word of their class or id names them
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
COMMENT_NAMES = frozenset("comment comments reply replies".split())
#: names that wrappers of a whole page carry too: has-sidebar, widget-wrap, share-enabled
LAYOUT_NAMES = frozenset(
    "sidebar share sharing social widget widgets nav navbar navigation menu footer banner modal "
    "overlay toolbar related recommended ad ads header".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an element that ends an open one of these, up to one of the third
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<more2>[^>]*+)(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(
    r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
    re.I,
)
_NAME = re.compile(r"[a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？¿¡]")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


@dataclass
class _Element:
    name: str
    number: int
    left_out: bool
    headings_only: bool
    article: int
    main: int
    path: str
    heading: bool = False
    parent: _Element | None = None
    layout: tuple[int, ...] = ()
    headers: tuple[int, ...] = ()


@dataclass
class _Block:
    path: str
    inside: _Element
    heading: bool
    article: int
    main: int
    layout: tuple[int, ...] = ()
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _marked(name: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether attributes say that an element is not content, that its name is one of what stands
    beside the content, that this name is none of the layout, that it looks like a header."""
    names: set[str] = set()
    for kind, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if kind.lower() == "hidden" or kind.lower() == "aria-hidden" and value == "true":
            return name not in ("html", "body", "main", "article"), False, False, False
        if kind.lower() == "role" and value.strip() in ROLES:
            return True, False, False, False
        if kind.lower() in ("class", "id"):
            names.update(value.split() if name in TEXTUAL else _NAME.findall(value))
    if name in ("html", "body", "main"):
        return False, False, False, False
    named = names & (COMMENT_NAMES if name == "article" else NAMES)
    header = "header" in names and name != "article"
    return False, bool(named), bool(named - LAYOUT_NAMES), header


def _wrappers(blocks: list[_Block], judged: set[int] | None = None) -> set[int]:
    """Elements with the name of a part of the layout that hold the page itself.

    Such a one has most of the text outside links, a heading or several
    paragraphs, and no article or main element stands beside it. With ``judged``,
    of these elements only, whose names are no layout: beside such a one there is
    no text under a heading either, as there is beside many comments.
    """
    parts: dict[int, list[_Block]] = {}
    for b in blocks:
        for number in b.layout:
            if judged is None or number in judged:
                parts.setdefault(number, []).append(b)
    own = lambda some: sum(max(0, len(b.text) - b.linked) for b in some)
    told = lambda some: sum(b.article > 0 or b.main > 0 for b in some)
    total, articles = own(blocks), told(blocks)

    def alone(number: int, inside: list[_Block]) -> bool:
        layout = inside[0].layout
        around = set(layout[: layout.index(number)])
        beside = [b for b in blocks if number not in b.layout and around.issuperset(b.layout)]
        return not (any(b.heading for b in beside) and any(b.path.endswith("/p") for b in beside))

    return {
        number
        for number, inside in parts.items()
        if 2 * own(inside) > total
        and told(inside) == articles
        and (any(b.heading for b in inside) or sum(b.path.endswith("/p") for b in inside) > 1)
        and (judged is None or alone(number, inside))
    }


def blocks_of(page: str) -> list[_Block]:
    """The blocks of a page that no element leaves out, in order."""
    root = _Element("", 0, False, False, 0, 0, "")
    stack, found, numbers, anchors = [root], [], 0, 0
    paths: dict[str, str] = {}
    strange: set[int] = set()  # elements with names that are none of the layout
    block: _Block | None = None

    def add(text: str) -> None:
        nonlocal block
        top = stack[-1]
        if top.left_out or not text:
            return
        if block is None:
            if text.isspace():
                return
            if top.headings_only and not top.heading:
                return
            inner = top if top.name in BLOCKS or top is root else top.parent
            layout = top.layout if top.heading else top.layout + top.headers
            block = _Block(top.path, inner, top.heading, top.article, top.main, layout)
            found.append(block)
        block.parts.append(text)
        if anchors:
            block.linked += len(text)

    def close(to: int) -> None:
        nonlocal block, anchors
        for e in stack[to:]:
            if e.name in BLOCKS:
                block = None
            if e.name == "a":
                anchors -= 1
        del stack[to:]

    at = 0
    while at < len(page):
        match = _TAG.search(page, at)
        if not match:
            add(entities.unescape(page[at:]))
            break
        if match.start() > at:
            add(entities.unescape(page[at : match.start()]))
        at = match.end()
        if match["data"] is not None:
            add(match["data"])
            continue
        name = match["name"] or match["name2"]
        if name is None:
            continue
        name = name.lower()
        if match["end"] or match["end2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
                if name not in BLOCKS and stack[i].name in BLOCKS:
                    break  # an inline end does not close blocks
            else:
                if name in BLOCKS:
                    block = None
            continue
        attributes = match["more"] or match["more2"] or ""
        if name in BLOCKS:
            block = None
            if name in ENDS:
                same, limit = ENDS[name]
                cut = 0
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in limit:
                        break
                    if stack[i].name in same:
                        cut = i
                if cut:
                    close(cut)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in BLOCKS:
                    break
        if name == "br":
            add(" ")
        if name in EMPTY:
            continue
        top = stack[-1]
        marked, layout, other, header = _marked(name, attributes) if attributes else (False,) * 4
        # a form may hold the whole page
        layout = layout or name == "form"
        numbers += 1
        if other:
            strange.add(numbers)
        inside, deep = bool(top.article or top.main), len(stack) > DEEPEST
        path = f"{top.path}/{name}" if name in BLOCKS and not deep else top.path
        element = _Element(
            name,
            numbers,
            top.left_out or name in LEFT_OUT or marked or name == "header" and not inside,
            top.headings_only or name == "header",
            numbers if name == "article" and not top.article else top.article,
            numbers if name == "main" and not top.main else top.main,
            paths.setdefault(path, path),
            top.heading or name in HEADINGS,
            top if top is root or top.name in BLOCKS and not deep else top.parent,
            top.layout + (numbers,) * (layout and not deep),
            top.headers + (numbers,) * (header and not deep),
        )
        if name in RAW:
            end = _RAW_ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if attributes.rstrip().endswith("/") and name in ("svg", "path"):
            continue
        if deep:
            close(len(stack) - 1)
        stack.append(element)
        if name == "a":
            anchors += 1
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    found = [b for b in found if b.text]
    if strange:
        gone = strange - _wrappers(found, strange)
        found = [b for b in found if gone.isdisjoint(b.layout)]
        strange -= gone
    wrappers = _wrappers(found) | strange
    return [b for b in found if wrappers.issuperset(b.layout)]


def _smoothed(values: np.ndarray) -> np.ndarray:
    """Means over neighbours, weighed 1 2 1."""
    wide = np.concatenate([values[:1], values, values[-1:]])
    return (wide[:-2] + 2 * wide[1:-1] + wide[2:]) / 4


def content_paths(blocks: list[_Block]) -> set[str]:
    """The paths whose fused ratio reaches the threshold."""
    sums: dict[str, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0, 0, 0])
        s[0] += max(0, len(b.text) - b.linked)
        s[1] += len(_PUNCTUATION.findall(b.text))
        s[2] += 1
    text = _smoothed(np.array([sums[b.path][0] / sums[b.path][2] for b in blocks]))
    marks = _smoothed(np.array([sums[b.path][1] / sums[b.path][2] for b in blocks]))
    fused = text * (1 + marks)
    score: dict[str, list[float]] = {}
    for b, x in zip(blocks, fused, strict=True):
        score.setdefault(b.path, []).append(float(x))
    means = {path: sum(x) / len(x) for path, x in score.items()}
    least = min(THRESHOLD * float(fused.std()), max(means.values()))
    return {path for path, x in means.items() if x >= least}


def _lineage(block: _Block) -> list[_Element]:
    """The open block elements around a block, from the root on."""
    out, element = [], block.inside
    while element is not None:
        out.append(element)
        element = element.parent
    return out[::-1]


def main_text(page: str | None) -> str:
    """The main text of a page, blocks on lines of their own."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    paths = content_paths(blocks)
    content = [b for b in blocks if b.path in paths]
    for kind in ("article", "main"):
        sums: dict[int, int] = {}
        for b in content:
            if getattr(b, kind):
                sums[getattr(b, kind)] = sums.get(getattr(b, kind), 0) + len(b.text)
        if not sums and any(getattr(b, kind) for b in blocks):
            sums = {getattr(b, kind): 1 for b in blocks if getattr(b, kind)}
        if sums:
            return "\n".join(b.text for b in blocks if getattr(b, kind) in sums)
    shared = _lineage(content[0])
    for b in content[1:]:
        place = {e.number: i for i, e in enumerate(shared)}
        above: _Element | None = b.inside
        while above is not None and above.number not in place:
            above = above.parent
        shared = shared[: place[above.number] + 1] if above else []
    if shared and shared[-1].name not in ("", "html", "body"):
        kept = [b for b in blocks if any(e is shared[-1] for e in _lineage(b))]
    else:
        kept = [b for b in blocks if b.path in paths or b.heading]
    return "\n".join(b.text for b in kept)


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [main_text(x) for x in batch["html"]]
        yield pd.DataFrame(
            {
                "page_id": batch["page_id"],
                "url": batch["url"],
                "text": texts,
                "n_chars": [len(x) for x in texts],
            }
        )


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of all pages."""
    return pages.select("page_id", "url", "html").mapInPandas(
        _extracted, "page_id long, url string, text string, n_chars long"
    )
