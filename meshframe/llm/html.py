"""Main text of web pages by tag-path ratios.

A page is read into blocks, each with its root-to-leaf path of block tags. Text length and punctuation are
aggregated by path; a path's ratios are those sums over its number of blocks. The two ratios are fused, less the share of
text in links, smoothed over neighbouring blocks in page order, and paths of at least a share of the page's mean are
content: all their blocks, short ones too. Blocks of other paths (lists, tables, references) follow what they stand with: the
article or main element of content, or, unless they are mostly links, the element that holds it. Page furniture that names itself (by tag, role, or a
whole class or id that says nothing else) has no part in the ratios; inside an article only elements that hold others do so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from meshframe.llm import store

#: HTML element names and the usual names of page furniture.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes".split())
HIDDEN = set("head noscript template iframe object canvas audio video desc metadata annotation annotation-xml button select datalist".split())
FURNITURE = set("nav footer aside form dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar sidenav widget widgets "
    "cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus reply replies respond pagination pager toolbar copyright".split()
)
#: Parts that a name of furniture may have beside those, and the elements that hold other ones.
FILLERS = set("bar box list block links link button buttons wrapper wrap container section area item items post posts article articles content inner outer icon icons media top bottom left right main site page primary secondary text message panel slot unit zone google global col row group info law header form".split())
HOLDERS = set("div section ul ol dl table aside nav form footer header details figure".split())
#: What an opening tag closes if it is open and nothing of the second set is between.
CLOSES = {**dict.fromkeys(BLOCKS - {"td", "th", "tr", "li", "dd", "dt"}, ({"p"}, {"table", "td", "th"})), "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt", "p"}, {"dl"}), "dt": ({"dd", "dt", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"table", "tr"}), "th": ({"td", "th", "p"}, {"table", "tr"})}
#: The least share of the mean score that makes a path content, and the most of its text in links.
LEAST, MOST_LINKED = 0.3, 0.6

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[^a-z0-9]+")
_MARKS = re.compile(r"[.,;:!?…、。！，？]")
_SPACE = re.compile(r"[ \t\n\r\f]+")


def _furniture(name: str, header: bool) -> bool:
    """Whether a class or id names furniture and nothing else: share-buttons does, share-price doesn't."""
    parts = {x for x in _PART.split(name) if x and not x.isdigit()}
    own = parts & NAMES or (header and "header" in parts)
    return bool(own) and parts <= NAMES | FILLERS


class _Reader:
    """Collects blocks: path, text, characters in links, element."""

    def __init__(self) -> None:
        self.blocks: list[tuple[int, str, int, int]] = []
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, furniture or hidden, path, block element
        self.elements: list[tuple[str, int]] = [("", 0)]  # tag and parent of each block element; 0 is the root
        self.paths: dict[tuple[int, str], int] = {}  # a path's number by its parent's and its last tag; 0 is the root
        self.open: dict[str, list[int]] = {}  # places on the stack of each open tag
        self.open_blocks: list[int] = []
        self.out = 0  # open elements that are furniture or hidden
        self.parts: list[str] = []
        self.linked, self.in_link = 0, 0

    def text(self, raw: str) -> None:
        if not self.out and raw:
            self.parts.append(raw)
            if self.in_link:
                self.linked += len(raw)

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", unescape("".join(self.parts))).replace("\xa0", " ")
            text = " ".join(text.split())
            if text:
                self.blocks.append((self.stack[-1][2] if self.stack else 0, text, self.linked, self.stack[-1][3] if self.stack else 0))
            self.parts, self.linked = [], 0

    def push(self, tag: str, bad: bool) -> None:
        path, element = self.stack[-1][2:] if self.stack else (0, 0)
        if tag in BLOCKS:
            path = self.paths.setdefault((path, tag), len(self.paths) + 1)
            self.elements.append((tag, element))
            element = len(self.elements) - 1
            self.open_blocks.append(len(self.stack))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, bad, path, element))
        self.out += bad

    def pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            tag, bad, *_ = self.stack.pop()
            self.open[tag].pop()
            if tag in BLOCKS:
                self.open_blocks.pop()
            self.out -= bad

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag == "a":
            self.in_link = 1
        elif tag == "br":
            self.text(" ")
        if tag in BLOCKS:
            self.flush()
            self.in_link = 0
            closes, keep = CLOSES.get(tag, (set(), set()))
            at = len(self.open_blocks)
            while at and self.stack[self.open_blocks[at - 1]][0] in closes - keep:
                at -= 1
            if at < len(self.open_blocks):
                self.pop_to(self.open_blocks[at])
        if tag in VOID or closed and tag not in BLOCKS:
            return
        if tag in BLOCKS or tag in HIDDEN:
            self.push(tag, tag in HIDDEN or tag in FURNITURE or self.named(tag, attributes))
        elif attributes and self.named(tag, attributes):
            self.push(tag, True)

    def named(self, tag: str, attributes: str) -> bool:
        inside = bool(self.open.get("article") or self.open.get("main"))
        if tag == "header" and not inside:
            return True
        if "=" not in attributes or tag in ("html", "body", "article", "main"):
            return False
        for name, a, b, c in _NAMED.findall(attributes):
            for value in (a or b or c).lower().split():
                if name.lower() == "role":
                    if value in ROLES:
                        return True
                elif (not inside or tag in HOLDERS) and _furniture(value, not inside):
                    return True
        return False

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
        if tag in BLOCKS:
            self.flush()
        if self.open.get(tag) and (tag in BLOCKS or not self.open_blocks or self.open[tag][-1] > self.open_blocks[-1]):
            self.pop_to(self.open[tag][-1])


#: Where the text of a raw element ends; letters of other alphabets have other lengths in lower case, so the page is searched as it is.
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}


def read_blocks(html: str) -> tuple[list[tuple[int, str, int, int]], list[tuple[str, int]]]:
    """(number of the path, text, characters in links, element) of the blocks with text in page order, without furniture, scripts and markup; tag and parent of the elements."""
    reader, at = _Reader(), 0
    while True:
        m = _TOKEN.search(html, at)
        if not m:
            break
        reader.text(html[at : m.start()])
        at = m.end()
        close, tag, attributes, stop = (m[1], m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7], m[8])
        if not tag or (not stop and at == len(html)):
            continue
        tag = tag.lower()
        if close:
            reader.end(tag)
        elif tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = (html.find(">", end.start()) + 1 or len(html)) if end else len(html)
        else:
            reader.start(tag, attributes, attributes.endswith("/"))
    reader.text(html[at:])
    reader.flush()
    return reader.blocks, reader.elements


def content_paths(blocks: list[tuple[int, str, int, int]]) -> tuple[set[int], set[int]]:
    """The paths whose smoothed, fused ratio is a share of the page's mean at least, and the paths that are mostly links."""
    sums: dict[int, list[float]] = {}
    for path, text, linked, _ in blocks:
        own = sums.setdefault(path, [0.0, 0.0, 0.0, 0.0])
        own[0] += 1
        own[1] += len(text)
        own[2] += len(_MARKS.findall(text))
        own[3] += min(linked, len(text))
    fused = {p: ((c / n) * (1 + m / n)) ** 0.5 * (1 - l / c) for p, (n, c, m, l) in sums.items()}  # noqa: E741
    row = [fused[p] for p, *_ in blocks]
    smooth = [(row[max(i - 1, 0)] + 2 * row[i] + row[min(i + 1, len(row) - 1)]) / 4 for i in range(len(row))]
    mean = sum(s * len(b[1]) for s, b in zip(smooth, blocks, strict=True)) / max(1, sum(len(b[1]) for b in blocks))
    by: dict[int, list[float]] = {}
    for s, (path, *_) in zip(smooth, blocks, strict=True):
        by.setdefault(path, []).append(s)
    linked = {p for p in by if sums[p][3] > MOST_LINKED * sums[p][1]}
    return {p for p, s in by.items() if sum(s) / len(s) >= LEAST * mean} - linked, linked


def content_blocks(blocks: list[tuple[int, str, int, int]], elements: list[tuple[str, int]]) -> list[bool]:
    """Which blocks are content: those of content paths, and those that stand with them."""
    paths, linked = content_paths(blocks)
    zone = [0] * len(elements)  # the nearest article or main element
    for e in range(1, len(elements)):
        tag, parent = elements[e]
        zone[e] = e if tag in ("article", "main") else zone[parent]
    sure = [i for i, b in enumerate(blocks) if b[0] in paths]
    zones = {zone[blocks[i][3]] for i in sure} - {0}
    # Elements that hold content, themselves or in a child. The body holds everything: there, only what is between counts.
    holds = {h for i in sure for h in (blocks[i][3], elements[blocks[i][3]][1])}
    top = [i for i in sure if elements[elements[blocks[i][3]][1]][0] in ("", "html", "body")]
    under = [False] * len(elements)
    for e in range(1, len(elements)):
        tag, parent = elements[e]
        under[e] = under[parent] or (e in holds and tag not in ("html", "body"))
    out = []
    for i, (path, _, _, e) in enumerate(blocks):
        near = under[e] or (bool(top) and top[0] < i < top[-1])
        out.append(path in paths or zone[e] in zones or (not zone[e] and path not in linked and near))
    return out


def main_text(html: str) -> str:
    blocks, elements = read_blocks(html)
    return "\n".join(b[1] for b, keep in zip(blocks, content_blocks(blocks, elements), strict=True) if keep)


def _extracted(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(x.as_py() or "") for x in part.column(part.schema.get_field_index("html"))]
            yield pa.RecordBatch.from_pydict({**{c: part.column(part.schema.get_field_index(c)) for c in names}, "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """The columns of pages but html, then text and n_chars (code points).

    Null and empty pages, and pages without content, have an empty text. A page cut off in a tag loses that tag.
    Repeated rows stay; columns of pages that clash with the new ones are replaced; an empty table gives an empty table.
    """
    pages = store.without(pages, "text", "n_chars")
    names, pages = [c for c in pages.columns if c.lower() != "html"], store.plain(pages)
    rest = store.without(pages, "html")
    return store.named(pages.mapInArrow(partial(_extracted, names=rest.columns), store.extended(rest, "text string, n_chars long")), names)
