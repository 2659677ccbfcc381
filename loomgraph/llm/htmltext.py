"""Main text of web pages: a recurrent labeller over the leaf blocks of each page."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm.common import small_batches
from loomgraph.llm.layouts import MARK, draw_pages
from loomgraph.llm.lstm import BiLstm, padded, train

#: Hashed features of tag paths and of words, then figures of the block.
PATH_BITS, WORD_BITS, FIGURES = 192, 64, 8
#: Depth at which the figure for it is full; the elements of a path count at any depth.
DEEPEST = 24
HIDDEN, EPOCHS, DRAWN_PAGES = 24, 8, 900

# Elements by their role in HTML.
RAW = "script style noscript textarea title iframe noembed noframes xmp"
UNSHOWN = frozenset("head template svg select button option datalist object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr input".split()
)
#: Controls whose end tag may be missing: what follows their own text is then part of the page.
CONTROLS = UNSHOWN - {"head", "template", "svg"}
#: Elements that end a drawing or formula when they begin in it.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HEAD_ONLY = frozenset("meta link title base script style noscript template".split())
#: An element that begins closes those of the set that are open, up to a container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "p": {"p"},
    "button": {"button"}, "select": {"select"},
}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot div section article main aside nav header footer body form".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW.replace(' ', '|')})\b[^>]*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|\b(hidden|display\s*:\s*none)\b""", re.I)
_WORD = re.compile(r"\w+")
_CUT_TAG = re.compile(r"\s*<[a-zA-Z/!?]")


def _slot(kind: str, value: str, size: int) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "replace")) % size


@lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> tuple[str, tuple[int, ...], int, bool]:
    """Tag, path features of the element, the feature of its tag as the nearest one, a link or not."""
    found = [_slot("tag", tag, PATH_BITS)]
    for names, hidden in _NAMES.findall(attributes):
        found += [_slot("name", n, PATH_BITS) for n in re.findall(r"[a-z]+", names.lower())]
        found += [_slot("hidden", "", PATH_BITS)] if hidden else []
    return tag, tuple(found), _slot("nearest", tag, PATH_BITS), tag == "a"


@dataclass
class Block:
    """Text between two block borders, with the innermost element around it.

    An element is (tag, the element around it or None, depth, what _element tells of it).
    """

    text: str
    around: tuple | None
    linked: int

    @property
    def path(self) -> tuple:
        """The elements around it, outermost first."""
        out, element = [], self.around
        while element is not None:
            out.append(element[3])
            element = element[1]
        return tuple(reversed(out))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, without scripts, styles, comments and controls.

    Inline elements do not end a block; `br` does. Elements left open are closed by what HTML
    lets close them, and end tags of nothing open are ignored. A control that its own end tag
    does not close hides only its text up to the next block border.
    """
    out: list[Block] = []
    stack: list[tuple] = []
    open_tags: dict[str, int] = {}
    pieces: list[str] = []
    linked = 0
    around: tuple | None = None
    # Of each open element that is not shown: its place in the stack, the number of blocks before
    # it, and whether its own text has ended.
    hidden: list[list] = []

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        # Blocks in a control are taken back by its end tag.
        if text and (not hidden or hidden[-1][2]):
            out.append(Block(text, around, linked))
        if hidden:
            hidden[-1][2] = True
        pieces.clear()
        linked = 0

    def pop(own: bool = False) -> None:
        tag = stack.pop()[0]
        if hidden and hidden[-1][0] == len(stack):
            _, before, _ = hidden.pop()
            if own or tag not in CONTROLS:
                del out[before:]
        open_tags[tag] -= 1
        if not open_tags[tag]:
            del open_tags[tag]

    def say(raw: str) -> None:
        nonlocal linked, around
        if not raw:
            return
        text = entities.unescape(raw)
        if not pieces and not text.isspace():
            around = stack[-1] if stack else None
        pieces.append(text)
        if "a" in open_tags:
            linked += len(text)

    def start(tag: str, attributes: str) -> None:
        if tag not in INLINE:
            flush()
        if "head" in open_tags and tag not in HEAD_ONLY:
            while "head" in open_tags:
                pop()
        if tag in BREAKOUT and ("svg" in open_tags or "math" in open_tags) and not open_tags.keys() & {"foreignobject", "desc"}:
            flush()
            while "svg" in open_tags or "math" in open_tags:
                pop()
        if tag not in INLINE and "p" in open_tags and tag != "br":
            while "p" in open_tags:
                pop()
        for closed in CLOSES.get(tag, ()):
            if closed in open_tags:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] != closed and stack[k][0] not in CONTAINERS:
                    k -= 1
                if k >= 0 and stack[k][0] == closed:
                    while len(stack) > k:
                        pop()
        closed = attributes.rstrip().endswith("/")
        if tag not in VOID and not (closed and tag in ("svg", "math")):
            if tag in UNSHOWN:
                hidden.append([len(stack), len(out), closed])
            stack.append((tag, stack[-1] if stack else None, len(stack) + 1, _element(tag, attributes)))
            open_tags[tag] = open_tags.get(tag, 0) + 1

    def stop(tag: str) -> None:
        if tag not in INLINE:
            flush()
        if tag in open_tags:
            while stack[-1][0] != tag:
                pop()
            pop(own=True)

    at, cut_off = 0, False
    # What follows the last ">" can be no markup, and is not searched for any.
    limit = page.rfind(">") + 1
    for found in _TOKEN.finditer(page, 0, limit):
        say(page[at : found.start()])
        at = found.end()
        raw = (found[1] or "").lower()
        ends, tag, attributes = (found[2], found[3], found[4]) if found[3] else (found[5], found[6], found[7])
        if tag:
            tag = tag.lower()
            stop(tag) if ends else start(tag, attributes)
            if tag in ("br", "hr"):
                flush()
        elif raw in ("textarea", "iframe"):
            flush()
        # A comment or script that nothing closes reaches to the end of the page.
        cut_off = at == limit and (
            not re.search(rf"</{raw}\s*>\Z", found[0], re.I) if raw else found[0].startswith("<!--") and not found[0].endswith("-->")
        )
    tail = page[at:]
    if not cut_off and not _CUT_TAG.match(tail):
        say(tail)
    flush()
    while hidden:
        pop()
    return out


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = _slot("word", word, WORD_BITS)
        return value


_WORDS = _Words()


def block_features(page: list[Block]) -> np.ndarray:
    """A row for each block: tag path, hashed words, and its figures."""
    x = np.zeros((len(page), PATH_BITS + WORD_BITS + FIGURES), np.float32)
    # Of the elements around the block before and around this one, only those that differ are counted.
    counts, last = np.zeros(PATH_BITS, np.float32), None
    for k, block in enumerate(page):
        row = x[k]
        new = block.around
        while last is not new:
            if last is None or new is not None and new[2] > last[2]:
                counts[list(new[3][1])] += 0.5
                new = new[1]
            else:
                counts[list(last[3][1])] -= 0.5
                last = last[1]
        row[:PATH_BITS] = counts
        last = near = block.around
        for _ in range(3):
            if near is not None:
                row[list(near[3][1])] += 0.5
                near = near[1]
        depth = 0
        if last is not None:
            row[last[3][2]] += 1
            depth = min(last[2], DEEPEST)
        words = _WORD.findall(block.text.lower())
        if words:
            counted = np.bincount(list(map(_WORDS.__getitem__, words)), minlength=WORD_BITS)
            row[PATH_BITS : PATH_BITS + WORD_BITS] = counted / len(words)
        n = len(block.text)
        row[-FIGURES:] = (
            np.log1p(n) / 5, block.linked / n, np.log1p(len(words)) / 4, block.text[-1] in ".!?:", depth / 10,
            k / len(page), np.log1p(k) / 4, np.log1p(len(page) - k) / 4,
        )
    np.minimum(x[:, :PATH_BITS], 2, out=x[:, :PATH_BITS])
    return x


@lru_cache(maxsize=2)
def learn_labeller(pages: int = DRAWN_PAGES, seed: int = 17, epochs: int = EPOCHS) -> BiLstm:
    """A labeller fitted on `pages` drawn layouts, the bound of its training sample."""
    sequences, labels = [], []
    for page in draw_pages(pages, seed):
        found = blocks(page)
        labels.append(np.array([MARK in b.text for b in found], np.float32))
        for b in found:
            b.text = b.text.replace(MARK, "") or "."
        sequences.append(block_features(found))
    return train(sequences, labels, HIDDEN, epochs)


def label(model: BiLstm, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which of its blocks belong to the article."""
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        end = at + 1
        # Pages of similar length side by side, about 20,000 blocks at a time.
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= 20_000:
            end += 1
        x, mask = padded([block_features(pages[k]) for k in order[at:end]])
        chance = model.predict(x, mask)
        for i, k in enumerate(order[at:end]):
            out[k] = chance[: len(pages[k]), i] > 0.5
        at = end
    return out


def main_texts(model: BiLstm, pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    return [
        " ".join(b.text for b, keep in zip(page, kept, strict=True) if keep)
        for page, kept in zip(found, label(model, found), strict=True)
    ]


def extract_pages(pages: DataFrame, model: BiLstm | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages(page_id, url, html)`.

    text joins the blocks that the labeller takes for the article by one blank, with character
    references decoded and white space inside a block as one blank; empty if there is none, as
    for a null or empty page. n_chars counts its code points. Every block of a page is read and
    labelled in view of the whole page. Repeated rows give equal rows; extra columns are left
    out. No shuffle; a task holds a few hundred pages at a time.
    """
    small_batches(pages.sparkSession)
    model = model or learn_labeller()
    kinds = [pages.schema[c].dataType for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = main_texts(model, [p or "" for p in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(arrow_kinds[0]), part.column(1).cast(arrow_kinds[1]),
                        pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars"],
                )

    arrow_kinds = [to_arrow_type(k) for k in kinds]
    schema = f"page_id {kinds[0].simpleString()}, url {kinds[1].simpleString()}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
