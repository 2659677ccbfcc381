"""Benchmark passages in documents, also reordered ones, by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructType

from loomgraph.llm.common import small_batches, written
from loomgraph.llm.shingles import WordHashes, windows

#: Words of the shortest tile, and the share of an item that tiles must cover.
LEAST_TILE = 5
COVERAGE = 0.8
#: Characters of a benchmark that is sent to the tasks; a larger one is joined by its seeds.
SLICE_CHARS = 16_000_000

#: Pairs of equal windows that are looked at together, and runs that are held in between.
PAIRS = 1_000_000
HELD_RUNS = 100_000

_WORD = re.compile(r"\w+")
_SIEVE_BITS = 20


def tokens(text: str, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words of a text, in lower case and without punctuation."""
    return hashes.of(_WORD.findall(text.lower()))


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST_TILE, held: int = HELD_RUNS) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the tiles, in the order in which they are marked.

    Always marks the longest match of unmarked words, the first in the item, then in the
    document, among equals, until none has `least` words. An item shorter than that must match
    as a whole. Of the runs in common the best `held` to twice as many are known at a time; what
    ranks behind them is looked for again among the words that are left once they are used up.
    """
    least = min(least, len(item))
    if not least or len(doc) < least:
        return []
    used_item, used_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    marked = []
    while True:
        waiting, last = _runs(item, doc, ~used_item, ~used_doc, least, held)
        heapq.heapify(waiting)
        while waiting and len(item) - np.count_nonzero(used_item) >= least:
            n, i, j = heapq.heappop(waiting)
            n = -n
            taken = used_item[i : i + n] | used_doc[j : j + n]
            if not taken.any():
                used_item[i : i + n] = used_doc[j : j + n] = True
                marked.append((i, j, n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True]))))
            for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                run = (begin - end, i + begin, j + begin)
                if end - begin >= least and (last is None or run <= last):
                    heapq.heappush(waiting, run)
        if last is None or len(item) - np.count_nonzero(used_item) < least:
            return marked


def _runs(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, least: int, held: int):
    """(runs, last): the best maximal common runs of free words, as (-length, place in item, in doc).

    Seeds are Karp-Rabin hashes of windows. A run begins at a window whose words on the left
    differ, or are not free, and ends at one whose words on the right do, so only these are kept
    of all pairs of equal windows, which are looked at in steps. All runs up to `last` are in the
    list; it is None where no run was left out.
    """
    own = np.flatnonzero(_all_free(free_item, least))
    theirs = np.flatnonzero(_all_free(free_doc, least))
    hashes, sought = windows(item, least)[own], windows(doc, least)[theirs]
    order = np.argsort(hashes, kind="stable")
    own, hashes = own[order], hashes[order]
    low = np.searchsorted(hashes, sought, "left")
    found = np.searchsorted(hashes, sought, "right") - low
    theirs, low, found = theirs[found > 0], low[found > 0], found[found > 0]
    total = np.cumsum(found)
    # (diagonal, place in item, 0 at a run's first window and 1 at its last)
    open_runs = np.zeros((0, 3), np.int64)
    runs, last, at = np.zeros((0, 3), np.int64), None, 0
    while at < len(theirs):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        count = found[at:end]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        j = np.repeat(theirs[at:end], count)
        i = own[np.repeat(low[at:end], count) + nth]
        true = np.ones(len(j), bool)
        for k in range(least):
            true &= item[i + k] == doc[j + k]
        i, j, at = i[true], j[true], end
        first = ~_goes_on(item, doc, free_item, free_doc, i - 1, j - 1)
        final = ~_goes_on(item, doc, free_item, free_doc, i + least, j + least)
        ends = [np.stack([j[w] - i[w], i[w], np.full(np.count_nonzero(w), kind)], axis=1) for kind, w in ((0, first), (1, final))]
        marks = np.concatenate([open_runs, *ends])
        marks = marks[np.lexsort((marks[:, 2], marks[:, 1], marks[:, 0]))]
        begins = np.flatnonzero(marks[:, 2] == 0)
        closed = np.append(marks[1:, 2] == 1, False)[begins]
        open_runs = marks[begins[~closed]]
        begin, close = marks[begins[closed]], marks[begins[closed] + 1]
        length = close[:, 1] - begin[:, 1] + least
        runs = np.concatenate([runs, np.stack([-length, begin[:, 1], begin[:, 0] + begin[:, 1]], axis=1)])
        if len(runs) > 2 * held:
            runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))[:held]]
            last = tuple(runs[-1].tolist())
    known = list(map(tuple, runs.tolist()))
    return [r for r in known if last is None or r <= last], last


def _all_free(free: np.ndarray, size: int) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(free)))
    return total[size:] - total[:-size] == size


def _goes_on(item, doc, free_item, free_doc, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the words at these places exist, are equal, and are free."""
    inside = (i >= 0) & (j >= 0) & (i < len(item)) & (j < len(doc))
    i, j = np.where(inside, i, 0), np.where(inside, j, 0)
    return inside & (item[i] == doc[j]) & free_item[i] & free_doc[j]


@dataclass
class _Items:
    """Items of a small benchmark, with the windows that seed a match."""

    ids: list
    words: list[np.ndarray]

    def __post_init__(self):
        seeds = [windows(w, min(LEAST_TILE, len(w))) if len(w) else w for w in self.words]
        self.sizes = sorted({min(LEAST_TILE, len(w)) for w in self.words if len(w)})
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        flat = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[self._low(self.seeds)] = True

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << _SIEVE_BITS) - 1)).astype(np.int64)

    def sharing(self, doc: np.ndarray) -> np.ndarray:
        """Numbers of the items that share a seed with a document."""
        out = [np.zeros(0, np.int64)]
        for size in self.sizes:
            h = windows(doc, size)
            h = np.unique(h[self.sieve[self._low(h)]])
            low, high = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
            out += [self.owner[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a]
        return np.unique(np.concatenate(out))


HIT = "array<struct<item_id {}, item_tokens int, matched_tokens int, tiles int, coverage double>>"


def _hits(items: _Items, id_type, coverage: float):
    """A function of a text column: the items it contains."""
    arrow_id = to_arrow_type(id_type)
    kind = pa.list_(
        pa.struct(
            [("item_id", arrow_id), ("item_tokens", pa.int32()), ("matched_tokens", pa.int32()),
             ("tiles", pa.int32()), ("coverage", pa.float64())]
        )
    )

    @arrow_udf(HIT.format(id_type.simpleString()))
    def hits(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()

        def of(text: str) -> list[dict]:
            doc, out = tokens(text, hashes), []
            for k in items.sharing(doc).tolist():
                item = items.words[k]
                found = tiles(item, doc)
                matched = sum(n for _, _, n in found)
                if matched >= coverage * len(item):
                    out.append(
                        {"item_id": items.ids[k], "item_tokens": len(item), "matched_tokens": matched,
                         "tiles": len(found), "coverage": matched / len(item)}
                    )
            return out

        for batch in texts:
            yield pa.array([of(t.as_py() or "") for t in batch], kind)

    return hits


def _broadcast_hits(benchmark: DataFrame, coverage: float, slice_chars: int):
    """A function of a text column, for a benchmark of at most `slice_chars` characters; else None.

    It gives an array of struct(item_id, item_tokens, matched_tokens, tiles, coverage) of the items
    whose tiles cover at least `coverage` of their words. The items are sent to each task.
    """
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    chars, rows = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count(F.lit(1))).first()
    if chars + rows > slice_chars:
        return None
    hashes = WordHashes()
    own = items.toArrow()
    words = [tokens(t, hashes) for t in own["text"].to_pylist()]
    return _hits(_Items(own["item_id"].to_pylist(), words), benchmark.schema["item_id"].dataType, coverage)


def _seeds(sizes: list[int] | None, distinct: bool):
    """A function of a text column: its window hashes, of `sizes` or of the size an item of it has."""

    @arrow_udf("array<long>")
    def seeds(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()

        def of(text: str) -> np.ndarray:
            words = tokens(text, hashes)
            wide = sizes or ([min(LEAST_TILE, len(words))] if len(words) else [])
            found = np.concatenate([windows(words, size) for size in wide] or [np.zeros(0, np.uint64)])
            return (np.unique(found) if distinct else found).view(np.int64)

        for batch in texts:
            yield pa.array([of(t.as_py() or "") for t in batch], pa.list_(pa.int64()))

    return seeds.asNondeterministic()


@arrow_udf(IntegerType())
def _n_tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([len(_WORD.findall((t.as_py() or "").lower())) for t in batch], pa.int32())


@arrow_udf(StructType().add("matched_tokens", IntegerType()).add("tiles", IntegerType()))
def _tiled(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct([("matched_tokens", pa.int32()), ("tiles", pa.int32())])
    hashes = WordHashes()
    for items, docs in columns:
        out = []
        for item, doc in zip(items, docs, strict=True):
            found = tiles(tokens(item.as_py(), hashes), tokens(doc.as_py(), hashes))
            out.append({"matched_tokens": sum(n for _, _, n in found), "tiles": len(found)})
        yield pa.array(out, kind)


def _text_id(text: Column) -> Column:
    return F.sha2(text, 256)


def _joined_hits(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """(text_id, copies, item_id, item_tokens, matched_tokens, tiles, coverage) for a benchmark of any size.

    Distinct texts and items are joined by seeds. Tiles of five words or more that cover a share c
    of an item's n words hold at least c * n / 5 of its windows, so its most frequent windows, fewer
    than that, need not be looked up: what stands in very many documents is a seed only of items
    that have little else. Nothing of the benchmark is on the driver.
    """
    texts = docs.select("text").where(F.length("text") > 0).distinct()
    texts = texts.select(_text_id(F.col("text")).alias("text_id"), F.col("text").alias("doc_text"))
    items = benchmark.where(F.length("text") > 0).groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    items = written(
        items.withColumn("item_key", F.sha2(F.to_json(F.struct("item_id", "text")), 256))
        .withColumn("item_tokens", _n_tokens.asNondeterministic()("text")),
        "items",
    ).where(F.col("item_tokens") > 0)
    own = items.select("item_key", "item_tokens", F.explode(_seeds(None, False)("text")).alias("seed"))
    sizes = [r[0] for r in items.select(F.least("item_tokens", F.lit(LEAST_TILE))).distinct().collect()]  # five at most
    if not sizes:
        sizes = [LEAST_TILE]
    all_seeds = texts.select("text_id", F.explode(_seeds(sorted(sizes), True)("doc_text")).alias("seed"))
    seen = written(all_seeds.join(own.select("seed").distinct(), "seed", "left_semi"), "seeds")
    frequency = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    spare = F.ceil(F.col("item_tokens") * coverage / LEAST_TILE - 1e-6) - 1
    rarest = (
        own.join(frequency, "seed", "left")
        .withColumn("nth", F.row_number().over(Window.partitionBy("item_key").orderBy(F.desc_nulls_last("n"), "seed")))
        .where((F.col("nth") > spare) & F.col("n").isNotNull())
        .select("item_key", "seed")
        .distinct()
    )
    pairs = seen.join(rarest, "seed").select("text_id", "item_key").distinct()
    tiled = (
        pairs.join(items, "item_key")
        .join(texts, "text_id")
        .withColumn("found", _tiled.asNondeterministic()("text", "doc_text"))
        .where(F.col("found.matched_tokens") >= F.lit(coverage) * F.col("item_tokens"))
    )
    share = F.col("found.matched_tokens") / F.col("item_tokens")
    return tiled.select(
        "text_id", "copies", "item_id", "item_tokens", "found.matched_tokens", "found.tiles", share.alias("coverage")
    )


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """(doc_id, item_id, item_tokens, matched_tokens, tiles, coverage) of contained items.

    Words are runs of letters, digits and underscores in lower case. An item is contained where
    tiles of at least five words, each word used once, cover 0.8 of it, in whatever order; an
    item of fewer words has to occur as it stands, one without words never does. Null and empty
    texts contain nothing. Repeated rows give repeated results; extra columns are ignored; an
    empty table on either side gives no rows. A benchmark of at most `slice_chars` characters is
    sent to the tasks, and documents are not shuffled; a larger one is joined with them by seeds.
    """
    small_batches(docs.sparkSession)
    hits = _broadcast_hits(benchmark, coverage, slice_chars)
    if hits is not None:
        return docs.select("doc_id", F.inline(hits(F.col("text"))))
    found = _joined_hits(docs, benchmark, coverage)
    rows = docs.select("doc_id", _text_id(F.col("text")).alias("text_id")).join(found, "text_id")
    rows = rows.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.drop("text_id", "copies")


def is_clean(text: Column, hits) -> Column:
    return F.size(hits(F.coalesce(text, F.lit("")))) == 0


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """The documents that contain no item, with all their columns.

    Without a shuffle for a benchmark of at most `slice_chars` characters; see `find_leaks`.
    """
    small_batches(docs.sparkSession)
    hits = _broadcast_hits(benchmark, coverage, slice_chars)
    if hits is not None:
        return docs.where(is_clean(F.col("text"), hits))
    leaked = _joined_hits(docs, benchmark, coverage).select(F.col("text_id").alias("__text_id")).distinct()
    return docs.join(leaked, _text_id(F.col("text")) == F.col("__text_id"), "left_anti")
