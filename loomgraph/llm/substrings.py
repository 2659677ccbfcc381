"""Removal of long repeated byte strings: ranks of positions, doubled from places chosen by content.

Two equal strings of LENGTH bytes choose the same place in them, by the least hash of GRAM bytes
among their first WIDTH starts, and agree on the LENGTH - WIDTH + 1 bytes from there on. So the
first round ranks only such places, by that many bytes, and drops what is unique. Further rounds
pair a rank with what lies around the place, at growing lengths, for whole ranges of starts: the
bytes that all strings of a range cover (`union`), and those that each of them covers (`core`).
A range with a repeated union is repeated throughout, one with a unique core nowhere; what is
neither is cut into smaller ranges, the last of one start each, where both are the LENGTH bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructType

from loomgraph.llm.bytehash import Hashes, least_in_windows
from loomgraph.llm.common import join_counted, same, settled, small_batches, text_key

LENGTH = 400
WIDTH, GRAM = 256, 16
FIRST = LENGTH - WIDTH + 1
#: Starts in a range of the second round; the third has single starts.
RANGE = 16
#: Starts whose places are looked for at a time.
SEGMENT = 1 << 22
#: Buckets of documents that a broadcast filter tells apart: a bound on its rows.
FILTER_BUCKETS = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)

#: A place, and how far before it its first and last start lie, in one number.
DISTANCE_BITS = 8


def _anchors(data: bytes, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, and the first and last start that chooses each."""
    starts = len(data) - LENGTH + 1
    grams = hashes.every(GRAM)
    chosen = np.concatenate(
        [
            least_in_windows(grams[at : at + SEGMENT + WIDTH - 1], WIDTH)[: min(SEGMENT, starts - at)] + at
            for at in range(0, starts, SEGMENT)
        ]
    )
    cut = np.flatnonzero(np.diff(chosen)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [starts - 1]))
    return chosen[first], first, last


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _flat(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key(F.col("text")).alias("tkey"), "text")


def _ranks(docs: DataFrame) -> DataFrame:
    """(g): the rank of each chosen place, from its first FIRST bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            out = []
            for text in part.column(0).to_pylist():
                data = (text or "").encode()
                if len(data) >= LENGTH:
                    hashes = Hashes(data)
                    at, _, _ = _anchors(data, hashes)
                    out.append(_signed(hashes.of(at, at + FIRST)))
            yield pa.RecordBatch.from_arrays([pa.array(_flat(out))], ["g"])

    return docs.select("text").mapInArrow(run, "g long")


def _places(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, place, g, whole): chosen places with the hash of all that their starts cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            row, place, g, whole = [], [], [], []
            for i, text in enumerate(part.column(2).to_pylist()):
                data = (text or "").encode()
                if len(data) < LENGTH:
                    continue
                hashes = Hashes(data)
                at, first, last = _anchors(data, hashes)
                row.append(np.full(len(at), i))
                place.append((((at << DISTANCE_BITS) | (at - first)) << DISTANCE_BITS) | (at - last))
                g.append(_signed(hashes.of(at, at + FIRST)))
                whole.append(_signed(hashes.of(first, last + LENGTH)))
            at_row = pa.array(_flat(row))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at_row), part.column(1).take(at_row), *(pa.array(_flat(x)) for x in (place, g, whole))],
                ["doc_id", "tkey", "place", "g", "whole"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, tkey long, place long, g long, whole long")


def _ranges(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, tkey, at, g, low, union, core) of the ranges of `width` starts to look at.

    `texts` has `open`, an array of (g, at, low, high): a place and the distances, before it, of
    the starts in question. Ranges lie on a fixed grid of distances, so that they compare. A
    range that sticks out of its text has a union of its own, which equals no other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches, 64):
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, (text, own) in enumerate(zip(part.column(2).to_pylist(), part.column(3), strict=True)):
                data = (text or "").encode()
                hashes = Hashes(data)
                g, at, low, high = (own.values.field(k).to_numpy() for k in range(4))
                grid = np.arange(0, WIDTH, width)
                far = at[:, None] - grid - (width - 1)
                look = (low[:, None] <= grid + width - 1) & (high[:, None] >= grid)
                which, cell = np.nonzero(look & (far + width - 1 >= 0) & (far + LENGTH <= len(data)))
                place, begin, first = at[which], grid[cell], far[which, cell]
                last = first + width - 1
                inside = (first >= 0) & (last + LENGTH <= len(data))
                union = hashes.of(np.maximum(first, 0), np.minimum(last + LENGTH, len(data)))
                alone = hashes.of(np.zeros(1, int), np.full(1, len(data))) + (place * WIDTH + begin).astype(np.uint64)
                union = np.where(inside, union, alone * _ODD)
                core = hashes.of(last, first + LENGTH)
                values = (np.full(len(place), i), place, g[which], begin, _signed(union), _signed(core))
                for column, x in zip(columns, values, strict=True):
                    column.append(x)
            row, *rest = (pa.array(_flat(c).astype(np.int64)) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(row), part.column(1).take(row), *rest],
                ["doc_id", "tkey", "at", "g", "low", "union", "core"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "tkey", "text", "open")
    return rows.mapInArrow(run, f"doc_id {kind}, tkey long, at long, g long, low long, union long, core long")


def _with_open(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Texts with their `places(doc_id, tkey, g, at, low, high)` in an array `open`."""
    lists = places.groupBy(F.col("doc_id").alias("__id"), F.col("tkey").alias("__tkey")).agg(
        F.collect_set(F.struct("g", "at", "low", "high")).alias("open")
    )
    on = same(texts["doc_id"], lists["__id"]) & (texts["tkey"] == lists["__tkey"])
    return texts.join(lists, on).select("doc_id", "tkey", "text", "open")


def _likely(docs: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that may be among the documents of `places`, and those that are not.

    Only the buckets of those documents are broadcast, so their number has a bound; with very
    many documents the filter lets all pass, and the join that follows does the whole work.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "tkey"), F.lit(FILTER_BUCKETS))
    some = F.broadcast(settled(places.select(bucket.alias("__bucket")).distinct()))
    rows = _keyed(docs).withColumn("__bucket", bucket)
    return (
        rows.join(some, "__bucket", "left_semi").drop("__bucket"),
        rows.join(some, "__bucket", "left_anti").drop("__bucket"),
    )


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, first, last): ranges of starts of LENGTH bytes that occur elsewhere, too."""
    small_batches(docs.sparkSession)
    counts = settled(_ranks(docs).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    near = settled(join_counted(_places(docs), counts, ["g"], "n").drop("n"))
    # Second rank: the first with everything that the starts of a place cover.
    mask = (1 << DISTANCE_BITS) - 1
    at = F.shiftright("place", 2 * DISTANCE_BITS)
    high = F.shiftright("place", DISTANCE_BITS).bitwiseAND(mask)
    low = F.col("place").bitwiseAND(mask)
    shape = F.col("place").bitwiseAND((1 << 2 * DISTANCE_BITS) - 1)
    shaped = near.withColumn("shape", shape)
    classes = settled(
        shaped.groupBy("g", "shape", "whole").agg(
            F.count("*").alias("n"), F.min(F.struct("doc_id", "tkey", "place")).alias("sample")
        )
    )
    equal = classes.where(F.col("n") > 1).select("g", "shape", "whole", "n")
    whole = join_counted(shaped, settled(equal), ["g", "shape", "whole"], "n").select(
        "doc_id", "tkey", (at - high).alias("first"), (at - low).alias("last")
    )
    # What is left: places that met no equal, and one of each class they may meet in part.
    mixed = settled(
        classes.groupBy("g")
        .agg(F.count("*").alias("n"), F.min("n").alias("least"))
        .where((F.col("n") > 1) & (F.col("least") == 1))
        .select("g", "n")
    )
    open_places = settled(
        join_counted(classes.select("g", "sample"), mixed, ["g"], "n").select(
            "g", "sample.doc_id", "sample.tkey", "sample.place"
        ).select("g", "doc_id", "tkey", at.alias("at"), low.alias("low"), high.alias("high"))
    )
    likely, _ = _likely(docs, open_places)
    texts = settled(_with_open(likely, open_places))
    found, undecided = _round(_ranges(texts, RANGE), RANGE)
    whole = whole.unionByName(found)
    again = settled(_with_open(texts.drop("open"), undecided))
    found, _ = _round(_ranges(again, 1), 1)
    return whole.unionByName(found)


def _round(ranges: DataFrame, width: int) -> tuple[DataFrame, DataFrame | None]:
    """Ranges that are repeated, and the places with the starts that have to be looked at again."""
    keys = ["g", "low", "core", "union"]
    rows = settled(ranges)
    classes = settled(
        rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tkey", "at")).alias("sample"))
    )
    equal = settled(classes.where(F.col("n") > 1).select(*keys, "n"))
    found = join_counted(rows, equal, keys, "n").select(
        "doc_id", "tkey", (F.col("at") - F.col("low") - (width - 1)).alias("first"), (F.col("at") - F.col("low")).alias("last")
    )
    if width == 1:
        return found, None
    # A core that only one class has, while that class is equal throughout or alone, is settled.
    shared = settled(
        classes.groupBy("g", "low", "core").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    )
    undecided = join_counted(classes.select(*keys, "sample"), shared, ["g", "low", "core"], "n")
    return found, undecided.select(
        "g", "sample.doc_id", "sample.tkey", "sample.at", "low", (F.col("low") + width - 1).alias("high")
    )


_CUT = (
    StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
)


@arrow_udf(_CUT)
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        data = (text or "").encode()
        merged: list[list[int]] = []
        for s in sorted((s["first"], s["last"] + LENGTH) for s in own or []):
            begin, end = max(s[0], 0), min(s[1], len(data))
            if merged and begin <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([begin, end])
        kept, at = [], 0
        for begin, end in merged:
            kept.append(data[at:begin])
            at = end
        kept.append(data[at:])
        out.append(
            {"n_bytes": len(data), "n_removed": sum(e - b for b, e in merged), "n_spans": len(merged), "kept": b"".join(kept)}
        )
    return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of `docs(doc_id, text)`.

    Takes out every byte of the UTF-8 text that a string of LENGTH bytes covers which starts
    anywhere else as well, in the same document or another; overlaps count, and all strings are
    judged on the input. `kept` has the remaining bytes, which need not be valid UTF-8, and
    n_spans counts the maximal runs taken out. Null texts are empty. Rows equal in doc_id and
    text are documents of their own, so each repeats the other. Extra columns are left out.

    Equality is that of two independent 64-bit hashes. A string with very many occurrences is
    counted with map-side aggregation and joined back over several tasks. Whole texts are
    shuffled for documents with repeats in part, through a filter of bounded size, and once more
    for those with anything to take out.
    """
    starts = settled(repeated_starts(docs))
    spans = starts.groupBy(F.col("doc_id").alias("__id"), F.col("tkey").alias("__tkey")).agg(
        F.collect_set(F.struct("first", "last")).alias("spans")
    )
    likely, rest = _likely(docs, starts)
    on = same(likely["doc_id"], spans["__id"]) & (likely["tkey"] == spans["__tkey"])
    joined = likely.join(spans, on, "left").select("doc_id", "text", "spans")
    whole = rest.select("doc_id", "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans"))
    cut = joined.unionByName(whole).withColumn("c", _cut(F.coalesce("text", F.lit("")), "spans"))
    return cut.select("doc_id", "c.*")


def cut_repeats_plainly(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same by brute force, for tests: (n_bytes, n_removed, n_spans, hex digest of the rest)."""
    seen: dict[bytes, int] = {}
    all_data = [(t or "").encode() for t in texts]
    for data in all_data:
        for i in range(len(data) - length + 1):
            seen[data[i : i + length]] = seen.get(data[i : i + length], 0) + 1
    out = []
    for data in all_data:
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        runs = int((np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1).sum())
        out.append((len(data), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out
