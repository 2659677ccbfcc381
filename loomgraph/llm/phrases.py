"""Document fingerprints by locally consistent parsing with deterministic coin tossing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm.common import small_batches, text_key, written

#: Levels of the parse whose phrases are kept, and least hashes kept of each, 16 bits wide.
#: A phrase of the levels has about 12, 40 and 130 bytes.
LEVELS, BINS = (2, 3, 4), 32
#: Characters that are parsed at a time.
CHUNK = 1 << 20
#: Bytes of text in a range of ids, about.
BUCKET_BYTES = 4 << 20
#: Ranges at most: the sampled bounds of so many are what Spark's driver holds.
MOST_RANGES = 20_000

_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_HALF = np.uint64(32)
_POWERS = np.array([pow(0xD1342543DE82EF95, k, 1 << 64) for k in range(512)], np.uint64)
_DEBRUIJN = np.uint64(0x03F79D71B4CB0A89)
_LOWEST = np.zeros(64, np.uint8)
_LOWEST[[((1 << k) * 0x03F79D71B4CB0A89 % (1 << 64)) >> 58 for k in range(64)]] = np.arange(64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _HALF)) * _MIX
    return h ^ (h >> _HALF)


def _coin(own: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Twice the lowest place where two numbers differ, plus the bit that the own one has there."""
    differ = own ^ left
    with np.errstate(over="ignore"):
        lowest = differ & (~differ + np.uint64(1))
        place = _LOWEST[(lowest * _DEBRUIJN) >> np.uint64(58)]
    return (2 * place + ((own & lowest) != 0)).astype(np.uint8)


_SMALL = np.arange(256, dtype=np.uint64)
_COIN = np.where(
    np.eye(256, dtype=bool), 0, _coin(np.repeat(_SMALL, 256), np.tile(_SMALL, 256)).reshape(256, 256)
).astype(np.uint8)


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, none equal to the one before it in its text.

    Each toss reads a symbol and its left neighbour, and leaves neighbours different; the first
    symbol of a text has one that differs in the lowest bit.
    """
    if symbols.dtype == np.uint8:
        labels, tosses = symbols, 4
    else:
        left = np.empty_like(symbols)
        left[1:] = symbols[:-1]
        left[first] = symbols[first] ^ np.uint64(1)
        labels, tosses = _coin(symbols, left), 3
    for _ in range(tosses):
        left = np.empty_like(labels)
        left[1:] = labels[:-1]
        left[first] = labels[first] ^ 1
        labels = _COIN[labels, left]
    return labels


def parse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level, and which of them begin a text.

    A run of equal symbols becomes one. Phrases begin where a label is larger than those beside
    it, so whether one begins depends on a few symbols around alone: equal substrings are cut
    alike but near their ends. A name is a hash of the phrase's content.
    """
    fresh = first.copy()
    fresh[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(fresh)
    run = np.diff(at, append=len(symbols))
    base, first = symbols[at], first[at]
    labels = _labels(base, first)
    wide = base.astype(np.uint64)
    named = _mixed(wide + np.uint64(1) + run.astype(np.uint64) * _MIX2)
    begin = first.copy()
    begin[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~first[2:]
    where = np.flatnonzero(begin)
    size = np.diff(where, append=len(base))
    offset = np.arange(len(base)) - np.repeat(where, size)
    names = np.add.reduceat(named * _POWERS[offset], where)
    return _mixed(names + size.astype(np.uint64)), first[where]


def _least(names: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """For each text, the least name in each of BINS classes of names; empty ones ask others."""
    low = (np.uint64(1) << np.uint64(40)) - np.uint64(1)
    cell = text.astype(np.uint64) * np.uint64(BINS) + (names >> np.uint64(59))
    packed = np.sort((cell << np.uint64(40)) | (names & low))
    cell = packed >> np.uint64(40)
    head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    out, filled = np.zeros(texts * BINS, np.uint64), np.zeros(texts * BINS, bool)
    out[cell[head].astype(np.int64)] = packed[head] & low
    filled[cell[head].astype(np.int64)] = True
    out, filled = out.reshape(texts, BINS), filled.reshape(texts, BINS)
    rows, bins = np.nonzero(~filled & filled.any(axis=1)[:, None])
    order = _DONORS[bins]
    out[rows, bins] = out[rows, order[np.arange(len(rows)), filled[rows[:, None], order].argmax(axis=1)]]
    return out.astype(np.uint16)


_DONORS = np.stack([np.random.default_rng(i).permutation(BINS) for i in range(BINS)])


def sketches(texts: list[str]) -> np.ndarray:
    """A row of BINS numbers for each of LEVELS for each text; zeros for an empty one."""
    out = np.zeros((len(texts), len(LEVELS) * BINS), np.uint16)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK) and end - at < 4096:
            size += len(texts[end])
            end += 1
        data = [t.encode() for t in texts[at:end]]
        there = np.array([i for i, d in enumerate(data) if d], np.int64)
        if len(there):
            symbols = np.frombuffer(b"".join(data), np.uint8)
            first = np.zeros(len(symbols), bool)
            first[np.cumsum([0, *(len(data[i]) for i in there[:-1])])] = True
            for level in range(1, max(LEVELS) + 1):
                symbols, first = parse(symbols, first)
                if level in LEVELS:
                    k = LEVELS.index(level) * BINS
                    out[at + there, k : k + BINS] = _least(symbols, np.cumsum(first) - 1, len(there))
        at = end
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal numbers in two rows of sketches."""
    return (a == b).mean(axis=1)


def _fingerprint(texts: list[str], rows: np.ndarray) -> list[bytes]:
    return [row.astype(">u2").tobytes() if text else b"" for text, row in zip(texts, rows, strict=True)]


def _near(a: np.ndarray, b: np.ndarray, texts: list[str], others: list[str]) -> np.ndarray:
    near = likeness(a, b)
    for i, (x, y) in enumerate(zip(texts, others, strict=True)):
        if not x or not y:
            near[i] = float(x == y)
    return near


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row of `docs(doc_id, text)`: hexadecimal, equal for equal texts.

    The fingerprint of a null or empty text is empty, as is that of no other. Repeated rows give
    equal rows; extra columns are left out. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                prints = [p.hex() for p in _fingerprint(texts, sketches(texts))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of falling doc_id, nulls last; then by the hash of the text.

    Equal rows are told apart by their place in the table, so that a row repeated very often is
    spread over ranges, too. Ranges hold about BUCKET_BYTES of text, and more where there would be
    over MOST_RANGES of them; a sort within a range spills.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = docs.select(
        "doc_id", "text", text_key(F.col("text")).alias("tkey"), F.monotonically_increasing_id().alias("place")
    )
    order = [F.col("doc_id").desc_nulls_last(), F.col("tkey").desc(), F.col("place")]
    ranged = keyed.repartitionByRange(min(int(total // BUCKET_BYTES) + 1, MOST_RANGES), *order)
    return ranged.sortWithinPartitions(*order).select("doc_id", "text")


#: What is known of a text and its edit, fingerprints as bytes.
DIGESTS = "n_chars long, edited_sha256 string, own binary, edited binary, near_edited double, near_next double"


def _digests(texts: list[str], at: np.ndarray) -> list[pa.Array]:
    """DIGESTS of the texts at the given places, each followed by its next one."""
    own, after = [texts[i] for i in at], [texts[i + 1] for i in at]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(own, after, strict=True)]
    whole, new = sketches(texts), sketches(edited)
    return [
        pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(_fingerprint(own, whole[at]), pa.binary()),
        pa.array(_fingerprint(edited, new), pa.binary()),
        pa.array(_near(whole[at], new, own, edited), pa.float64()),
        pa.array(_near(whole[at], whole[at + 1], own, after), pa.float64()),
    ]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, and their likeness, for `docs(doc_id, text)`.

    The edit replaces the last floor(n_chars / 2) code points by the first as many, or all, of
    the next document: that of the next smaller doc_id (null last, then by the hash of the text),
    after the last the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next. Two empty texts have likeness 1, an empty one
    and another 0. Null texts are empty. Repeated rows follow each other. A single document is
    its own next. doc_id is of any type that has an order; extra columns are left out.

    Texts are shuffled once, into ranges. Each range tells the digests of all its rows but the
    last, and passes on its first and last text; these are joined by range afterwards. The driver
    sees no row.
    """
    small_batches(docs.sparkSession)
    arrow_id = to_arrow_type(docs.schema["doc_id"].dataType)
    kind = docs.schema["doc_id"].dataType.simpleString()
    digest_names = [c.split()[0] for c in DIGESTS.split(", ")]
    names = ["doc_id", *digest_names, "range", "is_last", "text"]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        held: list[tuple] = []

        def edge(row: tuple, is_last: bool) -> pa.RecordBatch:
            own = dict(zip(names, (row[0], *[None] * len(digest_names), here, is_last, row[1]), strict=True))
            return pa.RecordBatch.from_pylist([own], schema=passed)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                fresh = list(zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True))
                if not held:
                    yield edge(fresh[0], False)
                rows = held + fresh
                held = rows[-1:]
                n = len(rows) - 1
                ids = pa.array([r[0] for r in rows[:-1]], arrow_id)
                found = _digests([r[1] or "" for r in rows], np.arange(n))
                nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.bool_(), pa.string())]
                yield pa.RecordBatch.from_arrays([ids, *found, *nothing], schema=passed)
        if held:
            yield edge(held[0], True)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own, after = batch.columns
            texts = [t or "" for pair in zip(own.to_pylist(), after.to_pylist(), strict=True) for t in pair]
            found = _digests(texts, np.arange(0, len(texts), 2))
            yield pa.RecordBatch.from_arrays([ids, *found], ["doc_id", *digest_names])

    own_types = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    types = [arrow_id, *own_types, pa.int32(), pa.bool_(), pa.string()]
    passed = pa.schema(list(zip(names, types, strict=True)))
    done = written(
        in_order(docs).mapInArrow(within, f"doc_id {kind}, {DIGESTS}, range int, is_last boolean, text string"), "phrases"
    )
    edges = done.where(F.col("range").isNotNull())
    firsts = edges.where(~F.col("is_last")).select(F.col("range").alias("following"), F.col("text").alias("next_text"))
    # One row per range, of a number each: at most MOST_RANGES.
    every = Window.partitionBy(F.lit(0))
    following = F.coalesce(F.lead("range").over(every.orderBy("range")), F.min("range").over(every))
    ranges = edges.where("is_last").select("range").withColumn("following", following)
    lasts = edges.where("is_last").join(ranges, "range").join(firsts, "following").select("doc_id", "text", "next_text")
    rows = done.where(F.col("range").isNull()).select("doc_id", *digest_names)
    return rows.unionByName(lasts.mapInArrow(between, f"doc_id {kind}, {DIGESTS}")).select(
        "doc_id", "n_chars", "edited_sha256",
        F.lower(F.hex("own")).alias("fingerprint"), F.lower(F.hex("edited")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
