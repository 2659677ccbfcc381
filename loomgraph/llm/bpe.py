"""Byte-level BPE by tree reduction: halves are encoded on their own and joined at their seam."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomgraph.llm.common import small_batches

#: Bytes up to which a piece is merged directly, and characters up to which a text is split
#: into pieces at once: the leaves of the two trees.
LEAF_BYTES = 32
LEAF_CHARS = 1 << 16
#: Pieces of text, and bytes in each, that a task remembers.
REMEMBERED, REMEMBERED_BYTES = 150_000, 64

_SEAM, _SEAM_BEFORE = regex.compile(r"(?<=\S)(?=\s)"), regex.compile(r"(?r)(?<=\S)(?=\s)")


class Vocabulary:
    """Ranks of byte strings, as the lines of a rank file: base64, blank, rank."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self._stable: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, leftmost first, until none is in the vocabulary."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            least, at = None, -1
            for i, rank in enumerate(pairs):
                if rank is not None and (least is None or rank < least):
                    least, at = rank, i
            if at < 0:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side encode to themselves."""
        known = self._stable.get((left, right))
        if known is None:
            if len(self._stable) >= REMEMBERED // 4:
                self._stable.clear()
            known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._stable[left, right] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded strings put together.

        Encodes anew a window around the seam. Tokens are the encoding of their bytes exactly
        when each two neighbours among them are, so once the window's outermost tokens are stable
        next to those outside, nothing outside can change; until then the window grows.
        """
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        before = after = 1
        while True:
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[-before:] + right[:after])))
            left_ok = before >= len(left) or self.stable(left[-before - 1], window[0])
            right_ok = after >= len(right) or self.stable(window[-1], right[after])
            if left_ok and right_ok:
                return left[:-before] + window + right[after:]
            before = before if left_ok else min(2 * before, len(left))
            after = after if right_ok else min(2 * after, len(right))

    def encode_bytes(self, data: bytes) -> list[int]:
        """The merges of a byte string: its halves' encodings, joined."""
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def encode_piece(self, piece: str) -> list[int]:
        """A piece that is a token as a whole is that token, whatever its merges would give."""
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.encode_bytes(data)


class _Pieces(dict):
    """Ids of pieces, as little-endian 32-bit integers, encoded when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.encode_piece(piece), dtype="<u4").tobytes()
        if len(piece) <= REMEMBERED_BYTES:
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts; `pattern` splits text into pieces before the merges."""

    def __init__(self, rank_lines: bytes, pattern: str):
        self.vocabulary = Vocabulary(rank_lines)
        self.pattern = regex.compile(pattern)
        self.pieces = _Pieces(self.vocabulary)
        size = max(self.vocabulary.bytes_of, default=-1) + 1
        self.tokens = [self.vocabulary.bytes_of.get(i, b"") for i in range(size)]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers.

        A long text is halved near its middle, before white space that follows something else:
        no piece of the pattern goes over such a place, nor does what stands there change the
        pieces on its other side, so that here the join of two halves is to put them together.
        """
        if len(text) > LEAF_CHARS:
            half = len(text) // 2
            if seam := _SEAM.search(text, half) or _SEAM_BEFORE.search(text, 0, half):
                return self.encode(text[: seam.start()]) + self.encode(text[seam.start() :])
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, put together up the same kind of tree."""
        if len(ids) > 4 * LEAF_CHARS:
            half = len(ids) // 8 * 4
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(rank_lines: bytes, pattern: str) -> Codec:
    return Codec(rank_lines, pattern)


def _shared(spark, ranks_path: str):
    """The rank file, read on the driver and sent once to each executor: a vocabulary is a few MB."""
    small_batches(spark)
    with open(ranks_path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    keep_text: bool = False, decode: bool = False,
) -> DataFrame:
    """(id, ids binary, n_tokens): every whole text as little-endian unsigned 32-bit ids.

    A null text is empty and has no token. Repeated rows and null ids are rows like others;
    other columns are left out, the text unless `keep_text`. With `decode` the ids are decoded at
    once, as by `decode_documents`, in the same Python process. No shuffle; a task holds one
    batch of texts.
    """
    lines = _shared(docs.sparkSession, ranks_path)
    width = 2 if keep_text else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(lines.value, pattern)
        for batch in batches:
            for part in _sliced(batch):
                ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
                n = [len(x) // 4 for x in ids]
                back = [pa.array(list(map(codec.decode, ids)), pa.binary())] if decode else []
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], pa.array(ids, pa.binary()), pa.array(n, pa.int64()), *back],
                    [*part.schema.names[:width], "ids", "n_tokens", "decoded"][: width + 2 + decode],
                )

    rows = docs.select(id_col, text_col)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:width])
    schema = f"{kept}, ids binary, n_tokens long" + ", decoded binary" * decode
    return rows.mapInArrow(run, schema)


def _sliced(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """`encoded` with `decoded`, the bytes of its `ids`; null ids give no bytes."""
    lines = _shared(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(lines.value, "")
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for part in _sliced(batch):
                decoded = [codec.decode(x or b"") for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, "decoded"]
                )

    encoded = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


