"""Fill-in-the-middle samples over texts kept as seekable zstandard frames.

A text is stored as frames of a fixed number of code points, each compressed on its own, with the
cumulative count of code points at the end of each. A cut finds its frame in the counts, and only
that frame is decompressed; all others go into the sample as they are. A sample is a list of frames
again, so it can be stored, joined into one zstandard file, or read one frame at a time: no step
holds more of a text than its compressed frames and one frame in clear.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from loomgraph.llm.common import small_batches, written

FRAME_UNITS = 16_384
SEED = "1:"
#: Of 100 documents, those left plain, and of the others those with the suffix first.
PLAIN_PERCENT = 10
SUFFIX_FIRST_PERCENT = 20
# What stands before the parts of a sample.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Order of the marks in each form; a plain text has none.
ORDER = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

_packer = zstandard.ZstdCompressor(level=3)
_unpacker = zstandard.ZstdDecompressor()
_STORED = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("marked", T.BooleanType()),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("frames", T.ArrayType(T.BinaryType())),
    ]
)


def pack(text: str) -> bytes:
    return _packer.compress(text.encode())


def unpack(frame: bytes) -> bytes:
    return _unpacker.decompress(frame)


def to_frames(text: str, units: int = FRAME_UNITS) -> tuple[list[int], list[bytes]]:
    """Cumulative counts of code points and frames; an empty text has none."""
    ends = [min(at + units, len(text)) for at in range(0, len(text), units)]
    return ends, [pack(text[at : at + units]) for at in range(0, len(text), units)]


def parts(frames: list[bytes], ends: list[int], cuts: list[int]) -> list[list[bytes]]:
    """The frames of each part between the cuts, which are counts of code points in order.

    A frame with a cut inside is decompressed and packed again in pieces; no other is touched.
    """
    out: list[list[bytes]] = [[] for _ in range(len(cuts) + 1)]
    begin = 0
    for frame, end in zip(frames, ends, strict=True):
        inside = [c for c in cuts if begin < c < end]
        part = bisect_right(cuts, begin)
        if inside:
            text = unpack(frame).decode()
            for low, high in zip([begin, *inside], [*inside, end]):
                if high > low:
                    out[bisect_right(cuts, low)].append(pack(text[low - begin : high - begin]))
        else:
            out[part].append(frame)
        begin = end
    return out


def sample(frames: list[bytes], ends: list[int], form: str, first: int, second: int) -> list[bytes]:
    """The frames of the sample of a form, cut after `first` and `second` code points."""
    if form == "plain":
        return list(frames)
    prefix, middle, suffix = parts(frames, ends, [first, second])
    piece = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}
    return [frame for mark in ORDER[form] for frame in (pack(mark), *piece[mark])]


def marks_at(frames: list[bytes], form: str) -> list[int]:
    """The byte offset of each mark of the form, by reading the frames in order.

    No text of a marked form holds a mark, and none can arise where a text meets a mark, as `<` is
    only a mark's first character and `>` its last. So the first of each is the right one.
    """
    found, before, kept = [], 0, b""
    for frame in frames:
        clear = kept + unpack(frame)
        at = 0
        while len(found) < len(ORDER[form]):
            mark = ORDER[form][len(found)].encode()
            at = clear.find(mark, at)
            if at < 0:
                break
            found.append(before + at)
            at += len(mark)
        # A mark could lie across two frames; what is kept is shorter than one.
        kept = clear[-2:]
        before += len(clear) - len(kept)
    return found


def spans(frames: list[bytes], ranges: list[tuple[int, int | None]]) -> Iterator[bytes]:
    """The bytes of the ranges, in their order; frames outside a range are skipped by their size."""
    sizes = [zstandard.frame_content_size(f) for f in frames]
    for low, high in ranges:
        begin = 0
        for frame, size in zip(frames, sizes, strict=True):
            if begin + size > low and (high is None or begin < high):
                yield unpack(frame)[max(low - begin, 0) : None if high is None else high - begin]
            begin += size


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The bytes of the text a sample was made from, from its frames and form alone."""
    if form == "plain":
        return spans(frames, [(0, None)])
    at = marks_at(frames, form)
    piece = {
        mark: (begin + len(mark), end)
        for mark, begin, end in zip(ORDER[form], at, [*at[1:], None], strict=True)
    }
    return spans(frames, [piece[PREFIX], piece[MIDDLE], piece[SUFFIX]])


def store_frames(docs: DataFrame, units: int = FRAME_UNITS) -> DataFrame:
    """The documents with `n`, `marked`, `ends` and `frames` for their text, written to the shared folder.

    `n` counts code points; `marked` tells whether the text holds a mark itself; `ends` has the
    cumulative counts. A null text is an empty one: no frames. Columns of these names are replaced,
    all others but the text stay. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("text", *_STORED.names)]
    rows = docs.select(*kept, F.col("text").alias("text"))
    types = {"n": pa.int64(), "marked": pa.bool_(), "ends": pa.list_(pa.int64()), "frames": pa.list_(pa.binary())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            packed = [to_frames(t, units) for t in texts]
            columns = [
                [len(t) for t in texts],
                [any(mark in t for mark in (PREFIX, SUFFIX, MIDDLE)) for t in texts],
                [ends for ends, _ in packed],
                [frames for _, frames in packed],
            ]
            made = [pa.array(c, kind) for c, kind in zip(columns, types.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], *made], names=[*batch.schema.names[: len(kept)], *types]
            )

    schema = T.StructType([*rows.schema.fields[: len(kept)], *_STORED.fields])
    return written(rows.mapInArrow(run, schema), "frames")


def _draws(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_plan(
    stored: DataFrame, seed: str = SEED, plain: int = PLAIN_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT
) -> DataFrame:
    """The stored rows with `form`, `prefix_chars` and `middle_chars` (null where plain)."""
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    low, high = F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)), F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))
    is_plain = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= 100 - plain)
    form = F.when(is_plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    cut = stored.withColumns({"form": form, "__low": low, "__high": high})
    marked = F.col("form") != "plain"
    return cut.withColumns(
        {
            "prefix_chars": F.when(marked, F.col("__low")),
            "middle_chars": F.when(marked, F.col("__high") - F.col("__low")),
        }
    ).drop("__low", "__high")


@arrow_udf(T.ArrayType(T.BinaryType()))
def _sampled(frames: pa.Array, ends: pa.Array, form: pa.Array, prefix: pa.Array, middle: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (frames, ends, form, prefix, middle)), strict=True)
    made = [sample(f, e, kind, p or 0, (p or 0) + (m or 0)) for f, e, kind, p, m in rows]
    return pa.array(made, pa.list_(pa.binary()))


@arrow_udf(T.StringType())
def frames_sha256(frames: pa.Array) -> pa.Array:
    """Hex digest of what the frames hold, read one after another."""
    return pa.array([_digest(map(unpack, f)) for f in frames.to_pylist()], pa.string())


@arrow_udf(T.StringType())
def restored_sha256(output: pa.Array, form: pa.Array) -> pa.Array:
    """Hex digest of the text that samples were made from, read back from the samples."""
    rows = zip(output.to_pylist(), form.to_pylist(), strict=True)
    return pa.array([_digest(restored(f, kind)) for f, kind in rows], pa.string())


@arrow_udf(T.StringType())
def frames_text(frames: pa.Array) -> pa.Array:
    """What the frames hold, as one text."""
    return pa.array([b"".join(map(unpack, f)).decode() for f in frames.to_pylist()], pa.string())


def _digest(chunks: Iterator[bytes]) -> str:
    seen = hashlib.sha256()
    for chunk in chunks:
        seen.update(chunk)
    return seen.hexdigest()


def fill_in_middle(docs: DataFrame, units: int = FRAME_UNITS, **plan) -> DataFrame:
    """The documents with `n`, `form`, `prefix_chars`, `middle_chars` and `output`, the sample's frames.

    Joined, the frames of a row are one zstandard file; `frames_text` gives the text. A text is cut
    at two places drawn from the doc_id; some are left plain, as are empty and null texts and those
    that hold a mark. Rows that share an id are cut at the same draws, each by its own length, and
    equal rows give equal rows. Columns of the added names are replaced, others stay; an empty
    table gives an empty result. Each row is on its own: nothing is shuffled or gathered.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in docs.columns if c not in (*added, *_STORED.names, "text")]
    planned = cut_plan(store_frames(docs.select(*kept, "text"), units), **plan)
    output = _sampled("frames", "ends", "form", "prefix_chars", "middle_chars")
    return planned.select(*kept, *added[:-1], output.alias("output"))
