"""Chunkers: one file row in, many chunk rows out, with no shuffle.

Every chunker takes a frame with a text column, keeps all its other columns and adds
`chunk_index`, `chunk_text`, `section`, `exports` and `imports`. What is longer than `max_chars`
becomes several chunks in a row, so no text is lost.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.outline import PACKED_ARROW, PACKED_TYPE, in_batches, pack_nodes
from loomgraph.functions.text import (
    LINE_BREAKS,
    MAX_CHUNK_CHARS,
    WS_NO_NEWLINE,
    last_line_value,
    lines,
    pieces,
    trim,
)

WINDOW_LINES = 200
OVERLAP_LINES = 50
SCRIPT_PATH = r"\.(ts|tsx|js|jsx|mts|cts|mjs|cjs)\z"
HEADING = rf"##[{WS_NO_NEWLINE}]+[^{LINE_BREAKS}]"


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _window_pieces(split: Column, window: int, overlap: int, max_chars: int) -> Column:
    starts = F.sequence(F.lit(0), F.size(split) - 1, F.lit(window - overlap))
    windows = F.transform(starts, lambda s: trim(F.array_join(F.slice(split, s + 1, window), "\n")))
    return F.flatten(F.transform(windows, lambda w: pieces(w, max_chars)))


def chunk_windows(
    files: DataFrame,
    text: str = "content",
    window: int = WINDOW_LINES,
    overlap: int = OVERLAP_LINES,
    max_chars: int = MAX_CHUNK_CHARS,
) -> DataFrame:
    """Overlapping line windows; blank ones are dropped and not numbered."""
    kept = [c for c in files.columns if c != text]
    split = files.select(*kept, lines(F.col(text)).alias("_lines"))
    chunks = _window_pieces(F.col("_lines"), window, overlap, max_chars)
    return split.select(
        *kept, F.posexplode(chunks).alias("chunk_index", "chunk_text")
    ).select(
        *kept,
        "chunk_index",
        "chunk_text",
        F.lit("").alias("section"),
        _no_names().alias("exports"),
        _no_names().alias("imports"),
    )


def chunk_sections(
    files: DataFrame, text: str = "content", max_chars: int = MAX_CHUNK_CHARS
) -> DataFrame:
    """Split at level-2 headings; what precedes the first one is `(intro)`."""
    kept = [c for c in files.columns if c != text]
    parts = F.split(F.col(text), rf"\n(?={HEADING})", -1)

    def section(part: Column) -> Column:
        name = F.regexp_extract(part, rf"\A##[{WS_NO_NEWLINE}]+([^{LINE_BREAKS}]+)", 1)
        return F.when(part.rlike(rf"\A{HEADING}"), trim(name)).otherwise("(intro)")

    def chunks_of(part: Column) -> Column:
        return F.transform(
            pieces(trim(part), max_chars),
            lambda p: F.struct(p.alias("chunk_text"), section(part).alias("section")),
        )

    chunks = F.flatten(F.transform(parts, chunks_of))
    return files.select(*kept, F.posexplode(chunks).alias("chunk_index", "_c")).select(
        *kept,
        "chunk_index",
        "_c.chunk_text",
        "_c.section",
        _no_names().alias("exports"),
        _no_names().alias("imports"),
    )


def chunk_notes(
    files: DataFrame, text: str = "content", max_chars: int = MAX_CHUNK_CHARS
) -> DataFrame:
    """The chunks of a note, with `name`, `description` and `type` from its front matter.

    The front matter ends at the next `---`, wherever that stands. A note without a body is one
    empty chunk.
    """
    kept = [c for c in files.columns if c != text]
    source = F.col(text)
    end = F.locate("---", source, 4)
    has_matter = source.startswith("---") & (end > 0)
    matter = F.when(has_matter, F.substring(source, F.lit(4), end - 4)).otherwise("")
    body = F.when(has_matter, trim(F.substring(source, end + 3, F.length(source)))).otherwise(source)
    return (
        files.select(
            *kept, matter.alias("_matter"),
            F.posexplode(F.when(body == "", F.array(F.lit(""))).otherwise(pieces(body, max_chars))).alias(
                "chunk_index", "chunk_text"
            ),
        )
        .select(
            *kept,
            "chunk_index",
            "chunk_text",
            F.lit("").alias("section"),
            _no_names().alias("exports"),
            _no_names().alias("imports"),
            *[
                last_line_value(F.col("_matter"), key).alias(key)
                for key in ("name", "description", "type")
            ],
        )
    )


def chunk_declarations(
    files: DataFrame, text: str = "content", max_chars: int = MAX_CHUNK_CHARS
) -> DataFrame:
    """Pack top-level declarations of scripts greedily into chunks of `max_chars`.

    Files that give no chunk (not a script, or nothing but imports and comments) fall back to
    line windows. Needs a `file_path` column.
    """
    kept = [c for c in files.columns if c != text]

    @F.arrow_udf(PACKED_TYPE)
    def pack(paths: pa.Array, texts: pa.Array) -> pa.Array:
        rows = zip(paths.to_pylist(), texts.to_pylist())
        return in_batches(lambda p, t: pack_nodes(p, t, max_chars), rows, PACKED_ARROW)

    # Only scripts are sent to Python with their text. Marked so that no plan packs twice.
    pack_once = pack.asNondeterministic()
    is_script = F.col("file_path").rlike(SCRIPT_PATH)
    packed = files.select(
        *kept, text,
        pack_once("file_path", F.when(is_script, F.col(text)).otherwise("")).alias("_packed"),
    )
    falls_back = F.size("_packed") == 0
    split = packed.select(
        *kept, "_packed", F.when(falls_back, lines(F.col(text))).alias("_lines")
    )
    windows = F.transform(
        _window_pieces(F.col("_lines"), WINDOW_LINES, OVERLAP_LINES, max_chars),
        lambda p: F.struct(
            p.alias("chunk_text"), _no_names().alias("exports"), _no_names().alias("imports")
        ),
    )
    chunks = F.when(F.col("_lines").isNull(), F.col("_packed")).otherwise(windows)
    return split.select(*kept, F.posexplode(chunks).alias("chunk_index", "_c")).select(
        *kept, "chunk_index", "_c.chunk_text", F.lit("").alias("section"), "_c.exports", "_c.imports"
    )
