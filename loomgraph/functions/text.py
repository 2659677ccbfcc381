"""Text helpers as Column expressions, with ECMAScript whitespace and UTF-16 length rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters ECMAScript treats as white space, and those "." does not match.
WS_NO_NEWLINE = (
    r"\t\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
WS = r"\n" + WS_NO_NEWLINE
LINE_BREAKS = r"\n\r\x{2028}\x{2029}"

BLANKS = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000, 0xFEFF])
)

#: UTF-16 units of a chunk. With any instruction text before it, it fits the models' input.
MAX_CHUNK_CHARS = 3900
_PAIRS = r"[\x{10000}-\x{10FFFF}]"


def trim(col: Column) -> Column:
    """Strip every kind of white space from both ends; SQL `trim` strips blanks only."""
    return F.btrim(col, F.lit(BLANKS))


def is_blank(col: Column) -> Column:
    return ~col.rlike(rf"[^{WS}]")


def cut(col: Column, limit: int) -> Column:
    """First `limit` UTF-16 units. A pair that would be split at the cut is left out."""
    units = F.encode(col, "UTF-16BE")
    head = F.substring(units, 1, 2 * limit)
    splits_pair = F.hex(F.substring(units, 2 * limit - 1, 1)).rlike("^D[89AB]")
    whole = F.when(splits_pair, F.substring(units, 1, 2 * limit - 2)).otherwise(head)
    has_pairs = col.rlike(_PAIRS)
    return (
        F.when(F.length(col) * 2 <= limit, col)
        .when(has_pairs, F.decode(whole, "UTF-16BE"))
        .otherwise(F.substring(col, 1, limit))
    )


def pieces(col: Column, limit: int) -> Column:
    """The text in consecutive parts of at most `limit` UTF-16 units, none of an empty text.

    A text with characters outside the basic plane is cut into parts of half as many characters.
    """
    part = F.when(col.rlike(_PAIRS), rf"(?s).{{1,{max(limit // 2, 1)}}}").otherwise(rf"(?s).{{1,{limit}}}")
    return F.regexp_extract_all(col, part, F.lit(0))


def lines(col: Column) -> Column:
    return F.split(col, "\n", -1)


def content_hash(col: Column) -> Column:
    """SHA-256 hex of the UTF-8 text."""
    return F.sha2(col.cast("binary"), 256)


def last_line_value(col: Column, label: str) -> Column:
    """Value of the last line `<label>: value`; '' when there is none. `label` is a regex."""
    pattern = rf"(?<![^\n]){label}:[{WS_NO_NEWLINE}]*([^{LINE_BREAKS}]+)"
    found = F.regexp_extract_all(col, F.lit(pattern), 1)
    return F.coalesce(trim(F.try_element_at(found, F.lit(-1))), F.lit(""))


def wiki_links(col: Column) -> Column:
    """Distinct `[[target]]` names in first-seen order."""
    found = F.regexp_extract_all(col, F.lit(r"\[\[([^\]\n]+)\]\]"), 1)
    return F.array_distinct(F.transform(found, trim))


def page_file_name(name: Column) -> Column:
    """`My Page` -> `my-page.md`: lower case, blanks to dashes, all else dropped."""
    dashed = F.regexp_replace(F.lower(name), rf"[{WS}]+", "-")
    return F.concat(F.regexp_replace(dashed, "[^a-z0-9-]", ""), F.lit(".md"))


def glob_regex(glob: str) -> str:
    """Whole-path regex of a glob: `**`, `*`, `?`, `[..]`, `{a,b}`.

    Wildcards match a path part that starts with a dot only when the glob spells the dot.
    """
    visible = r"(?!\.)"
    out: list[str] = []
    depth = 0
    pos = 0
    while pos < len(glob):
        starts_part = pos == 0 or glob[pos - 1] == "/"
        if glob.startswith("**/", pos):
            out.append(rf"(?:{visible}[^/]+/)*")
            pos += 3
            continue
        if glob.startswith("**", pos):
            out.append(rf"{visible}[^/]+(?:/{visible}[^/]+)*")
            pos += 2
            continue
        char = glob[pos]
        if char in "*?":
            out.append((visible if starts_part else "") + ("[^/]*" if char == "*" else "[^/]"))
        elif char == "[" and "]" in glob[pos:]:
            end = glob.index("]", pos)
            body = glob[pos + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] in ("!", "^") else body) + "]")
            pos = end
        elif char == "{":
            depth += 1
            out.append("(?:")
        elif char == "}" and depth:
            depth -= 1
            out.append(")")
        elif char == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(char))
        pos += 1
    return r"\A" + "".join(out) + r"\z"


def matches_any_glob(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)


def contains_any(path: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | path.contains(part)
    return hit


def in_words(name: str) -> list[Column]:
    """Sort keys that order texts as words are: case and accents decide among equal letters only."""
    return [F.collate(name, "UNICODE"), F.col(name)]
