"""Import and export statements of a script, as built-in expressions on its text.

Escapes go first, so that strings, templates and regular expressions end at the next mark. Then
comments, templates and regular expressions are taken out, and statements are found where they can
begin: at the start of a line, or behind a semicolon or brace. Every pattern is linear in the text;
none has a group that repeats per character. Quotes and slashes that open nothing spoil the rest of
their line at most, so text between tags does no harm to later lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"[\p{L}_$][\p{L}\p{N}_$]*+"
_STRING = r"\"[^\"\n]*+\"|'[^'\n]*+'"
_COMMENT = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)[ \t]*+"
# A blank between a word and a backtick is text between tags, unless the word asks for a value or is
# a tag itself, which then stands where a value can.
_ASKING = r"(?<=\breturn )|(?<=\bcase )|(?<=\bdefault )"
_TAGGED = r"(?<=(?:[=(\[{:?&|+]|=>|\breturn|\bdefault)[ \t]{0,4}[\p{L}_$][\p{L}\p{N}_$.]{0,60} )"
_TEMPLATE = rf"(?:(?<![\p{{L}}\p{{N}},.!?] )|{_ASKING}|{_TAGGED})`[^`]*+`"
_REGEX = r"(?<![\p{L}\p{N}_$\])])/(?![*/])[^/\n\[]*+(?:\[[^\]\n]{0,200}+\][^/\n\[]*+){0,50}+/[a-z]*+"
# Declaring keywords of the language, and those that may stand before them.
_DECLARING = "const\\s++enum|function|class|interface|type|enum|const|let|var"
_BEFORE = r"(?:default\s++)?+(?:(?:declare|abstract|async)\s++)*+"
_IMPORT = rf"import(?=[\s\"'{{*])[^;'\"`()=]*?(?:{_STRING})"
_EXPORT = rf"export\s++{_BEFORE}(?:{_DECLARING})(?![\p{{L}}\p{{N}}_$])[\s*]*+{_NAME}(?:\s*+[=<])?+"
# The engine first looks at one character, so that most places of a text are left at once.
_STATEMENT = rf"(?m)(?=[\"';}} \t\x{{FEFF}}ie])(?:(?:^|\A\x{{FEFF}}|(?<=[;}}])[ \t]*+)({_IMPORT}|{_EXPORT})|{_STRING})"
_NOISE = rf"(?=[\"'/`])(?:({_STRING})|{_COMMENT}|{_TEMPLATE}|{_REGEX})"
#: A specifier with its quotes, at the end of a statement.
_QUOTED = r"(?:\"[^\"\n]*+\"|'[^'\n]*+')\z"
_EXPORT_PARTS = rf"(?s)\Aexport\s++{_BEFORE}({_DECLARING})[\s*]*+({_NAME})(\s*+[=<])?+.*"


def statements(text: Column) -> Column:
    """The import and export statements of a script, from their keyword on, in order."""
    plain = F.when(text.contains("\\"), F.regexp_replace(text, r"\\(?s:.)", "")).otherwise(text)
    # Templates within templates, then what templates fill in, go first.
    filled = F.regexp_replace(plain, r"\$\{[^{}`]*+`[^`]*+`[^{}`]*+\}", "")
    filled = F.regexp_replace(filled, r"\$\{[^{}`]*+\}", "")
    plain = F.when(text.contains("${"), filled).otherwise(plain)
    kept = F.when(text.rlike("[/`]"), F.regexp_replace(plain, _NOISE, "$1")).otherwise(plain)
    found = F.filter(F.regexp_extract_all(kept, F.lit(_STATEMENT), 1), lambda s: s != "")
    return F.when(text.contains("import") | text.contains("export"), found).otherwise(
        F.array().cast("array<string>")
    )


def joined_path(folder: Column, relative: Column) -> Column:
    """A relative path from a folder, with `.` and `..` resolved."""

    def step(done: Column, part: Column) -> Column:
        goes_up = (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return (
            F.when(goes_up, F.slice(done, F.lit(1), F.size(done) - 1))
            .when(part.isin("", "."), done)
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.split(F.concat_ws("/", folder, relative), "/")
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def specifier(statement: Column) -> Column:
    """The text after `from` of an import statement."""
    quoted = F.regexp_extract(statement, _QUOTED, 0)
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def base_path(statement: Column, path: Column) -> Column:
    """The path that a relative specifier means, before an extension is searched for; else null."""
    folder = F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)
    return F.when(specifier(statement).startswith("."), joined_path(folder, specifier(statement)))


def local_names(statement: Column) -> Column:
    """Local names of what an import statement brings, the default first, without namespaces."""
    clause = F.regexp_extract(statement, rf"(?s)\Aimport\s*+(.*?)\s*+(?:\bfrom\s*+)?{_QUOTED}", 1)
    clause = F.regexp_replace(clause, r"\Atype\s++(?=[\p{L}_${*])", "")
    first = F.regexp_extract(clause, rf"\A({_NAME})", 1)
    listed = F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ",")
    last_words = F.transform(listed, lambda item: F.regexp_extract(item, rf"({_NAME})\s*+\z", 1))
    return F.filter(F.concat(F.array(first), last_words), lambda name: name != "")


def exported(statement: Column) -> Column:
    """struct<name, kind> of the declaration that an export statement makes, null if it makes none."""
    word = F.regexp_extract(statement, _EXPORT_PARTS, 1)
    name = F.regexp_extract(statement, _EXPORT_PARTS, 2)
    is_type = (word != "type") | (F.regexp_extract(statement, _EXPORT_PARTS, 3) != "")
    kind = (
        F.when(word.isin("const", "let", "var"), "variable")
        .when(word.startswith("const"), "enum")
        .otherwise(word)
    )
    return F.when(
        is_type & ~name.isin("extends", "implements"), F.struct(name.alias("name"), kind.alias("kind"))
    )
