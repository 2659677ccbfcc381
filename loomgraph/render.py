"""Plain-text tables of results, for a person to read.

Every table shows at most `most` rows and says how many there are beyond, so that a result of any
size costs the driver a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.symbols import edge_groups

MOST_ROWS = 50


def table(rows: DataFrame, columns: dict[str, Column | str], most: int = MOST_ROWS) -> str:
    """Aligned columns of `rows` in their order; `columns` gives title and expression of each."""
    shown = rows.select(*((F.expr(c) if isinstance(c, str) else c).cast("string").alias(t) for t, c in columns.items()))
    found = shown.limit(most + 1).collect()
    cells = [list(columns)] + [["-" if v is None else v for v in r] for r in found[:most]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in cells]
    if not found:
        lines.append("(no rows)")
    if len(found) > most:
        lines.append(f"({rows.count() - most} more rows)")
    return "\n".join(lines)


def _passages(rows: DataFrame, title: Column, most: int) -> str:
    """Texts of hits one below the other, each under a numbered title with its score."""
    heading = F.concat(title, F.format_string(" [%.3f]", F.col("score")))
    found = rows.select(heading.alias("title"), "chunk_text").limit(most).collect()
    parts = [f"({i}) {r['title']}\n{r['chunk_text']}" for i, r in enumerate(found, 1)]
    return "\n\n".join(parts) or "(no hits)"


def code_hits(hits: DataFrame, most: int = MOST_ROWS) -> str:
    names = F.when(F.size("exports") > 0, F.concat(F.lit(" defines "), F.array_join("exports", " ")))
    return _passages(hits, F.concat(F.col("file"), F.coalesce(names, F.lit(""))), most)


def section_hits(hits: DataFrame, most: int = MOST_ROWS) -> str:
    return _passages(hits, F.concat_ws(" # ", "file", "section"), most)


def note_hits(hits: DataFrame, most: int = MOST_ROWS) -> str:
    return _passages(hits, F.concat_ws(" : ", "type", "name"), most)


def dependencies(found: DataFrame, most: int = MOST_ROWS) -> str:
    columns = {"direction": "direction", "distance": "level", "file": "file", "names": "array_join(names, ' ')"}
    return table(found, columns, most)


def co_changes(found: DataFrame, most: int = MOST_ROWS) -> str:
    return table(found, {"commits": "count", "changed with": "other"}, most)


def type_consumers(found: DataFrame, most: int = MOST_ROWS) -> str:
    return table(found, {"role": "role", "defined in": "def_file", "kind": "kind", "used in": "consumer"}, most)


def symbol(found: dict[str, DataFrame], most: int = MOST_ROWS) -> str:
    """The tables of one symbol, each under its name."""
    place = F.concat_ws(":", "file", "line")
    parts = [("symbols", table(found["matches"], {"kind": "kind", "symbol": "id", "place": place}, most))]
    for side in ("outgoing", "incoming"):
        groups = edge_groups(found[side], side).orderBy("label_rank", "id")
        parts.append((side, table(groups, {"relation": "label", "symbol": "id"}, most)))
    near = {"score": "format_string('%.3f', score)", "symbol": "id"}
    parts.append(("similar", table(found["neighbors"], near, most)))
    return "\n\n".join(f"[{name}]\n{text}" for name, text in parts)


def wiki_pages(found: DataFrame, most: int = MOST_ROWS) -> str:
    return table(found, {"page": "name", "updated": "last_updated", "about": "summary"}, most)


def partition(plan: dict, most: int = MOST_ROWS) -> str:
    """Waves, conflicts and advisory couplings of a plan, and the commit it was made at."""
    by_wave = plan["waves"].groupBy("wave").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("issue")).alias("issues")
    ).orderBy("wave")
    issues = F.array_join(F.transform("issues", lambda i: i.cast("string")), " ")
    parts = [
        ("waves", table(by_wave, {"wave": "wave", "size": "n", "issues": issues}, most)),
        ("conflicts", table(plan["conflicts"], {"issue": "a", "with": "b", "because": "reason"}, most)),
        (
            "couplings, for information",
            table(
                plan["warnings"],
                {"issue": "issue", "file": "file", "often changes with": "coupled_to", "commits": "count"},
                most,
            ),
        ),
    ]
    if plan.get("head_sha"):
        parts.append(("commit", plan["head_sha"]))
    return "\n\n".join(f"[{name}]\n{text}" for name, text in parts)
