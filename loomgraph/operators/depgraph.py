"""File-level dependency graph: imports, exports, their reverse views, and traversal."""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import heads
from loomgraph.functions.outline import OUTLINE_ARROW, OUTLINE_TYPE, in_batches, outline
from loomgraph.operators.dealing import dealt, key_counts, matched, stored
from loomgraph.session import ensure_checkpoint_dir

# What is tried, in order, to find the file an import means.
TRIED_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]
REPLACED_SUFFIX = ".js"
REPLACEMENTS = [".ts", ".tsx"]
MAX_DEPTH = 5
#: Edges of one node that a walk's join reads in one task, about.
NODE_SLICE = 50_000


def with_outline(
    files: DataFrame, text: str = "content", with_symbols: bool = True
) -> DataFrame:
    """Replace the text column by the parsed `outline` of each file.

    Without symbols only imports and top-level declarations are read, which costs less.
    """

    @F.arrow_udf(OUTLINE_TYPE)
    def parse(paths: pa.Array, texts: pa.Array) -> pa.Array:
        rows = zip(paths.to_pylist(), texts.to_pylist())
        return in_batches(lambda p, t: outline(p, t, with_symbols), rows, OUTLINE_ARROW)

    # Marked so that the optimizer neither repeats the parse nor moves it into a pushed filter.
    parse_once = parse.asNondeterministic()
    kept = [c for c in files.columns if c != text]
    return files.select(*kept, parse_once("file_path", text).alias("outline"))


def with_heads(files: DataFrame, text: str = "content") -> DataFrame:
    """Replace the text column by `heads`, the import and export statements of each file.

    Built-in expressions only. Imports, exports and all that follows from them read it.
    """
    kept = [c for c in files.columns if c != text]
    return files.select(*kept, heads.statements(F.col(text)).alias("heads"))


def _statements(rows: DataFrame, keyword: str) -> DataFrame:
    """(file_path, pos, statement) of the heads that begin with a keyword.

    The outer form: Spark would infer a filter from the inner one, and find the heads twice.
    """
    found = F.filter("heads", lambda s: s.startswith(keyword))
    exploded = rows.select("file_path", F.posexplode_outer(found).alias("pos", "statement"))
    return exploded.where(F.col("statement").isNotNull())


def import_statements(rows: DataFrame) -> DataFrame:
    """(file_path, pos, specifier, base, names) of every import statement."""
    if "heads" in rows.columns:
        statement = F.col("statement")
        return _statements(rows, "import").select(
            "file_path",
            "pos",
            heads.specifier(statement).alias("specifier"),
            heads.base_path(statement, F.col("file_path")).alias("base"),
            heads.local_names(statement).alias("names"),
        )
    return rows.select("file_path", F.explode("outline.imports").alias("_i")).select(
        "file_path", "_i.*"
    )


def exports(rows: DataFrame) -> DataFrame:
    """(file_path, pos, name, kind) of every exported declaration."""
    if "heads" in rows.columns:
        made = heads.exported(F.col("statement")).alias("_e")
        return _statements(rows, "export").select("file_path", "pos", made).where(
            F.col("_e").isNotNull()
        ).select("file_path", "pos", "_e.*")
    return (
        rows.select("file_path", F.posexplode("outline.nodes").alias("pos", "_n"))
        .where("_n.exported")
        .select("file_path", "pos", "_n.name", "_n.kind")
    )


def candidate_paths(base: Column) -> Column:
    """Array of the paths to try for an import of `base`, best first."""
    tried = [F.concat(base, F.lit(s)) for s in TRIED_SUFFIXES]
    has_extension = base.rlike(r"[^/.][^/]*\.[^/]*\z")
    stem = F.substring(base, F.lit(1), F.length(base) - len(REPLACED_SUFFIX))
    replaced = [
        F.when(base.endswith(REPLACED_SUFFIX), F.concat(stem, F.lit(s))) for s in REPLACEMENTS
    ]
    return F.array(*tried, F.when(has_extension, base), *replaced)


def resolve_bases(bases: DataFrame, paths: DataFrame, column: str = "base") -> DataFrame:
    """(base, target): the first candidate of each distinct base that is a known path.

    Distinct bases are tried once each, so a file imported everywhere costs one lookup. `bases`
    is read twice and should be settled.
    """
    named = bases.select(F.col(column).alias("base")).where(F.col("base").isNotNull())
    known = stored(key_counts(named, named.count(), ["base"]).select("base"))
    tried = known.select("base", F.posexplode(candidate_paths(F.col("base"))).alias("_rank", "file_path")).where(
        F.col("file_path").isNotNull()
    )
    listed = paths.select("file_path")
    n_bases = known.count()
    count = n_bases * len(TRIED_SUFFIXES) + listed.count()
    found = dealt(tried, count, "file_path").join(
        dealt(listed, count, "file_path").distinct().hint("merge"), "file_path"
    )
    return dealt(found, n_bases, "base").groupBy("base").agg(F.min_by("file_path", "_rank").alias("target"))


def import_edges(outlined: DataFrame, paths: DataFrame) -> DataFrame:
    """(source, target, stmt_pos, names), one row per import that resolves; repeats kept."""
    statements = stored(import_statements(outlined))
    return edges_of(statements, stored(resolve_bases(statements, paths)))


def edges_of(statements: DataFrame, targets: DataFrame) -> DataFrame:
    """Import edges from statements and the file that each base means."""
    relative = statements.where(F.col("base").isNotNull())
    return matched(relative, targets, ["base"]).select(
        F.col("file_path").alias("source"), "target", F.col("pos").alias("stmt_pos"), "names"
    )


def imported_by(edges: DataFrame) -> DataFrame:
    return edges.select("target", "source").distinct()


def named_imports(edges: DataFrame) -> DataFrame:
    """Names per (source, target): those of the last statement that has any."""
    return (
        edges.where(F.size("names") > 0)
        .groupBy("source", "target")
        .agg(F.max_by("names", "stmt_pos").alias("names"))
    )


def symbol_consumers(edges: DataFrame) -> DataFrame:
    """(def_file, name, consumer): who imports which name from where."""
    return edges.select(
        F.col("target").alias("def_file"), F.explode("names").alias("name"),
        F.col("source").alias("consumer"),
    ).distinct()


def type_consumers(edges: DataFrame) -> DataFrame:
    """(name, consumer): who imports a name, from anywhere."""
    return edges.select(
        F.explode("names").alias("name"), F.col("source").alias("consumer")
    ).distinct()


def consumers_of(edges: DataFrame, exported: DataFrame, type_name: str) -> DataFrame:
    """(role, def_file, kind, consumer) rows for a bare name or a `file::name`.

    `defined` rows tell where it is defined, `consumed` rows who imports it, and `qualified`
    rows give the same per defining file.
    """
    qualified = symbol_consumers(edges)
    nothing = F.lit(None).cast("string")

    def rows(frame: DataFrame, role: str, def_file: Column, kind: Column, consumer: Column):
        return frame.select(
            F.lit(role).alias("role"), def_file.alias("def_file"), kind.alias("kind"),
            consumer.alias("consumer"),
        )

    if "::" in type_name:
        def_file, name = type_name.rsplit("::", 1)
        hits = qualified.where((F.col("def_file") == def_file) & (F.col("name") == name))
        spark = edges.sparkSession
        given = rows(spark.range(1), "defined", F.lit(def_file), F.lit("unknown"), nothing)
        return given.unionByName(
            rows(hits, "consumed", nothing, nothing, F.col("consumer"))
        ).unionByName(rows(hits, "qualified", F.col("def_file"), nothing, F.col("consumer")))
    named = exported.where(F.col("name") == type_name).groupBy("file_path").agg(
        F.min_by("kind", "pos").alias("kind")
    )
    hits = qualified.where(F.col("name") == type_name)
    return (
        rows(named, "defined", F.col("file_path"), F.col("kind"), nothing)
        .unionByName(
            rows(hits.select("consumer").distinct(), "consumed", nothing, nothing, F.col("consumer"))
        )
        .unionByName(rows(hits, "qualified", F.col("def_file"), nothing, F.col("consumer")))
    )


def reachable(edges: DataFrame, start: str, depth: int | None = 1) -> DataFrame:
    """(node, level) at shortest distance 1 to `depth` from `start`, which is left out.

    Without a depth the walk goes on until a level finds nothing new.

    `edges` has `from_node` and `to_node`. One join per level, each against nodes not yet seen,
    so dense graphs do not multiply walks. A level that finds nothing ends the loop.
    """
    if depth is not None and not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_DEPTH}")
    ensure_checkpoint_dir(edges.sparkSession)
    steps = edges.select("from_node", "to_node").where(F.col("to_node") != start)
    first = steps.where(F.col("from_node") == start).select(F.col("to_node").alias("node"))
    seen = first.distinct().withColumn("level", F.lit(1))
    for level in count(2) if depth is None else range(2, depth + 1):
        seen = seen.checkpoint()
        frontier = seen.where(F.col("level") == level - 1)
        if frontier.isEmpty():
            break
        found = (
            steps.join(frontier, steps["from_node"] == frontier["node"], "left_semi")
            .select(F.col("to_node").alias("node"))
            .distinct()
            .join(seen, "node", "left_anti")
        )
        seen = seen.unionByName(found.withColumn("level", F.lit(level)))
    return seen


def reachable_from(
    edges: DataFrame, starts: DataFrame, depth: int | None = None, slice_edges: int = NODE_SLICE
) -> DataFrame:
    """(start, node, level): what each of many starts reaches, at its shortest distance from 1 on.

    As `reachable`, for all rows of `starts(start)` at once: a level is one join of all frontiers.
    The edges of a node with very many are cut into slices, and its frontier rows go to each, so
    no task joins all of them. Without a depth the walk goes on until a level finds nothing new.
    Null starts and ends reach nothing; a start is not among what it reaches itself.
    """
    if depth is not None and depth < 1:
        raise ValueError("depth must be at least 1")
    ensure_checkpoint_dir(edges.sparkSession)
    steps = edges.select("from_node", "to_node").dropna().distinct()
    slices = steps.groupBy("from_node").agg(F.ceil(F.count(F.lit(1)) / slice_edges).cast("int").alias("_slices"))
    steps = (
        steps.join(slices, "from_node")
        .withColumn("_slice", F.pmod(F.xxhash64("to_node"), F.col("_slices")).cast("int"))
        .checkpoint()
    )
    slices = steps.select("from_node", "_slices").distinct().checkpoint()
    # Level 0 is the start itself, which keeps walks from coming back to it.
    seen = starts.select("start").dropna().distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("level"))
    for level in count(1) if depth is None else range(1, depth + 1):
        seen = seen.checkpoint()
        frontier = seen.where(F.col("level") == level - 1).select("start", F.col("node").alias("from_node"))
        dealt = frontier.join(slices, "from_node").select(
            "start", "from_node", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice")
        )
        found = (
            dealt.join(steps, ["from_node", "_slice"])
            .select("start", F.col("to_node").alias("node"))
            .distinct()
            .join(seen, ["start", "node"], "left_anti")
            .checkpoint()
        )
        if found.isEmpty():
            break
        seen = seen.unionByName(found.withColumn("level", F.lit(level)))
    return seen.where(F.col("level") > 0)


def dependencies(
    edges: DataFrame, file: str, direction: str = "both", depth: int = 1
) -> DataFrame:
    """(direction, file, level, names) around `file`.

    `names` is filled for direct edges only, from the last import statement that names any.
    """
    if direction not in ("imports", "importedBy", "both"):
        raise ValueError("direction must be imports, importedBy or both")
    names = named_imports(
        edges.where((F.col("source") == file) | (F.col("target") == file))
    )
    sides = []
    for side, here, there in (("imports", "source", "target"), ("importedBy", "target", "source")):
        if direction not in (side, "both"):
            continue
        walk = edges.select(F.col(here).alias("from_node"), F.col(there).alias("to_node"))
        direct = names.where(F.col(here) == file).select(F.col(there).alias("node"), "names")
        sides.append(
            reachable(walk, file, depth).join(direct, "node", "left").select(
                F.lit(side).alias("direction"), F.col("node").alias("file"), "level", "names"
            )
        )
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
