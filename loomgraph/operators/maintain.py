"""Graph tables after a change set, by delta joins: only what the change touches is worked out anew.

The change set is `changed`, the scanned files that are new or different, and `gone`, paths that
are no more. Stored tables are those of the last build: `statements` (import statements with their
base path), `targets` (the file each base means), `edges` and `counts` (all pairs of co-changing
files). Each function gives what a full rebuild would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.dealing import key_counts, matched, settled
from loomgraph.operators.depgraph import REPLACED_SUFFIX, REPLACEMENTS, TRIED_SUFFIXES, resolve_bases


def possible_bases(path: Column) -> Column:
    """Array of the bases that have `path` among their candidates: the inverse of `candidate_paths`."""

    def without(suffix: str) -> Column:
        return F.substring(path, F.lit(1), F.length(path) - len(suffix))

    tried = [F.when(path.endswith(s), without(s)) for s in TRIED_SUFFIXES]
    itself = F.when(path.rlike(r"[^/.][^/]*\.[^/]*\z"), path)
    replaced = [F.when(path.endswith(s), F.concat(without(s), F.lit(REPLACED_SUFFIX))) for s in REPLACEMENTS]
    return F.array_distinct(F.filter(F.array(*tried, itself, *replaced), lambda b: b.isNotNull()))


def updated_rows(stored: DataFrame, fresh: DataFrame, touched: DataFrame, key: str = "file_path") -> DataFrame:
    """Rows per file, such as statements or exports: those of touched files go, fresh ones come.

    `touched` has the path of every changed and every gone file.
    """
    paths = touched.select(F.col("file_path").alias(key)).distinct()
    return matched(stored, paths, [key], "left_anti").unionByName(fresh)


def affected_bases(
    statements: DataFrame, targets: DataFrame, come: DataFrame, gone: DataFrame, fresh: DataFrame
) -> DataFrame:
    """(base): those whose target may differ now.

    These are bases in use for which a path that came or went is a candidate, and those of fresh
    statements that were never looked up.
    """
    moved = come.select("file_path").union(gone.select("file_path"))
    near = settled(moved.select(F.explode(possible_bases(F.col("file_path"))).alias("base")))
    known = matched(near, _bases(statements), ["base"], "left_semi")
    new = matched(_bases(fresh), targets, ["base"], "left_anti")
    return _bases(settled(known.union(new)))


def _bases(rows: DataFrame) -> DataFrame:
    """(base): each base of the rows once."""
    return settled(key_counts(rows, rows.count(), ["base"]).select("base"))


def updated_targets(targets: DataFrame, affected: DataFrame, paths: DataFrame) -> DataFrame:
    """(base, target): affected bases are looked up again among the present paths."""
    found = resolve_bases(affected, paths)
    return matched(targets, affected, ["base"], "left_anti").unionByName(found.select("base", "target"))


def updated_edges(
    edges: DataFrame, statements: DataFrame, targets: DataFrame, affected: DataFrame, touched: DataFrame
) -> DataFrame:
    """Import edges: those of touched files and of affected bases are made anew, all others stay.

    `statements` and `targets` are the updated ones.
    """
    own = settled(touched.select("file_path").distinct())
    resolved_anew = settled(matched(statements, affected, ["base"], "left_semi"))
    rewritten = matched(settled(matched(statements, own, ["file_path"], "left_semi")), affected, ["base"], "left_anti")
    again = settled(resolved_anew.unionByName(rewritten).where(F.col("base").isNotNull()))
    places = resolved_anew.select(F.col("file_path").alias("source"), F.col("pos").alias("stmt_pos"))
    here = settled(matched(edges, own.withColumnRenamed("file_path", "source"), ["source"], "left_anti"))
    kept = matched(here, places, ["source", "stmt_pos"], "left_anti")
    made = matched(again, targets, ["base"]).select(
        F.col("file_path").alias("source"), "target", F.col("pos").alias("stmt_pos"), "names"
    )
    return kept.unionByName(made)


def updated_counts(counts: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pairs of co-changing files with counts: those of new commits are added to the stored ones.

    Both sides have all pairs, however rare: a pair may reach the minimum only with later commits.
    """
    return counts.unionByName(fresh).groupBy("file_a", "file_b").agg(F.sum("count").cast("long").alias("count"))
