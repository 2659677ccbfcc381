"""What an index must change: new, changed and vanished files, as joins of two listings.

A listing has repo_id, source, file_path and content_hash; `now` is what was scanned and
`stored` what the index holds. Work is limited to the scopes present in `scopes`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_KEY = ["repo_id", "source", "file_path"]


def changed_files(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs; all others need no work."""
    return now.join(
        stored.select(*PATH_KEY, "content_hash"), [*PATH_KEY, "content_hash"], "left_anti"
    )


def vanished_files(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored files of a scope that the scan of that scope no longer has."""
    return stored.join(now.select(*PATH_KEY), PATH_KEY, "left_anti")


def compared(now: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per path of either listing with its `status`: same, changed, new or gone.

    Other columns of the listings come as structs `now` and `stored`, so that one join tells all
    that an index run has to know.
    """
    left = now.select(*PATH_KEY, F.struct(*now.columns).alias("now"))
    right = stored.select(*PATH_KEY, F.struct(*stored.columns).alias("stored"))
    status = (
        F.when(F.col("now").isNull(), "gone")
        .when(F.col("stored").isNull(), "new")
        .when(F.col("now.content_hash") == F.col("stored.content_hash"), "same")
        .otherwise("changed")
    )
    return left.join(right, PATH_KEY, "full_outer").withColumn("status", status)


def merged_files(now: DataFrame, stored: DataFrame) -> DataFrame:
    """The files an index holds after a run, from two trees of equal columns, with their status."""
    rows = compared(now, stored).where(F.col("status") != "gone")
    same = F.col("status") == "same"
    others = [c for c in now.columns if c not in PATH_KEY]
    return rows.select(
        *PATH_KEY,
        *(F.when(same, F.col(f"stored.{c}")).otherwise(F.col(f"now.{c}")).alias(c) for c in others),
        "status",
    )


def upsert_chunks(stored: DataFrame, fresh: DataFrame, replaced: DataFrame) -> DataFrame:
    """Chunks after a run: those of the `replaced` paths go, `fresh` ones come.

    `replaced` lists every changed and every vanished path; a changed file that has no chunk any
    more is only found there.
    """
    kept = stored.join(replaced.select(*PATH_KEY).distinct(), PATH_KEY, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def delete_file(stored: DataFrame, repo_id: str, source: str, file_path: str) -> DataFrame:
    """Everything but one file."""
    return stored.where(
        ~(
            (F.col("repo_id") == repo_id)
            & (F.col("source") == source)
            & (F.col("file_path") == file_path)
        )
    )


def latest_versions(log: DataFrame) -> DataFrame:
    """Live files of an append-only log of (path key, version, content_hash or NULL if deleted)."""
    return (
        log.groupBy(*PATH_KEY)
        .agg(F.max(F.struct("version", "content_hash")).alias("_last"))
        .where(F.col("_last.content_hash").isNotNull())
        .select(*PATH_KEY, "_last.version", "_last.content_hash")
    )


def unseen_texts(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(text_hash, chunk_text) of each distinct text without a stored vector, once.

    Copies are folded in map tasks already, so a text that very many chunks share is no skew.
    """
    texts = chunks.groupBy("text_hash").agg(F.first("chunk_text").alias("chunk_text"))
    return texts.join(vectors.select("text_hash"), "text_hash", "left_anti")


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The chunks with the `embedding` stored for their text, whichever of equal texts it was made for.

    A hash that is stored twice, by runs side by side, counts once.
    """
    wanted = vectors.join(chunks.select("text_hash").distinct(), "text_hash", "left_semi")
    once = wanted.groupBy("text_hash").agg(F.first("embedding").alias("embedding"))
    return chunks.join(once, "text_hash").drop("text_hash")
