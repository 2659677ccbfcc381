"""Source trees as frames: scan, glob and skip rules, one row per file."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.functions.text import contains_any, glob_regex, matches_any_glob

MAX_SUBTREES = 256
SLICES = 4


def select_paths(
    paths: DataFrame, globs: list[str], skip_parts: list[str] = (), column: str = "file_path"
) -> DataFrame:
    """Rows whose path matches any glob and contains none of `skip_parts`, once per path."""
    path = F.col(column)
    wanted = matches_any_glob(path, list(globs)) & ~contains_any(path, list(skip_parts))
    return paths.where(wanted).dropDuplicates([column])


def filter_files(rows: DataFrame, glob: str | None, column: str = "file_path") -> DataFrame:
    return rows if glob is None else rows.where(F.col(column).rlike(glob_regex(glob)))


class Subtree(InputPartition):
    """One folder (with or without what lies below it), and the share of its files to read."""

    def __init__(self, folder: str, deep: bool, part: int, parts: int):
        self.folder, self.deep, self.part, self.parts = folder, deep, part, parts


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["root"])
        self.globs = json.loads(options.get("globs", "[]"))
        self.skip = json.loads(options.get("skip", "[]"))
        self.contents = options.get("contents", "true") == "true"

    def partitions(self) -> list[Subtree]:
        # Folders are opened level by level until there are enough of them to share out.
        shallow, deep = [], [self.root]
        while deep and len(shallow) + len(deep) < MAX_SUBTREES:
            below = [e.path for f in deep for e in self._folders(f)]
            shallow, deep = shallow + deep, below
        return [
            Subtree(folder, is_deep, part, SLICES)
            for folders, is_deep in ((shallow, False), (deep, True))
            for folder in folders
            for part in range(SLICES)
        ]

    @staticmethod
    def _folders(folder: str) -> list[os.DirEntry]:
        try:
            return [e for e in os.scandir(folder) if e.is_dir(follow_symlinks=False)]
        except OSError:
            return []

    def read(self, tree: Subtree) -> Iterator[tuple[str, str | None, int]]:
        pattern = "|".join(glob_regex(g) for g in self.globs).replace(r"\z", r"\Z")
        wanted = re.compile(pattern)
        for folder, below, names in os.walk(tree.folder):
            if not tree.deep:
                below.clear()
            for name in names:
                path = os.path.join(folder, name)
                shown = os.path.relpath(path, self.root).replace(os.sep, "/")
                if zlib.crc32(shown.encode("utf-8", "surrogateescape")) % tree.parts != tree.part:
                    continue
                if pattern and not wanted.match(shown) or any(s in shown for s in self.skip):
                    continue
                try:
                    changed = os.stat(path).st_mtime_ns // 1_000_000
                    text = None
                    if self.contents:
                        with open(path, "rb") as handle:
                            text = handle.read().decode("utf-8-sig", "replace")
                except FileNotFoundError:
                    # Gone since it was listed. Any other failure ends the scan: a file that
                    # cannot be read must not look like one that was deleted.
                    continue
                yield shown, text, changed


class SourceTree(DataSource):
    """(file_path, content, mtime) of the files of a folder every executor can see."""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return "file_path string, content string, mtime long"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def _tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("sourcetree").options(root=root, **options).load()


def scan_tree(
    spark: SparkSession,
    root: str,
    globs: list[str],
    skip_parts: list[str] = (),
    repo_id: str = "default",
    source: str = "code",
) -> DataFrame:
    """(repo_id, source, file_path, content, mtime) of every matching file under `root`.

    Files that vanish during the scan are skipped; one that cannot be read is an error. Paths
    are relative to `root`. A byte-order mark at a file's start is no part of its text.
    """
    files = _tree(
        spark, root, globs=json.dumps(list(globs)), skip=json.dumps(list(skip_parts))
    )
    return files.select(
        F.lit(repo_id).alias("repo_id"), F.lit(source).alias("source"), "file_path", "content",
        "mtime",
    )


def scan(spark: SparkSession, root: str, *rules) -> DataFrame:
    """`scan_store` for a root with a scheme other than file, else `scan_tree`."""
    scheme = re.match(r"([a-z][a-z0-9+.-]+):", root)
    if scheme and scheme[1] != "file":
        return scan_store(spark, root, *rules)
    return scan_tree(spark, re.sub("^file:/*", "/", root), *rules)


def list_paths(spark: SparkSession, root: str) -> DataFrame:
    """Every file path under `root`, whatever its kind, without reading the files."""
    return _tree(spark, root, contents="false").select("file_path")


def scan_store(
    spark: SparkSession,
    root: str,
    globs: list[str],
    skip_parts: list[str] = (),
    repo_id: str = "default",
    source: str = "code",
) -> DataFrame:
    """As `scan_tree`, for any storage Spark reads, such as object stores.

    Spark does not list names that start with a dot or an underscore.
    """
    folder = root.rstrip("/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .load(folder)
    )
    below = F.regexp_replace(
        "path", "^(?:[a-z0-9]+:)?/*" + re.escape(re.sub("^[a-z0-9]+:", "", folder).lstrip("/")) + "/", ""
    )
    wanted = files.withColumn("file_path", below)
    return select_paths(wanted, globs, skip_parts).select(
        F.lit(repo_id).alias("repo_id"),
        F.lit(source).alias("source"),
        "file_path",
        F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\A\x{FEFF}", "").alias("content"),
        F.unix_millis("modificationTime").alias("mtime"),
    )
