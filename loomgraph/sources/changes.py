"""Changes of a file tree as a stream: a streaming data source that compares listings.

An offset is the version of a listing, a count of intervals since the epoch. A batch goes from one
version to the next; its partitions are parts of the tree, and each task lists its own part, leaves
the listing in the state folder under the new version, and emits what differs from the old one. The
first listing of a part under a version stays: a batch that is run again reads it and emits the
same rows, so with the checkpoint of the query nothing is lost or told twice.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import tempfile
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomgraph.functions.text import glob_regex

MOST_PARTS = 256
DEFAULT_INTERVAL_SECONDS = 5.0
ADDED, CHANGED, REMOVED = "add", "change", "unlink"
_PARTS_FILE = "parts.json"


class TreePart(InputPartition):
    """A folder and all below it but what lies in other parts' folders."""

    def __init__(self, number: int, folder: str, others: list[str], old: int, new: int):
        self.number, self.folder, self.others, self.old, self.new = number, folder, others, old, new


def split_tree(root: str, most: int = MOST_PARTS) -> list[str]:
    """Folders that share out a tree, the root first: it is opened level by level until they are enough."""
    chosen, level = [root], [root]
    while level:
        level = [e.path for f in level for e in _folders(f)]
        if len(chosen) + len(level) > most:
            break
        chosen += level
    return chosen


def _folders(folder: str) -> list[os.DirEntry]:
    try:
        return sorted((e for e in os.scandir(folder) if e.is_dir(follow_symlinks=False)), key=lambda e: e.path)
    except FileNotFoundError:
        return []


def _keep_first(path: str, data: bytes) -> None:
    """Write a file as a whole unless it is there: of several writers the first one counts."""
    handle, scratch = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".part-")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
        os.link(scratch, path)
    except FileExistsError:
        pass
    finally:
        os.unlink(scratch)


class TreeChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["root"])
        self.state = os.path.abspath(options["state"])
        self.interval = float(options.get("interval", DEFAULT_INTERVAL_SECONDS))
        pattern = "|".join(glob_regex(g) for g in json.loads(options.get("globs", "[]")))
        self.wanted = re.compile(pattern.replace(r"\z", r"\Z"))
        self.skip = json.loads(options.get("skip", "[]"))
        self.last = 0

    # --- on the driver ---------------------------------------------------------------------

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        """The running interval's number; a clock that is set back does not lead back."""
        if not self.last:
            self.last = max((v for _, v in self._kept()), default=0)
        self.last = max(self.last, int(time.time() / self.interval))
        return {"version": self.last}

    def partitions(self, start: dict, end: dict) -> list[TreePart]:
        folders = self._parts()
        return [
            TreePart(k, folder, [f for f in folders if f != folder], start["version"], end["version"])
            for k, folder in enumerate(folders)
        ]

    def _parts(self) -> list[str]:
        """The parts of the first listing, kept for good: listings are compared part by part.

        Folders that come later belong to the part they lie in; a part whose folder goes is empty.
        """
        path = os.path.join(self.state, _PARTS_FILE)
        os.makedirs(self.state, exist_ok=True)
        if not os.path.exists(path):
            below = [os.path.relpath(f, self.root) for f in split_tree(self.root)]
            _keep_first(path, json.dumps(below).encode())
        with open(path, "rb") as file:
            return [os.path.normpath(os.path.join(self.root, f)) for f in json.load(file)]

    def _kept(self) -> list[tuple[str, int]]:
        """(file name, version) of the listings in the state folder."""
        try:
            names = os.listdir(self.state)
        except FileNotFoundError:
            return []
        return [(n, int(m[1])) for n in names if (m := re.fullmatch(r"\d+-(\d+)\.json\.gz", n))]

    def commit(self, end: dict) -> None:
        """Listings older than the committed version are not asked for again."""
        for name, version in self._kept():
            if version < end["version"]:
                os.unlink(os.path.join(self.state, name))

    # --- in a task -------------------------------------------------------------------------

    def read(self, part: TreePart) -> Iterator[tuple]:
        old = self._listing(part, part.old) if part.old else {}
        if old is None:
            raise FileNotFoundError(f"{self.state} has lost the listing of version {part.old}")
        new = self._listing(part, part.new)
        if new is None:
            # Versions are compared by their own listings, whoever wrote them first.
            _keep_first(self._path(part, part.new), gzip.compress(json.dumps(dict(self._walk(part))).encode()))
            new = self._listing(part, part.new)
        seen = datetime.fromtimestamp(part.new * self.interval, timezone.utc)
        for path in sorted(old.keys() | new.keys()):
            if old.get(path) != new.get(path):
                op = ADDED if path not in old else REMOVED if path not in new else CHANGED
                yield path, op, seen

    def _path(self, part: TreePart, version: int) -> str:
        return os.path.join(self.state, f"{part.number}-{version}.json.gz")

    def _listing(self, part: TreePart, version: int) -> dict[str, list[int]] | None:
        try:
            with gzip.open(self._path(part, version)) as file:
                return json.load(file)
        except FileNotFoundError:
            return None

    def _walk(self, part: TreePart) -> Iterator[tuple[str, list[int]]]:
        """(path, [time of change, size]) of the wanted files of a part."""
        others = set(part.others)
        for folder, below, names in os.walk(part.folder):
            below[:] = [b for b in below if os.path.join(folder, b) not in others]
            for name in names:
                path = os.path.join(folder, name)
                shown = os.path.relpath(path, self.root).replace(os.sep, "/")
                if not self.wanted.match(shown) or any(s in shown for s in self.skip):
                    continue
                try:
                    now = os.stat(path)
                except FileNotFoundError:
                    continue
                yield shown, [now.st_mtime_ns, now.st_size]


class TreeChanges(DataSource):
    """(file_path, op, ts) of each file of a shared folder that is new, different or gone."""

    @classmethod
    def name(cls) -> str:
        return "treechanges"

    def schema(self) -> str:
        return "file_path string, op string, ts timestamp"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeChangeReader(self.options)


def tree_changes(
    spark: SparkSession, root: str, globs: list[str], state: str, skip_parts: list[str] = (),
    source: str = "code", interval_seconds: float = DEFAULT_INTERVAL_SECONDS,
) -> DataFrame:
    """A stream of (source, file_path, op, ts): the first batch adds all files, later ones what changed.

    `root` and `state` are folders that driver and executors share; a query needs a state folder of
    its own, next to its checkpoint. The tree is listed once per interval and trigger. A file
    changes when its time of change or its size does. Files that come and go within an interval are
    not seen. Folders that cannot be read count as empty, as they do for `os.walk`.
    """
    spark.dataSource.register(TreeChanges)
    options = {
        "root": root, "state": state, "globs": json.dumps(list(globs)), "skip": json.dumps(list(skip_parts)),
        "interval": str(interval_seconds),
    }
    found = spark.readStream.format("treechanges").options(**options).load()
    return found.select(F.lit(source).alias("source"), "file_path", "op", "ts")
