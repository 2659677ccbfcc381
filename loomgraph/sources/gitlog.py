"""Commit history as a Spark data source: `git log` runs in the tasks, a range of commits each."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.functions.text import WS, is_blank, trim

COMMIT_MARK = "---COMMIT---"
_HASH_MARK = "\x01"


class CommitRange(InputPartition):
    def __init__(self, repo_id: str, root: str, sha: str, skip: int, count: int):
        self.repo_id, self.root, self.sha, self.skip, self.count = repo_id, root, sha, skip, count


def _git(root: str, *arguments: str) -> str:
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, check=False)
    if done.returncode:
        raise OSError(f"git {arguments[0]} failed in {root}: {done.stderr.strip()}")
    return done.stdout.strip()


class _GitLogReader(DataSourceReader):
    """Commits before a pinned one, so that commits made during a scan shift no range."""

    def __init__(self, options: dict[str, str]):
        # `roots` is "id=path" per line; every executor must see the same paths.
        pairs = [p.split("=", 1) for p in options["roots"].splitlines() if p]
        self.roots = [(name, root) for name, root in pairs]
        self.limit = int(options.get("maxcommits", "0"))
        self.since = options.get("since", "")
        self.step = int(options.get("commitspertask", "5000"))

    def partitions(self) -> list[CommitRange]:
        ranges = []
        for name, root in self.roots:
            if sha := head_sha(root):
                if self.since:
                    sha = f"{self.since}..{sha}"
                total = int(_git(root, "rev-list", "--count", sha))
                total = min(total, self.limit) if self.limit else total
                for skip in range(0, total, self.step):
                    ranges.append(CommitRange(name, root, sha, skip, min(self.step, total - skip)))
        return ranges

    def read(self, part: CommitRange | None) -> Iterator[tuple[str, str, str]]:
        if part is None:  # what Spark asks for when there is no range
            return
        # Commits without files (such as merges) are counted by the limit but give no rows.
        command = [
            "git", "-C", part.root, "-c", "core.quotePath=false", "log",
            f"--pretty=format:{_HASH_MARK}%H", "--name-only",
            "--skip", str(part.skip), "-n", str(part.count), part.sha,
        ]
        with subprocess.Popen(
            command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace"
        ) as process:
            commit = ""
            for line in process.stdout:
                line = line.rstrip("\n")
                if line.startswith(_HASH_MARK):
                    commit = line[1:]
                elif line.strip():
                    yield part.repo_id, commit, line
            said = process.stderr.read()
        if process.returncode:
            raise OSError(f"git log failed in {part.root}: {said.strip()}")


class GitLogSource(DataSource):
    """(repo_id, commit_id, file) rows of the newest commits of each repository."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "repo_id string, commit_id string, file string"

    def reader(self, schema) -> DataSourceReader:
        return _GitLogReader(self.options)


def commit_files(
    spark: SparkSession, roots: dict[str, str], max_commits: int | None = None, per_task: int = 5000,
    since: str = "",
) -> DataFrame:
    """Files of the newest `max_commits` commits of each repository, by default of all.

    With `since`, a commit of the one repository given, those that it leads to are left out.
    A folder that is no repository, or one without a commit, has none; a `git` that fails later
    fails its task.
    """
    spark.dataSource.register(GitLogSource)
    return (
        spark.read.format("gitlog")
        .option("roots", "\n".join(f"{k}={v}" for k, v in roots.items()))
        .option("maxCommits", str(max_commits or 0))
        .option("commitsPerTask", str(per_task))
        .option("since", since)
        .load()
    )


def newest_commits(files: DataFrame, max_commits: int, commit: str = "commit_no") -> DataFrame:
    """Rows of the first `max_commits` commits of a parsed log; the limit counts commits, not files."""
    return files.where(F.col(commit) < max_commits)


def leads_to(root: str, old: str, new: str) -> bool:
    """Whether the history of `new` still holds `old`, which a rewritten one does not."""
    command = ["git", "-C", root, "merge-base", "--is-ancestor", old, new]
    return bool(old and new) and subprocess.run(command, capture_output=True, check=False).returncode == 0


def head_sha(root: str) -> str:
    """Current commit of a checkout, '' when there is none."""
    done = subprocess.run(
        ["git", "-C", root, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True, text=True, check=False
    )
    return done.stdout.strip() if done.returncode == 0 else ""


def parse_log_text(logs: DataFrame, log: str = "log", mark: str = COMMIT_MARK) -> DataFrame:
    """Commit blocks of a log dump, one row per file line: `commit_no`, `file_pos`, `file`.

    Blank blocks are dropped before numbering and blank lines after splitting.
    """
    kept = [c for c in logs.columns if c != log]
    quoted = "".join("\\" + c if not c.isalnum() else c for c in mark)

    def file_lines(block: Column) -> Column:
        return F.filter(F.split(block, "\n", -1), lambda f: ~is_blank(f))

    blocks = F.filter(F.split(F.col(log), quoted, -1), lambda b: b.rlike(f"[^{WS}]"))
    return (
        logs.select(*kept, F.posexplode(F.transform(blocks, trim)).alias("commit_no", "_block"))
        .select(*kept, "commit_no", F.posexplode(file_lines(F.col("_block"))).alias("file_pos", "file"))
    )
