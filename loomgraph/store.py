"""The index as Parquet tables.

Chunks and the file log are append-only: each index run writes its chunks under a new version
and then, as the commit, one log row per changed or deleted file. A chunk is live when the log's
last row of its file has the chunk's version. A run that dies before its log rows leaves only chunks
that no reader sees. Compaction writes the live rows as a new generation of both tables, which one
write to the list of generations makes the current one; earlier ones stay for those who still read
them, until they are dropped. Graph tables are written under a version, too,
and become current together, by one write to their log.
"""

from __future__ import annotations

import re
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.incremental import PATH_KEY, latest_versions

CHUNKS = {
    "file_path": "string",
    "chunk_index": "int",
    "chunk_text": "string",
    "section": "string",
    "exports": "array<string>",
    "imports": "array<string>",
    "name": "string",
    "description": "string",
    "type": "string",
    "content_hash": "string",
    "mtime": "bigint",
    "version": "bigint",
    "embedding": "array<float>",
    "repo_id": "string",
    "source": "string",
}
FILE_LOG = {
    "file_path": "string",
    "content_hash": "string",
    "version": "bigint",
    "repo_id": "string",
    "source": "string",
}
GENERATIONS = {"generation": "bigint"}
VECTORS = {"text_hash": "string", "embedding": "array<float>", "model": "string"}
GRAPH_LOG = {"name": "string", "repo_id": "string", "version": "bigint"}
TABLES = {
    "import_edges": "source string, target string, stmt_pos int, names array<string>",
    "exports": "file_path string, pos int, name string, kind string",
    "co_changes": "file_a string, file_b string, count long",
    "graph_files": "file_path string, content_hash string",
    "import_statements": "file_path string, pos int, specifier string, base string, names array<string>",
    "import_targets": "base string, target string",
    "co_change_counts": "file_a string, file_b string, count long",
    "symbol_nodes": "id string, name string, kind string, file string, line int, lang string,"
    " is_default boolean",
    "symbol_edges": "src string, dst string, kind string",
    "semantic_edges": "src string, dst string, score double",
    "build_meta": "built_at timestamp, head_sha string, dim int",
}
#: Timestamps in exported JSON, to the microsecond.
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


class NotBuilt(LookupError):
    """The graph tables of a repository do not exist yet."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # --- chunks and file log ---------------------------------------------------------------

    def _read(self, name: str, columns: dict[str, str]) -> DataFrame:
        schema = ", ".join(f"{k} {v}" for k, v in columns.items())
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def generation(self) -> int:
        """The current generation of chunks and file log; 0 before the first compaction."""
        return self._read("generations", GENERATIONS).agg(F.max("generation")).first()[0] or 0

    @staticmethod
    def _named(name: str, generation: int) -> str:
        return f"{name}-{generation}" if generation else name

    def file_log(self, repo_id: str, source: str | None = None, generation: int | None = None) -> DataFrame:
        generation = self.generation() if generation is None else generation
        log = self._read(self._named("file_log", generation), FILE_LOG).where(F.col("repo_id") == repo_id)
        return log if source is None else log.where(F.col("source") == source)

    def stored_files(self, repo_id: str, source: str | None = None, generation: int | None = None) -> DataFrame:
        return latest_versions(self.file_log(repo_id, source, generation))

    def live_chunks(self, repo_id: str, source: str | None = None) -> DataFrame:
        # Both tables are read in one generation, whatever is made the current one in between.
        generation = self.generation()
        chunks = self._read(self._named("chunks", generation), CHUNKS).where(F.col("repo_id") == repo_id)
        if source is not None:
            chunks = chunks.where(F.col("source") == source)
        live = self.stored_files(repo_id, source, generation).select(*PATH_KEY, "version")
        return chunks.join(live, [*PATH_KEY, "version"], "left_semi")

    def compact(self) -> int:
        """Rewrite chunks and log of all repositories without dead rows; returns the new generation.

        Readers see equal rows before, during and after. A run that dies half-way leaves the
        generation it began with, and can be repeated. Indexing has one writer at a time, and
        compaction is one: if the log has grown meanwhile, nothing is published and it fails.
        """
        old, new = self.generation(), self.next_version()
        log = self._read(self._named("file_log", old), FILE_LOG)
        grown = log.agg(F.count(F.lit(1)), F.max("version"))
        before = grown.first()
        live = latest_versions(log)
        chunks = self._read(self._named("chunks", old), CHUNKS)
        kept = chunks.join(live.select(*PATH_KEY, "version"), [*PATH_KEY, "version"], "left_semi")
        # Files of even size, however many rows a source has.
        kept = kept.hint("rebalance", "repo_id", "source")
        kept.write.partitionBy("repo_id", "source").parquet(f"{self.root}/{self._named('chunks', new)}")
        rows = live.select("file_path", "content_hash", "version", "repo_id", "source")
        rows.write.partitionBy("repo_id", "source").parquet(f"{self.root}/{self._named('file_log', new)}")
        now = self._read(self._named("file_log", old), FILE_LOG).agg(F.count(F.lit(1)), F.max("version")).first()
        if now != before or self.generation() != old:
            raise RuntimeError("the index was written to while it was compacted: compact again")
        listed = self.spark.createDataFrame([(new,)], "generation bigint")
        listed.coalesce(1).write.mode("append").parquet(f"{self.root}/generations")
        return new

    def drop_old_generations(self) -> list[str]:
        """Delete the tables of generations other than the current one; for times without other readers."""
        current = self.generation()
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        kept = {self._named(name, current) for name in ("chunks", "file_log")}
        gone = []
        for status in files.listStatus(root):
            name = status.getPath().getName()
            if re.fullmatch(r"(chunks|file_log)(-\d+)?", name) and name not in kept:
                files.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def append_chunks(self, chunks: DataFrame, version: int) -> int:
        """Write chunks and return how many there were."""
        seen = Observation()
        given = chunks.withColumn("version", F.lit(version))
        rows = given.select(
            *[
                (F.col(name) if name in given.columns else F.lit(None)).cast(kind).alias(name)
                for name, kind in CHUNKS.items()
            ]
        ).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("append").partitionBy("repo_id", "source").parquet(
            f"{self.root}/{self._named('chunks', self.generation())}"
        )
        return seen.get["n"]

    def vectors(self, model: str) -> DataFrame:
        """(text_hash, embedding) of all texts that a model has ever been asked for."""
        return self._read("vectors", VECTORS).where(F.col("model") == model).drop("model")

    def append_vectors(self, rows: DataFrame, model: str) -> None:
        """Keep vectors for texts. They are true whatever becomes of the run that asked for them."""
        rows.select("text_hash", "embedding", F.lit(model).alias("model")).write.mode("append").partitionBy(
            "model"
        ).parquet(f"{self.root}/vectors")

    def append_log(self, files: DataFrame, version: int) -> None:
        """Write log rows; a NULL content_hash marks a deleted file."""
        files.select("file_path", "content_hash", F.lit(version).alias("version"), "repo_id",
                     "source").write.mode("append").partitionBy("repo_id", "source").parquet(
            f"{self.root}/{self._named('file_log', self.generation())}"
        )

    @staticmethod
    def next_version() -> int:
        return time.time_ns()

    # --- graph tables ----------------------------------------------------------------------

    def _table_path(self, name: str, repo_id: str) -> str:
        if not re.fullmatch(r"[\w.-]+", repo_id):
            raise ValueError(f"repository id not usable as a folder name: {repo_id!r}")
        return f"{self.root}/{name}/repo_id={repo_id}"

    def write_table(self, name: str, repo_id: str, rows: DataFrame, version: int) -> DataFrame:
        """Write one repository's rows of a graph table under a version, and read them back.

        Nobody else sees them before the version is published.
        """
        path = f"{self._table_path(name, repo_id)}/version={version}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def publish(self, repo_id: str, names: list[str], version: int) -> None:
        """Make the version of these tables the current one, with one write for all of them."""
        rows = [(name, repo_id, version) for name in names]
        log = self.spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in GRAPH_LOG.items()))
        log.coalesce(1).write.mode("append").parquet(f"{self.root}/graph_log")

    def table(self, name: str, repo_id: str) -> DataFrame:
        """The current version; earlier ones stay for those who still read them."""
        log = self._read("graph_log", GRAPH_LOG)
        mine = log.where((F.col("repo_id") == repo_id) & (F.col("name") == name))
        version = mine.agg(F.max("version")).first()[0]
        if version is None:
            raise NotBuilt(f"{name} of {repo_id!r} is not built yet")
        path = f"{self._table_path(name, repo_id)}/version={version}"
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def export_graph(self, repo_id: str, folder: str) -> None:
        """Write the current graph tables as JSON lines into `folder/<table>`, which must not exist."""
        for name in TABLES:
            rows = self.table(name, repo_id)
            rows.write.option("timestampFormat", JSON_TIME).json(f"{folder}/{name}")

    def import_graph(self, repo_id: str, folder: str) -> None:
        """Read what `export_graph` has written, from any repository, and make it the current graph.

        A table that is absent or a line that is no JSON fails the import, and the graph stays as it was.
        """
        version = self.next_version()
        for name, schema in TABLES.items():
            read = self.spark.read.schema(schema).option("mode", "FAILFAST").option("timestampFormat", JSON_TIME)
            self.write_table(name, repo_id, read.json(f"{folder}/{name}"), version)
        self.publish(repo_id, list(TABLES), version)

    def dimension(self, repo_id: str) -> int | None:
        try:
            row = self.table("build_meta", repo_id).first()
        except NotBuilt:
            return None
        return row["dim"] if row else None
