"""The user-facing API: index a repository and ask questions about it.

Every question returns a DataFrame; `loomgraph.render` turns small results into text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import wiki
from loomgraph.config import EmbeddingConfig, RepoConfig
from loomgraph.functions.embedding import dimension, embed, embed_query
from loomgraph.functions.text import content_hash, in_words
from loomgraph.operators import chunking, cochange, depgraph, maintain, pages, symbols, waves
from loomgraph.operators.dealing import settled
from loomgraph.operators.incremental import (
    PATH_KEY, changed_files, unseen_texts, vanished_files, with_vectors,
)
from loomgraph.operators.search import check_k, nearest
from loomgraph.session import ensure_checkpoint_dir, ship_package
from loomgraph.sources.files import filter_files, list_paths, scan
from loomgraph.sources.gitlog import commit_files, head_sha, leads_to
from loomgraph.store import TABLES, NotBuilt, Store

SOURCES = ("code", "docs", "memory", "wiki")
# Kinds of notes.
NOTE_TYPES = ("user", "feedback", "project", "reference")
NOTE_SKIP = ["MEMORY.md", "archive/"]


class Workspace:
    """One repository's index in a store that several repositories may share."""

    def __init__(
        self,
        spark: SparkSession,
        repo: RepoConfig,
        embedding: EmbeddingConfig,
        store_root: str | None = None,
        provider: Callable | None = None,
    ):
        self.spark, self.repo, self.embedding, self.provider = spark, repo, embedding, provider
        self.store = Store(spark, store_root or f"{repo.state_dir}/index")
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        if repo.wiki_auto_init:
            wiki.init_wiki(repo.wiki_dir)

    # --- indexing --------------------------------------------------------------------------

    def tree(self, source: str) -> tuple[str, list[str], list[str]]:
        """Root folder, globs and parts of paths to skip of a source."""
        repo = self.repo
        return {
            "code": (repo.project_root, repo.code_globs, repo.skip_parts),
            "docs": (repo.project_root, repo.doc_globs, []),
            "memory": (repo.memory_dir, ["*.md"], NOTE_SKIP),
            "wiki": (repo.wiki_dir, ["*.md"], []),
        }[source]

    def scan(self, source: str) -> DataFrame:
        return scan(self.spark, *self.tree(source), self.repo.repo_id, source)

    def index(self, source: str) -> int:
        """Bring one source up to date; returns the number of chunks written.

        Only new and changed files are chunked and embedded, each as a whole.
        """
        repo_id = self.repo.repo_id
        files = self.scan(source).withColumn("content_hash", content_hash(F.col("content")))
        now = files.select(*PATH_KEY, "content_hash").checkpoint()
        stored = self.store.stored_files(repo_id, source).select(*PATH_KEY, "content_hash")
        stored = stored.checkpoint()
        changed = changed_files(now, stored).checkpoint()
        gone = vanished_files(now, stored).withColumn("content_hash", F.lit(None).cast("string"))
        gone = gone.checkpoint()
        is_changed = not changed.isEmpty()
        if not is_changed and gone.isEmpty():
            return 0
        version = self.store.next_version()
        count = 0
        if is_changed:
            fresh = files
            if not stored.isEmpty():
                fresh = files.join(changed, [*PATH_KEY, "content_hash"], "left_semi")
            count = self.store.append_chunks(self._embedded(self._chunked(fresh, source)), version)
        self.store.append_log(changed.unionByName(gone), version)
        return count

    def _chunked(self, files: DataFrame, source: str) -> DataFrame:
        chunker = {
            "code": chunking.chunk_declarations,
            "docs": chunking.chunk_sections,
            "memory": chunking.chunk_notes,
            "wiki": chunking.chunk_sections,
        }[source]
        return chunker(files)

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        """The chunks with vectors. Each distinct text is sent once per model, whatever file or run it is in."""
        model = f"{self.embedding.type}:{self.embedding.model}"
        hashed = chunks.withColumn("text_hash", F.sha2("chunk_text", 256)).checkpoint()
        unseen = unseen_texts(hashed, self.store.vectors(model))
        # Dealt anew: the few texts of a small run would otherwise be sent by one task.
        dealt = unseen.repartition(self.spark.sparkContext.defaultParallelism, "text_hash")
        vector = embed(F.col("chunk_text"), self.embedding, "document", self.provider)
        self.store.append_vectors(dealt.select("text_hash", vector.alias("embedding")), model)
        return with_vectors(hashed, self.store.vectors(model))

    def delete_files(self, files: DataFrame) -> None:
        """Take files out of the index at once; `files` has source and file_path."""
        gone = files.select(
            F.lit(self.repo.repo_id).alias("repo_id"), "source", "file_path",
            F.lit(None).cast("string").alias("content_hash"),
        ).distinct()
        self.store.append_log(gone, self.store.next_version())

    def delete_file(self, source: str, file_path: str) -> None:
        self.delete_files(
            self.spark.createDataFrame([(source, file_path)], "source string, file_path string")
        )

    def build_graph(self) -> None:
        """Rebuild import, export, co-change and symbol tables, and the overlay.

        Readers see the tables of the last build until all are written.
        """
        repo, store = self.repo, self.store
        settings, repo_id = repo.graph, repo.repo_id
        version = store.next_version()

        def write(name: str, rows: DataFrame) -> DataFrame:
            return store.write_table(name, repo_id, rows, version)

        files = self._graph_scan().checkpoint()
        paths = list_paths(self.spark, repo.project_root)
        heads = depgraph.with_heads(files.select("file_path", "content")).checkpoint()
        sha = head_sha(repo.project_root)
        write("graph_files", files.select("file_path", "content_hash"))
        statements = write("import_statements", depgraph.import_statements(heads))
        targets = write("import_targets", depgraph.resolve_bases(statements, paths))
        write("import_edges", depgraph.edges_of(statements, targets))
        write("exports", depgraph.exports(heads))
        counts = write("co_change_counts", self._pair_counts())
        write("co_changes", counts.where(F.col("count") >= settings.co_change_min_count))
        self._write_symbols(files, paths, write)
        write("build_meta", self._meta(sha))
        store.publish(repo_id, list(TABLES), version)

    def _graph_scan(self) -> DataFrame:
        return self.scan("code").select("file_path", "content", content_hash(F.col("content")).alias("content_hash"))

    def _pair_counts(self, since: str = "") -> DataFrame:
        repo = self.repo
        history = commit_files(
            self.spark, {repo.repo_id: repo.project_root}, repo.graph.co_change_max_commits, since=since
        )
        # Written out: the rows are counted before they are dealt, and git should run once.
        return cochange.co_change_pairs(settled(history), 1)

    def _write_symbols(self, files: DataFrame, paths: DataFrame, write: Callable) -> None:
        settings = self.repo.graph
        outlined = depgraph.with_outline(files.select("file_path", "content") if settings.symbols_enabled
                                         else files.select("file_path", "content").limit(0)).checkpoint()
        nodes = write("symbol_nodes", symbols.symbol_nodes(outlined))
        write("symbol_edges", symbols.symbol_edges(outlined, nodes, paths))
        write("semantic_edges", self._overlay(nodes, settings.semantic_min_score, settings.semantic_top_k))

    def _meta(self, sha: str) -> DataFrame:
        return self.spark.range(1).select(
            F.current_timestamp().alias("built_at"), F.lit(sha).alias("head_sha"),
            F.lit(dimension(self.embedding)).alias("dim"),
        )

    def update_graph(self) -> bool:
        """Bring the graph up to date from what changed since the last build; false if nothing did.

        Only changed scripts are read for statements, only bases that the change can affect are
        looked up, and only commits since the stored one are counted. Symbols and the overlay, where
        enabled, are made anew if a script changed. Without an earlier build, after a rewritten
        history, or with a limit on commits, which drops old ones, history is read as a whole.
        """
        repo, store, repo_id = self.repo, self.store, self.repo.repo_id
        try:
            old = {name: self._table(name) for name in TABLES}
        except NotBuilt:
            self.build_graph()
            return True
        version = store.next_version()
        written: list[str] = []

        def write(name: str, rows: DataFrame) -> DataFrame:
            written.append(name)
            return store.write_table(name, repo_id, rows, version)

        scanned = self._graph_scan().checkpoint()
        now, before = scanned.select("file_path", "content_hash"), old["graph_files"]
        changed = scanned.join(before, ["file_path", "content_hash"], "left_anti").checkpoint()
        gone = before.join(now, "file_path", "left_anti").select("file_path").checkpoint()
        all_paths = list_paths(self.spark, repo.project_root).checkpoint()
        sha, old_sha = head_sha(repo.project_root), old["build_meta"].first()["head_sha"]
        is_changed = not (changed.isEmpty() and gone.isEmpty())
        if not is_changed and sha == old_sha:
            return False
        if is_changed:
            touched = changed.select("file_path").union(gone).checkpoint()
            heads = depgraph.with_heads(changed.select("file_path", "content")).checkpoint()
            fresh = depgraph.import_statements(heads).checkpoint()
            come = now.join(before, "file_path", "left_anti")
            statements = write("import_statements", maintain.updated_rows(old["import_statements"], fresh, touched))
            affected = maintain.affected_bases(statements, old["import_targets"], come, gone, fresh).checkpoint()
            targets = write("import_targets", maintain.updated_targets(old["import_targets"], affected, all_paths))
            write("import_edges", maintain.updated_edges(old["import_edges"], statements, targets, affected, touched))
            write("exports", maintain.updated_rows(old["exports"], depgraph.exports(heads), touched))
            write("graph_files", now)
            self._write_symbols(scanned, all_paths, write)
        if sha != old_sha:
            follows = not repo.graph.co_change_max_commits and leads_to(repo.project_root, old_sha, sha)
            counts = self._pair_counts(since=old_sha if follows else "")
            counts = maintain.updated_counts(old["co_change_counts"], counts) if follows else counts
            counts = write("co_change_counts", counts)
            write("co_changes", counts.where(F.col("count") >= repo.graph.co_change_min_count))
        write("build_meta", self._meta(sha))
        store.publish(repo_id, written, version)
        return True

    def _overlay(self, nodes: DataFrame, min_score: float, top_k: int) -> DataFrame:
        chunks = self.store.live_chunks(self.repo.repo_id, "code")
        return symbols.symbol_overlay(chunks, nodes, min_score, top_k)

    def build_overlay(self, min_score: float, top_k: int) -> None:
        """Rebuild the similarity edges alone from the code chunks in the index."""
        repo_id, version = self.repo.repo_id, self.store.next_version()
        near = self._overlay(self.store.table("symbol_nodes", repo_id), min_score, top_k)
        self.store.write_table("semantic_edges", repo_id, near, version)
        self.store.publish(repo_id, ["semantic_edges"], version)

    def build(self) -> dict[str, int]:
        """Index all sources, rebuild the graph and report what there is."""
        known = self.store.dimension(self.repo.repo_id)
        if known is not None and known != dimension(self.embedding):
            # Vectors of another size cannot be compared: every file is indexed anew.
            self.delete_files(self.store.stored_files(self.repo.repo_id))
        report = {f"{source} chunks": self.index(source) for source in SOURCES}
        self.build_graph()
        for table in TABLES:
            if table != "build_meta":
                report[table] = self._table(table).count()
        return report

    def export_graph(self, folder: str) -> None:
        """Write the graph of the last build as JSON lines, one folder per table."""
        self.store.export_graph(self.repo.repo_id, folder)

    def import_graph(self, folder: str) -> None:
        """Make an exported graph the current one, all of it or nothing."""
        self.store.import_graph(self.repo.repo_id, folder)

    def _table(self, name: str) -> DataFrame:
        return self.store.table(name, self.repo.repo_id)

    def register_views(self) -> None:
        """Temporary views of all tables, so that everything is open to SQL."""
        self.store.live_chunks(self.repo.repo_id).createOrReplaceTempView("chunks")
        for table in TABLES:
            try:
                self._table(table).createOrReplaceTempView(table)
            except NotBuilt:
                continue

    # --- search ----------------------------------------------------------------------------

    def _search(self, source: str, query: str, k: int, where, columns: list[str]) -> DataFrame:
        """Rank keys and vectors only, then fetch the texts of the few winners."""
        keys = ["file_path", "chunk_index", "version"]
        chunks = self.store.live_chunks(self.repo.repo_id, source)
        scope = chunks if where is None else where(chunks)
        vector = embed_query(query, self.embedding, self.provider)
        hits = nearest(scope.select(*keys, "embedding"), vector, k, keys[:2]).collect()
        wanted = F.lit(False)
        for hit in hits:
            wanted = wanted | (
                (F.col("file_path") == hit["file_path"])
                & (F.col("chunk_index") == hit["chunk_index"])
                & (F.col("version") == hit["version"])
            )
        scores = self.spark.createDataFrame(
            [tuple(h[c] for c in (*keys, "score")) for h in hits],
            "file_path string, chunk_index int, version long, score double",
        )
        return (
            chunks.where(wanted).join(scores, keys)
            .orderBy(F.desc("score"), "file_path", "chunk_index")
            .select(F.col("file_path").alias("file"), *columns, "score")
        )

    def search_code(self, query: str, k: int = 5, file_filter: str | None = None) -> DataFrame:
        return self._search(
            "code", query, check_k(k, 20), lambda c: filter_files(c, file_filter),
            ["chunk_index", "chunk_text", "exports"],
        )

    def search_docs(self, query: str, k: int = 3) -> DataFrame:
        return self._search("docs", query, check_k(k, 10), None, ["section", "chunk_text"])

    def search_wiki(self, query: str, k: int = 3) -> DataFrame:
        return self._search("wiki", query, check_k(k, 10), None, ["section", "chunk_text"])

    def search_memory(self, query: str, k: int = 3, type: str | None = None) -> DataFrame:
        if type is not None and type not in NOTE_TYPES:
            raise ValueError(f"type must be one of {NOTE_TYPES}")
        where = None if type is None else (lambda c: c.where(F.col("type") == type))
        return self._search("memory", query, check_k(k, 10), where, ["name", "type", "chunk_text"])

    # --- graph -----------------------------------------------------------------------------

    def query_dependencies(
        self, file_path: str, direction: str = "both", depth: int = 1
    ) -> DataFrame:
        edges = self._table("import_edges")
        return depgraph.dependencies(edges, file_path, direction, depth).orderBy(
            "direction", "level", "file"
        )

    def query_co_changes(self, file_path: str, min_count: int = 2) -> DataFrame:
        found = cochange.co_changes_of(self._table("co_changes"), file_path, min_count)
        return found.orderBy(F.desc("count"), "other")

    def query_type_consumers(self, type_name: str) -> DataFrame:
        found = depgraph.consumers_of(
            self._table("import_edges"), self._table("exports"), type_name
        )
        return found.orderBy("role", *in_words("def_file"), *in_words("consumer"))

    def query_symbol(self, symbol: str) -> dict[str, DataFrame]:
        """Frames `matches`, `outgoing`, `incoming` and `neighbors` of one symbol."""
        nodes, edges = self._table("symbol_nodes"), self._table("symbol_edges")
        near = symbols.neighbors(self._table("semantic_edges"), nodes, symbol)
        return {
            "matches": symbols.find_symbols(nodes, symbol).orderBy("id"),
            "outgoing": symbols.outgoing(edges, nodes, symbol).orderBy("kind", "id"),
            "incoming": symbols.incoming(edges, nodes, symbol).orderBy("kind", "id"),
            "neighbors": near.orderBy(F.desc("score"), "id"),
        }

    def symbol_counts(self) -> dict[str, int]:
        names = {"nodes": "symbol_nodes", "edges": "symbol_edges", "semantic": "semantic_edges"}
        return {k: self._table(v).count() for k, v in names.items()}

    # --- wiki ------------------------------------------------------------------------------

    def list_wiki_pages(self) -> DataFrame:
        return pages.list_pages(self.scan("wiki")).orderBy("name")

    def read_wiki_page(self, page_name: str) -> DataFrame:
        return pages.read_page(self.scan("wiki"), page_name)

    def write_wiki_page(self, page_name: str, content: str) -> bool:
        """Write a page and index it; tells whether the page is new."""
        created = wiki.write_page(self.repo.wiki_dir, page_name, content)
        self.index("wiki")
        return created

    # --- work planning ---------------------------------------------------------------------

    def partition(self, touch_sets: list[dict], min_co_change: int = 3) -> dict:
        """Frames `plan`, `conflicts`, `waves`, `independent_set` and `warnings`, and `head_sha`.

        `plan` has one row per issue, with the commit that the warnings are of.
        """
        co_changes = self._table("co_changes")
        sets = waves.local_touch_sets(self.spark, touch_sets)
        touches = waves.touch_rows(sets)
        planned = waves.waves(touches)
        sha = self._table("build_meta").first()["head_sha"]
        return {
            "plan": waves.plan(touches, co_changes, (), min_co_change)
            .withColumn("head_sha", F.lit(sha)).orderBy("wave", "issue"),
            "conflicts": waves.conflicts(touches).orderBy("a", "b"),
            "waves": planned.orderBy("wave", "issue"),
            "independent_set": waves.independent_set(planned).orderBy("issue"),
            "warnings": waves.coupling_warnings(touches, co_changes, (), min_co_change).orderBy(
                "issue", "file", F.desc("count"), "coupled_to"
            ),
            "head_sha": sha,
        }
