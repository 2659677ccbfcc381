"""Every registered query: an operator bound to whole sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.config import EmbeddingConfig
from loomgraph.functions import embedding as emb
from loomgraph.functions.text import content_hash, cut
from loomgraph.functions.vectors import cosine, list_array
from loomgraph.operators import (
    chunking, cochange, depgraph, incremental, maintain, overlay, pages, search, symbols,
    vector_index, waves,
)
from loomgraph.operators.dealing import stored
from loomgraph.plans import corpus
from loomgraph.plans.corpus import table
from loomgraph.session import ensure_checkpoint_dir
from loomgraph.sources.files import filter_files, select_paths
from loomgraph.sources.gitlog import COMMIT_MARK, newest_commits, parse_log_text
from loomgraph.streaming.debounce import change_bursts

OFFLINE = EmbeddingConfig("offline", "char-bins")
QUERY_TEXT = "where are the entries of the older index kept"
OVERLAY_MIN_SCORE = 0.3
HUB_FILE = "src/nation/n3.ts"
HUB_SYMBOL = "src/nation/n3.ts::Nation3"
MODULE = "src/Brand#2/ECONOMY.ts"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__.rstrip("_")] = run
    return run


# --- scans, chunkers, hashing -------------------------------------------------------------


@query
def scan_filter_skip(spark, sf):
    path = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    found = table(spark, sf, "pages").select(path.alias("file_path"))
    return select_paths(found, ["*/{en,fr}/*", "**/*.html"], ["spam", ".net/"])


@query
def content_hash_(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", content_hash(F.col("text")).alias("content_hash")
    )


def _digest(chunks: DataFrame, *keys: str) -> DataFrame:
    return chunks.select(
        *keys, "chunk_index", F.length("chunk_text").alias("n_chars"),
        content_hash(F.col("chunk_text")).alias("chunk_hash"),
    )


@query
def chunk_sliding_window(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return _digest(chunking.chunk_windows(docs, "text", window=20, overlap=5), "doc_id")


@query
def chunk_markdown(spark, sf):
    chunks = chunking.chunk_sections(corpus.doc_files(spark, sf))
    return _digest(chunks, "file_path", "section")


@query
def chunk_memory_frontmatter(spark, sf):
    chunks = chunking.chunk_notes(corpus.note_files(spark, sf))
    return _digest(chunks, "file_path", "name", "description", "type")


@query
def chunk_pack_greedy(spark, sf):
    chunks = chunking.chunk_declarations(corpus.script_files(spark, sf))
    return chunks.select(
        "file_path", "chunk_index", F.length("chunk_text").alias("n_chars"),
        content_hash(F.col("chunk_text")).alias("chunk_hash"),
        F.size("exports").alias("n_exports"),
        F.array_join("imports", ", ").alias("imports"),
    )


def _chunks(spark, sf, source: str) -> DataFrame:
    if source == "code":
        return chunking.chunk_declarations(corpus.code_files(spark, sf))
    if source == "docs":
        return chunking.chunk_sections(corpus.doc_files(spark, sf))
    if source == "memory":
        return chunking.chunk_notes(corpus.note_files(spark, sf))
    return chunking.chunk_sections(corpus.wiki_files(spark, sf))


def _index_counts(chunks: DataFrame) -> DataFrame:
    """Per top folder: files and chunks."""
    folder = F.regexp_extract("file_path", r"^((?:[^/]+/)*?[^/]+)/[^/]*\d", 1)
    per_file = chunks.groupBy("source", "file_path").agg(F.count(F.lit(1)).alias("_n"))
    return per_file.groupBy("source", folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("_n").alias("n_chunks")
    )


@query
def index_code_counts(spark, sf):
    return _index_counts(_chunks(spark, sf, "code"))


@query
def index_docs_counts(spark, sf):
    return _index_counts(_chunks(spark, sf, "docs"))


@query
def index_memory_counts(spark, sf):
    return _index_counts(_chunks(spark, sf, "memory"))


@query
def index_wiki_counts(spark, sf):
    return _index_counts(_chunks(spark, sf, "wiki"))


def _all_chunks(spark, sf) -> DataFrame:
    rows = _chunks(spark, sf, "code")
    for source in ("docs", "memory", "wiki"):
        rows = rows.unionByName(_chunks(spark, sf, source), allowMissingColumns=True)
    return rows


@query
def chunk_counts(spark, sf):
    return _all_chunks(spark, sf).groupBy("repo_id", "source").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.length("chunk_text").cast("long")).alias("n_chars"),
    )


@query
def wiki_list_pages(spark, sf):
    return pages.list_pages(corpus.wiki_files(spark, sf))


@query
def wiki_read_page(spark, sf):
    found = pages.read_page(corpus.wiki_files(spark, sf), "Page 17")
    return found.select(
        "name", "summary", "last_updated", content_hash(F.col("content")).alias("content_hash"),
        F.array_join("related_pages", ",").alias("related_pages"),
    )


# --- embedding and search -----------------------------------------------------------------


@query
def embed_prefix_truncate(spark, sf):
    models = ["nomic-embed-code", "nomic-embed-text:v1.5", "my/Qwen3-Embedding-8B", "other"]
    cases = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(mode).alias("mode"))
          for m in models for mode in ("query", "document")]
    )
    # What lies beyond the limit is cut off once, before a text becomes a row for each case.
    head = cut(F.col("text"), emb.MAX_TEXT_CHARS).alias("text")
    docs = corpus.dealt(spark, sf, "documents", "doc_id", "text").select("doc_id", head)
    rows = docs.select("doc_id", "text", F.explode(cases).alias("_c"))
    sent = emb.model_input(F.col("text"), F.col("_c.model"), F.col("_c.mode"))
    return rows.select("doc_id", "_c.model", "_c.mode", sent.alias("_sent")).select(
        "doc_id", "model", "mode", F.length("_sent").alias("n_chars"),
        content_hash(F.col("_sent")).alias("input_hash"),
    )


@query
def embedding_dim_lookup(spark, sf):
    model = (
        F.when(F.col("lang") == "en", "nomic-embed-code").when(F.col("lang") == "fr", "all-minilm")
        .otherwise("unlisted")
    )
    provider = (
        F.when(F.col("source") < "src2", "openai").when(F.col("source") < "src5", "tei")
        .otherwise("elsewhere")
    )
    return table(spark, sf, "documents").select(
        "doc_id", emb.dimension_of(provider, model).alias("dim")
    )


@query
def fake_embedding(spark, sf):
    """Non-zero components of the offline embedding of every whole document."""

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        return list_array(np.asarray([emb.char_bins(t) for t in texts.to_pylist()]))

    rows = table(spark, sf, "documents").select(
        "doc_id", vectors.asNondeterministic()("text").alias("_v")
    )
    return rows.select("doc_id", F.posexplode("_v").alias("bin", "_w")).where("_w > 0").select(
        "doc_id", "bin", F.round("_w", 6).alias("weight")
    )


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", "embedding",
        F.concat(F.lit("label_"), F.col("label"), F.lit("/v"), F.col("vec_id"), F.lit(".ts")).alias(
            "file_path"
        ),
    )


def _query_vector(spark, sf) -> list[float]:
    """The vector searched for: that of row 0."""
    rows = table(spark, sf, "embeddings")
    return list(rows.where("vec_id = 0").select("embedding").first()[0])


@query
def search_code(spark, sf):
    rows = _vectors(spark, sf)
    return search.nearest(rows, _query_vector(spark, sf), 20, ["vec_id"])


@query
def search_code_indexed(spark, sf):
    """As search_code, through an index of cells built on the whole table."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/index-{uuid.uuid4().hex}"
    vector_index.build_index(_vectors(spark, sf), path, cells=64)
    index = vector_index.VectorIndex(spark, path)
    return index.search(_query_vector(spark, sf), 20, ["vec_id"])


@query
def search_code_file_filter(spark, sf):
    rows = filter_files(_vectors(spark, sf), "label_{3,4}/**")
    return search.nearest(rows, _query_vector(spark, sf), 20, ["vec_id"])


def _search_text(
    chunks: DataFrame, k: int, keys: list[str], where=None, wanted: str = QUERY_TEXT
) -> DataFrame:
    scope = chunks if where is None else chunks.where(where)
    rows = scope.select(*keys, emb.embed(F.col("chunk_text"), OFFLINE).alias("embedding"))
    hits = search.nearest(rows, emb.embed_query(wanted, OFFLINE), k, keys)
    return hits.select(*keys, F.round("score", 4).alias("score"))


@query
def search_docs(spark, sf):
    return _search_text(_chunks(spark, sf, "docs"), 10, ["file_path", "chunk_index"])


@query
def search_docs_tail(spark, sf):
    """What is searched for is the end of the longest document."""
    longest = table(spark, sf, "documents").orderBy(F.desc(F.length("text")), "doc_id")
    wanted = longest.select(F.expr("right(text, 300)")).first()[0]
    return _search_text(
        _chunks(spark, sf, "docs"), 10, ["file_path", "chunk_index"], wanted=wanted
    )


@query
def search_wiki(spark, sf):
    return _search_text(_chunks(spark, sf, "wiki"), 10, ["file_path", "chunk_index"])


@query
def search_memory_type(spark, sf):
    return _search_text(
        _chunks(spark, sf, "memory"), 10, ["file_path", "chunk_index"],
        F.col("type") == "feedback",
    )


@query
def cosine_pairs(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_next"))
    return rows.join(after, "vec_id").select(
        "vec_id", cosine(F.col("embedding"), F.col("_next")).alias("score")
    )


def _overlay(spark, sf) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("file"), "embedding"
    )
    return overlay.overlay(rows, OVERLAY_MIN_SCORE)


@query
def symbol_overlay(spark, sf):
    """Each vector as a chunk that exports two symbols, one of them shared with the next chunk."""
    vec = F.col("vec_id")
    name = lambda n: F.concat(F.lit("s"), n.cast("string"))
    chunks = table(spark, sf, "embeddings").select(
        F.concat(F.lit("f"), F.col("label")).alias("file_path"), "embedding",
        F.array(name(F.floor(vec / 2)), name(vec + 100_000)).alias("exports"),
    )
    nodes = chunks.select("file_path", F.explode("exports").alias("name")).where(
        ~F.col("name").endswith("7")
    ).select(symbols.symbol_id(F.col("file_path"), F.col("name")).alias("id")).distinct()
    return symbols.symbol_overlay(chunks, nodes, OVERLAY_MIN_SCORE, 3)


@query
def search_code_scope(spark, sf):
    """One repository and source of an index that several share."""
    rows = _vectors(spark, sf).withColumn(
        "repo_id", F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b")
    ).withColumn("source", F.when(F.col("vec_id") % 2 == 0, "code").otherwise("docs"))
    found = search.nearest(
        rows, _query_vector(spark, sf), 15, ["vec_id"],
        where=(F.col("repo_id") == "b") & (F.col("source") == "code"),
    )
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "vec_id"))
    return found.select("vec_id", "repo_id", "source", "score", rank.alias("rank"))


@query
def touch_rows_trimmed(spark, sf):
    """Touch sets with blanks around paths, repeated paths and empty sets."""
    line = F.col("l_linenumber")
    padded = F.concat(F.when(line % 2 == 0, F.lit(" \t")).otherwise(""), F.lit("p"), F.col("l_partkey") % 50, F.lit("\n"))
    sets = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("issue")).agg(
        F.collect_list(F.when(line < 4, padded)).alias("files")
    )
    return waves.touch_rows(sets)


@query
def reindex_unchanged(spark, sf):
    """A second run over the same tree: nothing to do, whatever the source."""
    listing = corpus.listing(corpus.doc_files(spark, sf))
    compared = incremental.compared(listing, listing)
    return compared.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n_files"))


@query
def chunk_fallback(spark, sf):
    """Files of any kind through the chunker of code: what has no declaration goes by lines."""
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("d"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".ts"))
    commented = F.concat(F.lit("// "), F.replace("text", F.lit("\n"), F.lit("\n// ")))
    files = docs.select(path.alias("file_path"), commented.alias("content"))
    return _digest(chunking.chunk_declarations(files), "file_path")


@query
def semantic_overlay(spark, sf):
    return _overlay(spark, sf)


@query
def semantic_overlay_low(spark, sf):
    """Best 3 above -0.5: no cell is out of reach there, only pairs whose rest is too short."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("file"), "embedding")
    return overlay.overlay(rows, -0.5, 3)


# --- history ------------------------------------------------------------------------------


@query
def parse_commit_log(spark, sf):
    """Each document gives two commits: its lines, and its source and language."""
    log = F.concat(
        F.lit(COMMIT_MARK + "\n"), F.col("text"), F.lit("\n\n" + COMMIT_MARK + "\n"),
        F.col("source"), F.lit("\n\n"), F.col("lang"), F.lit("\n"),
    )
    rows = table(spark, sf, "documents").select("doc_id", log.alias("log"))
    return parse_log_text(rows).select(
        "doc_id", "commit_no", "file_pos", content_hash(F.col("file")).alias("file_hash")
    )


@query
def commit_limit(spark, sf):
    """The newest commit of each log: the limit counts commits before files are listed."""
    logs = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.lit(COMMIT_MARK + "\n"), F.col("text"), F.lit("\n" + COMMIT_MARK + "\n"), F.col("lang")
        ).alias("log"),
    )
    rows = newest_commits(parse_log_text(logs), 1)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_files"), F.max("commit_no").alias("last"))


@query
def co_change_pairs(spark, sf):
    return cochange.co_change_pairs(corpus.part_history(spark, sf))


@query
def query_co_changes(spark, sf):
    return cochange.co_changes_of(
        cochange.co_change_pairs(corpus.module_history(spark, sf)), MODULE
    )


@query
def distinct_files(spark, sf):
    return corpus.module_history(spark, sf).select("file").distinct()


# --- file graph ---------------------------------------------------------------------------


def _tree(spark, sf, with_symbols: bool = False) -> tuple[DataFrame, DataFrame]:
    files = corpus.code_files(spark, sf)
    outlined = depgraph.with_outline(files) if with_symbols else depgraph.with_heads(files)
    return outlined, files.select("file_path")


def _written(frame: DataFrame) -> DataFrame:
    """The frame written out once, for queries that read it more than once."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def _edges(spark, sf) -> DataFrame:
    outlined, paths = _tree(spark, sf)
    return depgraph.import_edges(outlined, paths)


@query
def import_extract(spark, sf):
    return depgraph.import_statements(_tree(spark, sf)[0]).select(
        "file_path", "pos", "specifier", F.array_join("names", ",").alias("names")
    )


@query
def export_extract(spark, sf):
    return depgraph.exports(_tree(spark, sf)[0]).select("file_path", "name", "kind")


@query
def import_heads_varied(spark, sf):
    """Statements of scripts made from the documents' own lines, in comments and texts too."""
    outlined = depgraph.with_heads(corpus.varied_scripts(spark, sf))
    imported = depgraph.import_statements(outlined).select(
        "file_path", F.lit("import").alias("what"), F.col("base").alias("name"),
        F.array_join("names", ",").alias("detail"),
    )
    exported = depgraph.exports(outlined).select(
        "file_path", F.lit("export").alias("what"), "name", F.col("kind").alias("detail")
    )
    return imported.unionByName(exported)


@query
def import_resolve(spark, sf):
    outlined, paths = _tree(spark, sf)
    return depgraph.resolve_bases(depgraph.import_statements(outlined), paths)


@query
def import_edges(spark, sf):
    return _edges(spark, sf).select(
        "source", "target", "stmt_pos", F.array_join("names", ",").alias("names")
    )


@query
def import_edges_updated(spark, sf):
    """The edges of the whole tree, from those of an earlier state of it by delta joins.

    In the earlier state nations were .js files next to the folder they are in now, orders of 1995
    and later were not there, and customers in debt imported nothing.
    """
    files = corpus.code_files(spark, sf)
    path, late = F.col("file_path"), table(spark, sf, "orders").where("o_orderdate >= '1995-01-01'")
    late = late.select(F.concat(F.lit("src/orders/o"), "o_orderkey", F.lit(".tsx")).alias("file_path"))
    in_debt = path.startswith("src/customer/") & F.col("content").contains("return -")
    earlier = files.join(late, "file_path", "left_anti").select(
        F.when(path.startswith("src/nation/"), F.regexp_replace(path, r"\.ts\z", "/index.ts")).otherwise(path).alias("file_path"),
        F.when(in_debt, F.lit("export {}")).otherwise(F.col("content")).alias("content"),
    )
    before = _written(earlier.select("file_path", "content", content_hash(F.col("content")).alias("content_hash")))
    now = _written(files.select("file_path", "content", content_hash(F.col("content")).alias("content_hash")))
    statements = _written(depgraph.import_statements(depgraph.with_heads(before.select("file_path", "content"))))
    targets = _written(depgraph.resolve_bases(statements, before))
    edges = _written(depgraph.edges_of(statements, targets))
    # From here on, as an update of stored tables.
    changed = _written(now.join(before.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti"))
    gone = _written(before.select("file_path").join(now, "file_path", "left_anti"))
    touched = changed.select("file_path").union(gone)
    fresh = _written(depgraph.import_statements(depgraph.with_heads(changed.select("file_path", "content"))))
    come = now.select("file_path").join(before, "file_path", "left_anti")
    statements_now = _written(maintain.updated_rows(statements, fresh, touched))
    affected = _written(maintain.affected_bases(statements_now, targets, come, gone, fresh))
    targets_now = _written(maintain.updated_targets(targets, affected, now))
    rows = maintain.updated_edges(edges, statements_now, targets_now, affected, touched)
    return rows.select("source", "target", "stmt_pos", F.array_join("names", ",").alias("names"))


@query
def reachable_from_many(spark, sf):
    """What depends on each nation and region, over any number of imports, for all of them at once."""
    edges = _edges(spark, sf).select(F.col("target").alias("from_node"), F.col("source").alias("to_node"))
    places = corpus.code_files(spark, sf).where(F.col("file_path").rlike("^src/(nation|region)/"))
    return depgraph.reachable_from(edges, places.select(F.col("file_path").alias("start")))


@query
def import_edge_count(spark, sf):
    return _edges(spark, sf).agg(F.count(F.lit(1)).alias("n_edges"))


@query
def imported_by(spark, sf):
    return depgraph.imported_by(_edges(spark, sf))


@query
def named_imports(spark, sf):
    return depgraph.named_imports(_edges(spark, sf)).select(
        "source", "target", F.array_join("names", ",").alias("names")
    )


@query
def type_consumers(spark, sf):
    return depgraph.type_consumers(_edges(spark, sf))


@query
def symbol_consumers(spark, sf):
    return depgraph.symbol_consumers(_edges(spark, sf))


@query
def query_type_consumers(spark, sf):
    outlined, paths = _tree(spark, sf)
    outlined = _written(outlined)
    edges = _written(depgraph.import_edges(outlined, paths))
    return depgraph.consumers_of(edges, depgraph.exports(outlined), "Nation3")


@query
def query_type_consumers_q(spark, sf):
    outlined, paths = _tree(spark, sf)
    outlined = _written(outlined)
    edges = _written(depgraph.import_edges(outlined, paths))
    return depgraph.consumers_of(edges, depgraph.exports(outlined), HUB_SYMBOL)


@query
def transitive_deps(spark, sf):
    """Everything that imports a region, directly or not."""
    walk = depgraph.imported_by(_edges(spark, sf)).select(
        F.col("target").alias("from_node"), F.col("source").alias("to_node")
    )
    return depgraph.reachable(_written(walk), "src/region/r0.ts", None)


@query
def query_dependencies(spark, sf):
    return depgraph.dependencies(_written(_edges(spark, sf)), HUB_FILE, "both", 2).select(
        "direction", "file", "level", F.array_join("names", ",").alias("names")
    )


# --- symbol graph -------------------------------------------------------------------------


def _symbol_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    outlined, paths = _tree(spark, sf, with_symbols=True)
    parts = F.struct("outline.symbols", "outline.refs").alias("outline")
    outlined = stored(outlined.select("file_path", parts))
    nodes = symbols.symbol_nodes(outlined)
    return nodes, symbols.symbol_edges(outlined, nodes, paths)


@query
def symbol_nodes(spark, sf):
    outlined, _ = _tree(spark, sf, with_symbols=True)
    return symbols.symbol_nodes(outlined).select("id", "name", "kind", "file", "line", "lang")


@query
def symbol_edges_heritage(spark, sf):
    return _symbol_graph(spark, sf)[1].where(F.col("kind").isin("extends", "implements"))


@query
def symbol_edges_calls(spark, sf):
    return _symbol_graph(spark, sf)[1].where(F.col("kind") == "calls")


@query
def symbol_edges_uses(spark, sf):
    return _symbol_graph(spark, sf)[1].where(F.col("kind") == "uses-type")


@query
def symbol_edges_valid(spark, sf):
    """Raw order-to-customer and self edges against the nodes of customers in debt."""
    nodes = table(spark, sf, "customer").where("c_acctbal < 5000").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("id")
    )
    owner = F.concat(F.lit("c"), F.col("o_custkey"))
    other = F.concat(F.lit("c"), F.pmod(F.col("o_orderkey"), F.col("o_custkey") + 1))
    raw = table(spark, sf, "orders").select(
        owner.alias("src"), other.alias("dst"), F.lit("references").alias("kind")
    )
    return symbols.valid_edges(raw, nodes)


@query
def symbol_counts(spark, sf):
    nodes, edges = _symbol_graph(spark, sf)
    return _count_rows([("nodes", nodes), ("edges", edges), ("semantic", _overlay(spark, sf))])


def _count_rows(named: list[tuple[str, DataFrame]]) -> DataFrame:
    rows = None
    for name, frame in named:
        row = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query
def query_symbol_out(spark, sf):
    nodes, edges = _symbol_graph(spark, sf)
    edges = stored(edges)
    return symbols.outgoing(edges, nodes, "src/orders/o7.tsx::open7").select("kind", "id", "line")


@query
def query_symbol_in(spark, sf):
    nodes, edges = _symbol_graph(spark, sf)
    edges = stored(edges)
    return symbols.incoming(edges, nodes, "Nation3").select("kind", "id", "node_kind", "line")


@query
def symbol_edges_grouped(spark, sf):
    nodes, edges = _symbol_graph(spark, sf)
    edges = stored(edges)
    return symbols.edge_groups(symbols.incoming(edges, nodes, HUB_SYMBOL), "incoming")


@query
def query_symbol_neighbors(spark, sf):
    vectors = table(spark, sf, "embeddings")
    nodes = vectors.select(
        F.col("vec_id").cast("string").alias("id"),
        F.concat(F.lit("v"), F.col("vec_id")).alias("name"),
        F.lit("function").alias("kind"), F.col("label").alias("file"), F.lit(1).alias("line"),
    )
    near = _overlay(spark, sf).select(
        F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "score"
    )
    return symbols.neighbors(near, nodes, "v3").select("id", "name", "file", "score")


@query
def build_report(spark, sf):
    outlined, paths = _tree(spark, sf, with_symbols=True)
    outlined = stored(outlined)
    nodes = symbols.symbol_nodes(outlined)
    chunks = [(f"{s} chunks", _chunks(spark, sf, s)) for s in ("code", "docs", "memory", "wiki")]
    return _count_rows([
        *chunks, ("import edges", depgraph.import_edges(outlined, paths)),
        ("co-change pairs", cochange.co_change_pairs(corpus.part_history(spark, sf))),
        ("symbols", nodes),
        ("symbol edges", symbols.symbol_edges(outlined, nodes, paths)),
    ])


# --- work planning ------------------------------------------------------------------------


@query
def partition_conflicts(spark, sf):
    return waves.conflicts(corpus.module_touches(spark, sf), ["batch"])


@query
def touch_set_intersect(spark, sf):
    return waves.shared_files(corpus.module_touches(spark, sf), ["batch"])


@query
def partition_file_issues(spark, sf):
    """The same conflicts per file, in slices of three issues."""
    slices = waves.file_issues(corpus.module_touches(spark, sf), ["batch"], 3)
    return slices.withColumn("issues", F.array_join(F.transform("issues", lambda i: i.cast("string")), ","))


@query
def partition_conflicts_of(spark, sf):
    asked = table(spark, sf, "orders").agg(F.max("o_orderkey"), F.min("o_orderkey")).first()
    return waves.conflicts_of(corpus.module_touches(spark, sf), list(asked), ["batch"])


@query
def partition_waves(spark, sf):
    return waves.waves(corpus.module_touches(spark, sf), ["batch"])


@query
def partition_independent_set(spark, sf):
    return waves.independent_set(waves.waves(corpus.module_touches(spark, sf), ["batch"]))


@query
def partition_plan(spark, sf):
    """What the whole plan of a customer's orders says of each: wave, files, shared files, warnings."""
    history = corpus.part_history(spark, sf)
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("issue"))
    touches = orders.join(history.withColumnRenamed("commit_id", "issue"), "issue")
    return waves.plan(touches, cochange.co_change_pairs(history), ["batch"])


@query
def partition_warnings(spark, sf):
    """All orders as one batch, over the parts that are often ordered together."""
    history = corpus.part_history(spark, sf)
    touches = history.withColumnRenamed("commit_id", "issue")
    return waves.coupling_warnings(touches, cochange.co_change_pairs(history))


# --- incremental index --------------------------------------------------------------------


def _labelled(spark, sf) -> DataFrame:
    """Documents with their labels: what an earlier index run had seen."""
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.join(labels, "doc_id", "left").select(
        F.lit(corpus.REPO).alias("repo_id"), F.lit("docs").alias("source"),
        F.concat(F.lit("docs/d"), F.col("doc_id"), F.lit(".md")).alias("file_path"),
        "text", "quality", "toxic",
    )


def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(now, stored): toxic documents are gone now, low quality ones were worded otherwise.

    Of those of high quality some have been emptied.
    """
    rows = _labelled(spark, sf)
    emptied = (F.col("quality") == 1) & (F.length("text") % 5 == 0)
    now = rows.where(F.coalesce(F.col("toxic"), F.lit(0)) == 0).withColumn(
        "text", F.when(emptied, F.lit(" \n")).otherwise(F.col("text"))
    )
    before = F.when(F.col("quality") == 0, F.concat("text", F.lit("\nearlier"))).otherwise(
        F.col("text")
    )
    stored = rows.where(F.col("quality").isNotNull()).withColumn("text", before)
    keys = ["repo_id", "source", "file_path", F.col("text").alias("content")]
    return now.select(*keys), stored.select(*keys)


@query
def dedup_changed_files(spark, sf):
    now, stored = (corpus.listing(f) for f in _snapshots(spark, sf))
    return incremental.changed_files(now, stored)


@query
def prune_deleted(spark, sf):
    now, stored = (corpus.listing(f) for f in _snapshots(spark, sf))
    return incremental.vanished_files(now, stored)


@query
def upsert_chunks(spark, sf):
    now, stored = _snapshots(spark, sf)
    now, stored = (f.withColumn("content_hash", content_hash(F.col("content"))) for f in (now, stored))
    kept = incremental.merged_files(now, stored).drop("content_hash", "status")
    return _digest(
        chunking.chunk_windows(kept, window=20, overlap=5), "repo_id", "source", "file_path"
    )


@query
def delete_file(spark, sf):
    _, stored = _snapshots(spark, sf)
    return incremental.delete_file(corpus.listing(stored), corpus.REPO, "docs", "docs/d7.md")


# --- change streams -----------------------------------------------------------------------


@query
def debounce_sessions(spark, sf):
    """Bursts of events of each type with pauses of at most ten minutes."""
    return change_bursts(table(spark, sf, "events"), "event_type", quiet_seconds=600)
