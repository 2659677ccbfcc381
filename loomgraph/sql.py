"""The questions of a workspace as table functions of Spark SQL: `SELECT * FROM search_code('…', 5)`.

Each is a temporary SQL function over the workspace's views, so its result can be filtered, joined and
grouped like any table, and Catalyst plans function and query as one. Only the embedding of the one
query text and the scores of vectors run in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.engine import Workspace
from loomgraph.functions.embedding import embed_query
from loomgraph.functions.text import glob_regex
from loomgraph.functions.vectors import EXACT_DIGITS, SCORE_DIGITS, as_matrix, unit_rows

#: Most rows a search gives, by source, and its default.
_LIMITS = {"code": (20, 5), "docs": (10, 3), "wiki": (10, 3), "memory": (10, 3)}
_COLUMNS = {
    "code": "chunk_index INT, chunk_text STRING, exports ARRAY<STRING>",
    "docs": "section STRING, chunk_text STRING",
    "wiki": "section STRING, chunk_text STRING",
    "memory": "name STRING, type STRING, chunk_text STRING",
}

_QUESTIONS = {
    "query_co_changes": """(file STRING, min_count INT DEFAULT 2) RETURNS TABLE (other STRING, count BIGINT) RETURN
SELECT CASE WHEN file_a = query_co_changes.file THEN file_b ELSE file_a END, count FROM co_changes
WHERE (file_a = query_co_changes.file OR file_b = query_co_changes.file) AND count >= query_co_changes.min_count""",
    # Direct edges with the names of the last import statement that has any; deeper levels are
    # `Workspace.query_dependencies`, which drops what it has seen after each level.
    "query_dependencies": """(path STRING) RETURNS TABLE (direction STRING, file STRING, names ARRAY<STRING>) RETURN
SELECT direction, file, max_by(names, stmt_pos) FILTER (WHERE size(names) > 0) FROM (
  SELECT 'imports' AS direction, target AS file, names, stmt_pos FROM import_edges
  WHERE source = query_dependencies.path AND target <> source
  UNION ALL SELECT 'importedBy', source, names, stmt_pos FROM import_edges
  WHERE target = query_dependencies.path AND target <> source)
GROUP BY direction, file""",
    "query_type_consumers": """(type_name STRING) RETURNS TABLE (role STRING, file STRING, kind STRING) RETURN
SELECT 'defined', file_path, min_by(kind, pos) FROM exports
WHERE name = query_type_consumers.type_name GROUP BY file_path
UNION ALL SELECT DISTINCT 'consumed', source, CAST(NULL AS STRING) FROM import_edges
WHERE array_contains(names, query_type_consumers.type_name)""",
    "query_symbol": """(symbol STRING) RETURNS TABLE (role STRING, kind STRING, id STRING, score DOUBLE) RETURN
WITH matched AS (
  SELECT id, kind FROM symbol_nodes WHERE id = query_symbol.symbol OR name = query_symbol.symbol)
SELECT 'match', kind, id, CAST(NULL AS DOUBLE) FROM matched
UNION ALL SELECT 'outgoing', kind, dst, NULL FROM symbol_edges LEFT SEMI JOIN matched ON src = id
UNION ALL SELECT 'incoming', kind, src, NULL FROM symbol_edges LEFT SEMI JOIN matched ON dst = id
UNION ALL SELECT 'neighbor', NULL, dst, score FROM semantic_edges LEFT SEMI JOIN matched ON src = id""",
}


def _search(source: str) -> str:
    """A search: the question is one row, whose vector and pattern are worked out once and sent round."""
    most, usual = _LIMITS[source]
    name, columns = f"search_{source}", _COLUMNS[source]
    named = ", ".join(c.split()[0] for c in columns.split(", "))
    extra = {"code": ", file_filter STRING DEFAULT NULL", "memory": ", type_filter STRING DEFAULT NULL"}.get(source, "")
    where = {
        "code": "(search_code.file_filter IS NULL OR file_path RLIKE q.pattern)",
        "memory": "(search_memory.type_filter IS NULL OR type = search_memory.type_filter)",
    }.get(source, "true")
    pattern = "glob_regex_of(search_code.file_filter)" if source == "code" else "''"
    return f"""(query STRING, k INT DEFAULT {usual}{extra})
RETURNS TABLE (file STRING, {columns}, score DOUBLE) RETURN
SELECT file_path, {named}, round(score, {SCORE_DIGITS}) FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, file_path, chunk_index) AS nth FROM (
    SELECT c.*, cosine_score(c.embedding, q.vector) AS score FROM chunks AS c,
      (SELECT embed_query_text({name}.query) AS vector, {pattern} AS pattern) AS q
    WHERE c.source = '{source}' AND {where})
  WHERE score IS NOT NULL)
WHERE nth <= if({name}.k BETWEEN 1 AND {most}, {name}.k, raise_error('k must be between 1 and {most}'))"""


def register_functions(space: Workspace) -> list[str]:
    """Make the workspace's views and the functions over them; returns the functions' names.

    They show the tables of the last build: call it again after the next one. `k` out of range is an
    error when the query runs. With a filter, `k` rows come back whenever that many pass it.
    """
    spark, config, provider = space.spark, space.embedding, space.provider
    space.register_views()

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed_query_text(texts: pa.Array) -> pa.Array:
        return pa.array([embed_query(t, config, provider) for t in texts.to_pylist()], pa.list_(pa.float64()))

    @F.arrow_udf(T.StringType())
    def glob_regex_of(globs: pa.Array) -> pa.Array:
        return pa.array([None if g is None else glob_regex(g) for g in globs.to_pylist()], pa.string())

    @F.arrow_udf(T.DoubleType())
    def cosine_score(vectors: pa.Array, queries: pa.Array) -> pa.Array:
        target = as_matrix(queries)
        scores = (unit_rows(as_matrix(vectors, target.shape[1])) * unit_rows(target)).sum(axis=1)
        return pa.array(np.round(scores, EXACT_DIGITS), pa.float64(), from_pandas=True)

    # Marked so that the one row of the question is worked out before it meets the chunks.
    spark.udf.register("embed_query_text", embed_query_text.asNondeterministic())
    spark.udf.register("glob_regex_of", glob_regex_of.asNondeterministic())
    spark.udf.register("cosine_score", cosine_score.asNondeterministic())
    made = {**{f"search_{source}": _search(source) for source in _LIMITS}, **_QUESTIONS}
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    pages = space.list_wiki_pages()
    pages.createOrReplaceTempView("wiki_pages")
    return list(made)
