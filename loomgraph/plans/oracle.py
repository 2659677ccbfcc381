"""DuckDB SQL that states each registered query's result on its own, from the raw tables.

Graph results come straight from the key columns, not from parsing the derived files, so they
check the extraction as well as the joins.
"""

from __future__ import annotations

_DOC_FILES = """
doc_lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
headed AS (
  SELECT doc_id, i, CASE WHEN i > 0 AND regexp_matches(line, '^[AEIOU]') THEN '## ' || line
                         ELSE line END AS line,
         sum(CASE WHEN i > 0 AND regexp_matches(line, '^[AEIOU]') THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id ORDER BY i) AS part
  FROM doc_lines),
doc_parts AS (
  SELECT doc_id, part, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10)) AS body,
         arg_min(line, i) AS head
  FROM headed GROUP BY doc_id, part),
doc_pieces AS (
  SELECT *, unnest(range(0, (length(body) + 3899) // 3900)) AS k FROM doc_parts WHERE body <> ''),
doc_chunks AS (
  SELECT 'docs/d' || doc_id || '.md' AS file_path,
         row_number() OVER (PARTITION BY doc_id ORDER BY part, k) - 1 AS chunk_index,
         CASE WHEN part = 0 THEN '(intro)' ELSE trim(substr(head, 4)) END AS section,
         substr(body, 3900 * k + 1, 3900) AS chunk_text
  FROM doc_pieces)
"""

_NOTES = """
note_bodies AS (
  SELECT *, CASE WHEN role = 'system' THEN text ELSE trim(text, ' ' || chr(10)) END AS body
  FROM conversations),
note_pieces AS (
  SELECT *, unnest(range(0, greatest(1, (length(body) + 3899) // 3900))) AS k FROM note_bodies),
note_chunks AS (
  SELECT 'c' || conv_id || '-t' || turn || '.md' AS file_path, k AS chunk_index,
         CASE WHEN role = 'system' THEN '' ELSE 'turn ' || turn END AS name,
         CASE WHEN role = 'system' THEN '' ELSE 'talk ' || conv_id END AS description,
         CASE role WHEN 'system' THEN '' WHEN 'assistant' THEN 'feedback' ELSE 'user' END AS type,
         substr(body, 3900 * k + 1, 3900) AS chunk_text
  FROM note_pieces)
"""

_WIKI = """
wiki_pages AS (
  SELECT page_id, '# Page ' || page_id || chr(10) || chr(10) || '**Summary**: Found at ' || url
    || chr(10) || chr(10) || '**Last updated**: 2024-01-15' || chr(10) || chr(10) || '---'
    || chr(10) || chr(10) || html AS intro,
    '## Related pages' || chr(10) || chr(10) || '- [[page-' || (page_id + 1) || ']]' || chr(10)
    || '- [[ page-' || (page_id + 2) || ' ]] and [[page-' || (page_id + 1) || ']]' AS related,
    url
  FROM pages),
wiki_intros AS (
  SELECT *, trim(intro, ' ' || chr(10)) AS body, (length(body) + 3899) // 3900 AS n FROM wiki_pages),
wiki_chunks AS (
  SELECT 'page-' || page_id || '.md' AS file_path, k AS chunk_index,
         substr(body, 3900 * k + 1, 3900) AS chunk_text
  FROM (SELECT *, unnest(range(0, n)) AS k FROM wiki_intros)
  UNION ALL
  SELECT 'page-' || page_id || '.md', n, related FROM wiki_intros)
"""

_CODE_FILES = """
code_paths AS (
  SELECT 'src/region/r' || r_regionkey || '.ts' AS file_path FROM region UNION ALL
  SELECT 'src/nation/n' || n_nationkey || '.ts' FROM nation UNION ALL
  SELECT 'src/customer/c' || c_custkey || '.ts' FROM customer UNION ALL
  SELECT 'src/supplier/s' || s_suppkey || '/index.ts' FROM supplier UNION ALL
  SELECT 'src/orders/o' || o_orderkey || '.tsx' FROM orders)
"""

_STATEMENTS = """
statements AS (
  SELECT 'src/nation/n' || n_nationkey || '.ts' AS file_path, 0 AS pos,
         '../region/r' || n_regionkey AS specifier, 'Region' || n_regionkey AS names,
         'src/region/r' || n_regionkey AS base, 'src/region/r' || n_regionkey || '.ts' AS target
  FROM nation UNION ALL
  SELECT 'src/customer/c' || c_custkey || '.ts', 0, '../nation/n' || c_nationkey || '.js',
         'Nation' || c_nationkey, 'src/nation/n' || c_nationkey || '.js',
         'src/nation/n' || c_nationkey || '.ts' FROM customer UNION ALL
  SELECT 'src/customer/c' || c_custkey || '.ts', 1, '../nation/n' || c_nationkey, 'Home',
         'src/nation/n' || c_nationkey, 'src/nation/n' || c_nationkey || '.ts' FROM customer
  UNION ALL
  SELECT 'src/supplier/s' || s_suppkey || '/index.ts', 0, '../../nation/n' || s_nationkey, '',
         'src/nation/n' || s_nationkey, 'src/nation/n' || s_nationkey || '.ts' FROM supplier
  UNION ALL
  SELECT 'src/orders/o' || o_orderkey || '.tsx', 0, 'react', 'React', NULL, NULL FROM orders
  UNION ALL
  SELECT 'src/orders/o' || o_orderkey || '.tsx', 1, './missing', '', 'src/orders/missing', NULL
  FROM orders UNION ALL
  SELECT 'src/orders/o' || o_orderkey || '.tsx', 2, '../customer/c' || o_custkey,
         'Customer' || o_custkey, 'src/customer/c' || o_custkey,
         'src/customer/c' || o_custkey || '.ts' FROM orders),
edges AS (
  SELECT file_path AS source, target, pos AS stmt_pos, names FROM statements
  WHERE target IN (SELECT file_path FROM code_paths)),
consumers AS (
  SELECT DISTINCT target AS def_file, names AS name, source AS consumer FROM edges
  WHERE names <> '')
"""

_SYMBOLS = """
nodes AS (
  SELECT 'src/region/r' || r_regionkey || '.ts' AS file, 'Region' || r_regionkey AS name,
         'enum' AS kind, 2 AS line FROM region UNION ALL
  SELECT 'src/nation/n' || n_nationkey || '.ts', 'Nation' || n_nationkey, 'interface', 3
  FROM nation UNION ALL
  SELECT 'src/customer/c' || c_custkey || '.ts', 'Customer' || c_custkey, 'class', 5
  FROM customer UNION ALL
  SELECT 'src/customer/c' || c_custkey || '.ts', 'Customer' || c_custkey || '.balance', 'method',
         8 FROM customer UNION ALL
  SELECT 'src/supplier/s' || s_suppkey || '/index.ts', 'supplier' || s_suppkey, 'variable', 2
  FROM supplier UNION ALL
  SELECT 'src/supplier/s' || s_suppkey || '/index.ts', 'Site' || s_suppkey, 'type', 3
  FROM supplier UNION ALL
  SELECT 'src/orders/o' || o_orderkey || '.tsx', 'Order' || o_orderkey, 'class', 5 FROM orders
  UNION ALL
  SELECT 'src/orders/o' || o_orderkey || '.tsx', 'Order' || o_orderkey || '.total', 'method', 6
  FROM orders UNION ALL
  SELECT 'src/orders/o' || o_orderkey || '.tsx', 'price' || o_orderkey, 'function', 9 FROM orders
  UNION ALL
  SELECT 'src/orders/o' || o_orderkey || '.tsx', 'open' || o_orderkey, 'function', 11 FROM orders),
symbol_nodes AS (SELECT file || '::' || name AS id, name, kind, file, line, 'ts' AS lang FROM nodes),
c_ids AS (
  SELECT c_custkey, c_nationkey,
         'src/customer/c' || c_custkey || '.ts::Customer' || c_custkey AS id,
         'src/nation/n' || c_nationkey || '.ts::Nation' || c_nationkey AS nation_id FROM customer),
symbol_edges AS (
  SELECT 'src/nation/n' || n_nationkey || '.ts::Nation' || n_nationkey AS src,
         'src/region/r' || n_regionkey || '.ts::Region' || n_regionkey AS dst,
         'uses-type' AS kind FROM nation UNION ALL
  SELECT id, nation_id, 'implements' FROM c_ids UNION ALL
  SELECT id, nation_id, 'uses-type' FROM c_ids UNION ALL
  SELECT 'src/supplier/s' || s_suppkey || '/index.ts::Site' || s_suppkey,
         'src/nation/n' || s_nationkey || '.ts::Nation' || s_nationkey, 'uses-type' FROM supplier
  UNION ALL
  SELECT 'src/orders/o' || o_orderkey || '.tsx::Order' || o_orderkey, id, 'extends'
  FROM orders JOIN c_ids ON o_custkey = c_custkey UNION ALL
  SELECT 'src/orders/o' || o_orderkey || '.tsx::Order' || o_orderkey || '.total',
         'src/orders/o' || o_orderkey || '.tsx::price' || o_orderkey, 'calls' FROM orders UNION ALL
  SELECT 'src/orders/o' || o_orderkey || '.tsx::open' || o_orderkey,
         'src/orders/o' || o_orderkey || '.tsx::Order' || o_orderkey, 'calls' FROM orders UNION ALL
  SELECT 'src/orders/o' || o_orderkey || '.tsx::open' || o_orderkey, id, 'uses-type'
  FROM orders JOIN c_ids ON o_custkey = c_custkey)
"""


def _overlay_above(least: float, top: int) -> str:
    return f"""
vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
scored AS (
  SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.v, b.v), 12) AS score
  FROM vec a JOIN vec b ON a.label <> b.label),
overlay AS (
  SELECT src, dst, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS n
    FROM scored WHERE score >= {least}) WHERE n <= {top})
"""


_OVERLAY = _overlay_above(0.3, 5)

_PART_PAIRS = """
history AS (
  SELECT DISTINCT l_orderkey AS commit_id, 'part/p' || l_partkey || '.ts' AS file FROM lineitem),
moderate AS (SELECT commit_id FROM history GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20),
pairs AS (
  SELECT a.file AS file_a, b.file AS file_b, count(*) AS count
  FROM history a JOIN history b ON a.commit_id = b.commit_id AND a.file < b.file
  WHERE a.commit_id IN (SELECT commit_id FROM moderate)
  GROUP BY 1, 2 HAVING count(*) >= 3)
"""

_MODULES = """
modules AS (
  SELECT DISTINCT l_orderkey AS commit_id, 'src/' || p_brand || '/' || p_type || '.ts' AS file
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""

_TOUCHES = (
    _MODULES
    + """,
touches AS (
  SELECT o_custkey AS batch, o_orderkey AS issue, file
  FROM orders JOIN modules ON o_orderkey = commit_id),
shared AS (
  SELECT a.batch, a.issue AS a, b.issue AS b, count(*) AS n_shared, min(a.file) AS first_shared
  FROM touches a JOIN touches b
    ON a.batch = b.batch AND a.file = b.file AND a.issue < b.issue
  GROUP BY 1, 2, 3)
"""
)

_WAVES = (
    _TOUCHES
    + """,
issues AS (
  SELECT batch, issue, row_number() OVER (PARTITION BY batch ORDER BY issue) AS rank
  FROM (SELECT DISTINCT batch, issue FROM touches)),
earlier AS (
  SELECT b.batch, b.rank, list(a.rank) AS ranks
  FROM shared s JOIN issues a ON s.batch = a.batch AND s.a = a.issue
  JOIN issues b ON s.batch = b.batch AND s.b = b.issue GROUP BY 1, 2),
colour(batch, rank, colours) AS (
  SELECT DISTINCT batch, 1::BIGINT, [0::BIGINT] FROM issues
  UNION ALL
  SELECT c.batch, i.rank, list_append(c.colours, list_filter(
           range(0, len(c.colours) + 1), lambda x: NOT list_contains(
             list_transform(coalesce(e.ranks, []), lambda r: c.colours[r]), x))[1])
  FROM colour c JOIN issues i ON i.batch = c.batch AND i.rank = c.rank + 1
  LEFT JOIN earlier e ON e.batch = i.batch AND e.rank = i.rank),
waves AS (
  SELECT i.batch, i.issue, c.colours[i.rank] AS wave
  FROM issues i JOIN colour c ON c.batch = i.batch AND c.rank = i.rank)
"""
)

#: The same for issues that touch the parts themselves, not their modules.
_PART_WAVES = _WAVES.replace(
    _MODULES,
    """
modules AS (SELECT DISTINCT l_orderkey AS commit_id, 'part/p' || l_partkey || '.ts' AS file FROM lineitem)
""",
)

_SNAPSHOTS = """
docs AS (
  SELECT 'sample' AS repo_id, 'docs' AS source, 'docs/d' || d.doc_id || '.md' AS file_path,
         text, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
now AS (
  SELECT * REPLACE (CASE WHEN quality = 1 AND len(text) % 5 = 0 THEN ' ' || chr(10) ELSE text END AS text)
  FROM docs WHERE coalesce(toxic, 0) = 0),
stored AS (
  SELECT repo_id, source, file_path,
         CASE WHEN quality = 0 THEN text || chr(10) || 'earlier' ELSE text END AS text
  FROM docs WHERE quality IS NOT NULL)
"""


def _windows(source: str, key: str) -> str:
    return f"""
split AS (SELECT {key}, string_split(text, chr(10)) AS l FROM {source}),
starts AS (SELECT {key}, l, unnest(range(0, len(l), 15)) AS s FROM split),
bodies AS (
  SELECT {key}, s, trim(array_to_string(l[s + 1 : s + 20], chr(10)), ' ' || chr(10)) AS t
  FROM starts),
pieces AS (
  SELECT {key}, s, k, substr(t, 3900 * k + 1, 3900) AS t
  FROM (SELECT *, unnest(range(0, (length(t) + 3899) // 3900)) AS k FROM bodies)),
windows AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY s, k) - 1 AS chunk_index,
         length(t) AS n_chars, sha256(t) AS chunk_hash
  FROM pieces)
"""


_WANTED = "SELECT 'where are the entries of the older index kept' AS w"


def _text_search(chunks: str, where: str = "true", wanted: str = _WANTED) -> str:
    return f"""
wanted AS (SELECT unnest(string_split(w, '')) AS c FROM ({wanted})),
q AS (SELECT b, sum(n) AS n FROM (
        SELECT ord(c) % 768 AS b, 1 AS n FROM wanted UNION ALL SELECT 0, 1) GROUP BY b),
chars AS (
  SELECT file_path, chunk_index, ord(c) % 768 AS b FROM (
    SELECT file_path, chunk_index, unnest(string_split(chunk_text, '')) AS c
    FROM {chunks} WHERE {where})
  UNION ALL SELECT file_path, chunk_index, 0 FROM {chunks} WHERE {where}),
bins AS (SELECT file_path, chunk_index, b, count(*) AS n FROM chars GROUP BY ALL),
hits AS (
  SELECT file_path, chunk_index,
         round(sum(bins.n * coalesce(q.n, 0)) / sqrt(sum(bins.n * bins.n))
               / (SELECT sqrt(sum(n * n)) FROM q), 10) AS s
  FROM bins LEFT JOIN q ON bins.b = q.b GROUP BY 1, 2)
SELECT file_path, chunk_index, round(s, 4) AS score FROM hits
ORDER BY s DESC, file_path, chunk_index LIMIT 10
"""


def _counts(chunks: str, source: str) -> str:
    return f"""
per_file AS (SELECT file_path, count(*) AS n FROM {chunks} GROUP BY 1)
SELECT '{source}' AS source,
       regexp_extract(file_path, '^((?:[^/]+/)*?[^/]+)/[^/]*[0-9]', 1) AS folder,
       count(*) AS n_files, sum(n)::BIGINT AS n_chunks
FROM per_file GROUP BY 1, 2
"""


_CODE_CHUNK_CHARS = """
code_chars AS (
  SELECT length('export enum Region' || r_regionkey || ' { Zone }') AS n FROM region UNION ALL
  SELECT length('export interface Nation' || n_nationkey || ' {' || chr(10) || '  region: Region'
    || n_regionkey || ';' || chr(10) || '}') FROM nation UNION ALL
  SELECT length('export class Customer' || c_custkey || ' implements Nation' || c_nationkey || ' {'
    || chr(10) || '  home?: Home;' || chr(10) || '  name = ''' || c_name || ''';' || chr(10)
    || '  balance(): number {' || chr(10) || '    return ' || c_acctbal || ';' || chr(10) || '  }'
    || chr(10) || '}') FROM customer UNION ALL
  SELECT length('export const supplier' || s_suppkey || ' = { name: ''' || s_name || ''' };'
    || chr(10) || 'export type Site' || s_suppkey || ' = places.Nation' || s_nationkey || ';')
  FROM supplier UNION ALL
  SELECT length('export class Order' || o_orderkey || ' extends Customer' || o_custkey || ' {'
    || chr(10) || '  total(): number { return price' || o_orderkey || '(' || o_totalprice
    || '); }' || chr(10) || '}' || chr(10) || 'function price' || o_orderkey
    || '(x: number) { return x; }' || chr(10) || 'export default function open' || o_orderkey
    || '(c: Customer' || o_custkey || ') {' || chr(10) || '  return new Order' || o_orderkey
    || '();' || chr(10) || '}') FROM orders)
"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts)


ORACLE: dict[str, str] = {
    "scan_filter_skip": """
SELECT DISTINCT file_path FROM (
  SELECT regexp_extract(url, '^https?://([^?#]*)', 1) AS file_path FROM pages)
WHERE (regexp_matches(file_path, '^[^./][^/]*(/[^./][^/]*)*/(en|fr)/[^./][^/]*$')
       OR regexp_matches(file_path, '^([^./][^/]*/)*[^./][^/]*[.]html$'))
  AND NOT contains(file_path, 'spam') AND NOT contains(file_path, '.net/')""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "chunk_sliding_window": _with(_windows("documents", "doc_id")) + " SELECT * FROM windows",
    "chunk_markdown": _with(_DOC_FILES)
    + """ SELECT file_path, section, chunk_index, length(chunk_text) AS n_chars,
 sha256(chunk_text) AS chunk_hash FROM doc_chunks""",
    "chunk_memory_frontmatter": _with(_NOTES)
    + """ SELECT file_path, name, description, type, chunk_index, length(chunk_text) AS n_chars,
 sha256(chunk_text) AS chunk_hash FROM note_chunks""",
    "chunk_pack_greedy": _with(
        """
nodes AS (
  SELECT doc_id, i, 'export function d' || doc_id || '_l' || i || '() {' || chr(10) || '  // '
         || line || chr(10) || '  return ' || i || ';' || chr(10) || '}' AS t
  FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
packed(doc_id, i, chunk_index, size) AS (
  SELECT doc_id, i, 0, length(t) FROM nodes WHERE i = 0
  UNION ALL
  SELECT n.doc_id, n.i,
         p.chunk_index + CASE WHEN p.size + length(n.t) > 3900 THEN 1 ELSE 0 END,
         CASE WHEN p.size + length(n.t) > 3900 THEN length(n.t)
              ELSE p.size + 1 + length(n.t) END
  FROM packed p JOIN nodes n ON n.doc_id = p.doc_id AND n.i = p.i + 1),
whole AS (
  SELECT doc_id, chunk_index, string_agg(t, chr(10) ORDER BY i) AS t, count(*) AS n_exports
  FROM packed JOIN nodes USING (doc_id, i) GROUP BY 1, 2),
chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, k) - 1 AS chunk_index,
         substr(t, 3900 * k + 1, 3900) AS t, n_exports
  FROM (SELECT *, unnest(range(0, (length(t) + 3899) // 3900)) AS k FROM whole))"""
    )
    + """ SELECT 'gen/d' || doc_id || '.ts' AS file_path, chunk_index, length(t) AS n_chars,
 sha256(t) AS chunk_hash, n_exports, CASE WHEN chunk_index = 0 THEN './base' ELSE '' END AS imports
 FROM chunks""",
    "index_code_counts": _with(_CODE_FILES, _counts("code_paths", "code")),
    "index_docs_counts": _with(_DOC_FILES, _counts("doc_chunks", "docs")),
    "index_memory_counts": _with(_NOTES, _counts("note_chunks", "memory")),
    "index_wiki_counts": _with(_WIKI, _counts("wiki_chunks", "wiki")),
    "chunk_counts": _with(_DOC_FILES, _NOTES, _WIKI, _CODE_CHUNK_CHARS)
    + """ SELECT 'sample' AS repo_id, source, count(*) AS n_chunks, sum(n)::BIGINT AS n_chars FROM (
  SELECT 'docs' AS source, length(chunk_text) AS n FROM doc_chunks UNION ALL
  SELECT 'memory', length(chunk_text) FROM note_chunks UNION ALL
  SELECT 'wiki', length(chunk_text) FROM wiki_chunks UNION ALL
  SELECT 'code', n FROM code_chars) GROUP BY 1, 2""",
    "wiki_list_pages": """
SELECT 'page-' || page_id AS name, 'Found at ' || url AS summary, '2024-01-15' AS last_updated
FROM pages""",
    "wiki_read_page": _with(_WIKI)
    + """ SELECT 'page-' || page_id AS name, 'Found at ' || url AS summary,
 '2024-01-15' AS last_updated,
 sha256(intro || chr(10) || chr(10) || related || chr(10)) AS content_hash,
 'page-' || (page_id + 1) || ',page-' || (page_id + 2) AS related_pages
 FROM wiki_pages WHERE page_id = 17""",
    "embed_prefix_truncate": """
WITH cases(model, mode, prefix) AS (VALUES
  ('nomic-embed-code', 'query', 'Represent this query for searching relevant code: '),
  ('nomic-embed-code', 'document', ''),
  ('nomic-embed-text:v1.5', 'query', 'search_query: '),
  ('nomic-embed-text:v1.5', 'document', 'search_document: '),
  ('my/Qwen3-Embedding-8B', 'query', 'Instruct: Given a search query, retrieve relevant code or documentation' || chr(10) || 'Query: '),
  ('my/Qwen3-Embedding-8B', 'document', ''), ('other', 'query', ''), ('other', 'document', ''))
SELECT doc_id, model, mode, length(substr(prefix || text, 1, 4000)) AS n_chars,
       sha256(substr(prefix || text, 1, 4000)) AS input_hash
FROM documents CROSS JOIN cases""",
    "embedding_dim_lookup": """
SELECT doc_id, CASE WHEN lang = 'en' THEN 3584 WHEN lang = 'fr' THEN 384
                    WHEN source < 'src2' THEN 1536 WHEN source < 'src5' THEN 3584
                    ELSE 768 END AS dim
FROM documents""",
    "fake_embedding": """
WITH chars AS (
  SELECT doc_id, ord(c) % 768 AS bin
  FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents)
  UNION ALL SELECT doc_id, 0 FROM documents),
bins AS (SELECT doc_id, bin, count(*) AS n FROM chars GROUP BY 1, 2)
SELECT doc_id, bin, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight
FROM bins""",
    "search_code": """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, label, 'label_' || label || '/v' || vec_id || '.ts' AS file_path,
       round(list_cosine_similarity(v, (SELECT v FROM v WHERE vec_id = 0)), 6) AS score
FROM v ORDER BY round(list_cosine_similarity(v, (SELECT v FROM v WHERE vec_id = 0)), 12) DESC, vec_id LIMIT 20""",
    "search_code_indexed": """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, label, 'label_' || label || '/v' || vec_id || '.ts' AS file_path,
       round(list_cosine_similarity(v, (SELECT v FROM v WHERE vec_id = 0)), 6) AS score
FROM v ORDER BY round(list_cosine_similarity(v, (SELECT v FROM v WHERE vec_id = 0)), 12) DESC, vec_id LIMIT 20""",
    "search_code_file_filter": """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, label, 'label_' || label || '/v' || vec_id || '.ts' AS file_path,
       round(list_cosine_similarity(v, (SELECT v FROM v WHERE vec_id = 0)), 6) AS score
FROM v WHERE label IN (3, 4)
ORDER BY round(list_cosine_similarity(v, (SELECT v FROM v WHERE vec_id = 0)), 12) DESC, vec_id LIMIT 20""",
    "search_docs": _with(_DOC_FILES, _text_search("doc_chunks")),
    "search_docs_tail": _with(
        _DOC_FILES,
        _text_search(
            "doc_chunks",
            wanted="SELECT right(text, 300) AS w FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1",
        ),
    ),
    "search_wiki": _with(_WIKI, _text_search("wiki_chunks")),
    "search_memory_type": _with(_NOTES, _text_search("note_chunks", "type = 'feedback'")),
    "cosine_pairs": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
    "symbol_overlay": """
WITH vec AS (
  SELECT 'f' || label AS file, list_transform(embedding, lambda x: x::DOUBLE) AS v,
         unnest(['s' || vec_id // 2, 's' || (vec_id + 100000)]) AS name FROM embeddings),
named AS (SELECT file || '::' || name AS id, file, v FROM vec WHERE name NOT LIKE '%7'),
scored AS (
  SELECT a.id AS src, b.id AS dst, max(round(list_cosine_similarity(a.v, b.v), 12)) AS score
  FROM named a JOIN named b ON a.file <> b.file GROUP BY 1, 2)
SELECT src, dst, round(score, 6) AS score FROM scored WHERE score >= 0.3
QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 3""",
    "search_code_scope": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
scored AS (
  SELECT vec_id, list_cosine_similarity(v, (SELECT v FROM v WHERE vec_id = 0)) AS s
  FROM v WHERE vec_id % 3 <> 0 AND vec_id % 2 = 0),
best AS (SELECT *, row_number() OVER (ORDER BY round(s, 12) DESC, vec_id) AS rank FROM scored)
SELECT vec_id, 'b' AS repo_id, 'code' AS source, round(s, 6) AS score, rank FROM best WHERE rank <= 15""",
    "touch_rows_trimmed": """
SELECT DISTINCT l_orderkey AS issue, 'p' || l_partkey % 50 AS file FROM lineitem WHERE l_linenumber < 4
UNION ALL SELECT l_orderkey, NULL FROM lineitem GROUP BY 1 HAVING min(l_linenumber) >= 4""",
    "reindex_unchanged": "SELECT 'docs' AS source, 'same' AS status, count(*) AS n_files FROM documents",
    "chunk_fallback": """
WITH bodies AS (
  SELECT 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.ts' END AS file_path,
         string_split('// ' || replace(text, chr(10), chr(10) || '// '), chr(10)) AS l FROM documents),
windows AS (
  SELECT file_path, s, trim(array_to_string(l[s + 1 : s + 200], chr(10)), ' ' || chr(10)) AS t
  FROM (SELECT *, unnest(range(0, len(l), 150)) AS s FROM bodies)),
pieces AS (
  SELECT file_path, s, k, substr(t, 3900 * k + 1, 3900) AS t
  FROM (SELECT *, unnest(range(0, (length(t) + 3899) // 3900)) AS k FROM windows))
SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY s, k) - 1 AS chunk_index,
       length(t) AS n_chars, sha256(t) AS chunk_hash FROM pieces""",
    "semantic_overlay": _with(_OVERLAY) + " SELECT src, dst, score FROM overlay",
    "semantic_overlay_low": _with(_overlay_above(-0.5, 3)) + " SELECT src, dst, score FROM overlay",
    "parse_commit_log": """
WITH files AS (
  SELECT doc_id, 0 AS commit_no, generate_subscripts(l, 1) AS i, unnest(l) AS file
  FROM (SELECT doc_id, string_split(trim(text, ' ' || chr(10)), chr(10)) AS l FROM documents)
  UNION ALL SELECT doc_id, 1, 1, source FROM documents
  UNION ALL SELECT doc_id, 1, 2, lang FROM documents)
SELECT doc_id, commit_no,
       row_number() OVER (PARTITION BY doc_id, commit_no ORDER BY i) - 1 AS file_pos,
       sha256(file) AS file_hash
FROM files WHERE trim(file) <> ''""",
    "commit_limit": """
SELECT doc_id, count(*) FILTER (WHERE trim(line) <> '') AS n_files, 0 AS last
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
GROUP BY doc_id HAVING n_files > 0""",
    "co_change_pairs": _with(_PART_PAIRS) + " SELECT file_a, file_b, count FROM pairs",
    "query_co_changes": _with(_MODULES)
    + """, moderate AS (
  SELECT commit_id FROM modules GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20)
SELECT b.file AS other, count(*) AS count
FROM modules a JOIN modules b ON a.commit_id = b.commit_id AND a.file <> b.file
WHERE a.file = 'src/Brand#2/ECONOMY.ts' AND a.commit_id IN (SELECT commit_id FROM moderate)
GROUP BY 1 HAVING count(*) >= 3""",
    "distinct_files": _with(_MODULES) + " SELECT DISTINCT file FROM modules",
    "import_extract": _with(_CODE_FILES, _STATEMENTS)
    + " SELECT file_path, pos, specifier, names FROM statements",
    "export_extract": _with(_SYMBOLS)
    + """ SELECT file AS file_path, name, kind FROM nodes
 WHERE kind <> 'method' AND name NOT LIKE 'price%'""",
    "import_heads_varied": """
WITH lines AS (
  SELECT 'gen/d' || doc_id || '/x.tsx' AS file_path, unnest(range(0, len(string_split(text, chr(10))))) AS i
  FROM documents)
SELECT file_path, 'import' AS what, 'gen/m' || i AS name, 'D' || i || ',b' || i || ',T' || i AS detail
FROM lines WHERE i % 7 = 0
UNION ALL SELECT file_path, 'import',
  'gen/' || split_part(file_path, '/', 2) || '/side' || i, '' FROM lines WHERE i % 7 = 1
UNION ALL SELECT file_path, 'export', 'v' || i, 'variable' FROM lines WHERE i % 7 = 2
UNION ALL SELECT file_path, 'export', 'f' || i, 'function' FROM lines WHERE i % 7 = 3
UNION ALL SELECT file_path, 'export', 'Y' || i, 'type' FROM lines WHERE i % 7 = 4
UNION ALL SELECT file_path, 'import',
  'gen/' || split_part(file_path, '/', 2) || '/it''s' || i, 'Q' FROM lines WHERE i % 7 = 5
UNION ALL SELECT file_path, 'export', 'w' || i, 'variable' FROM lines WHERE i % 7 = 6""",
    "import_resolve": _with(_CODE_FILES, _STATEMENTS)
    + """ SELECT DISTINCT base, target FROM statements
 WHERE target IN (SELECT file_path FROM code_paths)""",
    "import_edges": _with(_CODE_FILES, _STATEMENTS) + " SELECT * FROM edges",
    "reachable_from_many": _with(
        _CODE_FILES,
        _STATEMENTS,
        """walk(start, node, level) AS (
  SELECT file_path, file_path, 0 FROM code_paths
  WHERE file_path LIKE 'src/nation/%' OR file_path LIKE 'src/region/%'
  UNION
  SELECT w.start, e.source, w.level + 1 FROM walk w JOIN edges e ON e.target = w.node
  WHERE w.level < 40)""",
    )
    + " SELECT start, node, min(level) AS level FROM walk WHERE level > 0 GROUP BY 1, 2",
    "import_edges_updated": _with(_CODE_FILES, _STATEMENTS) + " SELECT * FROM edges",
    "import_edge_count": _with(_CODE_FILES, _STATEMENTS)
    + " SELECT count(*) AS n_edges FROM edges",
    "imported_by": _with(_CODE_FILES, _STATEMENTS) + " SELECT DISTINCT target, source FROM edges",
    "named_imports": _with(_CODE_FILES, _STATEMENTS)
    + """ SELECT source, target, arg_max(names, stmt_pos) AS names FROM edges
 WHERE names <> '' GROUP BY 1, 2""",
    "type_consumers": _with(_CODE_FILES, _STATEMENTS)
    + " SELECT DISTINCT name, consumer FROM consumers",
    "symbol_consumers": _with(_CODE_FILES, _STATEMENTS) + " SELECT * FROM consumers",
    "query_type_consumers": _with(_CODE_FILES, _STATEMENTS)
    + """ SELECT 'defined' AS role, 'src/nation/n3.ts' AS def_file, 'interface' AS kind,
 NULL::VARCHAR AS consumer FROM nation WHERE n_nationkey = 3
UNION ALL SELECT DISTINCT 'consumed', NULL, NULL, consumer FROM consumers WHERE name = 'Nation3'
UNION ALL SELECT 'qualified', def_file, NULL, consumer FROM consumers WHERE name = 'Nation3'""",
    "query_type_consumers_q": _with(_CODE_FILES, _STATEMENTS)
    + """ SELECT 'defined' AS role, 'src/nation/n3.ts' AS def_file, 'unknown' AS kind,
 NULL::VARCHAR AS consumer
UNION ALL SELECT 'consumed', NULL, NULL, consumer FROM consumers
 WHERE name = 'Nation3' AND def_file = 'src/nation/n3.ts'
UNION ALL SELECT 'qualified', def_file, NULL, consumer FROM consumers
 WHERE name = 'Nation3' AND def_file = 'src/nation/n3.ts'""",
    "transitive_deps": _with(
        _CODE_FILES,
        _STATEMENTS,
        """walk(node, level) AS (
  SELECT 'src/region/r0.ts', 0
  UNION ALL
  SELECT DISTINCT e.source, w.level + 1 FROM walk w JOIN edges e ON e.target = w.node
  WHERE w.level < 40)""",
    )
    + " SELECT node, min(level) AS level FROM walk WHERE level > 0 GROUP BY 1",
    "query_dependencies": _with(
        _CODE_FILES,
        _STATEMENTS,
        """hub AS (SELECT 'src/nation/n3.ts' AS f),
one AS (
  SELECT DISTINCT 'imports' AS direction, target AS file FROM edges JOIN hub ON source = f
  UNION ALL SELECT DISTINCT 'importedBy', source FROM edges JOIN hub ON target = f),
two AS (
  SELECT DISTINCT direction, CASE direction WHEN 'imports' THEN e.target ELSE e.source END AS file
  FROM one JOIN edges e ON (direction = 'imports' AND e.source = file)
    OR (direction = 'importedBy' AND e.target = file)),
direct AS (
  SELECT 'imports' AS direction, target AS file, arg_max(names, stmt_pos) AS names
  FROM edges JOIN hub ON source = f WHERE names <> '' GROUP BY 1, 2
  UNION ALL SELECT 'importedBy', source, arg_max(names, stmt_pos)
  FROM edges JOIN hub ON target = f WHERE names <> '' GROUP BY 1, 2)""",
    )
    + """ SELECT direction, file, level, names FROM (
  SELECT direction, file, 1 AS level FROM one UNION ALL
  SELECT direction, file, 2 FROM two ANTI JOIN one USING (direction, file)
  WHERE file <> 'src/nation/n3.ts')
LEFT JOIN direct USING (direction, file)""",
    "symbol_nodes": _with(_SYMBOLS) + " SELECT * FROM symbol_nodes",
    "symbol_edges_heritage": _with(_SYMBOLS)
    + " SELECT * FROM symbol_edges WHERE kind IN ('extends', 'implements')",
    "symbol_edges_calls": _with(_SYMBOLS) + " SELECT * FROM symbol_edges WHERE kind = 'calls'",
    "symbol_edges_uses": _with(_SYMBOLS) + " SELECT * FROM symbol_edges WHERE kind = 'uses-type'",
    "symbol_edges_valid": """
WITH raw AS (
  SELECT DISTINCT o_custkey AS a, o_orderkey % (o_custkey + 1) AS b FROM orders)
SELECT 'c' || a AS src, 'c' || b AS dst, 'references' AS kind FROM raw
WHERE a <> b AND a IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)
  AND b IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)""",
    "symbol_counts": _with(_SYMBOLS, _OVERLAY)
    + """ SELECT 'nodes' AS what, count(*) AS n FROM nodes
UNION ALL SELECT 'edges', count(*) FROM symbol_edges
UNION ALL SELECT 'semantic', count(*) FROM overlay""",
    "query_symbol_out": _with(_SYMBOLS)
    + """ SELECT e.kind, n.id, n.line FROM symbol_edges e JOIN symbol_nodes n ON e.dst = n.id
 WHERE e.src = 'src/orders/o7.tsx::open7'""",
    "query_symbol_in": _with(_SYMBOLS)
    + """ SELECT e.kind, n.id, n.kind AS node_kind, n.line
 FROM symbol_edges e JOIN symbol_nodes n ON e.src = n.id
 WHERE e.dst = 'src/nation/n3.ts::Nation3'""",
    "symbol_edges_grouped": _with(_SYMBOLS)
    + """ SELECT DISTINCT CASE kind WHEN 'implements' THEN 2 ELSE 3 END AS label_rank,
 CASE kind WHEN 'implements' THEN 'implemented by' ELSE 'used as type by' END AS label, src AS id
 FROM symbol_edges WHERE dst = 'src/nation/n3.ts::Nation3'""",
    "query_symbol_neighbors": _with(_OVERLAY)
    + """ SELECT dst::VARCHAR AS id, 'v' || dst AS name, label AS file, score
 FROM overlay JOIN embeddings ON dst = vec_id WHERE src = 3""",
    "build_report": _with(
        _CODE_FILES, _STATEMENTS, _SYMBOLS, _PART_PAIRS, _DOC_FILES, _NOTES, _WIKI
    )
    + """ SELECT 'code chunks' AS what, count(*) AS n FROM code_paths
UNION ALL SELECT 'docs chunks', count(*) FROM doc_chunks
UNION ALL SELECT 'memory chunks', count(*) FROM note_chunks
UNION ALL SELECT 'wiki chunks', count(*) FROM wiki_chunks
UNION ALL SELECT 'import edges', count(*) FROM edges
UNION ALL SELECT 'co-change pairs', count(*) FROM pairs
UNION ALL SELECT 'symbols', count(*) FROM nodes
UNION ALL SELECT 'symbol edges', count(*) FROM symbol_edges""",
    "partition_conflicts": _with(_TOUCHES)
    + " SELECT batch, a, b, 'both touch ' || first_shared AS reason FROM shared",
    "touch_set_intersect": _with(_TOUCHES) + " SELECT * FROM shared",
    "partition_file_issues": _with(_TOUCHES)
    + """, numbered AS (
  SELECT batch, file, issue, row_number() OVER (PARTITION BY batch, file ORDER BY issue) - 1 AS nth,
         count(*) OVER (PARTITION BY batch, file) AS n FROM touches)
SELECT batch, file, (nth // 3)::INTEGER AS slice, string_agg(issue, ',' ORDER BY issue) AS issues
FROM numbered WHERE n > 1 GROUP BY ALL""",
    "partition_conflicts_of": _with(_TOUCHES)
    + """ SELECT batch, asked AS issue, CASE WHEN a = asked THEN b ELSE a END AS other,
 'both touch ' || first_shared AS reason
FROM shared JOIN (SELECT unnest([min(o_orderkey), max(o_orderkey)]) AS asked FROM orders)
  ON a = asked OR b = asked""",
    "partition_waves": _with(_WAVES) + " SELECT * FROM waves",
    "partition_independent_set": _with(_WAVES)
    + " SELECT batch, issue FROM waves WHERE wave = 0",
    "partition_plan": _with(_PART_WAVES, _PART_PAIRS)
    + """, users AS (SELECT batch, file, count(*) AS n FROM touches GROUP BY 1, 2),
counted AS (
  SELECT batch, issue, count(*) AS n_files, count(*) FILTER (WHERE n > 1) AS n_shared_files
  FROM touches JOIN users USING (batch, file) GROUP BY 1, 2),
warned AS (
  SELECT t.batch, t.issue, count(*) AS n_warnings
  FROM touches t
  JOIN (SELECT file_a AS file, file_b AS other FROM pairs
        UNION ALL SELECT file_b, file_a FROM pairs) p ON t.file = p.file
  WHERE EXISTS (SELECT 1 FROM touches o WHERE o.batch = t.batch AND o.file = p.other AND o.issue <> t.issue)
  GROUP BY 1, 2)
SELECT batch, issue, wave, wave = 0 AS independent, n_files, n_shared_files, coalesce(n_warnings, 0) AS n_warnings
FROM waves JOIN counted USING (batch, issue) LEFT JOIN warned USING (batch, issue)""",
    "partition_warnings": _with(_PART_PAIRS)
    + """, both_ways AS (
  SELECT file_a AS file, file_b AS coupled_to, count FROM pairs
  UNION ALL SELECT file_b, file_a, count FROM pairs)
SELECT h.commit_id AS issue, h.file, p.coupled_to, p.count
FROM history h JOIN both_ways p ON h.file = p.file
WHERE EXISTS (SELECT 1 FROM history o WHERE o.file = p.coupled_to AND o.commit_id <> h.commit_id)""",
    "dedup_changed_files": _with(_SNAPSHOTS)
    + """ SELECT repo_id, source, file_path, sha256(text) AS content_hash FROM now
 WHERE (file_path, sha256(text)) NOT IN (SELECT (file_path, sha256(text)) FROM stored)""",
    "prune_deleted": _with(_SNAPSHOTS)
    + """ SELECT repo_id, source, file_path, sha256(text) AS content_hash FROM stored
 WHERE file_path NOT IN (SELECT file_path FROM now)""",
    "upsert_chunks": _with(_SNAPSHOTS, _windows("now", "file_path"))
    + " SELECT 'sample' AS repo_id, 'docs' AS source, * FROM windows",
    "delete_file": _with(_SNAPSHOTS)
    + """ SELECT repo_id, source, file_path, sha256(text) AS content_hash FROM stored
 WHERE file_path <> 'docs/d7.md'""",
    "debounce_sessions": """
WITH gaps AS (
  SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END
    AS opens FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
numbered AS (
  SELECT event_type, ts, sum(opens) OVER (PARTITION BY event_type ORDER BY ts
    ROWS UNBOUNDED PRECEDING) AS burst FROM gaps)
SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events
FROM numbered GROUP BY event_type, burst""",
}
