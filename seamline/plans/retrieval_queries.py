"""Queries of the retrieval engine over the supplied tables, with their SQL.

The SQL is one chain of common table expressions in the order of the stages;
each query selects from one of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate
from ..session import table
from .retrieve import DIMS, TABLES, Retrieval

# The stated query set: (query_id, repo_id, mode, text, limit).
QUERY_SET = [
    (1, 17, "understand", "How does the snapshot resolver hydrate deferred queues, and what do the docs say about it", 12),
    (2, 17, "bugfix", "Fix the test coverage of the checksum scanner when retry settings expire", 10),
    (3, 6, "refactor", "Refactor the ledger router and its provider config", 12),
    (4, 3, "docs", "Which decision or runbook explains the architecture of the packer cluster", 12),
    (5, 9, "testgen", "Generate tests for the ticket planner module", 8),
    (6, 1, "architecture", "prior incident and decision history around leases and quota gateways", 12),
]
# Gold of the query set: files, symbols and memories that carry the word.
GOLD = {1: "snapshot", 2: "scanner", 3: "ledger", 4: "packer", 5: "ticket", 6: "lease"}

_cache: dict = {}


def retrieval(spark, d) -> Retrieval:
    """The stages of the query set over the tables of ``d``; kept for the queries that follow in the same
    application as long as the tables' files are the same ones."""
    files = tuple(sorted(f for n in TABLES for f in table(spark, d, n).inputFiles()))
    key = (spark.sparkContext.applicationId, d, files)
    if key not in _cache:
        _cache.clear()
        _cache[key] = Retrieval.over(spark, d, QUERY_SET)
    return _cache[key]


def forget() -> None:
    """Drop what ``retrieval`` keeps."""
    _cache.clear()


# What follows from each query by the fixed weights, mixes and limits, spelled here once more:
# query, repository, mode, text, limit; weights of lexical, graph, semantic and memory signals; whether the text is about
# documents, configuration, tests, history, "config"; code, test, doc and config files to select and to pack; selected
# files, symbols and memories; packed symbols and memories.
_QUERY_VALUES = """(1, 17, 'understand', 'How does the snapshot resolver hydrate deferred queues, and what do the docs say about it', 12, 1.0, 0.7, 0.8, 0.7, true, false, false, false, false, 3, 1, 2, 1, 2, 1, 3, 1, 12, 6, 2, 5, 2),
 (2, 17, 'bugfix', 'Fix the test coverage of the checksum scanner when retry settings expire', 10, 1.0, 0.8, 0.8, 0.8, false, true, true, false, false, 4, 2, 1, 2, 4, 2, 1, 1, 10, 6, 2, 6, 2),
 (3, 6, 'refactor', 'Refactor the ledger router and its provider config', 12, 0.8, 1.0, 0.7, 0.9, false, true, false, false, true, 4, 2, 1, 2, 4, 2, 1, 1, 12, 6, 3, 6, 3),
 (4, 3, 'docs', 'Which decision or runbook explains the architecture of the packer cluster', 12, 0.8, 0.4, 0.8, 0.9, true, false, false, true, false, 2, 1, 3, 2, 2, 1, 3, 2, 12, 6, 3, 4, 3),
 (5, 9, 'testgen', 'Generate tests for the ticket planner module', 8, 0.7, 1.0, 0.6, 0.3, false, false, true, false, false, 4, 2, 1, 1, 4, 2, 1, 1, 8, 6, 2, 6, 2),
 (6, 1, 'architecture', 'prior incident and decision history around leases and quota gateways', 12, 0.7, 0.9, 0.8, 1.0, true, false, false, true, false, 2, 0, 3, 1, 2, 0, 3, 1, 12, 6, 3, 4, 3)"""


_WORDS = r"regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+')"
# Spelled here once more, so that the SQL does not share the constant it is to prove.
_STOP = """'about', 'after', 'also', 'and', 'are', 'because', 'been', 'before', 'but', 'can', 'could', 'does', 'for', 'from', 'had', 'has', 'have', 'how', 'into',
 'not', 'our', 'out', 'same', 'should', 'than', 'that', 'the', 'then', 'there', 'these', 'this', 'when', 'where', 'which', 'while', 'with', 'would', 'you'"""
_FILES = """
files_now AS (SELECT id, repo_id, path, language, checksum, summary, imports, tags, indexed_at, map_extract_value(metadata_json, 'content_excerpt') AS excerpt,
    coalesce(list_contains(tags, 'test'), false) OR coalesce(path LIKE 'tests/%', false) OR coalesce(contains(path, '/test'), false) AS is_test,
    coalesce(path LIKE 'docs/%', false) OR coalesce(language = 'markdown', false) AS is_doc,
    coalesce(path LIKE 'config/%', false) OR coalesce(language IN ('toml', 'yaml', 'json'), false) AS is_config,
    coalesce(language IN ('python', 'typescript', 'javascript'), false) AS is_code
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, checksum DESC NULLS LAST) AS n FROM files WHERE id IS NOT NULL) WHERE n = 1),
syms AS (SELECT * FROM (SELECT id, repo_id, file_id, parent_symbol_id, name, qualified_name, lower(trim(symbol_type)) AS symbol_type, language, line_start, line_end, signature, docstring, summary, row_number() OVER (PARTITION BY id) AS n FROM symbols) WHERE n = 1),
mems AS (SELECT * FROM (SELECT id, repo_id, title, content, summary, memory_type, lower(trim(status)) AS status, source, confidence, created_at, updated_at, row_number() OVER (PARTITION BY id) AS n FROM memories) WHERE n = 1),
edg AS (SELECT * FROM (SELECT id, repo_id, CASE WHEN lower(trim(from_node_kind)) = 'doc' THEN 'file' ELSE lower(trim(from_node_kind)) END AS fk, from_node_id AS fid,
    CASE WHEN lower(trim(to_node_kind)) = 'doc' THEN 'file' ELSE lower(trim(to_node_kind)) END AS tk, to_node_id AS tid, upper(trim(edge_type)) AS edge_type, weight, row_number() OVER (PARTITION BY id) AS n FROM edges) WHERE n = 1),
vecs AS (SELECT * FROM (SELECT id, repo_id, CASE WHEN lower(trim(node_kind)) = 'doc' THEN 'file' ELSE lower(trim(node_kind)) END AS node_kind, node_id, embedding_role, model_name, dimensions, vector, content_preview, row_number() OVER (PARTITION BY id) AS n FROM node_embeddings) WHERE n = 1)"""
BASE = "WITH " + _FILES.strip()

_CHAIN = (
    BASE
    + f""",
q0 AS (SELECT * FROM (VALUES {_QUERY_VALUES}) t(query_id, repo_id, mode, text, lim, wl, wg, ws, wm, doc, config, test, history, about_config, s_code, s_test, s_doc, s_config, p_code, p_test, p_doc, p_config, q_files, q_symbols, q_memories, p_symbols, p_memories)),
q1 AS (SELECT *, list_filter({_WORDS.format('text')}, lambda t: length(t) >= 3) AS rterms FROM q0),
q2 AS (SELECT *, list_filter(rterms, lambda t: t NOT IN ({_STOP}))[1:80] AS b0 FROM q1),
q3 AS (SELECT *, CASE WHEN len(b0) > 0 THEN b0 ELSE [lower(text)] END AS base FROM q2),
q AS (SELECT *, list_distinct(list_filter(flatten(list_transform(base, lambda t: [t,
      CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' END,
      CASE WHEN t LIKE '%s' AND length(t) > 4 THEN left(t, length(t) - 1) ELSE t || 's' END,
      CASE WHEN t LIKE '%ing' AND length(t) > 5 THEN left(t, length(t) - 3) END,
      CASE WHEN t LIKE '%ed' AND length(t) > 4 THEN left(t, length(t) - 2) END])), lambda t: t IS NOT NULL AND length(t) >= 3)) AS terms,
    list_distinct(list_filter(list_concat(rterms, flatten(list_transform(range(1, len(rterms)), lambda i: [rterms[i] || '_' || rterms[i + 1], rterms[i] || rterms[i + 1]])),
      flatten(list_transform(range(1, greatest(len(rterms) - 1, 1)), lambda i: [rterms[i] || '_' || rterms[i + 1] || '_' || rterms[i + 2], rterms[i] || rterms[i + 1] || rterms[i + 2]]))), lambda a: length(a) >= 3)) AS aliases
  FROM q3),
lf0 AS (SELECT q.query_id, q.lim, f.id, f.path, f.is_test OR f.is_doc OR f.is_config AS is_support, lower(f.path) AS p, lower(coalesce(f.summary, '')) AS s, regexp_extract(lower(f.path), '[^/]*$') AS b, q.terms FROM files_now f JOIN q ON q.repo_id = f.repo_id),
lf1 AS (SELECT *, list_sum(list_transform(terms, lambda t: CASE WHEN contains(p, t) THEN CASE WHEN starts_with(b, t) THEN 6 ELSE 4 END ELSE 0 END + CASE WHEN contains(s, t) THEN 3 ELSE 0 END + CASE WHEN contains('/' || p || '/', '/' || t || '/') THEN 2 ELSE 0 END)) AS score FROM lf0),
lf AS (SELECT query_id, rank, id, score, path, is_support FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path DESC, id DESC) AS rank FROM lf1 WHERE score > 0) WHERE rank <= lim),
ls0 AS (SELECT q.query_id, q.lim, s.id, s.file_id, s.name, coalesce(nullif(s.qualified_name, ''), s.name) AS label, lower(coalesce(s.name, '')) AS n, lower(coalesce(s.qualified_name, '')) AS u, lower(coalesce(s.summary, '')) AS m, lower(coalesce(s.docstring, '')) AS d, q.terms FROM syms s JOIN q ON q.repo_id = s.repo_id),
ls1 AS (SELECT *, list_sum(list_transform(terms, lambda t: CASE WHEN n = t THEN 10 ELSE 0 END + CASE WHEN contains(n, t) THEN 7 ELSE 0 END + CASE WHEN contains(u, t) THEN 5 ELSE 0 END + CASE WHEN contains(m, t) THEN 3 ELSE 0 END + CASE WHEN contains(d, t) THEN 2 ELSE 0 END)) AS score FROM ls0),
ls AS (SELECT query_id, rank, id, score, file_id, name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label DESC, id DESC) AS rank FROM ls1 WHERE score > 0) WHERE rank <= lim),
lm0 AS (SELECT q.query_id, q.lim, m.id, coalesce(m.title, '') AS title, m.status, lower(coalesce(m.title, '')) AS t0, lower(coalesce(m.summary, '')) AS s, lower(coalesce(m.content, '')) AS c, q.terms FROM mems m JOIN q ON q.repo_id = m.repo_id OR m.repo_id IS NULL),
lm1 AS (SELECT *, list_sum(list_transform(terms, lambda t: CASE WHEN contains(t0, t) THEN 7 ELSE 0 END + CASE WHEN contains(s, t) THEN 4 ELSE 0 END + CASE WHEN contains(c, t) THEN 2 ELSE 0 END)) AS score FROM lm0),
lm AS (SELECT query_id, rank, id, score, title, status FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title DESC, id DESC) AS rank FROM lm1 WHERE score > 0) WHERE rank <= lim),
sig_lex AS (
  SELECT query_id, 'file' AS kind, id, 'lexical' AS stage, 1 * 10000000000000 + rank * 1000000000 AS seq, 10 * wl AS points, 'lexical match on path or summary' AS reason, true AS firm FROM lf JOIN q USING (query_id)
  UNION ALL SELECT query_id, 'symbol', id, 'lexical', 2 * 10000000000000 + rank * 1000000000, 14 * wl, 'lexical match on symbol metadata', true FROM ls JOIN q USING (query_id)
  UNION ALL SELECT query_id, 'file', file_id, NULL, 2 * 10000000000000 + rank * 1000000000 + 1, 7 * wg, 'file contains matched symbol', false FROM ls JOIN q USING (query_id) WHERE file_id IS NOT NULL
  UNION ALL SELECT query_id, 'memory', id, 'lexical', 3 * 10000000000000 + rank * 1000000000, 8 * wm, 'memory text matched query', true FROM lm JOIN q USING (query_id) WHERE status = 'active'),
prim AS (SELECT query_id, id FROM lf UNION SELECT query_id, file_id FROM ls),
mods AS (SELECT p.query_id, replace(regexp_replace(f.path, '\\.py$', ''), '/', '.') AS modkey FROM prim p JOIN files_now f USING (id)),
cand AS (SELECT query_id, unnest(rterms) AS t FROM q UNION SELECT query_id, lower(x) FROM (SELECT query_id, unnest(regexp_split_to_array(name, '[^\\p{{L}}\\p{{N}}]+')) AS x FROM ls) WHERE length(x) >= 3),
x0 AS (SELECT q.query_id, q.repo_id, q.mode, q.wg, q.wm, q.doc, q.config, q.test, q.history, (SELECT list(t) FROM cand c WHERE c.query_id = q.query_id) AS candidates, coalesce((SELECT list(modkey) FROM mods m WHERE m.query_id = q.query_id), []) AS modules FROM q),
sf0 AS (SELECT x.*, f.id, f.is_test, f.is_doc, f.is_config, lower(coalesce(f.path, '') || ' ' || coalesce(f.summary, '')) AS txt, coalesce(list_has_any(f.imports, x.modules), false) AS imports_primary
  FROM files_now f JOIN x0 x ON x.repo_id = f.repo_id WHERE NOT EXISTS (SELECT 1 FROM prim p WHERE p.query_id = x.query_id AND p.id = f.id)),
sf1 AS (SELECT *, len(list_filter(candidates, lambda t: contains(txt, t))) AS overlap FROM sf0),
sf2 AS (SELECT *, is_test AND (imports_primary OR overlap > 0) AND mode IN ('understand', 'refactor', 'bugfix', 'testgen') AS as_test FROM sf1),
sf AS (SELECT query_id, id, wg * CASE WHEN as_test THEN CASE WHEN test THEN 14 ELSE 12 END WHEN is_doc AND overlap > 0 THEN CASE WHEN doc THEN 6 WHEN overlap >= 2 OR config THEN 4 ELSE 2.5 END WHEN is_config AND overlap > 0 THEN CASE WHEN config THEN 6 ELSE 5 END END AS points,
    CASE WHEN as_test THEN 'related test expansion' WHEN is_doc AND overlap > 0 THEN 'related documentation expansion' ELSE 'related config expansion' END AS reason FROM sf2 WHERE as_test OR overlap > 0 AND (is_doc OR is_config)),
sm AS (SELECT x.query_id, m.id, x.wm * CASE WHEN x.history THEN 6 ELSE 4 END AS points FROM mems m JOIN x0 x ON x.repo_id = m.repo_id OR m.repo_id IS NULL
  WHERE m.status = 'active' AND len(list_filter(x.candidates, lambda t: contains(lower(coalesce(m.title, '') || ' ' || coalesce(m.summary, '') || ' ' || coalesce(m.content, '')), t))) > 0),
sig_sup AS (
  SELECT query_id, 'file' AS kind, id, 'support' AS stage, 4 * 10000000000000 + id AS seq, points, reason, false AS firm FROM sf
  UNION ALL SELECT query_id, 'memory', id, 'support', 5 * 10000000000000 + id, points, 'memory expansion from related task context', false FROM sm),
seeds AS (
  SELECT query_id * 100 + rank AS sid, query_id, 'symbol' AS source, rank AS nth, 'symbol' AS nk, id AS nid, ['FILE_CONTAINS_SYMBOL', 'TEST_COVERS_SYMBOL', 'DOC_DESCRIBES_SYMBOL', 'DOC_DESCRIBES_FILE', 'CONFIG_AFFECTS_FILE', 'APPLIES_TO'] AS types, lim, CASE WHEN mode = 'refactor' THEN 2 ELSE 1 END AS hops FROM ls JOIN q USING (query_id) WHERE rank <= 4
  UNION ALL SELECT query_id * 100 + 10 + rank, query_id, 'file', rank, 'file', id, ['FILE_IMPORTS_FILE', 'FILE_CONTAINS_SYMBOL', 'TEST_COVERS_SYMBOL', 'DOC_DESCRIBES_SYMBOL', 'DOC_DESCRIBES_FILE', 'CONFIG_AFFECTS_FILE', 'APPLIES_TO'], lim, CASE WHEN is_support THEN 2 ELSE 1 END FROM lf JOIN q USING (query_id) WHERE rank <= 3
  UNION ALL SELECT query_id * 100 + 20 + r, query_id, 'memory', r, 'memory', id, ['APPLIES_TO', 'CONSTRAINS', 'WARNS_ABOUT', 'IMPLEMENTED_BY', 'FILE_CONTAINS_SYMBOL'], lim, 2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM lm WHERE status = 'active') JOIN q USING (query_id) WHERE r <= 3),
both_ways AS (SELECT id, edge_type, fk AS nk, fid AS nid, tk AS ok, tid AS oid FROM edg WHERE tid IS NOT NULL UNION ALL SELECT id, edge_type, tk, tid, fk, fid FROM edg WHERE fid IS NOT NULL AND NOT (fk IS NOT DISTINCT FROM tk AND fid IS NOT DISTINCT FROM tid)),
h1a AS (SELECT * FROM (SELECT s.sid, s.nk AS sk, s.nid AS snid, s.types, s.lim, s.hops, b.ok, b.oid, b.edge_type, row_number() OVER (PARTITION BY s.sid ORDER BY b.id) AS nth FROM seeds s JOIN both_ways b ON b.nk = s.nk AND b.nid = s.nid AND list_contains(s.types, b.edge_type)) WHERE nth <= lim),
h1b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, ok, oid ORDER BY nth) AS pick FROM h1a WHERE NOT (ok = sk AND oid = snid)) WHERE pick = 1),
h1 AS (SELECT sid, sk, snid, types, lim, hops, ok AS kind, oid AS id, edge_type AS t1, row_number() OVER (PARTITION BY sid ORDER BY nth) AS d, count(*) OVER (PARTITION BY sid) AS n1 FROM h1b),
h2a AS (SELECT * FROM (SELECT p.sid, p.sk, p.snid, p.lim, p.d, p.n1, p.t1, b.ok, b.oid, b.edge_type, row_number() OVER (PARTITION BY p.sid, p.kind, p.id ORDER BY b.id) AS nth FROM h1 p JOIN both_ways b ON b.nk = p.kind AND b.nid = p.id AND list_contains(p.types, b.edge_type) WHERE p.hops >= 2) WHERE nth <= lim),
h2b AS (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.sid, a.ok, a.oid ORDER BY a.d, a.nth) AS pick FROM h2a a WHERE NOT (a.ok = a.sk AND a.oid = a.snid) AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.sid = a.sid AND h1.kind = a.ok AND h1.id = a.oid)) WHERE pick = 1),
h2c AS (SELECT *, n1 + (SELECT count(*) FROM h2b y WHERE y.sid = h2b.sid AND y.d < h2b.d) AS found FROM h2b),
found AS (
  SELECT sid, kind, id, 1 AS hops, [t1] AS path, d AS ord FROM h1
  UNION ALL SELECT sid, ok, oid, 2, [t1, edge_type], n1 + row_number() OVER (PARTITION BY sid ORDER BY d, nth) FROM h2c WHERE found < lim),
gh0 AS (SELECT s.query_id, s.source, s.nth, f.kind, f.id, f.hops, f.path, f.ord, q.mode, q.wg, q.doc, q.about_config, f.path[len(f.path)] AS last FROM found f JOIN seeds s USING (sid) JOIN q ON q.query_id = s.query_id),
gh AS (SELECT *, wg * greatest(1.0, CASE WHEN last = 'TEST_COVERS_SYMBOL' THEN CASE WHEN mode IN ('refactor', 'bugfix', 'testgen') THEN 8.0 ELSE 6.0 END WHEN last = 'FILE_CONTAINS_SYMBOL' THEN 5.5 WHEN last IN ('FILE_IMPORTS_FILE', 'APPLIES_TO') THEN 5.0
    WHEN last = 'DOC_DESCRIBES_FILE' THEN CASE WHEN mode IN ('docs', 'architecture') OR doc OR about_config THEN 5.5 ELSE 3.0 END WHEN last = 'DOC_DESCRIBES_SYMBOL' THEN CASE WHEN mode IN ('docs', 'architecture') OR doc THEN 5.0 ELSE 2.0 END ELSE 3.0 END - (hops - 1)) AS points FROM gh0),
promo AS (SELECT g.query_id, g.source, g.nth, g.ord, s.file_id, g.wg * CASE g.source WHEN 'file' THEN CASE mode WHEN 'docs' THEN 2.5 WHEN 'architecture' THEN 3.0 WHEN 'understand' THEN 4.0 ELSE 6.0 END WHEN 'memory' THEN CASE mode WHEN 'docs' THEN 2.5 WHEN 'architecture' THEN 3.5 ELSE 5.0 END ELSE CASE WHEN mode IN ('docs', 'architecture') THEN 4.0 ELSE 6.0 END END AS points,
    CASE g.source WHEN 'file' THEN 'owner file promoted from support artifact graph expansion' WHEN 'memory' THEN 'owner file promoted from memory link' ELSE 'owner file promoted from graph symbol expansion' END AS reason
  FROM gh g JOIN syms s ON s.id = g.id WHERE g.kind = 'symbol' AND s.file_id IS NOT NULL),
sig_graph AS (
  SELECT query_id, kind, id, 'graph' AS stage, CASE source WHEN 'symbol' THEN 6 WHEN 'file' THEN 7 ELSE 8 END * 10000000000000 + nth * 1000000000 + ord * 2 AS seq, points, CASE WHEN source = 'memory' THEN 'memory ' ELSE '' END || 'graph expansion via ' || array_to_string(path, ' > ') AS reason, source = 'symbol' AS firm FROM gh
  UNION ALL SELECT query_id, 'file', file_id, 'graph', CASE source WHEN 'symbol' THEN 6 WHEN 'file' THEN 7 ELSE 8 END * 10000000000000 + nth * 1000000000 + ord * 2 + 1, points, reason, false FROM promo),
tok AS (SELECT query_id, t, count(*) AS n FROM (SELECT query_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS t FROM q) WHERE t <> '' GROUP BY ALL),
buck AS (SELECT query_id, ('0x' || sha256(t)[1:2])::INT % {DIMS} AS b, sum(CASE WHEN ('0x' || sha256(t)[3:4])::INT % 2 = 1 THEN -n ELSE n END)::DOUBLE AS x FROM tok GROUP BY ALL),
asked AS (SELECT query_id, list_transform(range({DIMS}), lambda i: coalesce(map_extract_value(m, i), 0::DOUBLE) / CASE WHEN norm = 0 THEN 1 ELSE norm END) AS asked FROM (SELECT query_id, map_from_entries(list((b::BIGINT, x))) AS m, sqrt(sum(x * x)) AS norm FROM buck GROUP BY query_id)),
sem0 AS (SELECT * FROM (SELECT q.query_id, q.lim, v.*, row_number() OVER (PARTITION BY q.query_id ORDER BY v.id) AS nth FROM vecs v JOIN q ON q.repo_id = v.repo_id) WHERE nth <= lim * 8),
sem AS (SELECT * FROM (SELECT s.query_id, s.nth, s.node_kind AS kind, s.node_id AS id, list_sum(list_transform(range(1, least(len(a.asked), len(s.vector)) + 1), lambda i: a.asked[i] * s.vector[i]::DOUBLE)) AS sim FROM sem0 s JOIN asked a USING (query_id) WHERE s.vector IS NOT NULL) WHERE sim > 0),
sig_sem AS (SELECT query_id, kind, id, 'semantic' AS stage, 9 * 10000000000000 + nth AS seq, sim * 10 * ws AS points, 'semantic similarity to query' AS reason, false AS firm FROM sem JOIN q USING (query_id)),
sig1 AS (SELECT * FROM sig_lex UNION ALL SELECT * FROM sig_sup UNION ALL SELECT * FROM sig_graph UNION ALL SELECT * FROM sig_sem),
rr0 AS (SELECT DISTINCT s.query_id, f.* FROM sig1 s JOIN files_now f ON f.id = s.id WHERE s.kind = 'file'),
rr1 AS (SELECT r.*, r.is_test OR r.is_doc OR r.is_config AS is_support, q.mode, q.doc, q.config, q.test, len(list_filter(q.rterms, lambda t: contains(lower(coalesce(r.path, '')), t) OR contains(lower(coalesce(r.summary, '')), t))) AS m FROM rr0 r JOIN q USING (query_id)),
rr AS (SELECT query_id, id, least(m, 3) * CASE WHEN is_support THEN 1.0 ELSE 0.4 END + CASE WHEN is_doc THEN CASE WHEN doc OR mode IN ('docs', 'architecture') THEN 4.0 + least(m, 2) WHEN m > 0 THEN 2.0 ELSE 0 END ELSE 0 END
    + CASE WHEN is_doc AND contains(lower(path), 'readme') AND mode IN ('understand', 'docs', 'architecture') THEN 1.5 ELSE 0 END
    + CASE WHEN is_config THEN CASE WHEN config THEN 4.5 + least(m, 2) WHEN mode IN ('docs', 'architecture') THEN 2.0 WHEN m >= 2 THEN 1.5 ELSE 0 END ELSE 0 END
    + CASE WHEN is_test THEN CASE WHEN test THEN 2.5 WHEN mode IN ('refactor', 'bugfix', 'testgen') THEN 2.0 ELSE 0 END ELSE 0 END AS bonus FROM rr1),
sig_rr AS (SELECT query_id, 'file' AS kind, id, NULL AS stage, 10 * 10000000000000 + id AS seq, bonus AS points, 'final support-file reranking' AS reason, false AS firm FROM rr WHERE bonus > 0),
sc2 AS (SELECT query_id, kind, id, round(sum(points), 6) AS score, min(seq) AS first_seq FROM (SELECT * FROM sig1 UNION ALL SELECT * FROM sig_rr) GROUP BY ALL),
rf AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seq, id) AS nth FROM sc2 WHERE kind = 'file') WHERE nth <= 10),
dr0 AS (SELECT r.query_id, s.id, s.file_id, r.nth, q.mode, lower(coalesce(s.name, '')) AS n, lower(coalesce(s.qualified_name, '')) AS u, q.aliases, count(*) OVER (PARTITION BY r.query_id, s.file_id) AS many FROM rf r JOIN syms s ON s.file_id = r.id JOIN q ON q.query_id = r.query_id),
dr AS (SELECT query_id, id, file_id, nth, mode, len(list_filter(aliases, lambda a: contains(n, a) OR contains(u, a))) > 0 AS alias, nth <= 5 AND many <= 2 AS compact FROM dr0),
cp AS (SELECT * FROM dr WHERE compact AND NOT alias AND NOT EXISTS (SELECT 1 FROM sig1 WHERE sig1.query_id = dr.query_id AND sig1.kind = 'symbol' AND sig1.id = dr.id)),
sig_sym AS (
  SELECT query_id, 'symbol' AS kind, id, 'graph' AS stage, 11 * 10000000000000 + id * 2 AS seq, CASE WHEN mode IN ('docs', 'architecture') THEN 4.0 WHEN mode IN ('refactor', 'bugfix', 'testgen') THEN 6.0 ELSE 5.0 END AS points, 'symbol promoted from ranked file and query alias match' AS reason, false AS firm FROM dr WHERE alias
  UNION ALL SELECT query_id, 'file', file_id, 'graph', 11 * 10000000000000 + id * 2 + 1, CASE WHEN mode IN ('docs', 'architecture') THEN 4.0 ELSE 6.0 END, 'owner file promoted from ranked file symbol match', false FROM dr WHERE alias
  UNION ALL SELECT query_id, 'symbol', id, 'graph', 12 * 10000000000000 + id * 2, CASE WHEN mode IN ('docs', 'architecture') THEN 2.5 WHEN mode IN ('refactor', 'bugfix', 'testgen') THEN 4.0 ELSE 3.0 END, 'symbol promoted from compact ranked file', false FROM cp
  UNION ALL SELECT query_id, 'file', file_id, 'graph', 12 * 10000000000000 + id * 2 + 1, 0.8 * CASE WHEN mode IN ('docs', 'architecture') THEN 4.0 ELSE 6.0 END, 'owner file reinforced from compact ranked file symbol', false FROM cp),
sig AS (SELECT * FROM sig1 UNION ALL SELECT * FROM sig_rr UNION ALL SELECT * FROM sig_sym),
sc AS (SELECT query_id, kind, id, round(sum(points), 6) AS score, min(seq) AS first_seq, coalesce(arg_max(reason, seq) FILTER (firm), arg_min(reason, seq) FILTER (reason IS NOT NULL)) AS reason FROM sig GROUP BY query_id, kind, id),
ranking AS (SELECT * FROM (SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.first_seq, s.kind, s.id) AS rank, s.kind, s.id, s.score, s.reason, q.lim FROM sc s JOIN q USING (query_id)) WHERE rank <= lim * 4),
sl0 AS (SELECT r.*, CASE WHEN f.id IS NULL THEN NULL WHEN f.is_test THEN 1 WHEN f.is_doc THEN 2 WHEN f.is_config THEN 3 ELSE 0 END AS bucket FROM ranking r LEFT JOIN files_now f ON f.id = r.id WHERE r.kind = 'file'),
sl1 AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id, s.bucket ORDER BY s.rank) AS in_bucket FROM sl0 s),
sl2 AS (SELECT s.*, q.q_files, CASE WHEN bucket IS NOT NULL AND in_bucket <= CASE bucket WHEN 0 THEN s_code WHEN 1 THEN s_test WHEN 2 THEN s_doc ELSE s_config END THEN bucket ELSE 4 END AS grp FROM sl1 s JOIN q USING (query_id)),
sl3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grp, rank) AS place FROM sl2),
sl4 AS (SELECT r.*, q.q_symbols, q.q_memories, row_number() OVER (PARTITION BY query_id, kind ORDER BY rank) AS place FROM ranking r JOIN q USING (query_id) WHERE kind IN ('symbol', 'memory')),
selection AS (
  SELECT query_id, kind, id, place, score, reason FROM sl3 WHERE place <= q_files AND bucket IS NOT NULL
  UNION ALL SELECT query_id, kind, id, place, score, reason FROM sl4 WHERE place <= CASE kind WHEN 'symbol' THEN q_symbols ELSE q_memories END AND (kind = 'symbol' AND id IN (SELECT id FROM syms) OR kind = 'memory' AND id IN (SELECT id FROM mems))),
pk0 AS (SELECT * FROM (SELECT s.*, q.lim, q.p_code, q.p_test, q.p_doc, q.p_config, q.p_symbols, q.p_memories, row_number() OVER (PARTITION BY query_id, kind ORDER BY place) AS n FROM selection s JOIN q USING (query_id)) WHERE n <= lim),
pk1 AS (SELECT p.*, unnest(list_filter([CASE WHEN NOT (f.is_test OR f.is_doc OR f.is_config) THEN 0 END, CASE WHEN f.is_test THEN 1 END, CASE WHEN f.is_doc THEN 2 END, CASE WHEN f.is_config THEN 3 END, 4], lambda b: b IS NOT NULL)) AS bucket FROM pk0 p JOIN files_now f ON f.id = p.id WHERE p.kind = 'file'),
pk2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY n) AS nth FROM pk1),
pk3 AS (SELECT query_id, id, min(bucket * 1000 + nth) AS key FROM pk2 WHERE nth <= CASE bucket WHEN 0 THEN p_code WHEN 1 THEN p_test WHEN 2 THEN p_doc WHEN 3 THEN p_config ELSE lim END GROUP BY ALL),
packed AS (
  SELECT * FROM (SELECT query_id, 'file' AS kind, id, row_number() OVER (PARTITION BY query_id ORDER BY key) AS place FROM pk3) WHERE place <= 8
  UNION ALL SELECT query_id, kind, id, n FROM pk0 WHERE kind <> 'file' AND n <= CASE kind WHEN 'symbol' THEN p_symbols ELSE p_memories END),
members AS (SELECT DISTINCT * FROM (SELECT query_id, stage, kind, id FROM sig WHERE stage IS NOT NULL UNION ALL SELECT query_id, 'selected', kind, id FROM selection UNION ALL SELECT query_id, 'packed', kind, id FROM packed) WHERE kind IN ('file', 'symbol', 'memory')),
gold0 AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{w}')" for k, w in GOLD.items())}) g(query_id, word)),
gold AS (
  SELECT g.query_id, 'file' AS kind, f.id FROM gold0 g JOIN q USING (query_id) JOIN files_now f ON f.repo_id = q.repo_id WHERE starts_with(regexp_extract(lower(f.path), '[^/]*$'), g.word)
  UNION ALL SELECT g.query_id, 'symbol', s.id FROM gold0 g JOIN q USING (query_id) JOIN syms s ON s.repo_id = q.repo_id WHERE lower(s.name) = g.word OR ends_with(lower(coalesce(s.qualified_name, '')), g.word)
  UNION ALL SELECT g.query_id, 'memory', m.id FROM gold0 g JOIN q USING (query_id) JOIN mems m ON m.repo_id = q.repo_id WHERE contains(lower(m.title), g.word)),
miss AS (SELECT g.query_id, g.kind, g.id, CASE WHEN bool_or(m.stage = 'packed') THEN 'hit' WHEN bool_or(m.stage = 'selected') THEN 'packed_out' WHEN bool_or(m.stage IS NOT NULL) THEN 'scored_too_low' ELSE 'not_generated' END AS outcome
  FROM gold g LEFT JOIN members m ON m.query_id = g.query_id AND m.kind = g.kind AND m.id = g.id GROUP BY g.query_id, g.kind, g.id)
"""
)


def _joined(c: str):
    return F.array_join(F.array_sort(c), " ").alias(c)


def gold_rows(r: Retrieval):
    """(query_id, kind, id): what the query set should find."""
    word = F.create_map(*(F.lit(x) for kv in GOLD.items() for x in kv))[F.col("query_id").cast("int")]
    g = F.broadcast(r.queries.select("query_id", "repo_id", word.alias("word")))
    base = F.substring_index(F.lower("path"), "/", -1)
    f = r.files.join(g, "repo_id").where(F.startswith(base, F.col("word"))).select("query_id", F.lit("file").alias("kind"), "id")
    # a symbol is named by its name or by the end of its qualified name
    s = r.symbols.join(g, "repo_id").where((F.lower("name") == F.col("word")) | F.endswith(F.lower(F.coalesce("qualified_name", F.lit(""))), F.col("word"))).select("query_id", F.lit("symbol").alias("kind"), "id")
    m = r.memories.join(g, "repo_id").where(F.contains(F.lower("title"), F.col("word"))).select("query_id", F.lit("memory").alias("kind"), "id")
    return f.unionByName(s).unionByName(m)


def outcomes(r: Retrieval):
    """(query_id, kind, id, outcome): hit, packed_out, scored_too_low or not_generated for every gold row."""
    m = r.stage_members.groupBy("query_id", "kind", "id").agg(F.max(F.col("stage") == "packed").alias("p"), F.max(F.col("stage") == "selected").alias("s"))
    how = F.when(F.col("p"), "hit").when(F.col("s"), "packed_out").when(F.col("p").isNotNull(), "scored_too_low").otherwise("not_generated")
    return gold_rows(r).join(m, ["query_id", "kind", "id"], "left").select("query_id", "kind", "id", how.alias("outcome"))


def _rates(r: Retrieval):
    o = outcomes(r).groupBy("query_id", "kind").agg(F.count_if(F.col("outcome") == "hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    return o.groupBy("kind").agg(F.round(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)), 3).alias("hit_rate"), F.round(F.avg(F.col("hits") / F.col("n")), 4).alias("recall"), F.count(F.lit(1)).alias("n_queries"))


def _recall_per_tokens(r: Retrieval):
    """File recall (1 without gold) per thousand packed tokens (0 without any)."""
    recall = outcomes(r).where("kind = 'file'").groupBy("query_id").agg((F.count_if(F.col("outcome") == "hit") / F.count(F.lit(1))).alias("recall"))
    packed = r.files.select("id", "summary").join(F.broadcast(r.packed.where("kind = 'file'")), "id").groupBy("query_id").agg(F.sum(F.ceil(F.length(F.coalesce("summary", F.lit(""))) / 4)).alias("tokens"))
    x = r.queries.select("query_id").join(packed, "query_id", "left").join(recall, "query_id", "left")
    per = F.when(F.coalesce("tokens", F.lit(0)) == 0, 0.0).otherwise(F.coalesce("recall", F.lit(1.0)) / (F.col("tokens") / 1000))
    return x.select("query_id", F.round(per, 4).alias("recall_per_1k"))


def _gold_spans(r: Retrieval):
    """(query_id, file, first, last) of the gold symbols."""
    g = gold_rows(r).where("kind = 'symbol'").select("query_id", "id")
    s = r.symbols.select("id", "file_id", "line_start", "line_end").join(g, "id").join(r.files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id")
    return s.select("query_id", "file", F.col("line_start").alias("first"), F.col("line_end").alias("last")).distinct()


_SNIPPETS = r"""SELECT p.query_id, p.place, f.path AS file, y.qualified_name AS symbol, y.line_start AS low, y.line_end AS high,
 CASE WHEN c.content IS NULL OR y.line_start IS NULL OR y.line_end IS NULL THEN '' ELSE coalesce(array_to_string(list_slice(string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)), y.line_start, y.line_end), chr(10)), '') END AS code
 FROM packed p JOIN syms y ON y.id = p.id JOIN packed pf ON pf.query_id = p.query_id AND pf.kind = 'file' AND pf.id = y.file_id JOIN files_now f ON f.id = y.file_id
 LEFT JOIN (SELECT file_id, max(content) AS content FROM source_files GROUP BY 1) c ON c.file_id = f.id WHERE p.kind = 'symbol' AND p.place <= 6"""
_NODE = "query_id, kind, id"
_STAGES = {
    # name: (Spark stage, SQL of the same rows)
    "lexical_terms": (lambda r: r.queries.select("query_id", F.explode("terms").alias("term")), "SELECT query_id, unnest(terms) AS term FROM q"),
    "rerank_terms": (lambda r: r.queries.select("query_id", F.explode("rterms").alias("term")), "SELECT query_id, unnest(rterms) AS term FROM q"),
    "query_aliases": (lambda r: r.queries.select("query_id", F.explode("aliases").alias("alias")), "SELECT query_id, unnest(aliases) AS alias FROM q"),
    "query_focus": (lambda r: r.queries.select("query_id", *(F.col(c).cast("int").alias(c) for c in ("doc", "config", "test", "history"))), "SELECT query_id, regexp_matches(lower(text), 'doc|runbook|decision|adr|architecture')::INT AS doc, regexp_matches(lower(text), 'config|settings|provider')::INT AS config, regexp_matches(lower(text), 'test|coverage')::INT AS test, regexp_matches(lower(text), 'decision|runbook|incident|architecture|prior')::INT AS history FROM q0"),
    "lexical_files": (lambda r: r.lexical_files.select("query_id", "rank", "id", "score", "path"), "SELECT query_id, rank, id, score::INT AS score, path FROM lf"),
    "lexical_symbols": (lambda r: r.lexical_symbols.select("query_id", "rank", "id", "score"), "SELECT query_id, rank, id, score::INT AS score FROM ls"),
    "lexical_memories": (lambda r: r.lexical_memories.select("query_id", "rank", "id", "score", "status"), "SELECT query_id, rank, id, score::INT AS score, status FROM lm"),
    "search": (
        lambda r: r.lexical_files.select("query_id", F.lit("file").alias("kind"), "id", "rank").unionByName(r.lexical_symbols.select("query_id", F.lit("symbol").alias("kind"), "id", "rank")).unionByName(r.lexical_memories.select("query_id", F.lit("memory").alias("kind"), "id", "rank")),
        "SELECT query_id, 'file' AS kind, id, rank FROM lf UNION ALL SELECT query_id, 'symbol', id, rank FROM ls UNION ALL SELECT query_id, 'memory', id, rank FROM lm",
    ),
    "lexical_signals": (lambda r: r.lexical_signals.select("query_id", "kind", "id", "seq", F.round("points", 6).alias("points"), "reason"), "SELECT query_id, kind, id, seq, round(points, 6)::DOUBLE AS points, reason FROM sig_lex"),
    "expansion_terms": (lambda r: r.expansion.select("query_id", F.explode("candidates").alias("term")), "SELECT query_id, unnest(candidates) AS term FROM x0"),
    "support_files": (lambda r: r.support_files.select("query_id", "id", F.round("points", 6).alias("points"), "reason"), "SELECT query_id, id, round(points, 6)::DOUBLE AS points, reason FROM sf"),
    "support_memories": (lambda r: r.support_memories.select("query_id", "id", F.round("points", 6).alias("points")), "SELECT query_id, id, round(points, 6)::DOUBLE AS points FROM sm"),
    "graph_seeds": (lambda r: r.seeds.select("sid", "source", "nth", "nk", "nid", "hops"), "SELECT sid, source, nth, nk, nid, hops FROM seeds"),
    "graph_traverse": (lambda r: r.graph_hits.select("query_id", "source", "nth", "kind", "id", "hops", "ord", F.array_join("path", ">").alias("path")), "SELECT query_id, source, nth, kind, id, hops, ord, array_to_string(path, '>') AS path FROM gh"),
    "graph_edge_scores": (lambda r: r.graph_hits.select("query_id", "source", "nth", "kind", "id", F.round("points", 6).alias("points")), "SELECT query_id, source, nth, kind, id, round(points, 6)::DOUBLE AS points FROM gh"),
    "owner_promotion": (lambda r: r.promotions.select("query_id", "source", "nth", "ord", "file_id", F.round("points", 6).alias("points"), "reason"), "SELECT query_id, source, nth, ord, file_id, round(points, 6)::DOUBLE AS points, reason FROM promo"),
    "vector_prefix_scan": (lambda r: r.semantic_hits.select("query_id", "nth", "kind", "id", F.round("sim", 6).alias("sim")), "SELECT query_id, nth, kind, id, round(sim, 6) AS sim FROM sem"),
    "support_rerank": (lambda r: r.rerank_signals.select("query_id", "id", F.round("points", 6).alias("points")), "SELECT query_id, id, round(points, 6)::DOUBLE AS points FROM sig_rr"),
    "symbols_from_files": (lambda r: r.drawn_symbols.select("query_id", "id", "nth", F.col("alias").cast("int").alias("alias"), F.col("compact").cast("int").alias("compact")), "SELECT query_id, id, nth, alias::INT AS alias, compact::INT AS compact FROM dr"),
    "symbol_signals": (lambda r: r.symbol_signals.select("query_id", "kind", "id", "seq", F.round("points", 6).alias("points"), "reason"), "SELECT query_id, kind, id, seq, round(points, 6)::DOUBLE AS points, reason FROM sig_sym"),
    "score_aggregation": (lambda r: r.scores(r.signals).select("query_id", "kind", "id", "score"), "SELECT query_id, kind, id, score::DOUBLE AS score FROM sc"),
    "hybrid_rank": (lambda r: r.ranking.select("query_id", "rank", "kind", "id", "score", "reason"), "SELECT query_id, rank, kind, id, score::DOUBLE AS score, reason FROM ranking"),
    "quota_select": (lambda r: r.selection.select("query_id", "kind", "id", "place", "score"), "SELECT query_id, kind, id, place, score::DOUBLE AS score FROM selection"),
    "balanced_pack": (lambda r: r.packed.select("query_id", "kind", "id", "place"), "SELECT query_id, kind, id, place FROM packed"),
    "context_pack": (
        lambda r: r.context.select("query_id", "mode", *(F.when(F.size(k) > 0, F.array_join(F.transform(k, lambda x: F.concat_ws(":", x["place"].cast("string"), x["id"].cast("string"), x["label"], x["type"])), "|")).alias(k) for k in ("files", "symbols", "memories"))),
        """SELECT query_id, mode, (SELECT string_agg(place || ':' || f.id || ':' || path || ':' || language, '|' ORDER BY place) FROM packed p JOIN files_now f ON f.id = p.id WHERE p.kind = 'file' AND p.query_id = q.query_id) AS files,
 (SELECT string_agg(place || ':' || s.id || ':' || coalesce(qualified_name, name) || ':' || symbol_type, '|' ORDER BY place) FROM packed p JOIN syms s ON s.id = p.id WHERE p.kind = 'symbol' AND p.query_id = q.query_id) AS symbols,
 (SELECT string_agg(place || ':' || m.id || ':' || title || ':' || memory_type, '|' ORDER BY place) FROM packed p JOIN mems m ON m.id = p.id WHERE p.kind = 'memory' AND p.query_id = q.query_id) AS memories FROM q""",
    ),
    "trace": (lambda r: r.ranking.where("rank <= 10").select("query_id", "rank", F.concat_ws(":", "kind", F.col("id").cast("string")).alias("node"), F.round("score", 3).alias("score"), F.coalesce("reason", F.lit("selected by hybrid score")).alias("reason")), "SELECT query_id, rank, kind || ':' || id AS node, round(score, 3)::DOUBLE AS score, coalesce(reason, 'selected by hybrid score') AS reason FROM ranking WHERE rank <= 10"),
    "diagnostics": (lambda r: r.stage_members.groupBy("query_id", "stage", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most")), "SELECT query_id, stage, kind, count(*) AS n, min(id) AS least, max(id) AS most FROM members GROUP BY ALL"),
    "log_rank_json": (
        lambda r: r.ranking.where("rank <= 25").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "kind", "id"))), lambda x: F.concat(x["kind"], F.lit(":"), x["id"].cast("string"))), ",").alias("nodes")),
        "SELECT query_id, string_agg(kind || ':' || id, ',' ORDER BY rank) AS nodes FROM ranking WHERE rank <= 25 GROUP BY query_id",
    ),
    "gold_hits": (lambda r: gold_rows(r).join(r.packed.select("query_id", "kind", "id"), ["query_id", "kind", "id"], "left_semi"), "SELECT g.query_id, g.kind, g.id FROM gold g JOIN packed p ON p.query_id = g.query_id AND p.kind = g.kind AND p.id = g.id"),
    "missing_gold": (lambda r: gold_rows(r).join(r.packed.select("query_id", "kind", "id"), ["query_id", "kind", "id"], "left_anti"), f"SELECT {_NODE} FROM gold EXCEPT SELECT {_NODE} FROM packed"),
    "miss_classes": (outcomes, "SELECT query_id, kind, id, outcome FROM miss"),
    "miss_histogram": (
        lambda r: outcomes(r).agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in ("not_generated", "packed_out", "scored_too_low"))),
        "SELECT count(*) FILTER (outcome = 'not_generated') AS not_generated, count(*) FILTER (outcome = 'packed_out') AS packed_out, count(*) FILTER (outcome = 'scored_too_low') AS scored_too_low FROM miss",
    ),
    "hit_rates": (_rates, "SELECT kind, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0 END), 3)::DOUBLE AS hit_rate, round(avg(hits / n), 4)::DOUBLE AS recall, count(*) AS n_queries FROM (SELECT query_id, kind, count(*) FILTER (outcome = 'hit') AS hits, count(*) AS n FROM miss GROUP BY ALL) GROUP BY kind"),
    "artifact_recall": (
        lambda r: r.queries.select("query_id").join(outcomes(r).groupBy("query_id").agg(F.count_if(F.col("outcome") == "hit").alias("hits"), F.count(F.lit(1)).alias("n")), "query_id", "left").select("query_id", F.round(F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).otherwise(F.col("hits") / F.col("n")), 4).alias("recall")),
        "SELECT q.query_id, round(CASE WHEN count(m.id) = 0 THEN 1.0 ELSE count(*) FILTER (outcome = 'hit') / count(m.id) END, 4)::DOUBLE AS recall FROM q LEFT JOIN miss m USING (query_id) GROUP BY q.query_id",
    ),
    "file_precision": (
        lambda r: r.queries.select("query_id").join(r.packed.where("kind = 'file'").join(gold_rows(r).withColumn("gold", F.lit(1)), ["query_id", "kind", "id"], "left").groupBy("query_id").agg(F.count("gold").alias("hits"), F.count(F.lit(1)).alias("n")), "query_id", "left").select("query_id", F.round(F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).otherwise(F.col("hits") / F.col("n")), 4).alias("precision")),
        "SELECT q.query_id, round(CASE WHEN count(p.id) = 0 THEN 0.0 ELSE count(g.id) / count(p.id) END, 4)::DOUBLE AS precision FROM q LEFT JOIN packed p ON p.query_id = q.query_id AND p.kind = 'file' LEFT JOIN gold g ON g.query_id = p.query_id AND g.kind = 'file' AND g.id = p.id GROUP BY q.query_id",
    ),
    "pack_tokens": (
        lambda r: r.files.select("id", "summary").join(F.broadcast(r.packed.where("kind = 'file'")), "id").groupBy("query_id").agg(F.sum(F.size(F.filter(F.split(F.coalesce("summary", F.lit("")), r"\s+"), lambda w: w != ""))).cast("long").alias("words"), F.sum(F.ceil(F.length(F.coalesce("summary", F.lit(""))) / 4)).cast("long").alias("tokens")),
        r"SELECT p.query_id, sum(len(list_filter(regexp_split_to_array(coalesce(summary, ''), '\s+'), lambda w: w <> '')))::BIGINT AS words, sum(ceil(length(coalesce(summary, '')) / 4))::BIGINT AS tokens FROM packed p JOIN files_now f ON f.id = p.id WHERE p.kind = 'file' GROUP BY p.query_id",
    ),
    "recall_per_tokens": (
        lambda r: _recall_per_tokens(r),
        """SELECT query_id, round(CASE WHEN tokens = 0 THEN 0 ELSE coalesce(recall, 1.0) / (tokens / 1000) END, 4)::DOUBLE AS recall_per_1k FROM (SELECT q.query_id, coalesce(sum(ceil(length(coalesce(summary, '')) / 4)), 0) AS tokens FROM q LEFT JOIN packed p ON p.query_id = q.query_id AND p.kind = 'file' LEFT JOIN files_now f ON f.id = p.id GROUP BY 1)
 LEFT JOIN (SELECT query_id, count(*) FILTER (outcome = 'hit') / count(*) AS recall FROM miss WHERE kind = 'file' GROUP BY 1) USING (query_id)""",
    ),
    "pack_payload": (
        lambda r: r.context.select("query_id", F.explode(F.concat("files", "symbols", "memories")).alias("x")).select("query_id", "x.place", "x.id", "x.label", F.coalesce("x.summary", F.lit("-")).alias("summary"), "x.why"),
        """SELECT p.query_id, p.place, p.id, coalesce(f.path, s.qualified_name, s.name, m.title) AS label, coalesce(f.summary, s.summary, m.summary, '-') AS summary, coalesce(l.reason, 'selected by hybrid score') AS why
 FROM packed p JOIN selection l ON l.query_id = p.query_id AND l.kind = p.kind AND l.id = p.id LEFT JOIN files_now f ON p.kind = 'file' AND f.id = p.id LEFT JOIN syms s ON p.kind = 'symbol' AND s.id = p.id LEFT JOIN mems m ON p.kind = 'memory' AND m.id = p.id""",
    ),
    "pack_snippets": (lambda r: r.snippets.select("query_id", "place", "file", "symbol", "low", "high", F.md5("code").alias("digest")), "SELECT query_id, place, file, symbol, low, high, md5(code) AS digest FROM (" + _SNIPPETS + ")"),
    "snippet_recall": (
        lambda r: evaluate.span_recall(_gold_spans(r), r.snippets.select("query_id", "file", "low", "high"), ["query_id"]),
        "SELECT query_id, count(*) AS n_spans, sum(hit)::BIGINT AS n_hit, round(avg(hit), 4)::DOUBLE AS recall FROM (SELECT g.query_id, g.path, g.low, g.high, max((s.file = g.path AND g.low <= s.high AND g.high >= s.low)::INT) AS hit FROM ("
        "SELECT DISTINCT g.query_id, f.path, y.line_start AS low, y.line_end AS high FROM gold g JOIN syms y ON y.id = g.id JOIN files_now f ON f.id = y.file_id WHERE g.kind = 'symbol' AND y.line_start IS NOT NULL AND y.line_end IS NOT NULL) g JOIN (" + _SNIPPETS + ") s ON s.query_id = g.query_id WHERE s.low IS NOT NULL AND s.high IS NOT NULL GROUP BY ALL) GROUP BY 1",
    ),
}

QUERIES = {name: (lambda spark, d, f=f: f(retrieval(spark, d))) for name, (f, _) in _STAGES.items()}
SQL = {name: _CHAIN + sql for name, (_, sql) in _STAGES.items()}
