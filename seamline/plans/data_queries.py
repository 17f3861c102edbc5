"""Queries of the general problems (core), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import node_kind
from ..operators import incremental, orphans
from ..session import table


def _orphans(spark, d):
    t = {n: table(spark, d, n) for n in ("edges", "files", "symbols", "memories", "repos", "node_tombstones")}
    parents = orphans.parent_keys(t["files"], t["symbols"], t["memories"], t["repos"])
    dead = t["node_tombstones"].select(node_kind("node_kind").alias("kind"), F.col("node_id").alias("key"))
    return orphans.orphan_references(orphans.edge_references(t["edges"]), parents, dead)


def p2_found(spark, d):
    return _orphans(spark, d).select("edge_id", "side", "state").distinct()


def p2_report(spark, d):
    return orphans.orphan_report(_orphans(spark, d))


def _pending(spark, d):
    return incremental.pending_files(table(spark, d, "files"), table(spark, d, "index_state"), table(spark, d, "index_runs"))


def p5_found(spark, d):
    return _pending(spark, d).select("file_id")


def p5_report(spark, d):
    return _pending(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p5_found": p5_found, "p5_report": p5_report}

_ORPHANS = """
WITH f AS (SELECT id, min(indexed_at) AS seen FROM files WHERE id IS NOT NULL GROUP BY id),
parents AS (
  SELECT 'file' AS kind, id AS k, seen FROM f
  UNION ALL SELECT 'symbol', s.id, min(f.seen) FROM symbols s LEFT JOIN f ON f.id = s.file_id WHERE s.id IS NOT NULL GROUP BY s.id
  UNION ALL SELECT 'memory', id, min(created_at) FROM memories WHERE id IS NOT NULL GROUP BY id
  UNION ALL SELECT 'repo', id, min(created_at) FROM repos WHERE id IS NOT NULL GROUP BY id),
dead AS (SELECT DISTINCT CASE WHEN lower(trim(node_kind)) = 'doc' THEN 'file' ELSE lower(trim(node_kind)) END AS kind, node_id AS k FROM node_tombstones),
ends AS (
  SELECT id AS edge_id, 'from' AS side, lower(trim(from_node_kind)) AS kind0, from_node_id AS k, created_at FROM edges
  UNION SELECT id, 'to', lower(trim(to_node_kind)), to_node_id, created_at FROM edges),
refs AS (SELECT DISTINCT edge_id, side, CASE WHEN kind0 = 'doc' THEN 'file' ELSE kind0 END AS kind, k, created_at FROM ends
  WHERE k IS NOT NULL AND kind0 IN ('file', 'doc', 'symbol', 'memory', 'repo')),
orphans AS (
  SELECT r.*, CASE WHEN p.k IS NULL AND t.k IS NULL THEN 'missing' WHEN p.k IS NULL THEN 'deleted' WHEN p.seen > r.created_at THEN 'late' END AS state
  FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.k = r.k LEFT JOIN dead t ON t.kind = r.kind AND t.k = r.k)
"""

_PENDING = """
WITH norm AS (SELECT id AS file_id, indexed_at, nullif(regexp_replace(regexp_replace(lower(trim(checksum)), '\\s+', '', 'g'), '^[a-z0-9_-]+[:=]', ''), '') AS now FROM files WHERE id IS NOT NULL),
cur AS (SELECT file_id, now FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC NULLS LAST, now DESC NULLS LAST) AS n FROM norm) WHERE n = 1),
st AS (SELECT file_id, processed_at, run_id, nullif(regexp_replace(regexp_replace(lower(trim(checksum)), '\\s+', '', 'g'), '^[a-z0-9_-]+[:=]', ''), '') AS seen FROM index_state
  WHERE run_id IN (SELECT run_id FROM index_runs WHERE lower(trim(status)) = 'succeeded')),
last AS (SELECT file_id, seen FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY processed_at DESC NULLS LAST, run_id DESC NULLS LAST, seen DESC NULLS LAST) AS n FROM st) WHERE n = 1),
pending AS (SELECT c.file_id, CASE WHEN now IS NULL THEN 'unknown' WHEN l.file_id IS NULL THEN 'new' WHEN now IS DISTINCT FROM seen THEN 'changed' END AS reason
  FROM cur c LEFT JOIN last l ON l.file_id = c.file_id)
"""

SQL = {
    "p2_found": _ORPHANS + "SELECT DISTINCT edge_id, side, state FROM orphans WHERE state IS NOT NULL",
    "p2_report": _ORPHANS + "SELECT kind AS table_kind, state, strftime(created_at, '%Y-%m') AS period, count(*) AS n_refs, count(DISTINCT k) AS n_keys FROM orphans WHERE state IS NOT NULL GROUP BY 1, 2, 3",
    "p5_found": _PENDING + "SELECT file_id FROM pending WHERE reason IS NOT NULL",
    "p5_report": _PENDING + "SELECT reason, count(*) AS n_files FROM pending WHERE reason IS NOT NULL GROUP BY 1",
}
